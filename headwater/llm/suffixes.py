"""Substring dedup by a common-prefix-aware distributed merge sort of suffixes.

A 50-byte string can repeat only where its anchor does: the 20-byte gram with the least hash among its 31. Grams
that one document alone has drop out. The suffixes at the other anchors, with as much of the text before them as
their strings reach, are sorted in each block and sent as front-coded runs (each suffix as the length it shares
with the one before and its remaining bytes). A loser tree merges the runs of a range. It keeps, for each loser,
the prefix that it shares with the winner, so that most games compare two small numbers, and none looks at bytes
that are known to be equal. Equal suffixes and groups with a common anchor come out side by side with their
shared lengths, which tells which strings an earlier document has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import blocks as B
from headwater.llm.common import buffers, ids_of, trimmed
from headwater.llm.cover import mix, word_hashes

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # the most bytes of a string before its anchor
WIDTH = LENGTH + REACH + 1
#: Ends of the part after the anchor, of the part before it, and of the row; no UTF-8 text has these bytes.
AFTER, BEFORE, LAST = 0xFF, 0xFE, 0xFD
PLACE = 30
ALL = (1 << (REACH + 1)) - 1
#: Runs that have a gram beyond which each string around it is sent by its own hash, so that no group is one task's.
HOT_RUNS = 2048
#: Rows of suffixes that are built at once.
ROWS = 1 << 17
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
U = np.uint64
C = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n values on end."""
    width = 1
    while width * 2 <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if n > width else values


def ordered(rows: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each row's place among the distinct ones, by range and bytes; where those are first)."""
    order = np.argsort(rows.reshape(-1).view(f"S{WIDTH}"), kind="stable")
    order = order[np.argsort(q[order], kind="stable")]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(first) - 1
    return place, order[first]


class Suffixes:
    """The anchored suffixes of a block's documents."""

    def __init__(self, table: pa.Table):
        self.block = table["block"][0].as_py()
        self.ids = ids_of(table["doc_id"])
        self.raw_ids = table["doc_id"].combine_chunks()
        self.buf, self.offsets = buffers(table["text"])
        n, sizes = len(self.buf), np.diff(self.offsets)
        ok = np.zeros(n + 1, np.int8)
        long = sizes >= LENGTH
        ok[self.offsets[:-1][long]] += 1
        ok[self.offsets[1:][long] - LENGTH + 1] -= 1
        inside = np.cumsum(ok, dtype=np.int8)[:n]
        parts = [self._anchored(a, inside) for a in range(0, n, B.PIECE_BYTES)]
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
        p, lo, hi, gram = (np.concatenate(x) for x in zip(none, *parts))
        # the strings of an anchor may lie in two pieces; rows are the same wherever pieces begin
        new = np.flatnonzero(np.diff(p, prepend=-1))
        self.p, self.gram = p[new], gram[new]
        self.lo, self.hi = (np.minimum.reduceat(lo, new), np.maximum.reduceat(hi, new)) if len(new) else (lo, hi)
        self.doc = np.searchsorted(self.offsets, self.p, side="right") - 1
        self.distinct, self.at, self.several = B.distinct(self.gram, self.ids[self.doc])

    def _anchored(self, a: int, inside: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors of the strings that start in a piece of the block, the least and most bytes before them, their grams."""
        buf = self.buf[a : a + B.PIECE_BYTES + LENGTH - 1]
        none = np.zeros(0, np.int64)
        if len(buf) < LENGTH:
            return none, none, none, np.zeros(0, U)
        padded = np.concatenate([buf, np.zeros(LENGTH + 8, np.uint8)])
        at = lambda k: np.ndarray((len(buf) - GRAM + 1,), "<u8", padded.data, k, (1,))
        h = at(0) * C[0]
        h += at(8) * C[1]
        h += at(12) * C[2]
        h = mix(h)
        key = (h & U(2**64 - 2**PLACE)) | np.arange(len(h), dtype=U)
        anchor = (least(key, REACH + 1) & U(2**PLACE - 1)).astype(np.int64)
        s = np.flatnonzero(inside[a : a + len(buf)][: len(anchor)])
        if not len(s):
            return none, none, none, np.zeros(0, U)
        own = anchor[s]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        ends = np.append(new[1:], len(s)) - 1
        p = own[new]
        # anchors have small hashes: mixed again, they spread over all ranges
        return p + a, p - s[ends], p - s[new], mix(h[p] * C[1]) >> U(64 - B.BITS)

    def items(self, codes: np.ndarray, ranges: int) -> None:
        """The rows of the repeated anchors; distinct ones ascend by range and bytes."""
        code = codes[self.at] if len(self.at) else np.zeros(0, np.uint8)
        cold, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        count = self.hi[hot] - self.lo[hot] + 1
        each = np.repeat(hot, count)
        back = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + self.lo[each]
        self.ip = np.concatenate([self.p[cold], self.p[each]])
        self.ilo, self.ihi = np.concatenate([self.lo[cold], back]), np.concatenate([self.hi[cold], back])
        self.idoc = np.concatenate([self.doc[cold], self.doc[each]])
        gram = np.concatenate([self.gram[cold], np.zeros(len(each), U)])
        d = self.ids[self.idoc]
        parts = [self._rows(a, gram, len(cold), ranges) for a in range(0, len(d), ROWS)]
        self.place = np.zeros(len(d), np.int64)
        self.rows, self.q, self.least = np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if parts:
            rows, q = (np.concatenate(x) for x in list(zip(*parts))[:2])
            ends = np.cumsum([0, *(len(x[0]) for x in parts)]).tolist()
            place, at = ordered(rows, q)
            self.rows, self.q = rows[at], q[at]
            for a, (_, _, own), e in zip(range(0, len(d), ROWS), parts, ends):
                self.place[a : a + ROWS] = place[e + own]
            self.least = np.full(len(at), 2**63 - 1, np.int64)
            np.minimum.at(self.least, self.place, d)

    def _rows(self, a: int, gram: np.ndarray, cold: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rows of the items from a on, their ranges, and each item's place among them."""
        p, lo, hi = (x[a : a + ROWS] for x in (self.ip, self.ilo, self.ihi))
        key = gram[a : a + ROWS].copy()
        each = np.arange(max(0, cold - a), len(p))  # a string of a hot anchor goes by its own hash
        for k in range(0, len(each), ROWS >> 3):
            start = (p - hi)[each[k : k + (ROWS >> 3)]]
            text = np.lib.stride_tricks.sliding_window_view(self.buf, LENGTH)[start]
            flat = np.ascontiguousarray(text).reshape(-1)
            at = np.arange(0, len(flat), LENGTH)
            key[each[k : k + (ROWS >> 3)]] = word_hashes(flat, at, at + LENGTH, 0) >> U(64 - B.BITS)
        m = np.zeros((len(p), WIDTH), np.uint8)
        low, high = int(p.min()) - REACH, int(p.max()) + LENGTH
        text = np.concatenate([np.zeros(max(0, -low), np.uint8), self.buf[max(0, low) : high], np.zeros(LENGTH, np.uint8)])
        m[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[p - low]
        m[:, LENGTH:-1] = np.lib.stride_tricks.sliding_window_view(text, REACH)[p - low - REACH][:, ::-1]
        col, after = np.arange(LENGTH), (LENGTH - lo)[:, None]
        m[:, :LENGTH][col > after] = 0
        m[:, :LENGTH][col == after] = AFTER
        col, before = np.arange(REACH), hi[:, None]
        m[:, LENGTH:-1][col > before] = 0
        m[:, LENGTH:-1][col == before] = BEFORE
        m[:, -1] = LAST
        q = B.ranges(key, ranges)
        place, at = ordered(m, q)
        return m[at], q[at], place

    def coded(self, a: int, b: int) -> bytes:
        """The rows a to b as a front-coded run."""
        m = self.rows[a:b]
        shared = np.zeros(b - a, np.uint8)
        shared[1:] = (m[1:] == m[:-1]).argmin(axis=1)
        return B.squeeze(shared) + B.squeeze(m[np.arange(WIDTH) >= shared[:, None]]) + B.squeeze(self.least[a:b])


def decoded(shared: list[int], rest: bytes) -> Iterator[tuple[int, int]]:
    """(row as a number, length shared with the row before) of a front-coded run."""
    value = at = 0
    for h in shared:
        n = WIDTH - h
        value = (value >> 8 * n << 8 * n) | int.from_bytes(rest[at : at + n], "big")
        at += n
        yield value, h


def merged(runs: list[Iterator[tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
    """(row, length shared with the row before, run) of all runs in order, by a loser tree.

    lcp[r] is what run r's head shares with the last row given out (of a loser: with the winner of its game), -1 at
    a run's end. The head with the longer shared prefix is the smaller one. Only heads that share equally much are
    compared, beyond what they share.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    head, lcp = [0] * size, [-1] * size
    for r, run in enumerate(runs):
        head[r], lcp[r] = next(run, (0, -1))
    tree, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if lcp[a] == lcp[b] == 0:
            if head[b] < head[a]:
                a, b = b, a
            lcp[b] = WIDTH - ((head[a] ^ head[b]).bit_length() + 7) // 8
        elif lcp[a] < lcp[b]:
            a, b = b, a
        tree[node], winners[node] = b, a
    w = winners[1]
    while (h := lcp[w]) >= 0:
        yield head[w], h, w
        value, h = next(runs[w], (0, -1))
        head[w] = value
        lcp[w] = h
        node = (w + size) >> 1
        while node:
            loser = tree[node]
            known = lcp[loser]
            if known > h:
                tree[node], w, h = w, loser, known
            elif known == h >= 0:
                other, mine = head[loser], head[w]
                common = WIDTH - ((other ^ mine).bit_length() + 7) // 8
                if other < mine:
                    lcp[w] = common
                    tree[node], w = w, loser
                else:
                    lcp[loser] = common
            node >>= 1


def strings(row: int) -> list[tuple[int, bytes]]:
    """(bytes before the anchor, string) of each 50-byte string of a row."""
    raw = row.to_bytes(WIDTH, "big")
    after, before = raw[:LENGTH], raw[LENGTH:-1]
    n = after.find(AFTER)
    after = after if n < 0 else after[:n]
    n = before.find(BEFORE)
    before = before if n < 0 else before[:n]
    text, most = before[::-1] + after, len(before)
    return [(back, text[most - back : most - back + LENGTH]) for back in range(LENGTH - len(after), most + 1)]


@trimmed
def earlier(table: pa.Table) -> pa.Table:
    """For a range: of each row of each run, which of its strings have a smaller id somewhere than in the run."""
    runs, docs, masks = [], [], []
    for x in table["run"]:
        raw = x.as_py()
        shared, at = B.unsqueeze(raw, 0, "u1")
        rest, at = B.unsqueeze(raw, at, "u1")
        runs.append(decoded(shared.tolist(), rest.tobytes()))
        docs.append(iter(B.unsqueeze(raw, at, "<i8")[0].tolist()))
        masks.append([])

    def settle(group: list[tuple[int, list]]) -> None:
        """group: rows with one anchor's gram, each with the (id, run, place) of its copies."""
        if len(group) == 1:
            who = group[0][1]
            if len(who) > 1:
                least = min(who)[0]
                for d, r, k in who:
                    if d > least:
                        masks[r][k] = ALL
            return
        found: dict[bytes, int] = {}
        parts = []
        for row, who in group:
            least = min(who)[0]
            parts.append(own := strings(row))
            for _, s in own:
                if (now := found.get(s)) is None or least < now:
                    found[s] = least
        for (_, who), own in zip(group, parts):
            ids = [(back, found[s]) for back, s in own]
            for d, r, k in who:
                masks[r][k] = sum(1 << back for back, least in ids if least < d)

    group: list[tuple[int, list]] = []
    for row, h, r in merged(runs):
        mine = (next(docs[r]), r, len(masks[r]))
        masks[r].append(0)
        if h == WIDTH:
            group[-1][1].append(mine)
            continue
        if h < GRAM and group:
            settle(group)
            group = []
        group.append((row, [mine]))
    if group:
        settle(group)
    return B.answer(table, [B.squeeze(np.array(m, "<u4")) for m in masks])


def counted(hot_runs: int):
    """For a range: of each gram of each run, 0 if one document has it, 1 if several do, 2 if over hot_runs runs do."""

    @trimmed
    def run(table: pa.Table) -> pa.Table:
        first = B.repeated(table)
        hashes = [B.unplanes(x.as_py())[0] for x in table["run"]]
        order = np.argsort(h := np.concatenate(hashes), kind="stable")
        new = np.flatnonzero(np.diff(h[order], prepend=~h[order][:1]))
        sizes = np.diff(np.append(new, len(h)))
        many = np.empty(len(h), bool)
        many[order] = np.repeat(sizes > hot_runs, sizes)
        out, a = [], 0
        for bits, own in zip(first["bits"], hashes):
            flags = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8, offset=4), count=len(own))
            out.append(B.squeeze(flags + (many[a : a + len(own)] & (flags > 0))))
            a += len(own)
        return B.answer(table, out)

    return run


def anchors(ranges: int):
    @trimmed
    def run(table: pa.Table) -> pa.Table:
        s = Suffixes(table)
        return B.hash_runs(s.block, s.distinct, s.several, ranges)

    return run


def candidates(ranges: int):
    @trimmed
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return B.cut(0, np.zeros(0, np.int64), None)
        s = Suffixes(docs)
        s.items(B.joined_bits(answers, "|u1"), ranges)
        return B.cut(s.block, s.q, s.coded)

    return run


def removal(ranges: int, with_bytes: bool):
    @trimmed
    def run(docs: pa.Table, both: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.string(), pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        s = Suffixes(docs)
        step = np.array(both["step"])
        s.items(B.joined_bits(both.filter(pa.array(step == 1)), "|u1"), ranges)
        mask = B.joined_bits(both.filter(pa.array(step == 2)), "<u4")[s.place]
        mask = np.where(s.ids[s.idoc] > s.least[s.place], np.uint32(ALL), mask)
        cover = np.zeros(len(s.buf) + LENGTH + 1, np.int32)
        for back in range(REACH + 1):
            hit = np.flatnonzero((s.ilo <= back) & (back <= s.ihi) & ((mask >> np.uint32(back)) & 1).astype(bool))
            at = s.ip[hit] - back
            cover[at] += 1
            cover[at + LENGTH] -= 1
        gone = np.cumsum(cover)[: len(s.buf)] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = s.offsets[:-1][np.diff(s.offsets) > 0]
        begins[inner] = gone[inner]
        total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
        kept = s.buf[~gone].tobytes()
        at = (s.offsets - total[s.offsets]).tolist()
        parts = [kept[a:b] for a, b in zip(at, at[1:])]
        return pa.table({
            "doc_id": s.raw_ids,
            "n_bytes": pa.array(np.diff(s.offsets), pa.int64()),
            "n_removed": pa.array(np.diff(total[s.offsets]), pa.int64()),
            "n_spans": pa.array(np.diff(spans[s.offsets]), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()),
            "kept": pa.array(parts if with_bytes else [None] * len(parts), pa.binary()),
        })

    return run


def remove_repeats(docs: DataFrame, with_bytes: bool = True, hot_runs: int = HOT_RUNS, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Drops each byte of a 50-byte string that also starts in a document with a smaller doc_id.

    docs: doc_id, text (more columns are ignored). Returns one row per input row: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 and kept, the bytes that stay (null unless with_bytes). Strings may
    start inside a character. A null or empty text has no bytes; texts of under 50 bytes keep all. A null doc_id
    counts as the smallest. Rows with one doc_id don't remove from each other, so repeated rows get equal results.
    A text of any length is one block's, and is hashed in pieces. block_bytes bounds blocks, not the result.
    """
    parts, n = B.in_blocks(docs, block_bytes)
    by_block = parts.groupBy("block")
    first = by_block.applyInArrow(anchors(n), B.RUN).groupBy("q").applyInArrow(counted(hot_runs), B.ANSWER)
    runs = by_block.cogroup(first.groupBy("block")).applyInArrow(candidates(n), B.RUN)
    second = runs.groupBy("q").applyInArrow(earlier, B.ANSWER)
    both = first.withColumn("step", F.lit(1)).unionAll(second.withColumn("step", F.lit(2)))
    return by_block.cogroup(both.groupBy("block")).applyInArrow(removal(n, with_bytes), OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_bytes=False).drop("kept")
