"""Substring dedup by difference-cover anchors: word windows that an earlier document has go.

Grams of 7 words are hashed only where a word's place modulo 7 is in the cover {0, 1, 3}. Every residue is a
difference of two members, so any two equal stretches of 13 words, wherever they start, share a gram that both
documents have hashed. Grams of one document alone drop out; what is left is extended to whole windows, which
are told apart by 112-bit fingerprints and by the smallest id that has them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import blocks as B
from headwater.llm.common import buffers, ids_of, trimmed

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
GRAM = WINDOW - PERIOD + 1
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"

U = np.uint64
_RNG = np.random.default_rng(20_240_601)
TABLES = [_RNG.integers(0, 2**64, 256, dtype=U) for _ in range(2)]
BASES = [U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0x9FB21C651E98DF25)
    h ^= h >> U(32)
    return h


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """64 bits of each word, from prefix sums of a polynomial over its bytes."""
    room = 1 << max(16, int(len(buf)).bit_length())
    base = int(BASES[which])
    up, down = powers(base, room), powers(pow(base, -1, 2**64), room)
    sums = np.empty(len(buf) + 1, U)
    sums[0] = 0
    np.cumsum(TABLES[which][buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def grams(h: np.ndarray, n: int, which: int) -> np.ndarray:
    """A hash of each n words on end."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for j in range(n):
        out *= BASES[which]
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """word_hashes by pieces of the buffer; words ascend."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + B.PIECE_BYTES, side="right")))
        x, y = int(starts[a]), int(ends[b - 1])
        out[a:b] = word_hashes(buf[x:y], starts[a:b] - x, ends[a:b] - x, which)
        a = b
    return out


class Words:
    """The words of a block's documents and their windows; documents ascend by id."""

    def __init__(self, table: pa.Table):
        self.block = table["block"][0].as_py()
        self.ids = ids_of(table["doc_id"])
        self.raw_ids = table["doc_id"].combine_chunks()
        data, offsets = buffers(table["text"])
        raw, at = data.tobytes(), offsets.tolist()
        self.texts = [raw[a:b] for a, b in zip(at, at[1:])]
        joined = np.frombuffer(b" ".join(self.texts) + b" ", np.uint8)
        white = (joined == 32) | ((joined >= 9) & (joined <= 13))
        edge = np.flatnonzero(np.diff(white.view(np.int8), prepend=1))
        starts, ends = edge[0::2], edge[1::2]
        begins = offsets[:-1] + np.arange(len(self.ids))
        self.of = np.searchsorted(begins, starts, side="right") - 1
        self.counts = np.bincount(self.of, minlength=len(self.ids))
        self.firsts = np.cumsum(self.counts) - self.counts
        n = len(starts)
        place = np.arange(n) - self.firsts[self.of]
        left = self.counts[self.of] - place
        self.h = hashed(joined, starts, ends, 0)
        self.anchors = np.flatnonzero((left >= GRAM) & np.isin(place % PERIOD, COVER))
        self.valid = left >= WINDOW
        self.anchor_hash = grams(self.h, GRAM, 0)[self.anchors] >> U(64 - B.BITS)
        self.distinct, self.at, self.several = B.distinct(self.anchor_hash, self.ids[self.of[self.anchors]])
        self.second = lambda: hashed(joined, starts, ends, 1)

    def windows(self, bits: np.ndarray) -> None:
        """The windows that hold a repeated anchor; distinct ones ascend by fingerprint."""
        n = len(self.h)
        hit = np.zeros(n + 1, np.int32)
        hit[self.anchors[bits[self.at]] + 1] = 1
        hit = np.cumsum(hit)
        upto = np.minimum(np.arange(n) + PERIOD, n)
        self.cand = np.flatnonzero(self.valid & (hit[upto] > hit[np.arange(n)]))
        hi = grams(self.h, WINDOW, 0)[self.cand]
        lo = grams(self.second(), WINDOW, 1)[self.cand] & U(2**48 - 1) if len(self.cand) else hi
        order = np.lexsort((lo, hi))
        h, low, d = hi[order], lo[order], self.ids[self.of[self.cand[order]]]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(first)
        self.place = np.empty(len(h), np.int64)
        self.place[order] = np.cumsum(first) - 1
        self.hi, self.lo = h[at], low[at]
        self.least = np.minimum.reduceat(d, at) if len(at) else np.zeros(0, np.int64)


def anchors(ranges: int):
    @trimmed
    def run(table: pa.Table) -> pa.Table:
        w = Words(table)
        return B.hash_runs(w.block, w.distinct, w.several, ranges)

    return run


def candidates(ranges: int):
    @trimmed
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return B.cut(0, np.zeros(0, np.int64), None)
        w = Words(docs)
        w.windows(B.joined_bits(answers))
        low = [np.ascontiguousarray(w.lo.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])]
        pack = lambda a, b: B.planes(w.hi[a:b]) + low[0][a:b].tobytes() + B.squeeze(w.least[a:b])
        return B.cut(w.block, B.ranges(w.hi >> U(64 - B.BITS), ranges), pack)

    return run


@trimmed
def earlier(table: pa.Table) -> pa.Table:
    """For a range: of each window of each run, whether a document outside has it and a smaller id than all of the run's."""
    his, los, docs = [], [], []
    for x in table["run"]:
        raw = x.as_py()
        hi, at = B.unplanes(raw)
        lo = np.zeros((len(hi), 8), np.uint8)
        lo[:, :6] = np.frombuffer(raw, np.uint8, 6 * len(hi), at).reshape(-1, 6)
        his.append(hi)
        los.append(lo.reshape(-1).view("<u8"))
        docs.append(B.unsqueeze(raw, at + 6 * len(hi), "<i8")[0])
    hi, lo, doc = np.concatenate(his), np.concatenate(los), np.concatenate(docs)
    order = np.lexsort((lo, hi))
    h, low, d = hi[order], lo[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(first)
    flags = np.empty(len(h), bool)
    flags[order] = np.minimum.reduceat(d, at)[np.cumsum(first) - 1] < d
    ends = np.cumsum([len(x) for x in his])
    return B.answer(table, [B.packed(flags[e - len(x) : e]) for x, e in zip(his, ends.tolist())])


def removal(with_text: bool):
    @trimmed
    def run(docs: pa.Table, both: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        w = Words(docs)
        step = np.array(both["step"])
        w.windows(B.joined_bits(both.filter(pa.array(step == 1))))
        bits = B.joined_bits(both.filter(pa.array(step == 2)))
        gone = bits[w.place] | (w.ids[w.of[w.cand]] > w.least[w.place])
        cover = np.zeros(len(w.h) + WINDOW + 1, np.int32)
        cover[w.cand[gone]] += 1
        cover[w.cand[gone] + WINDOW] -= 1
        keep = np.cumsum(cover)[: len(w.h)] == 0
        kept = np.concatenate([[0], np.cumsum(keep)])
        flags, sha, out = keep.tolist(), [], []
        for text, a, n in zip(w.texts, w.firsts.tolist(), w.counts.tolist()):
            s = b" ".join(compress(text.split(), flags[a : a + n]))
            sha.append(hashlib.sha256(s).hexdigest())
            out.append(s.decode() if with_text else None)
        ends = w.firsts + w.counts
        return pa.table({
            "doc_id": w.raw_ids,
            "n_words": pa.array(w.counts, pa.int64()),
            "n_removed": pa.array(w.counts - (kept[ends] - kept[w.firsts]), pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()),
            "kept": pa.array(out, pa.string()),
        })

    return run


def remove_repeats(docs: DataFrame, with_text: bool = True, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Drops each word of a 13-word window that also starts in a document with a smaller doc_id.

    docs: doc_id, text (more columns are ignored). Returns one row per input row: doc_id, n_words, n_removed,
    kept_sha256 and kept, the words that stay, joined by one space (null unless with_text). Words are runs of
    other bytes than ASCII white space. A null or empty text has no words; texts of under 13 words keep all.
    A null doc_id counts as the smallest. Rows with one doc_id don't remove from each other, so repeated rows
    get equal results. A text of any length is one block's, and is hashed in pieces. block_bytes bounds blocks, not
    the result.
    """
    parts, n = B.in_blocks(docs, block_bytes)
    by_block = parts.groupBy("block")
    runs = by_block.applyInArrow(anchors(n), B.RUN)
    first = runs.groupBy("q").applyInArrow(B.repeated, B.ANSWER)
    windows = by_block.cogroup(first.groupBy("block")).applyInArrow(candidates(n), B.RUN)
    second = windows.groupBy("q").applyInArrow(earlier, B.ANSWER)
    both = first.withColumn("step", F.lit(1)).unionAll(second.withColumn("step", F.lit(2)))
    return by_block.cogroup(both.groupBy("block")).applyInArrow(removal(with_text), OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS r(i)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT k, min(doc_id) AS least FROM win GROUP BY k) USING (k) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(13) AS r(j)),
word AS (SELECT doc_id, p, ws[p] AS x FROM w, unnest(range(1, len(ws) + 1)) AS r(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
