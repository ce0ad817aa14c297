"""Secret scans: patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of letters, digits, + / _ . - and of bytes above ASCII. The field tags each as a secret's begin (B),
inside (I) or outside (O) from its shape, its neighbours and two features of the whole file. It is trained on made-up
lines (TRAIN_LINES of them, seeded), by maximum likelihood, on the driver; its weights are a few hundred numbers.
Unary scores of all tokens come from table look-ups. Where O leads by more than any transitions can make up for, the
best path has O; Viterbi decodes what lies between such tokens, so the tags are those of the whole sequence.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from headwater.llm.common import buffers, sliced
from headwater.llm.cover import word_hashes

# The patterns of the contract, and words that often stand before a secret.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
KEYWORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "key", "bearer", "auth", "credential", "credentials", "passphrase"]
KINDS = ("assign", "access", "hex", "crf")

O, B, I = 0, 1, 2  # noqa: E741
TRAIN_LINES, SEED = 1500, 7
PIECE_BYTES = 1 << 19
U = np.uint64

_CLASS = np.zeros(256, np.uint8)  # bits: 1 token byte, 2 digit, 4 upper, 8 lower, 16 hex digit, 32 above ASCII, 64 + / _ . -
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        (_b >= 128 or (_c.isascii() and _c.isalnum()) or _c in "+/_.-")
        | 2 * (48 <= _b <= 57)
        | 4 * (65 <= _b <= 90)
        | 8 * (97 <= _b <= 122)
        | 16 * (48 <= _b <= 57 or 97 <= _b <= 102 or 65 <= _b <= 70)
        | 32 * (_b >= 128)
        | 64 * (_c in "+/_.-")
    )

FEATURES = (
    "bias length_1_7 length_8_15 length_16_19 length_20_31 length_32_39 length_40_up digits_only letters_only lower_only digit_and_letter upper_and_lower "
    "upper_and_digit_only all_hex few_turns some_turns many_turns above_ascii has_symbol many_symbols after_keyword two_after_keyword "
    "after_assignment after_quote before_quote is_keyword joined_to_last last_has_digit next_has_digit file_has_assignments file_has_numbers first_in_file"
).split()


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document, features as bits) of the tokens of the concatenated documents."""
    kind = _CLASS[buf]
    inside = (kind & 1).astype(bool)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    doc_starts = offsets[:-1][np.diff(offsets) > 0]
    begin[doc_starts] = inside[doc_starts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = doc_starts[1:] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    n = len(starts)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    if not n:
        return starts, ends, doc, np.zeros(0, np.uint32)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return sums[ends] - sums[starts]

    size = ends - starts
    digit, upper, lower = (count((kind & bit) > 0) for bit in (2, 4, 8))
    hexes, high, symbol = (count((kind & bit) > 0) for bit in (16, 32, 64))
    is_digit = (kind & 2) > 0
    turn = np.zeros(len(buf), bool)
    turn[1:] = (is_digit[1:] != is_digit[:-1]) & inside[1:] & inside[:-1]
    turns = count(turn) - turn[starts]
    small = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    known = np.zeros(n, bool)
    near = np.flatnonzero((size >= 3) & (size <= 12) & (digit == 0))
    known[near] = np.isin(word_hashes(small, starts[near], ends[near], 0), keyword_hashes())
    same1, same2 = np.zeros(n, bool), np.zeros(n, bool)
    same1[1:] = doc[1:] == doc[:-1]
    same2[2:] = doc[2:] == doc[:-2]
    gap_start = np.where(same1, np.concatenate([[0], ends[:-1]]), np.maximum(offsets[doc], starts - 8))
    gap = starts - gap_start

    def between(byte: bytes) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(np.isin(buf, np.frombuffer(byte, np.uint8)), dtype=np.int32)])
        return (sums[starts] - sums[gap_start]) > 0

    assigned = between(b":=") & (gap <= 6)
    nxt = np.where(ends < offsets[doc + 1], np.concatenate([buf, [32]])[ends], 32)
    prev = np.where(starts > offsets[doc], buf[np.maximum(starts - 1, 0)], 32)
    shift = lambda x, s, ok: np.concatenate([np.zeros(s, bool), x[:-s]])[:n] & ok if n > s else np.zeros(n, bool)
    has_digit = digit > 0
    next_digit = np.concatenate([has_digit[1:] & same1[1:], [False]])
    per_doc = np.bincount(doc, minlength=len(offsets) - 1)
    share = lambda x: (np.bincount(doc, weights=x, minlength=len(offsets) - 1) / np.maximum(per_doc, 1))[doc]
    letters = upper + lower + high
    bits = [
        np.ones(n, bool), size < 8, (size >= 8) & (size < 16), (size >= 16) & (size < 20), (size >= 20) & (size < 32), (size >= 32) & (size < 40), size >= 40,
        (digit > 0) & (letters == 0), (letters > 0) & (digit == 0), lower + high + symbol == size, (digit > 0) & (letters > 0), (upper > 0) & (lower > 0),
        (upper > 0) & (digit > 0) & (lower == 0), (hexes == size) & has_digit, turns == 0, (turns > 0) & (turns < 4), turns >= 4, high > 0, symbol > 0, symbol > 2,
        shift(known, 1, same1), shift(known, 2, same2), assigned, (prev == 34) | (prev == 39), (nxt == 34) | (nxt == 39), known, same1 & (gap == 1) & np.isin(prev, (58, 61)),
        shift(has_digit, 1, same1), next_digit, share(assigned) > 0.1, share(has_digit) > 0.1, ~same1,
    ]
    out = np.zeros(n, np.uint32)
    for k, b in enumerate(bits):
        out |= b.astype(np.uint32) << np.uint32(k)
    return starts, ends, doc, out


@lru_cache(1)
def keyword_hashes() -> np.ndarray:
    raw = np.frombuffer("".join(KEYWORDS).encode(), np.uint8)
    ends = np.cumsum([len(k) for k in KEYWORDS])
    return np.concatenate([word_hashes(raw[e - len(k) : e], np.array([0]), np.array([len(k)]), 0) for k, e in zip(KEYWORDS, ends.tolist())])


def lines(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up lines and the spans of their secrets."""
    r = random.Random(seed)
    alnum = string.ascii_letters + string.digits
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "ing", "tion", "eau", "que", "sch", "ich", "ción", "mente", "ß", "é", "ñ", "ou"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.choice([1, 1, 2, 2, 3, 3, 4, 5, 8]))).capitalize() if r.random() < 0.15 else "".join(r.choice(parts) for _ in range(r.randint(1, 5)))
    secret = lambda: r.choice([
        lambda: pick("0123456789abcdef", r.choice([32, 40, 64])), lambda: pick("0123456789ABCDEF", r.choice([32, 40])), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, r.randint(24, 48)), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24),
        lambda: pick(alnum + "+/", r.randint(24, 64)), lambda: pick(alnum, r.randint(20, 40)), lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum, 30) + "." + pick(alnum + "_-", 27),
    ])()
    short = lambda: pick(alnum, r.randint(8, 19)) if r.random() < 0.7 else word() + pick(string.digits, 3) + pick(alnum, 4)
    plain = lambda: r.choice([
        lambda: f"{word()}.{pick(string.digits, 2)}@mail{r.randint(1, 9)}.example.com", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: f"({pick(string.digits, 3)}) 555-{pick(string.digits, 4)}",
        lambda: pick(string.digits, r.choice([13, 16, 19])), lambda: f"20{pick('012', 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"https://www.{word()}.example.org/{word()}/{pick(string.digits, 3)}",
        lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: word() + r.choice(["***", "###", "$$$", "&&&", "%%%"]), lambda: word() + word().capitalize() + word().capitalize(), lambda: f"{word()}: {word()}", lambda: f"{word()} = {word()}",
        lambda: pick(string.digits, r.randint(1, 6)), lambda: r.choice(KEYWORDS), lambda: f"the {r.choice(KEYWORDS)} {word()}", lambda: f"{r.choice(KEYWORDS)}: {word()}", lambda: f"{word()}_{word()}_{word()}", lambda: f"/{word()}/{word()}/{word()}.{word()}",
        lambda: word().upper(), lambda: "".join(word() for _ in range(6)), lambda: f"{word()}-{word()}-{pick(string.digits, 2)}", lambda: "IBAN DE" + pick(string.digits, 20), lambda: f"{pick('0123456789abcdef', 7)}", lambda: f"{pick(string.digits, 3)}-{pick(string.digits, 2)}-{pick(string.digits, 4)}",
    ])()
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(6, 22)):
            if text:
                text += r.choice([" "] * 9 + ["\n"])
            roll = r.random()
            if roll < 0.07:
                quote, sign = r.choice(["", '"', "'"]), r.choice([" = ", "=", ": ", ":"])
                text += r.choice(KEYWORDS) + sign + quote
                s = secret() if r.random() < 0.7 else short()
                if r.random() < 0.15:
                    s += r.choice([":", "="]) + secret()
                spans.append((len(text), len(text) + len(s)))
                text += s + quote
            elif roll < 0.11:
                s = secret()
                spans.append((len(text), len(text) + len(s)))
                text += s
            elif roll < 0.32:
                text += plain()
            else:
                text += word() + r.choice(["", "", "", ",", "."])
        out.append((text, spans))
    return out


def tagged(sample: list[tuple[str, list[tuple[int, int]]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features as bits, tags) of each line."""
    raw = [t.encode() for t, _ in sample]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    starts, ends, doc, bits = tokens(np.frombuffer(b"".join(raw), np.uint8), offsets)
    out = []
    for i, (text, spans) in enumerate(sample):
        own = np.flatnonzero(doc == i)
        tags = np.zeros(len(own), np.int64)
        for a, b in spans:
            a, b = (len(text[:x].encode()) + offsets[i] for x in (a, b))
            hit = np.flatnonzero((starts[own] >= a) & (ends[own] <= b))
            tags[hit], tags[hit[:1]] = I, B
        out.append((bits[own], tags))
    return out


def expand(bits: np.ndarray) -> np.ndarray:
    return ((bits[..., None] >> np.arange(len(FEATURES), dtype=np.uint32)) & 1).astype(np.float64)


def train(sample: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, l2: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(weights by feature and tag, transitions) of the greatest penalised likelihood, by adaptive gradient steps."""
    n, t = len(sample), max(len(x) for x, _ in sample)
    x, y, on = np.zeros((n, t, len(FEATURES))), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (bits, tags) in enumerate(sample):
        x[i, : len(bits)], y[i, : len(bits)], on[i, : len(bits)] = expand(bits), tags, True
    hot = np.eye(3)[y] * on[..., None]
    pairs = on[:, 1:] & on[:, :-1]
    seen_w = np.einsum("ntf,ntk->fk", x, hot)
    seen_a = np.einsum("nti,ntj->ij", hot[:, :-1] * pairs[..., None], hot[:, 1:])
    w, a = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    gw, ga = np.full_like(w, 1e-8), np.full_like(a, 1e-8)
    for _ in range(steps):
        s = x @ w
        e = np.exp(a)
        alpha, beta, scale = np.zeros((n, t, 3)), np.ones((n, t, 3)), np.ones((n, t))
        u = np.exp(s - s.max(axis=2, keepdims=True))
        for k in range(t):
            now = u[:, k] if k == 0 else (alpha[:, k - 1] @ e) * u[:, k]
            scale[:, k] = np.where(on[:, k], now.sum(axis=1), 1)
            alpha[:, k] = now / scale[:, k, None]
        for k in range(t - 2, -1, -1):
            back = (beta[:, k + 1] * u[:, k + 1]) @ e.T / scale[:, k + 1, None]
            beta[:, k] = np.where(on[:, k + 1, None], back, 1)
        p = alpha * beta * on[..., None]
        p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
        pair = alpha[:, :-1, :, None] * e * (u[:, 1:] * beta[:, 1:])[:, :, None, :] * pairs[..., None, None]
        pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)
        dw = seen_w - np.einsum("ntf,ntk->fk", x, p) - l2 * w
        da = seen_a - pair.sum(axis=(0, 1)) - l2 * a
        gw, ga = gw + dw**2, ga + da**2
        w += 0.6 * dw / np.sqrt(gw)
        a += 0.6 * da / np.sqrt(ga)
    return w, a


class Tagger:
    def __init__(self, w: np.ndarray, a: np.ndarray):
        self.a = a
        half = expand(np.arange(1 << 16, dtype=np.uint32))[:, :16]
        self.low, self.high = half @ w[:16], half @ w[16:]
        #: The most that B or I can gain over O by the transitions around it.
        self.swing = max(max(0.0, a[p, k] - a[p, O]) + max(0.0, a[k, q] - a[O, q]) for p in range(3) for q in range(3) for k in (B, I))

    def tags(self, bits: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, tags) of the tokens that aren't O for sure; all others are O."""
        score = self.low[bits & np.uint32(0xFFFF)] + self.high[bits >> np.uint32(16)]
        open_ = np.flatnonzero(score[:, O] - np.maximum(score[:, B], score[:, I]) <= self.swing)
        out = np.zeros(len(open_), np.int64)
        if not len(open_):
            return open_, out
        a = self.a.tolist()
        new = np.flatnonzero((np.diff(open_, prepend=-9) > 1) | (np.diff(doc[open_], prepend=-1) != 0))
        for i, j in zip(new.tolist(), [*new[1:].tolist(), len(open_)]):
            first, last = open_[i], open_[j - 1]
            before = first > 0 and doc[first - 1] == doc[first]
            after = last + 1 < len(doc) and doc[last + 1] == doc[last]
            best, back = None, []
            for s in score[open_[i:j]].tolist():
                if best is None:
                    best = [s[k] + (a[O][k] if before else 0.0) for k in range(3)]
                    continue
                step = [max(range(3), key=lambda p, k=k: best[p] + a[p][k]) for k in range(3)]
                best = [best[step[k]] + a[step[k]][k] + s[k] for k in range(3)]
                back.append(step)
            k = max(range(3), key=lambda k: best[k] + (a[k][O] if after else 0.0))
            path = [k]
            for step in reversed(back):
                path.append(k := step[k])
            out[i:j] = path[::-1]
        return open_, out

    def spans(self, buf: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
        """Byte spans of the secrets of each document."""
        found: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
        starts, ends, doc, bits = tokens(buf, offsets)
        where, tags = self.tags(bits, doc)
        last = -9
        for p, tag in zip(where.tolist(), tags.tolist()):
            if tag != O:
                base = int(offsets[doc[p]])
                mine = found[doc[p]]
                if tag == I and last == p - 1 and mine:
                    mine[-1] = (mine[-1][0], int(ends[p]) - base)
                else:
                    mine.append((int(starts[p]) - base, int(ends[p]) - base))
                last = p
        return found


@lru_cache(1)
def tagger() -> Tagger:
    return Tagger(*train(tagged(lines(TRAIN_LINES, SEED))))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans by code points instead of bytes."""
    if not spans:
        return []
    raw = np.frombuffer(text, np.uint8)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(at[a]), k, int(at[b])) for a, k, b in spans]


def batch_spans(column: pa.Array, model: Tagger) -> Iterator[tuple[bytes, list, list]]:
    """(text, base spans, added spans) of each document; the field reads some PIECE_BYTES of whole texts at a time."""
    data, offsets = buffers(column)
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE_BYTES, side="right")) - 1)
        part = data[offsets[a] : offsets[b]]
        found = model.spans(part, offsets[a : b + 1] - offsets[a])
        raw = part.tobytes()
        for i in range(a, b):
            text = raw[offsets[i] - offsets[a] : offsets[i + 1] - offsets[a]]
            base = sorted(base_spans(text))
            more = [(x, 3, y) for x, y in found[i - a] if not any(s <= x and y <= e for s, _, e in base)]
            yield text, base, more
        a = b


def scan(docs: DataFrame) -> DataFrame:
    """The secrets of each document: one row per row of docs.

    docs: doc_id, text (more columns are ignored). Returns doc_id and spans, an array of kind (assign, access, hex:
    the patterns'; crf: the field's, unless it lies in one of those), start and end in code points, end exclusive,
    by start and kind. A null or empty text has none. A repeated row gets its own equal row.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in code_points(t, sorted(base + more))] for t, base, more in batch_spans(batch["text"], model.value)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, kind)], names=["doc_id", "spans"])

    return sliced(docs.select("doc_id", "text"), run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of a text replaced by mark; n_chars, where there is one, follows. All columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(tagger())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            valid = batch["text"].is_valid().to_pylist()
            for ok, (t, base, more) in zip(valid, batch_spans(batch["text"], model.value)):
                out, at = b"", 0
                for a, _, b in sorted(base + more):
                    if a >= at:
                        out += t[at:a] + mark.encode()
                    at = max(at, b)
                s = (out + t[at:]).decode()
                texts.append(s if ok else None)
                counts.append(len(s))
            cols = []
            for name, old in zip(batch.schema.names, batch.columns):
                if name == "text":
                    old = pa.array(texts, old.type)
                elif name == "n_chars" and pa.types.is_integer(old.type):
                    old = pa.array([c if v else o for c, o, v in zip(counts, old.to_pylist(), valid)], old.type)
                cols.append(old)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return sliced(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch["spans"].to_pylist()
            text = lambda own: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in own)
            counts = [pa.array([sum(x["kind"] == k for x in own) for own in spans], pa.int64()) for k in KINDS[:3]]
            base = [hashlib.sha256(text([x for x in own if x["kind"] != "crf"]).encode()).hexdigest() for own in spans]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, pa.array(base), pa.array([text(own) for own in spans], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(docs).mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
