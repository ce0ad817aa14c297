"""Packing documents into sequences of a fixed window by non-negative least squares over length combinations.

Every document is cut into whole windows and a rest. The histogram of piece lengths has at most `window` entries,
whatever the corpus; shallow combinations of lengths that fill a window are its columns, and least squares gives
how often each is to be used. Rounded down, they take nearly all pieces; the residual histogram is packed greedily.
The recipe, some thousand rows, is what the executors get: a piece's rank among those of its length names its slot.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import materialize, sliced
from headwater.llm.tokens import VOCABULARY, encoder

WINDOW = 1024
SEPARATOR = b"\0\0\0\0"
#: The most frequent lengths that are combined with every length to triples.
COMMON = 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long, ids binary"


def pieces(docs: DataFrame, window: int, path: str, with_ids: bool) -> DataFrame:
    """Whole windows and the rest of each document; nth: how many pieces of this length the task had before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "ids"]
        for batch in batches:
            row, start, length, crc, total, nth, ids = [], [], [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                raw = own(text or "") + SEPARATOR
                n = len(raw) // 4
                for a in range(0, n, window):
                    piece = raw[4 * a : 4 * (a + window)]
                    row.append(i)
                    start.append(a)
                    length.append(k := len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    nth.append(seen[k])
                    seen[k] += 1
                    ids.append(piece if with_ids else None)
            doc = batch["doc_id"].take(pa.array(row, pa.int64()))
            cols = [doc, *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return sliced(docs.select("doc_id", "text"), cut, PIECES, "encoder")


def combinations(hist: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Up to three lengths that fill the window, or a power of two, without padding."""
    lengths = sorted(hist)
    common = sorted(hist, key=lambda n: (-hist[n], n))[:COMMON]
    out = {(n,) for n in lengths if n == window}
    for goal in (window, *(1 << k for k in range(window.bit_length() - 1, 3, -1))):
        out |= {(goal - n, n) for n in lengths if n <= goal - n and goal - n in hist}
    out |= {tuple(sorted((n, c, window - n - c), reverse=True)) for n in lengths for c in common if window - n - c in hist}
    out |= {(n,) for n in lengths if n & (n - 1) == 0}
    return sorted(out, key=lambda p: (-sum(p), len(p), p))


def least_squares(columns: list[tuple[int, ...]], hist: dict[int, int], sweeps: int = 60) -> list[float]:
    """x >= 0 that brings sum x * column close to hist: coordinate descent over sparse columns, by order of columns."""
    rest = {n: float(c) for n, c in hist.items()}
    parts = [(tuple(Counter(c).items()), float(sum(k * k for k in Counter(c).values()))) for c in columns]
    x = [0.0] * len(columns)
    scale = max(rest.values(), default=0.0)
    for _ in range(sweeps):
        moved = 0.0
        for j, (own, norm) in enumerate(parts):
            step = max(-x[j], sum(k * rest[n] for n, k in own) / norm)
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, k in own:
                    rest[n] -= k * step
        if moved < 1e-4 * scale:
            break
    return x


def recipe(hist: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which take up the histogram exactly."""
    rest, out = dict(hist), []

    def take(pattern: tuple[int, ...], times: int) -> None:
        need = Counter(pattern)
        times = min(times, *(rest[n] // k for n, k in need.items()))
        if times > 0:
            out.append((pattern, times))
            for n, k in need.items():
                rest[n] -= k * times
                if not rest[n]:
                    del rest[n]

    columns = combinations(hist, window)
    for pattern, x in zip(columns, least_squares(columns, hist)):
        if x >= 1 and all(n in rest for n in pattern):
            take(pattern, int(x))
    while rest:  # greedily: the longest piece, then what fills the window exactly, else the longest that fits
        pattern = [max(rest)]
        left = dict(rest)
        left[pattern[0]] -= 1
        gap = window - pattern[0]
        while gap:
            fits = sorted((n for n, c in left.items() if c and n <= gap), reverse=True)
            if not fits:
                break
            here = set(fits)
            pair = next(((n, gap - n) for n in fits if gap - n in here and (2 * n != gap or left[n] > 1)), None)
            for n in (gap,) if gap in here else pair or fits[:1]:
                pattern.append(n)
                left[n] -= 1
                gap -= n
        need = Counter(pattern)
        take(tuple(pattern), min(rest[n] // k for n, k in need.items()))
    return out


class Slots:
    """Slots of the recipe by length and rank."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]]):
        rows, used, base = [], Counter(), 0
        for pattern, times in made:
            for offset, n in zip(itertools.accumulate(pattern, initial=0), pattern):
                rows.append((n << 44 | used[n], base, offset))
                used[n] += times
            base += times
        rows.sort()
        self.key, self.base, self.offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << 44 | rank
        at = np.searchsorted(self.key, key, side="right") - 1
        return self.base[at] + key - self.key[at], self.offset[at]


def pack(docs: DataFrame, window: int = WINDOW, path: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Packs the ids of docs (doc_id, text), each document closed by id 0, into sequences of at most window ids.

    Returns one row per piece: doc_id, start (its document's ids before it), length, ids_crc32 (of its ids as unsigned
    little-endian 32-bit numbers), doc_tokens, sequence_id, offset (in the sequence, gapless from 0) and ids (these
    bytes; null unless with_ids). Every id lies in one piece. A sequence that isn't full is to be padded, but for a
    power of two. A null or empty text is the closing id alone. Rows with one doc_id are packed each for itself. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, window, path, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    slots = spark.sparkContext.broadcast(Slots(recipe(hist, window)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        for batch in batches:
            seq, offset = slots.value.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    rows = placed.select(*columns, (F.col("before") + F.col("nth")).cast("long").alias("rank"))
    found = rows.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
