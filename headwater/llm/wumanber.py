"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 10-word windows of the benchmark items (an item of fewer words is one pattern). For each pattern
length, a shift table holds, for every block of words in a pattern, how far the block's end is from the pattern's
end; an unknown block lets the search jump over all positions that it would be part of. Where the shift is 0, the
block selects a bucket of patterns, their first words thin it out, and a direct comparison confirms.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import byte_values, materialize, sliced

WINDOW, BLOCK = 10, 3
#: Bytes of benchmark text that are searched for at once: some 200,000 patterns, whose tables take some 200 MB in each
#: worker. A larger benchmark is searched for in portions.
PORTION_BYTES = 1 << 20
#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes above ASCII, makes the rest white space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Search:
    """Shift tables and buckets of patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, set]):
        self.length, self.block = length, min(BLOCK, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[bytes, list]] = {}
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, length), length - end)
            self.buckets.setdefault(p[-self.block :], {}).setdefault(p[0], []).append((list(p), items))

    def find(self, w: list[bytes], hit: bytearray, items: set) -> None:
        """Marks the words of each occurrence and adds the items that have it."""
        length, b, n = self.length, self.block, len(w)
        shift, jump, i = self.shift.get, length - self.block + 1, length
        while i <= n:
            key = (w[i - 3], w[i - 2], w[i - 1]) if b == 3 else tuple(w[i - b : i])
            if step := shift(key, jump):
                i += step
                continue
            for p, of in self.buckets[key].get(w[i - length], ()):
                if w[i - length : i] == p:
                    hit[i - length : i] = b"\1" * length
                    items |= of
            i += 1


def searches(items: Iterable[tuple[object, str | None]]) -> list[Search]:
    """One search for each pattern length."""
    patterns: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        w = words((text or "").encode())
        n = min(len(w), WINDOW)
        for i in range(len(w) - n + 1 if w else 0):
            patterns.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    return [Search(n, p) for n, p in sorted(patterns.items(), reverse=True)]


def portions(benchmark: DataFrame, portion_bytes: int) -> Iterator[list[Search]]:
    """The searches of each portion of the benchmark, at least one; items are dealt by id and text."""
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(total / portion_bytes))
    for k in range(n):
        yield searches(tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator())


MARKS = "key long, doc_id long, n_words long, hits binary, items array<string>"


def marks(docs: DataFrame, benchmark: DataFrame, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """doc_id, n_words, hits (a byte for each word: 1 if hit) and items (sorted ids as strings): one row per row of docs.

    A benchmark of several portions is searched for in as many passes over the texts. From the second on, a pass writes
    the marks of the documents that it has found something in; these are put together by the row's number.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    made: list[DataFrame] = []
    tables = portions(benchmark, portion_bytes)
    one, more = next(tables), next(tables, None)
    if more is not None:
        keyed = materialize(keyed, "keyed")
    while one is not None:
        own = spark.sparkContext.broadcast(one)

        def scan(batches: Iterator[pa.RecordBatch], own=own, every=not made) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, n, hits, items = [], [], [], []
                for i, text in enumerate(byte_values(batch["text"])):
                    w = words(text)
                    hit, of = bytearray(len(w)), set()
                    for s in own.value:
                        s.find(w, hit, of)
                    if every or of:
                        at.append(i)
                        n.append(len(w))
                        hits.append(bytes(hit))
                        items.append(sorted(of))
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch["key"].take(rows), batch["doc_id"].take(rows), pa.array(n, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["key", "doc_id", "n_words", "hits", "items"])

        made.append(sliced(keyed, scan, MARKS))
        if more is not None or len(made) > 1:
            made[-1] = materialize(made[-1], "marks")
        one, more = more, next(tables, None) if more is not None else None
    if len(made) == 1:
        return made[0].drop("key")

    def put_together(table: pa.Table) -> pa.Table:
        hits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in byte_values(table["hits"])])
        items = sorted({x for own in table["items"].to_pylist() for x in own})
        first = {c: table[c].slice(0, 1) for c in ("key", "doc_id", "n_words")}
        return pa.table(first | {"hits": pa.array([hits.tobytes()], pa.binary()), "items": pa.array([items], pa.list_(pa.string()))})

    later = made[1]
    for x in made[2:]:
        later = later.unionAll(x)
    again = later.select("key").distinct()
    both = made[0].join(again, "key", "left_semi").unionAll(later).groupBy("key").applyInArrow(put_together, MARKS)
    return made[0].join(again, "key", "left_anti").unionAll(both).drop("key")


def contamination(docs: DataFrame, benchmark: DataFrame, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """What each document has of the benchmark: one row per row of docs.

    docs: doc_id, text; benchmark: item_id, text (more columns of either are ignored). Words are runs of letters and
    digits and of all characters above ASCII, A-Z lower-cased. Returns doc_id, n_words, n_hit (words inside an
    occurrence), n_items (items that occur), items_sha256 (their ids as strings, sorted, comma-joined) and
    contaminated. A null or empty text has no words. Items without words never occur; a null item_id is written as
    an empty string; rows with one item_id count as one item. A repeated document row gets its own equal row.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = byte_values(batch["hits"])
            items = batch["items"].to_pylist()
            n = np.array([x.count(1) for x in hits], np.int64)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"],
                batch["n_words"],
                pa.array(n),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array(n > 0),
            ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return marks(docs, benchmark, portion_bytes).mapInArrow(digest, OUT)


def clean(docs: DataFrame, benchmark: DataFrame, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs. Each portion sifts what is left."""
    for tables in portions(benchmark, portion_bytes):
        own = docs.sparkSession.sparkContext.broadcast(tables)

        def sift(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = []
                for text in byte_values(batch["text"]):
                    w, of = words(text), set()
                    hit = bytearray(len(w))
                    for s in own.value:
                        s.find(w, hit, of)
                    kept.append(not of)
                yield batch.filter(pa.array(kept, pa.bool_()))

        docs = sliced(docs, sift, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS ws FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS k FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS r(i) WHERE len(ws) > 0),
win AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM pat), unnest(range(1, len(ws) - n + 2)) AS r(i)),
hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN pat USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(n)) AS r(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
