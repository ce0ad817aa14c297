"""Exchange of repeated features between blocks of documents.

Documents are dealt into blocks of a few megabytes. A block sends the sorted, distinct features of its
documents as one delta-coded run for each range of the hash space; a range's task merges the runs and answers
with one bit for each feature of each run. Copies within a block collapse before anything is sent, and an
answer names positions of a run, never documents, so a hot group costs a block no more than one row.
All steps read the same exchange of the texts (Spark reuses it), which is written once.

The numbers of blocks and ranges follow from the bytes of text alone. A block sends a run to those ranges only for
which it has features, so there are never more runs than features, however large the input is.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import settled, text_bytes

#: Text bytes of a block, and of the blocks whose features would fill a range.
BLOCK_BYTES, RANGE_BYTES = 6 << 20, 24 << 20
#: Text bytes that are hashed at once; numpy's temporaries take some 60 times that.
PIECE_BYTES = 3 << 19
BITS = 48


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, doc_id, text) and the number of hash ranges.

    Rows are dealt by id, length and their place in the input, so that no id or text, however often it is there, fills
    a block.
    """
    docs = settled(docs.select("doc_id", "text"))
    total = text_bytes(docs)
    key = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.monotonically_increasing_id()), F.lit(max(1, math.ceil(total / block_bytes)))).cast("int")
    return docs.select(key.alias("block"), "doc_id", "text"), max(1, math.ceil(total / (RANGE_BYTES / BLOCK_BYTES * block_bytes)))


def planes(values: np.ndarray) -> bytes:
    """Ascending uint64 values as byte planes of their gaps."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return struct.pack("<IB", len(gaps), width) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    n, width = struct.unpack_from("<IB", raw, at)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 5).reshape(width, n).T
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64), at + 5 + n * width


def squeeze(values: np.ndarray) -> bytes:
    """Any array, compressed, with its length in front."""
    raw = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())
    return struct.pack("<I", len(raw)) + raw


def unsqueeze(raw: bytes, at: int, dtype: str) -> tuple[np.ndarray, int]:
    (n,) = struct.unpack_from("<I", raw, at)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at + 4 : at + 4 + n]), dtype), at + 4 + n


def ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range of each BITS-bit hash; ascending with it."""
    return ((hashes >> np.uint64(BITS - 24)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct hashes, place of each input among them, whether several ids have it); doc: an id each."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(first)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(first) - 1
    several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(at) else np.zeros(0, bool)
    return h[at], place, several


RUN = "q int, block int, run binary"
ANSWER = "block int, q int, bits binary"


def cut(block: int, q: np.ndarray, pack: Callable[[int, int], bytes]) -> pa.Table:
    """One run for each range that has features; q ascends. pack(a, b): the run of the features a to b."""
    edges = np.flatnonzero(np.diff(q, prepend=-1)) if len(q) else np.zeros(0, np.int64)
    ends = [*edges[1:].tolist(), len(q)]
    return pa.table({
        "q": pa.array(q[edges], pa.int32()),
        "block": pa.array(np.full(len(edges), block), pa.int32()),
        "run": pa.array([pack(a, b) for a, b in zip(edges.tolist(), ends)], pa.binary()),
    })


def joined_bits(answers: pa.Table, dtype: str = "u1") -> np.ndarray:
    """A block's answers, put together in the order of the ranges."""
    answers = answers.sort_by("q")
    raw = [x.as_py() for x in answers["bits"]]
    if dtype == "u1":
        return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=struct.unpack_from("<I", x)[0]).astype(bool) for x in raw] or [np.zeros(0, bool)])
    return np.concatenate([unsqueeze(x, 0, dtype)[0] for x in raw] or [np.zeros(0, dtype)])


def answer(table: pa.Table, bits: list[bytes]) -> pa.Table:
    return pa.table({"block": table["block"], "q": table["q"], "bits": pa.array(bits, pa.binary())})


def packed(flags: np.ndarray) -> bytes:
    return struct.pack("<I", len(flags)) + np.packbits(flags).tobytes()


def repeated(table: pa.Table) -> pa.Table:
    """For a range: of each hash of each run, whether several documents have it."""
    runs = []
    for x in table["run"]:
        raw = x.as_py()
        h, at = unplanes(raw)
        runs.append((h, np.unpackbits(np.frombuffer(raw, np.uint8, offset=at), count=len(h)).astype(bool)))
    h, several = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    flags = np.empty(len(s), bool)
    flags[order] = same
    flags |= several
    out, a = [], 0
    for r, _ in runs:
        out.append(packed(flags[a : a + len(r)]))
        a += len(r)
    return answer(table, out)


def hash_runs(block: int, hashes: np.ndarray, several: np.ndarray, n: int) -> pa.Table:
    return cut(block, ranges(hashes, n), lambda a, b: planes(hashes[a:b]) + np.packbits(several[a:b]).tobytes())
