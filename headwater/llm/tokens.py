"""Token ids of documents by a byte-level BPE vocabulary, and exact length histograms.

Spaces and line ends between other characters always begin a new piece of the vocabulary's pattern, so a text
falls into short chunks that are encoded alone and looked up; only new chunks reach the tokenizer.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headwater.llm.common import held, sliced

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SEPARATOR = 0
#: Chunks that a worker remembers.
REMEMBERED = 600_000
_ODD = re.compile(r"\s\s|^\s|\s$|[^\S \n]|<\|endoftext\|>")


def ranks(tokenizer: Tokenizer) -> dict[bytes, int]:
    """A byte-level vocabulary by its bytes; the letters that stand for bytes are those of the byte-level encoding."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(byte[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}


class Encoder(dict):
    """Chunk -> its ids as little-endian 32-bit bytes. A chunk with a line end in front has no space before it.

    Chunks are encoded by the same vocabulary as ranks, which is quicker for short strings; whole texts with other
    white space or special tokens by the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.short = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(self.tokenizer), special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.short(chunk if chunk[0] == "\n" else " " + chunk)
        out = self[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self.encode(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, rest))


@held
def encoder(path: str) -> Encoder:
    return Encoder(path)


def map_ids(docs: DataFrame, make: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch], schema: str, path: str = VOCABULARY) -> DataFrame:
    """make(batch, ids of each text) for the batches of docs; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            yield make(batch, [own(t or "") for t in batch["text"].to_pylist()])

    return sliced(docs, run, schema, "encoder")


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each row of docs (doc_id, text)."""
    make = lambda batch, ids: pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "n_tokens"])
    return map_ids(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long", path)
