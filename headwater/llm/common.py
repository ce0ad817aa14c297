"""Shared plumbing of the training-data operators: shared folder, sizing, Arrow text buffers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a slice that a worker holds in several forms at once.
PIECE_BYTES = 4 << 20
#: Hash values that `sieved` tells apart.
SIEVE_BITS = 24
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all tasks
    run in the driver (tests); elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="headwater-")
        _OWN[app] = f"{base.rstrip('/')}/{app}"
        ref = weakref.ref(sc)
        atexit.register(lambda: _clear(ref(), _OWN[app]))
    return _OWN[app]


def _clear(sc, path: str) -> None:
    """Best effort at the end of the application: the tables written here are intermediate."""
    try:
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the JVM may be gone already
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df, written as a table if it comes out of a shuffle: rows then keep their order when a lost task is run again."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialize(df, "settled") if "Exchange" in plan else df


def sieved(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ids, rows whose id isn't), both with the columns of docs.

    A bit for each of 2^SIEVE_BITS hash values goes to every task: SIEVE_BITS bits never take more than 2 MB, however many
    ids there are. Rows that need a join are thus told from most that don't before texts are shuffled; the join itself
    must still compare ids. ids: a table of one column, whatever its name.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << SIEVE_BITS))  # noqa: E731  hashes differ by type
    each = ids.select(place(F.col(ids.columns[0])).alias("p")).select(F.shiftright("p", 15).alias("__page"), F.col("p").bitwiseAND(32767).alias("bit"))
    pages = materialize(each.groupBy("__page").agg(F.bitmap_construct_agg("bit").alias("__bits")), "sieve")
    own = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("__row"), place(F.col(f"`{column}`")).alias("__place"))
    rows = rows.join(F.broadcast(pages), F.shiftright("__place", 15) == F.col("__page"), "left")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(F.col("__place").bitwiseAND(32767), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, F.col("__place").bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return rows.filter(hit).select("__row.*"), rows.filter(~hit).select("__row.*")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts; one aggregate over the column, to size blocks."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def give_back() -> None:
    """Returns freed memory to the system: a worker lives for many tasks, and executors share their limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What workers hold from task to task, by name: caches of one entry.
HELD: dict = {}


def held(f):
    """lru_cache(1) of f, until its worker gets a task of an operator that doesn't use it."""
    HELD[f.__name__] = lru_cache(1)(f)
    return HELD[f.__name__]


def let_go(but: str = "") -> None:
    """Drops all that this worker holds, except what is named."""
    for name, cached in HELD.items():
        if name != but:
            cached.cache_clear()


def sparing(run, holds: str = ""):
    """run over batches in slices of some PIECE_BYTES, with memory given back after each batch. holds: what run has of HELD."""

    def slices(batches):
        for batch in batches:
            step = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)
            del batch
            give_back()

    def call(batches):
        let_go(holds)
        yield from run(slices(batches))
        give_back()

    return call


def sliced(df: DataFrame, run, schema, holds: str = "") -> DataFrame:
    """df.mapInArrow with run made sparing. Batches are bounded by bytes: executor and worker hold a whole one, several times over.

    The bound is a setting of df's session, as Spark reads it when the rows are asked for; a lower one stays.
    """
    spark = df.sparkSession
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= PIECE_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE_BYTES))
    return df.mapInArrow(sparing(run, holds), schema)


def trimmed(run):
    """run, after which the worker gives freed memory back."""

    def call(*tables):
        let_go()
        out = run(*tables)
        give_back()
        return out

    # applyInArrow counts the arguments
    return (lambda table: call(table)) if run.__code__.co_argcount == 1 else (lambda left, right: call(left, right))


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column; a null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(arr) + 1, offset=8 * arr.offset) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if len(arr) and arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_values(column: pa.Array) -> list[bytes]:
    """Each value of a string column as bytes; a null counts as empty."""
    data, offsets = buffers(column)
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Document ids as int64; a missing id counts as the smallest."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    return arr.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
