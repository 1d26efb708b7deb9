"""What the operators of this subpackage share: work tables and byte-level text kernels.

Texts reach Python as Arrow batches. The kernels view the UTF-8 bytes of a block of
rows as one numpy array, so that no Python code runs per word. A block holds about
``BLOCK_BYTES`` of text (a longer text is a block of its own), which bounds memory
whatever the batch size is.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Commits as Commits
from ..sources.storage import work_dir as work_dir

BLOCK_BYTES = 1 << 18
#: Rows and bytes of an Arrow batch. A batch is in memory twice on its way, so these bound a worker's memory as much as the blocks do.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: How tables whose rows may be megabytes are written: pages and row groups are measured after each row, not each hundredth, as readers and codecs hold whole ones.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; sets the session's Arrow batches to BATCH_ROWS and BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, path: str | None = None, large_rows: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = path or work_dir(spark)
    df.write.options(**(LARGE_ROWS if large_rows else {})).mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: what else the caller's table holds can't clash with an operator's own names."""
    return df.select(*[df[n] for n in names])


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), o


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with arrays of a megabyte or more outside the heap, where freeing them gives them back; then memory that the allocators keep is given back too: workers live on for other operators' tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed instead of growing with what is freed
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


class Block:
    """Some rows' texts, joined and closed by a separator byte: text i is buf[at[i]:at[i + 1] - 1]."""

    __slots__ = ("at", "buf", "first", "n")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, sep: int) -> None:
        self.first, self.n = first, len(offsets) - 1
        lengths = np.diff(offsets)
        self.at = np.concatenate(([0], np.cumsum(lengths + 1)))
        part = data[offsets[0] : offsets[-1]]
        self.buf = np.full(int(self.at[-1]), sep, np.uint8)
        if len(part):
            keep = np.ones(len(self.buf), bool)
            keep[self.at[1:] - 1] = False
            self.buf[keep] = part


def blocks(col: pa.Array, sep: int = 0x20, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a batch's column into blocks of whole rows, of about ``size`` bytes each."""
    data, o = string_bytes(col)
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + size, "right")) - 1)
        yield Block(data, o[i : j + 1], i, sep)
        i = j


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last byte of a block is never inside."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for name, base in (("_pow", BASE), ("_inv", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            globals()[name] = np.cumprod(p)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of buf[start:end], all at once, by prefix sums modulo 2**64."""
    power, inverse = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total) + shift


#: Ids that may go to every executor (8 bytes each, some 50 in a hash table).
BROADCAST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs but for the rows whose key is among ids (one column), null matching null. Few ids go to the rows; more than BROADCAST_IDS are joined in a shuffle."""
    ids = stored(ids.toDF("id_to_drop").distinct())
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, docs[key].eqNullSafe(side["id_to_drop"]), "left_anti")


#: A key with more rows than this, and than a 10,000th of all, is hot; so there are fewer than 10,000 of them.
HOT_ROWS = 1_000


def spread_join(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "left", hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """left joined by ``keys`` with right, which has a row a key. A hot key's rows of left are dealt over several tasks by the partition that they come from, and its row of right is repeated for each; no row is lost and none is doubled.

    left: a stored table, or one whose partitions are always the same. counts: (*keys, hot_n) with the rows of each key, where the caller knows them.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_n"))
    named = reduce(and_, [F.col(k).isNotNull() for k in keys])
    total = F.lit(counts.agg(F.sum("hot_n")).first()[0] or 0)
    hot = stored(counts.where(named & (F.col("hot_n") > hot_rows) & (F.col("hot_n") * 10_000 > total)).select(*keys, F.ceil(F.col("hot_n") / F.greatest(F.lit(hot_rows), total / 10_000)).cast("int").alias("salts")))
    if not hot.limit(1).count():
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    left = left.join(hot, keys, "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.spark_partition_id(), F.col("salts")))).drop("salts")
    right = right.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [*keys, "salt"], how).drop("salt")
