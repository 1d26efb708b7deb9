"""How queries over the driver's tables are registered."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.memory import BATCH_BYTES, BATCH_ROWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times carry no zone and are read as UTC. Sets the session's Arrow batches to BATCH_ROWS and BATCH_BYTES."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, k in df.dtypes if k == "timestamp_ntz"})


def dealt(df: DataFrame) -> DataFrame:
    """A scanned table over all cores: one whose files make fewer partitions than there are cores is dealt out, any other is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextlib.contextmanager
def split(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs inside read files by ranges of ``most`` bytes at most, or of fewer if the session says so. A row group is never cut."""
    key = "spark.sql.files.maxPartitionBytes"
    had = spark.conf.get(key)
    n, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", had.strip().lower()).groups()
    spark.conf.set(key, str(min(most, int(n) << 10 * " kmgt".index(unit or " "))))
    try:
        yield
    finally:
        spark.conf.set(key, had)


def query(sql: str | None = None, name: str | None = None):
    """Registers f(t) where t(name) reads a table."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLE[key] = sql
        return f

    return put


#: SQL of squash: {c} a column, {n} the most characters.
SQUASH = "rtrim(left(trim(regexp_replace(regexp_replace({c}, '[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x{{84}}\\x{{86}}-\\x{{9F}}\\x{{061C}}\\x{{200E}}\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}]', '', 'g'), '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g')), {n}))"
#: The same without an end.
SQUASH_ALL = SQUASH.removeprefix("rtrim(left(").removesuffix(", {n}))")
REAL = "trim(text) <> '' AND NOT starts_with(trim(text), '<') AND NOT starts_with(trim(text), 'Caveat:')"
EPOCH = "floor(epoch({c}))::BIGINT"
#: SQL of the band of days {d} ago.
BANDS = "CASE WHEN {d} <= 0 THEN 'today' WHEN {d} = 1 THEN 'yesterday' WHEN {d} <= 6 THEN 'this week' WHEN {d} <= 30 THEN 'this month' WHEN {d} <= 365 THEN 'this year' ELSE 'older' END"
