"""The prose of transcripts: what was said, thought and run, without tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: Bytes of a file whose prose one row holds.
BLOCK_BYTES = 64 << 20
_S = X.JSON_CHARS
#: In this order: text blocks, thinking blocks, commands, descriptions, plain messages. A block's value key follows its type within 48 bytes.
PATTERNS = (
    rf'(?s)"type":"text".{{0,40}}?"text":"{_S}',
    rf'(?s)"type":"thinking".{{0,36}}?"thinking":"{_S}',
    rf'"command":"{_S}',
    rf'"description":"{_S}',
    rf'"role":"user","content":"{_S}',
    rf'"role":"assistant","content":"{_S}',
)


def harvest(raw: Column) -> Column:
    """A line's prose, each piece followed by a space; pieces by pattern, then place."""
    pieces = F.concat(*[F.regexp_extract_all(raw, F.lit(p), F.lit(1)) for p in PATTERNS])
    return F.concat_ws("", F.transform(pieces, lambda p: F.concat(X.unescaped(p), F.lit(" "))))


def said(lines: DataFrame) -> DataFrame:
    """Classified lines that carry prose: messages, without injected context and tool results."""
    raw = F.col("raw")
    return lines.where((F.col("is_user") | F.col("is_assistant")) & ~raw.contains('"isMeta":true') & ~raw.contains('"type":"tool_result"'))


def bodies(lines: DataFrame, cap: int | None = None, block_bytes: int = BLOCK_BYTES, had: DataFrame | None = None) -> DataFrame:
    """(path, text) of the transcripts that have prose, all of it in file order; with a cap, the lines before which there are less than ``cap`` bytes of it.

    Prose is gathered by blocks of a file first, each no larger than the block; running sums in and over the blocks leave out what comes beyond a cap before the rest are joined. had: (path, had) of bytes of prose that transcripts had before these lines, for a cap.
    """
    p = said(lines).select("path", "offset", harvest(F.col("raw")).alias("t")).where("t <> ''")
    p = p.withColumn("block", F.floor(F.col("offset") / F.lit(block_bytes)))
    blocks = _whole(p) if cap is None else _capped(p, cap, had)
    return blocks.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "t"))), lambda x: x["t"]), "").alias("text"))


def _whole(p: DataFrame) -> DataFrame:
    """(path, block, t) of lines (path, block, offset, t)."""
    return p.groupBy("path", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "t"))), lambda x: x["t"]), "").alias("t"))


def _capped(p: DataFrame, cap: int, had: DataFrame | None) -> DataFrame:
    so_far = lambda size, *by: F.coalesce(F.sum(size).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("run", so_far(F.octet_length("t"), "path", "block", "offset"))
    blocks = p.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("offset", "run", "t"))).alias("ls"), F.sum(F.octet_length("t")).alias("n"))
    if had is not None:
        blocks = blocks.join(had, "path", "left")
    start = F.coalesce("had", F.lit(0)) if had is not None else F.lit(0)
    blocks = blocks.withColumn("before", start + so_far(F.col("n"), "path", "block")).where(F.col("before") < cap)
    kept = F.filter("ls", lambda x: F.col("before") + x["run"] < cap)
    return blocks.select("path", "block", F.array_join(F.transform(kept, lambda x: x["t"]), "").alias("t"))
