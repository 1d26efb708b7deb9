"""Reports and line sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X

TOKENS = ("in_tokens", "out_tokens", "cache_read", "cache_write")


def stats(sessions: DataFrame) -> DataFrame:
    """(metric, value) over all sessions, from one aggregate."""
    text = lambda c: F.count_if(F.col(c) != "")
    aggs = {
        "sessions": F.count_if(~F.col("is_subagent")), "subagents": F.count_if("is_subagent"), "bytes": F.sum("size"), "entries": F.sum("entries"),
        "with_title": F.count_if((F.col("custom_title") != "") | (F.col("ai_title") != "")), "with_cwd": text("cwd"), "with_branch": text("git_branch"),
        **{c: F.sum(c) for c in TOKENS}, "total_tokens": N.total_tokens(*[F.sum(c) for c in TOKENS]),
    }
    one = sessions.agg(*[F.coalesce(a, F.lit(0)).cast("bigint").alias(k) for k, a in aggs.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in aggs]), F.array(*aggs))).alias("metric", "value"))


def token_lines(totals: DataFrame) -> DataFrame:
    """stats() with the numbers as people read them."""
    return totals.withColumn("shown", N.human_count(F.col("value")))


def tsv_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """One escaped line a row."""
    return rows.select(F.concat_ws("\t", *[X.tsv(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("value"))


def list_lines(sessions: DataFrame, now: int, home: str = "") -> DataFrame:
    s = sessions.select(N.reltime(F.col("mtime"), F.lit(now)).alias("age"), X.short_cwd(F.col("cwd"), home).alias("folder"), "title", "id", "mtime", "path")
    return tsv_lines(s.orderBy(F.desc("mtime"), "path"), "age", "folder", "title", "id")


def search_lines(results: DataFrame, now: int, home: str = "") -> DataFrame:
    s = results.withColumns({"age": N.reltime(F.col("mtime"), F.lit(now)), "folder": X.short_cwd(F.col("cwd"), home)})
    return tsv_lines(s, "age", "folder", "title", "id", "excerpt")


JSON_FIELDS = ("id", "title", "cwd", "git_branch", "model", "mtime", "first_ts", "last_ts", "size", "entries", "user_msgs", "assistant_msgs", "favorite", "tags", "note", "live_pid")


def json_lines(sessions: DataFrame) -> DataFrame:
    fields = [F.col(c) for c in (*JSON_FIELDS, "wsx") if c in sessions.columns]
    return sessions.orderBy(F.desc("mtime"), "path").select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def plan_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """Tab-separated fields for another program; a row with a tab, a line break or a unit separator in a field is left out."""
    clean = [~F.coalesce(F.col(c).cast("string"), F.lit("")).rlike("[\\t\\n\\x1f]") for c in columns]
    keep = clean[0]
    for c in clean[1:]:
        keep = keep & c
    return rows.where(keep).select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


def legacy_list(sessions: DataFrame) -> DataFrame:
    """The short listing: titles of 110 characters."""
    return sessions.select("id", "cwd", X.squash(F.col("title"), 110).alias("title"), "mtime").orderBy(F.desc("mtime"), "id")


def search_quality(ranks: DataFrame) -> DataFrame:
    """found, first, top five and mean reciprocal rank of (rank or null) per question."""
    r = F.col("rank")
    return ranks.agg(F.avg(r.isNotNull().cast("double")).alias("found"), F.avg(F.coalesce((r == 1).cast("double"), F.lit(0.0))).alias("first"), F.avg(F.coalesce((r <= 5).cast("double"), F.lit(0.0))).alias("top5"), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"))


def save_lines(lines: DataFrame, path: str) -> None:
    """A list's lines (value) as text files, in order by file name and line: Spark's own commit, so all of them or none are there."""
    lines.write.text(path)
