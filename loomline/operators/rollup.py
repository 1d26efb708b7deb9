"""Lines to sessions: one order-aware aggregate per transcript, mergeable over segments.

First and last values are arg-min and arg-max by byte offset, counts and sums add, so
partial aggregates combine in any order and a long transcript is no single task. Only
the token sums look at neighbours: a usage record counts unless it has the id of the one
before; they are sorted by blocks of a file, and blocks joined by their ends, in the same pass. A segment keeps its first and last usage ids and its first record, which is all
that joining two segments needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKENS = ("in_tokens", "out_tokens", "cache_read", "cache_write")
FIRST = ("cwd", "git_branch", "version", "agent_id", "permission_mode")
#: Bytes of a file whose usage records one task sorts.
BLOCK_BYTES = 64 << 20
LAST = ("custom_title", "ai_title", "last_prompt", "model")


def _at(f, value: str, order: str = "offset") -> Column:
    """(value, order) of the first or last row that has a value."""
    have = F.col(value).isNotNull()
    return F.struct(f(F.when(have, F.col(value)), F.when(have, F.col(order))).alias("v"), (F.min if f is F.min_by else F.max)(F.when(have, F.col(order))).alias("o"))


def deduplicated_usage(lines: DataFrame, key: str = "path", order: str = "offset", block: Column | None = None) -> DataFrame:
    """Usage lines with ``counted``: false if the usage line before has the same non-empty id. block: ascending with the order; lines are sorted by key and block, and only a block's last id is carried to the next."""
    u = lines.where("has_usage").withColumn("block", F.lit(0) if block is None else block)
    w = W.partitionBy(key, "block").orderBy(order)
    u = u.withColumns({"before": F.lag("usage_id").over(w), "nth": F.row_number().over(w)})
    if block is not None:
        ends = u.groupBy(key, "block").agg(F.max_by("usage_id", order).alias("last_id"))
        ends = ends.withColumn("carried", F.lag("last_id").over(W.partitionBy(key).orderBy("block"))).drop("last_id")
        u = u.join(ends, [key, "block"]).withColumn("before", F.when(F.col("nth") == 1, F.col("carried")).otherwise(F.col("before"))).drop("carried")
    return u.withColumn("counted", (F.col("usage_id") == "") | ~F.col("usage_id").eqNullSafe(F.col("before"))).drop("before", "nth", "block")


_USAGE = ("usage_id", *TOKENS)


def _counted(u: Column) -> list[Column]:
    """Token sums of sorted usage records: one counts unless it has the non-empty id of the one before."""
    kept = F.filter(u, lambda x, i: (x["usage_id"] == "") | ~x["usage_id"].eqNullSafe(F.get(u, i - 1)["usage_id"]))
    return [F.aggregate(F.transform(kept, _field(c)), F.lit(0).cast("long"), lambda acc, n: acc + n).alias(c) for c in TOKENS]


def _field(c: str):
    return lambda x: F.coalesce(x[c], F.lit(0)).cast("long")


def _joined(b: Column) -> list[Column]:
    """Token sums over a file's blocks in order: a block's first record doesn't count if the block before ended with its id."""
    again = lambda x, i: (x["first_usage"]["usage_id"] != "") & x["first_usage"]["usage_id"].eqNullSafe(F.get(b, i - 1)["last_usage_id"])
    sums = lambda c: F.transform(b, lambda x, i: x[c] - F.when(again(x, i), F.coalesce(x["first_usage"][c], F.lit(0))).otherwise(0))
    return [F.aggregate(sums(c), F.lit(0).cast("long"), lambda acc, x: acc + x).alias(c) for c in TOKENS]


def segments(lines: DataFrame) -> DataFrame:
    """One mergeable row per path from classified lines, in one pass: by blocks of a file first, whose usage records are sorted where they meet (those of BLOCK_BYTES at most), then the blocks by their ends."""
    b = lines.groupBy("path", F.floor(F.col("offset") / F.lit(BLOCK_BYTES)).alias("block")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if("is_user").alias("user_msgs"),
        F.count_if("is_assistant").alias("assistant_msgs"),
        _at(F.min_by, "ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        _at(F.min_by, "user_prompt").alias("first_prompt"),
        *[_at(F.min_by, c).alias(c) for c in FIRST],
        *[_at(F.max_by, c).alias(c) for c in LAST],
        F.max(F.col("offset") + (F.col("bytes") if "bytes" in lines.columns else F.octet_length("raw") + 1)).alias("scanned_len"),
        F.array_sort(F.collect_list(F.when(F.col("has_usage"), F.struct("offset", *_USAGE)))).alias("u"),
    )
    some = F.size("u") > 0
    first = F.when(some, F.struct(*[F.get("u", F.lit(0))[c].alias(c) for c in _USAGE]))
    b = b.withColumn("block", F.struct("block", *_counted(F.col("u")), first.alias("first_usage"), F.get("u", F.size("u") - 1)["usage_id"].alias("last_usage_id"))).withColumn("some", some).drop("u")
    one = lambda f, c: f(F.when(F.col(f"{c}.o").isNotNull(), F.col(c)), F.col(f"{c}.o")).alias(c)
    s = b.groupBy("path").agg(
        *[F.sum(c).alias(c) for c in ("entries", "user_msgs", "assistant_msgs")],
        *[F.max(c).alias(c) for c in ("last_ts", "scanned_len")],
        *[one(F.min_by, c) for c in ("first_ts", "first_prompt", *FIRST)],
        *[one(F.max_by, c) for c in LAST],
        F.array_sort(F.collect_list(F.when(F.col("some"), F.col("block")))).alias("b"),
    )
    ends = [F.get("b", F.lit(0))["first_usage"].alias("first_usage"), F.get("b", F.size("b") - 1)["last_usage_id"].alias("last_usage_id")]
    order = ("path", "entries", "user_msgs", "assistant_msgs", "first_ts", "last_ts", "first_prompt", *FIRST, *LAST, "scanned_len")
    return s.select(*order, *_joined(F.col("b")), *ends)


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Segments and the segments that follow them in the same files (offsets ascend) as one."""
    l, r = left.alias("l"), right.alias("r")
    L, R = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    add = lambda c: (F.coalesce(L(c), F.lit(0)) + F.coalesce(R(c), F.lit(0))).alias(c)
    keep_first = lambda c: F.when(L(f"{c}.o").isNotNull(), L(c)).otherwise(R(c)).alias(c)
    keep_last = lambda c: F.when(R(f"{c}.o").isNotNull(), R(c)).otherwise(L(c)).alias(c)
    same = F.coalesce((L("last_usage_id") == R("first_usage.usage_id")) & (L("last_usage_id") != ""), F.lit(False))
    token = lambda c: (F.coalesce(L(c), F.lit(0)) + F.coalesce(R(c), F.lit(0)) - F.when(same, R(f"first_usage.{c}")).otherwise(0)).alias(c)
    return l.join(r, F.col("l.path") == F.col("r.path"), "full_outer").select(
        F.coalesce(L("path"), R("path")).alias("path"),
        *map(add, ("entries", "user_msgs", "assistant_msgs")),
        keep_first("first_ts"),
        F.greatest(L("last_ts"), R("last_ts")).alias("last_ts"),
        keep_first("first_prompt"),
        *map(keep_first, FIRST),
        *map(keep_last, LAST),
        F.greatest(L("scanned_len"), R("scanned_len")).alias("scanned_len"),
        *map(token, TOKENS),
        F.coalesce(L("first_usage"), R("first_usage")).alias("first_usage"),
        F.coalesce(R("last_usage_id"), L("last_usage_id")).alias("last_usage_id"),
    )


def sessions(segments_: DataFrame, files: DataFrame) -> DataFrame:
    """Session rows: files joined with their merged segments; unknown text is empty, unknown numbers are 0."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c.partition(".")[0])
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c.partition(".")[0])
    s = files.join(segments_, "path", "left")
    return s.select(
        "path", "id", "project_dir", *[text(f"{c}.v") for c in ("cwd", "git_branch", "version", "agent_id", "custom_title", "ai_title", "first_prompt", "last_prompt", "model", "permission_mode")],
        "size", "mtime", number("first_ts.v"), *map(number, ("last_ts", "entries", "user_msgs", "assistant_msgs", *TOKENS)), F.coalesce("last_usage_id", F.lit("")).alias("last_msg_id"), number("scanned_len"), "is_subagent", "parent",
    )
