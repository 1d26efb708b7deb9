"""The list: which sessions pass, in what order, under which headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import numbers as N
from ..functions import text as X
from ..sources.storage import work_dir
from . import overlay as O
from .search import parents_of_hits, session_scores

SORTS = ("recency", "size", "entries", "duration", "title", "folder", "tokens")
RANGES = ("all", "today", "7", "30", "90")
BANDS = ("favourites", "today", "yesterday", "this week", "this month", "this year", "older", "earlier")


def after(names: tuple, now: str) -> str:
    """The next of a cycle."""
    return names[(names.index(now) + 1) % len(names)]


def title_of() -> Column:
    return X.title(F.col("custom_title"), F.col("ai_title"), F.col("first_prompt"), F.col("is_subagent"))


def _by(sort: str) -> list[tuple[Column, bool]]:
    """(key, whether the largest comes first) of a sort, then of the base order: newest first, then by path."""
    mtime = (F.col("mtime"), True)
    by = {
        "recency": [mtime],
        "size": [(F.col("size"), True)],
        "entries": [(F.col("entries"), True)],
        "duration": [(N.duration_secs(F.col("first_ts"), F.col("last_ts")), True)],
        "title": [(F.lower("title"), False)],
        "folder": [(F.col("cwd"), False), mtime],
        "tokens": [(N.total_tokens(*map(F.col, ("in_tokens", "out_tokens", "cache_read", "cache_write"))), True)],
    }[sort]
    return [*by, mtime, (F.col("path"), False)]


def _directed(keys: list[tuple[Column, bool]]) -> list[Column]:
    return [c.desc() if down else c.asc() for c, down in keys]


def sort_keys(sort: str) -> list[Column]:
    """Keys of a sort, then the base order: newest first, then by path."""
    return _directed(_by(sort))


def passing(sessions: DataFrame, now: int, favourites: bool = False, live: bool = False, tag: str | None = None, dates: str = "all", hits: DataFrame | None = None, zone: str = "UTC") -> DataFrame:
    """Listed sessions: all that is asked for holds. Subagents are listed only as orphans."""
    s = sessions.where("NOT is_subagent").unionByName(O.orphans(sessions).select(*sessions.columns))
    if favourites:
        s = s.where("favorite")
    if live:
        s = s.where("live_pid IS NOT NULL")
    if tag is not None:
        s = s.where(O.place_tag(F.col("wsx")) == tag if tag.startswith(O.TAG_PREFIX) else F.array_contains("tags", tag))
    s = s.where(N.in_range(F.col("mtime"), F.lit(now), dates, zone))
    if hits is not None:
        own = s.join(hits.select("path"), "path", "left_semi")
        above = s.join(parents_of_hits(sessions, hits), "id", "left_semi")
        s = own.unionByName(above).dropDuplicates(["path"])
    return s


def filtered(sessions: DataFrame, typed: str, home: str = "") -> DataFrame:
    """Sessions that the filter accepts, with filter_score."""
    if not fuzzy.Filter.parse(typed).words:
        return sessions.withColumn("filter_score", F.lit(0))
    w = F.col("wsx")
    fields = {
        "title": F.col("title"), "folder": X.short_cwd(F.col("cwd"), home), "place": F.when(w.isNotNull(), F.concat_ws(" ", O.place_label(w), O.place_tag(w))).otherwise(""),
        "branch": F.col("git_branch"), "tags": X.tag_words(F.col("tags")), "note": F.col("note"), "prompt": F.col("last_prompt"), "id": F.col("id"),
    }
    return fuzzy.accepted(sessions, fields, typed)


def _precedence(sort: str, filtering: bool, ranked: bool) -> list[tuple[Column, bool]]:
    return [*([(F.col("filter_score"), True)] if filtering else []), *([(F.col("answer"), True)] if ranked else []), (F.col("favorite"), True), *_by(sort)]


def ordered_keys(sort: str, filtering: bool = False, ranked: bool = False) -> list[Column]:
    """Filter score, answer score and favourites precede the chosen sort, as they apply."""
    return _directed(_precedence(sort, filtering, ranked))


def placed(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """rows with their place in an order, from 1: ranges of the keys are sorted apart, and a range's places start where the ranges before it end."""
    spark = rows.sparkSession
    path = work_dir(spark)
    at = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    at.write.parquet(path)  # a range's bounds are drawn anew by each job
    at = spark.read.schema(at.schema).parquet(path).withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})
    sizes = sorted((r["part"], r["n"]) for r in at.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(starts, "part bigint, start bigint"))
    return at.join(starts, "part").withColumn(name, F.col("start") + F.col("at") + 1).drop("part", "at", "start")


def numbered(sessions: DataFrame, sort: str) -> DataFrame:
    """All sessions with ``line``, their place in a sort."""
    return placed(sessions, ordered_keys(sort), "line")


def _ascending(keys: list[tuple[Column, bool]], dtypes: dict[str, str]) -> Column:
    """A struct that sorts upwards as the keys do, so that a minimum is a group's first row."""
    turned = lambda c, name: ~c if dtypes[name] == "boolean" else -c
    return F.struct(*[F.struct(c.isNull().alias("none"), turned(c, f"o{i}").alias("v")) if down else c.alias(f"o{i}") for i, (c, down) in enumerate(keys)])


def listed(sessions: DataFrame, now: int, sort: str = "recency", typed: str = "", hits: DataFrame | None = None, match_order: bool = True, grouped: bool = False, expanded: DataFrame | None = None, home: str = "", zone: str = "UTC", **passes) -> DataFrame:
    """Rows of the view: row_kind (header, divider, item, sub), label, n and the session's columns, with ``line``, their place.

    expanded: ids whose subagents are shown, oldest first; under a search, those found.
    Headings, items and subagents are sorted once, by ranges of (group, heading first, the
    order's keys, item before its subagents), and get their places from there, so that no
    task sees all rows. Rows come as they lie: sort by ``line`` to show them. Making the
    frame runs that sort.
    """
    s = sessions if "title" in sessions.columns else sessions.withColumn("title", title_of())
    s = filtered(passing(s, now, hits=hits, zone=zone, **passes), typed, home)
    scored = hits is not None
    if scored:
        s = s.join(session_scores(sessions, hits).withColumnRenamed("score", "answer"), "id", "left")
    s = s.withColumn("answer", F.coalesce("answer", F.lit(0.0)) if scored else F.lit(0.0))
    ranked = scored and match_order and not s.where("answer <> 0").isEmpty()
    filtering = bool(fuzzy.Filter.parse(typed).words) and match_order
    order = _precedence(sort, filtering, ranked)
    ups = [f"o{i}" for i in range(len(order))]
    s = s.withColumns({name: c for name, (c, _) in zip(ups, order, strict=True)})
    none = F.lit(None).cast("bigint")
    if grouped:
        s = s.withColumn("folder", F.coalesce(O.folder(F.col("cwd"), F.col("wsx"), home), F.lit("")))
        first = _ascending([(F.col(name), down) for name, (_, down) in zip(ups, order, strict=True)], dict(s.dtypes))
        folders = s.groupBy("folder").agg(F.max("mtime").alias("g0"), F.min(first).alias("g1"), F.count(F.lit(1)).alias("n"))
        groups = [F.desc("g0"), F.asc("g1"), F.asc("folder")]  # newest folder first, then the one whose first session comes first
        s = s.join(folders.drop("n"), "folder")
        heads = folders.select(F.lit("header").alias("row_kind"), F.col("folder").alias("label"), "n", "g0", "g1", "folder")
    elif sort == "recency" and not filtering and not ranked:
        groups = [F.asc("g0")]  # by recency, a band is one run of lines
        band = F.when(F.col("favorite"), "favourites").otherwise(N.date_band(F.col("mtime"), F.lit(now), zone))
        s = s.withColumn("band", band).withColumn("g0", F.array_position(F.lit(list(BANDS)), F.col("band")))
        heads = s.select(F.lit("divider").alias("row_kind"), F.col("band").alias("label"), none.alias("n"), "g0").distinct()
    else:
        groups, heads = [], None
    what, at = [*sessions.columns], ["g0", "g1", "folder"][: len(groups)]
    rows = s.select(F.lit("item").alias("row_kind"), F.col("title").alias("label"), none.alias("n"), *at, *ups, F.lit(None).cast("bigint").alias("sub_at"), F.col("path").alias("sub_path"), *what)
    if expanded is not None:
        above = s.join(expanded.select("id"), "id", "left_semi").select(F.col("id").alias("parent"), *at, *ups)
        kids = sessions.where("is_subagent")
        if scored:
            kids = kids.join(hits.select("path"), "path", "left_semi")
        kids = kids.join(above, "parent")
        label = F.col("title") if "title" in kids.columns else title_of()
        rows = rows.unionByName(kids.select(F.lit("sub").alias("row_kind"), label.alias("label"), none.alias("n"), *at, *ups, F.coalesce("mtime", F.lit(0)).cast("bigint").alias("sub_at"), F.col("path").alias("sub_path"), *what))
    if heads is not None:
        rows = rows.unionByName(heads, allowMissingColumns=True)
    head = F.when(F.col("row_kind").isin("header", "divider"), 0).otherwise(1)
    keys = [*groups, head.asc(), *[F.desc(name) if down else F.asc(name) for name, (_, down) in zip(ups, order, strict=True)], F.asc_nulls_first("sub_at"), F.asc("sub_path")]
    return placed(rows, keys, "line").drop(*at, *ups, "sub_at", "sub_path")


def retained(selected: DataFrame, sessions: DataFrame) -> DataFrame:
    """Picked paths (path) whose session is still there."""
    return selected.join(sessions.select("path").distinct(), "path", "left_semi")


def counters(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("favorite").alias("favourites"), F.count_if(F.col("live_pid").isNotNull()).alias("live"))


def top_recent(sessions: DataFrame, n: int) -> DataFrame:
    """The n newest sessions that can be restored, favourites no different."""
    return sessions.where("NOT is_subagent AND cwd <> ''").orderBy(F.desc("mtime"), "path").limit(n)


def describe(sort: str, grouped: bool = False, favourites: bool = False, live: bool = False, tag: str | None = None, dates: str = "all", typed: str = "") -> str:
    """The view in words."""
    parts = [f"by {sort}", *(["by folder"] if grouped else []), *(["favourites"] if favourites else []), *(["running"] if live else []), *([f"#{tag}"] if tag else [])]
    parts += {"all": [], "today": ["today"]}.get(dates, [f"last {dates}d"])
    return ", ".join([*parts, *([f"/{typed}"] if typed else [])])
