"""Queries of the list, its overlays and its sinks, with their SQL.

Orders stand for sessions: every fifth is a subagent of the one before, whose parent now
and then is gone; folders are workspaces by customer; dates tie often, so ties show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import overlay as O
from ..operators import report as R
from ..operators import search as S
from ..operators import snapshot as SN
from ..operators import tags as T
from ..operators import view as V
from ..sources import side
from .base import BANDS, query

NOW = 902_000_000
_UUID = "lpad(o_orderkey::VARCHAR, 8, '0') || '-0000-0000-0000-' || lpad(o_custkey::VARCHAR, 12, '0')"
_SUB = "o_orderkey % 5 = 4"
_S = f"""SELECT o_orderkey, o_custkey, o_totalprice, 'o' || o_orderkey AS id, '/p/' || o_orderkey AS path, {_SUB} AS sub, CASE WHEN {_SUB} THEN 'o' || CASE WHEN o_orderkey % 35 = 4 THEN -1 ELSE o_orderkey - 1 END END AS parent,
 CASE WHEN o_custkey % 11 = 0 THEN '' ELSE '/w/r' || o_custkey % 3 || '/s' || o_custkey % 4 || CASE WHEN o_custkey % 2 = 0 THEN '/sub' ELSE '' END END AS cwd, floor(epoch(o_orderdate))::BIGINT AS mtime, o_orderkey % 13 = 0 AS favorite, 'p' || left(o_orderpriority, 1) AS tag,
 CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey END AS pid, 'order ' || o_custkey AS title FROM orders"""
_DAYS = f"date_diff('day', make_timestamp(mtime * 1000000)::DATE, make_timestamp({NOW}::BIGINT * 1000000)::DATE)"
_SHOWN = f"s AS ({_S}), tops AS (SELECT * FROM s WHERE NOT sub), shown AS (SELECT * FROM tops UNION ALL SELECT * FROM s WHERE sub AND parent NOT IN (SELECT id FROM tops))"


def sessions(t) -> DataFrame:
    o = t("orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    sub = key % 5 == 4
    cwd = F.when(cust % 11 == 0, "").otherwise(F.concat(F.lit("/w/r"), cust % 3, F.lit("/s"), cust % 4, F.when(cust % 2 == 0, "/sub").otherwise("")))
    text = lambda c, v="": F.lit(v).alias(c)
    return o.select(
        F.concat(F.lit("o"), key).alias("id"), F.concat(F.lit("/p/"), key).alias("path"), sub.alias("is_subagent"), F.when(sub, F.concat(F.lit("o"), F.when(key % 35 == 4, F.lit(-1)).otherwise(key - 1))).alias("parent"), cwd.alias("cwd"), F.unix_seconds("o_orderdate").alias("mtime"), (key % 13 == 0).alias("favorite"),
        F.array(F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1)))).alias("tags"), F.when(key % 17 == 0, key).alias("live_pid"), F.concat(F.lit("order "), cust).alias("title"), text("note"), text("git_branch", "main"), text("last_prompt"), text("model"),
        F.lit(None).cast("struct<repo:string,slug:string,rest:string,state:string,worktree:string,checkout:string>").alias("wsx"), F.lit(0).cast("long").alias("first_ts"), F.unix_seconds("o_orderdate").alias("last_ts"), F.floor("o_totalprice").alias("size"), key.alias("entries"), "o_totalprice",
    )


def _hits(t) -> DataFrame:
    return sessions(t).where("o_totalprice > 300000").select("path", F.floor("o_totalprice").cast("double").alias("score"), F.concat(F.lit("said "), "id").alias("excerpt"))


@query(f"WITH {_SHOWN} SELECT path FROM shown WHERE favorite AND {NOW} - mtime <= 90 * 86400")
def list_filter(t):
    return V.passing(sessions(t), NOW, favourites=True, dates="90").select("path")


@query(f"WITH {_SHOWN} SELECT path FROM shown WHERE tag = 'p1' AND pid IS NOT NULL")
def list_tagged_live(t):
    return V.passing(sessions(t), NOW, live=True, tag="p1").select("path")


@query(f"WITH {_SHOWN} SELECT path FROM shown WHERE o_totalprice > 300000 OR id IN (SELECT parent FROM s WHERE sub AND o_totalprice > 300000)")
def list_of_hits(t):
    return V.passing(sessions(t), NOW, hits=_hits(t)).select("path")


_BAND = BANDS.format(d=_DAYS)
_LINES = "SELECT row_kind, label, path, row_number() OVER (ORDER BY {k}) AS line FROM r"


@query(f"WITH {_SHOWN}, o AS (SELECT *, row_number() OVER (ORDER BY favorite DESC, mtime DESC, path) AS ord, CASE WHEN favorite THEN 'favourites' ELSE {_BAND} END AS band FROM shown), r AS (SELECT 'item' AS row_kind, title AS label, path, ord * 3 AS k FROM o UNION ALL SELECT 'divider', band, NULL, min(ord) * 3 - 1 FROM o GROUP BY band) {_LINES.format(k='k')}")
def band_dividers(t):
    return V.listed(sessions(t), NOW).select("row_kind", "label", "path", "line")


@query(f"WITH {_SHOWN}, o AS (SELECT *, row_number() OVER (ORDER BY favorite DESC, mtime DESC, path) AS ord FROM shown), g AS (SELECT cwd, max(mtime) AS newest, min(ord) AS first, count(*) AS n FROM o GROUP BY cwd), r AS (SELECT 'item' AS row_kind, title AS label, path, NULL AS n, newest, first, ord * 3 AS k FROM o JOIN g USING (cwd) UNION ALL SELECT 'header', cwd, NULL, n, newest, first, 0 FROM g) SELECT row_kind, label, path, n, row_number() OVER (ORDER BY newest DESC, first, k) AS line FROM r".replace("NULL AS n, newest", "NULL::BIGINT AS n, newest"))
def group_by_folder(t):
    return V.listed(sessions(t), NOW, grouped=True).select("row_kind", "label", "path", "n", "line")


@query(f"WITH {_SHOWN}, o AS (SELECT *, row_number() OVER (ORDER BY favorite DESC, lower(title), mtime DESC, path) AS ord FROM shown), r AS (SELECT 'item' AS row_kind, title AS label, path, ord * 3 AS k, 0 AS m FROM o UNION ALL SELECT 'sub', c.title, c.path, ord * 3 + 1, c.mtime FROM s c JOIN o ON c.parent = o.id WHERE c.sub AND o.tag = 'p5') {_LINES.format(k='k, m, path')}")
def list_expanded(t):
    s = sessions(t)
    return V.listed(s, NOW, sort="title", expanded=s.where(F.array_contains("tags", "p5")).select("id")).select("row_kind", "label", "path", "line")


_SCORES = "scores AS (SELECT id, max(score) AS score FROM (SELECT unnest(CASE WHEN sub THEN [parent, id] ELSE [id] END) AS id, floor(o_totalprice)::DOUBLE AS score FROM s WHERE o_totalprice > 300000) GROUP BY id)"


@query(f"WITH {_SHOWN}, {_SCORES}, k AS (SELECT parent AS id, arg_min('said ' || id, (-mtime, path)) AS kid FROM s WHERE sub AND o_totalprice > 300000 GROUP BY parent) SELECT shown.id, path, score, CASE WHEN o_totalprice > 300000 THEN 'said ' || shown.id ELSE coalesce(kid, '') END AS excerpt, row_number() OVER (ORDER BY score DESC, mtime DESC, path) AS line FROM shown JOIN scores ON shown.id = scores.id LEFT JOIN k ON shown.id = k.id")
def search_results(t):
    r = S.results(sessions(t), _hits(t))
    return V.placed(r, [F.desc("score"), F.desc("mtime"), F.asc("path")], "line").select("id", "path", "score", "excerpt", "line")


_ANSWERED = f"WITH {_SHOWN}, {_SCORES}, found AS (SELECT shown.*, score FROM shown JOIN scores ON shown.id = scores.id)"


@query(f"{_ANSWERED} SELECT 'item' AS row_kind, title AS label, path, row_number() OVER (ORDER BY score DESC, favorite DESC, mtime DESC, path) AS line FROM found")
def list_ranked(t):
    """Sessions that a search found, best answer first: scores precede favourites and the sort."""
    return V.listed(sessions(t), NOW, hits=_hits(t)).select("row_kind", "label", "path", "line")


@query(f"{_ANSWERED}, o AS (SELECT *, row_number() OVER (ORDER BY favorite DESC, floor(o_totalprice) DESC, mtime DESC, path) AS ord FROM found), g AS (SELECT cwd, max(mtime) AS newest, min(ord) AS first, count(*) AS n FROM o GROUP BY cwd), r AS (SELECT 'item' AS row_kind, title AS label, path, NULL::BIGINT AS n, newest, first, ord * 3 AS k, 0 AS m FROM o JOIN g USING (cwd) UNION ALL SELECT 'header', cwd, NULL, n, newest, first, 0, 0 FROM g UNION ALL SELECT 'sub', c.title, c.path, NULL, newest, first, ord * 3 + 1, c.mtime FROM s c JOIN o ON c.parent = o.id JOIN g ON o.cwd = g.cwd WHERE c.sub AND c.o_totalprice > 300000) SELECT row_kind, label, path, n, row_number() OVER (ORDER BY newest DESC, first, k, m, path) AS line FROM r")
def list_found_by_folder(t):
    """What a search found in the list's own order, by folder, with the subagents that were found below their parents."""
    s = sessions(t)
    return V.listed(s, NOW, sort="size", hits=_hits(t), match_order=False, grouped=True, expanded=s.select("id")).select("row_kind", "label", "path", "n", "line")


@query(f"WITH {_SHOWN}, f AS (SELECT * FROM shown WHERE contains(title, '12')) SELECT title AS label, path, row_number() OVER (ORDER BY favorite DESC, cwd, mtime DESC, path) AS line FROM f WHERE NOT contains(title, '99') AND tag <> 'p3'")
def list_typed(t):
    """What a typed filter accepts, in the list's own order."""
    return V.listed(sessions(t), NOW, sort="folder", typed="'12 !99 !p3", match_order=False).select("label", "path", "line")


@query(f"WITH s AS ({_S}) SELECT count(*) AS sessions, count(*) FILTER (favorite) AS favourites, count(pid) AS live FROM s")
def list_counters(t):
    return V.counters(sessions(t))


@query(f"WITH {_SHOWN} SELECT DISTINCT t.id FROM tops t JOIN s ON t.id = s.parent OR (t.id = s.id) WHERE s.tag = 'p2'")
def resumable(t):
    s = sessions(t)
    named = s.where(F.array_contains("tags", "p2"))
    all_of = s.where("NOT is_subagent").join(named.where("is_subagent").select(F.col("parent").alias("id")).unionAll(named.where("NOT is_subagent").select("id")).distinct(), "id", "left_semi")
    return O.resumable(all_of.unionByName(named.where("is_subagent"))).select("id")


@query(f"WITH s AS ({_S}) SELECT cwd, arg_min(path, (-mtime, path)) AS path, max(pid) AS n FROM s WHERE NOT sub AND cwd <> '' AND pid IS NULL GROUP BY cwd".replace(", max(pid) AS n", ""))
def newest_per_folder(t):
    """Processes that name no session go to their folder's newest one; some name theirs."""
    s = sessions(t).drop("live_pid")
    exact = s.where("substring(id, 2) % 17 = 0").select(F.expr("cast(substring(id, 2) as int)").alias("pid"), F.lit("").alias("cwd"), F.col("id").alias("resume_id"), F.lit("m").alias("model"), F.lit(False).alias("under_wsx"))
    near = s.where("cwd <> ''").select("cwd").distinct().select(F.lit(5).alias("pid"), "cwd", F.lit(None).cast("string").alias("resume_id"), F.lit(None).cast("string").alias("model"), F.lit(True).alias("under_wsx"))
    live = O.with_live(s, exact.unionByName(near))
    return live.where("live_pid IS NOT NULL AND NOT live_exact").select("cwd", "path")


@query(f"WITH s AS ({_S}) SELECT id, pid::INT AS pid FROM s WHERE pid IS NOT NULL")
def live_by_id(t):
    s = sessions(t).drop("live_pid")
    exact = s.where("substring(id, 2) % 17 = 0").select(F.expr("cast(substring(id, 2) as int)").alias("pid"), F.lit("").alias("cwd"), F.col("id").alias("resume_id"), F.lit("m").alias("model"), F.lit(False).alias("under_wsx"))
    return O.with_live(s, exact).where("live_exact").select("id", F.col("live_pid").alias("pid"))


_WORKTREES = "SELECT 'r' || i AS repo, 's' || j AS slug, '/w/r' || i || '/s' || j AS path FROM range(2) a(i), range(3) b(j)"


def _placed(t) -> DataFrame:
    spark = t("orders").sparkSession
    live = spark.createDataFrame([(f"r{i}", f"s{j}", "b", f"/w/r{i}/s{j}") for i in range(2) for j in range(3)], "repo string, slug string, branch string, path string")
    repos = spark.createDataFrame([("r0", "/src/r0"), ("r1", "/src/r1")], "repo string, checkout string")
    return O.with_places(sessions(t).drop("wsx"), live, repos, "/w")


_PARTS = "regexp_extract(cwd, '^/w/([^/]+)/([^/]+)/?(.*)$', {n})"
_PLACES = f"SELECT path, mtime, sub, nullif({_PARTS.format(n=1)}, '') AS repo, nullif({_PARTS.format(n=2)}, '') AS slug, CASE WHEN cwd <> '' THEN {_PARTS.format(n=3)} END AS rest, w.path IS NOT NULL AS live, w.path AS worktree FROM ({_S}) s LEFT JOIN ({_WORKTREES}) w ON cwd = w.path OR starts_with(cwd, w.path || '/')".replace("SELECT path,", "SELECT s.path,")


@query(f"SELECT path, repo, slug, rest, CASE WHEN repo IS NULL THEN NULL WHEN live THEN 'live' WHEN repo IN ('r0', 'r1') THEN 'archived' ELSE 'unknown' END AS state, CASE WHEN repo IS NOT NULL THEN concat_ws('/', repo, slug, nullif(rest, '')) END AS label, CASE WHEN repo IS NOT NULL THEN 'wsx/' || repo END AS tag FROM ({_PLACES})")
def workspace_places(t):
    w = F.col("wsx")
    return _placed(t).select("path", w["repo"].alias("repo"), w["slug"].alias("slug"), w["rest"].alias("rest"), w["state"].alias("state"), F.when(w.isNotNull(), O.place_label(w)).alias("label"), O.place_tag(w).alias("tag"))


@query(f"SELECT worktree, arg_min(path, (-mtime, path)) AS path FROM ({_PLACES}) WHERE live AND NOT sub GROUP BY worktree")
def newest_by_worktree(t):
    return O.newest_by_worktree(_placed(t)).select(F.col("wsx.worktree").alias("worktree"), "path")


@query("SELECT o_orderkey, arg_min(p, ord) AS tmux_session FROM (SELECT o_orderkey, 'a' || o_custkey AS p, 1 AS ord FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'b' || o_custkey, 2 FROM orders WHERE o_totalprice > 200000) GROUP BY o_orderkey")
def panes(t):
    o = t("orders").withColumn("id", F.format_string("%08d-0000-0000-0000-%012d", "o_orderkey", "o_custkey"))
    line = lambda mark, pid: F.concat_ws("\t", F.concat(F.lit(mark), "o_custkey"), F.lit(pid), F.concat(F.lit("run --resume "), "id"))
    lines = o.where("o_orderstatus = 'F'").select(line("a", "1").alias("value")).unionAll(o.where("o_totalprice > 200000").select(line("b", "2").alias("value"))).unionAll(o.limit(1).select(F.lit("bad").alias("value")))
    p = side.panes(lines).withColumn("ord", F.col("pid"))
    return O.with_panes(o, p).where("has_tmux").select("o_orderkey", "tmux_session")


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 3 = 1 THEN {_UUID} END AS resume_id, CASE WHEN o_custkey % 3 = 0 THEN 'm' || o_custkey % 4 END AS model FROM orders")
def command_lines(t):
    u = F.format_string("%08d-0000-0000-0000-%012d", "o_orderkey", "o_custkey")
    kind = F.col("o_custkey") % 3
    args = F.when(kind == 1, F.array(F.lit("c"), F.lit("--resume"), u)).when(kind == 2, F.array(F.lit("c"), F.lit("-r"), u, F.lit("--fork-session"))).otherwise(F.array(F.lit("c"), F.lit("--resume"), F.lit("--model"), F.concat(F.lit("m"), F.col("o_custkey") % 4)))
    return t("orders").select("o_orderkey", side.command_line(args).alias("c")).select("o_orderkey", "c.*")


@query("SELECT c_custkey, trim(regexp_replace(c_name, '#', ' ')) AS note, '~/' || c_mktsegment AS folder, 'm-' || c_nationkey AS model, 'mn-' || left(regexp_replace(c_name, '[^A-Za-z0-9_-]', '-', 'g'), 8) AS pane, c_custkey % 2 = 0 AS uuid FROM customer")
def small_texts(t):
    u = F.when(F.col("c_custkey") % 2 == 0, F.format_string("%08d-ABCD-0000-0000-%012d", "c_custkey", "c_nationkey")).otherwise(F.format_string("%08d-ABCD-0000-%012d", "c_custkey", "c_nationkey"))
    note = X.clean_note(F.concat(F.lit(" \t"), F.translate("c_name", "#", "\n"), F.lit("\x07 ")))
    return t("customer").select("c_custkey", note.alias("note"), X.short_cwd(F.concat(F.lit("/home/u/"), "c_mktsegment"), "/home/u").alias("folder"), X.model_short(F.concat(F.lit("claude-m-"), "c_nationkey")).alias("model"), X.tmux_name(F.col("c_name")).alias("pane"), X.looks_like_uuid(u).alias("uuid"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT - CASE WHEN event_id % 3 = 0 THEN 5400 ELSE 0 END AS at, CASE WHEN event_id % 2 = 0 THEN floor(epoch(ts))::BIGINT END AS boot FROM events")
def iso_times(t):
    form = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(F.col("event_id") % 3 == 0, "+01:30").otherwise("Z"))
    boot = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("cpu 1\nbtime "), F.unix_seconds("ts"))).otherwise("none")
    return t("events").select("event_id", N.iso_to_epoch(form).alias("at"), N.boot_time(boot).alias("boot"))


@query("SELECT version, row_number() OVER (ORDER BY a, b, pre, c) AS line FROM (SELECT DISTINCT p_size AS a, p_partkey % 20 AS b, p_partkey % 3 <> 0 AS pre, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 30 ELSE 0 END AS c, p_size || '.' || p_partkey % 20 || CASE WHEN p_partkey % 3 = 0 THEN '-rc.' || p_partkey % 30 ELSE '' END AS version FROM part)")
def semver_order(t):
    pre = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-rc."), F.col("p_partkey") % 30)).otherwise("")
    v = t("part").select(F.concat("p_size", F.lit("."), F.col("p_partkey") % 20, pre).alias("version")).distinct()
    return V.placed(v, [N.semver_key(F.col("version")).asc()], "line")


@query(f"WITH s AS ({_S}) SELECT 'p' || o_orderkey AS path FROM s WHERE o_orderkey % 4 = 0 AND o_totalprice > 200000")
def retained_picks(t):
    picks = t("orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("p"), "o_orderkey").alias("path"))
    return V.retained(picks, t("orders").where("o_totalprice > 200000").select(F.concat(F.lit("p"), "o_orderkey").alias("path")))


_AGE = f"greatest({NOW} - mtime, 0)"
_REL = "CASE WHEN d < 90 THEN d || 's' WHEN d < 5400 THEN d // 60 || 'm' WHEN d < 129600 THEN d // 3600 || 'h' WHEN d < 86400000 THEN d // 86400 || 'd' ELSE d // 31557600 || 'y' END"


@query(f"WITH s AS ({_S}) SELECT {_REL} || chr(9) || cwd || chr(9) || title || chr(9) || id AS value FROM (SELECT *, {_AGE} AS d FROM s)")
def list_lines(t):
    return R.list_lines(sessions(t), NOW)


@query(f"WITH s AS ({_S}) SELECT {_REL} || chr(9) || cwd || chr(9) || title || chr(9) || id || chr(9) || 'a\\tb' AS value FROM (SELECT *, {_AGE} AS d FROM s)")
def search_lines(t):
    return R.search_lines(sessions(t).withColumn("excerpt", F.lit("a\tb")), NOW)


@query(f"""WITH s AS ({_S}) SELECT '{{"id":"' || id || '","title":"' || title || '","cwd":"' || cwd || '","git_branch":"main","model":"","mtime":' || mtime || ',"first_ts":0,"last_ts":' || mtime || ',"size":' || floor(o_totalprice)::BIGINT || ',"entries":' || o_orderkey || ',"favorite":' || favorite || ',"tags":["' || tag || '"],"note":"","live_pid":' || coalesce(pid::VARCHAR, 'null') || ',"wsx":null}}' AS value FROM s""")
def json_lines(t):
    return R.json_lines(sessions(t))


@query("SELECT p_partkey || chr(9) || p_name || chr(9) || p_type AS value FROM part WHERE p_partkey % 3 <> 0")
def plan_lines(t):
    p = t("part").withColumn("p_type", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("\t"))).otherwise(F.col("p_type")))
    return R.plan_lines(p, "p_partkey", "p_name", "p_type")


@query("SELECT tag, n FROM (SELECT 'brand' || p_size AS tag, count(*) AS n FROM part GROUP BY p_size) WHERE starts_with(tag, 'brand1') ORDER BY n DESC, tag LIMIT 8")
def tag_completions(t):
    return T.completions(t("part").select(F.array(F.concat(F.lit("brand"), "p_size")).alias("tags")), "brand1")


@query("SELECT p_partkey, CASE WHEN p_size = 7 THEN ['s8'] WHEN p_size = 8 THEN ['s8'] ELSE list_sort(['s' || p_size, 'x']) END AS tags FROM part".replace("list_sort(['s' || p_size, 'x'])", "['s' || p_size, 'x']").replace("AS tags", "AS names").replace("SELECT p_partkey,", "SELECT p_partkey, array_to_string(").replace(" AS names", ", ',') AS tags"))
def tags_renamed(t):
    own = F.when(F.col("p_size") == 7, F.array(F.lit("s7"), F.lit("s8"))).when(F.col("p_size") == 8, F.array(F.lit("s8"))).otherwise(F.array(F.concat(F.lit("s"), "p_size"), F.lit("x")))
    return T.renamed(t("part").select("p_partkey", own.alias("tags")), "s7", "s8").select("p_partkey", F.array_join("tags", ",").alias("tags"))


@query(f"WITH s AS ({_S}) SELECT id, cwd, title FROM s WHERE pid IS NOT NULL OR o_orderkey % 6 = 0")
def open_entries(t):
    s = sessions(t).withColumns({"live_exact": F.col("live_pid").isNotNull(), "has_tmux": F.col("entries") % 6 == 0, "permission_mode": F.lit("plan")})
    return SN.open_entries(s).select("id", "cwd", "title")


@query(f"WITH s AS ({_S}) SELECT path, cwd <> '' AND NOT (cwd LIKE '/w/r0%') AS cwd_missing FROM s")
def missing_folders(t):
    s = sessions(t)
    return O.with_missing_folders(s, s.where("cwd LIKE '/w/r0%'").select("cwd").distinct()).select("path", "cwd_missing")


@query("SELECT c_custkey::VARCHAR AS id, c_nationkey % 2 = 0 AS favorite, array_to_string(list_sort(list_distinct([lower(c_mktsegment), 'n' || c_nationkey])), ',') AS tags, c_name AS note, (c_nationkey % 2 <> 0 AND c_nationkey % 3 = 0)::INT AS bad FROM customer")
def marks_salvaged(t):
    c = t("customer")
    favorite = F.when(F.col("c_nationkey") % 2 == 0, "true").when(F.col("c_nationkey") % 3 == 0, '"no"').otherwise("false")
    bad = F.col("c_nationkey") % 3 == 0
    entry = F.concat(F.lit('{"favorite":'), favorite, F.lit(',"tags":["'), "c_mktsegment", F.lit('","n'), "c_nationkey", F.lit('"],"note":'), F.concat(F.lit('" '), "c_name", F.lit(' "')), F.when(bad & (F.col("c_nationkey") % 2 == 0), ',"more":1').otherwise(""), F.lit("}"))
    doc = c.select(F.concat(F.lit('{"sessions":{"'), "c_custkey", F.lit('":'), entry, F.lit("}}")).alias("value"), "c_nationkey")
    m = side.marks(doc.select("value"))
    return m.select("id", "favorite", F.array_join("tags", ",").alias("tags"), "note", "bad")
