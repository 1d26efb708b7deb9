"""Marks and live state over sessions: joins of a large table with small ones.

Sides that a user or a machine keeps by hand (marks, processes, panes, workspaces) are
sent to every task only while their row count is within ``SMALL``; beyond it, or
uncounted, the planner decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

SMALL = 100_000
TAG_PREFIX = "wsx/"


def small(df: DataFrame) -> DataFrame:
    """df as a broadcast side if it is proven to be small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def with_marks(sessions: DataFrame, marks: DataFrame) -> DataFrame:
    s = sessions.join(small(marks.select("id", "favorite", "tags", "note")), "id", "left")
    return s.withColumns({"favorite": F.coalesce("favorite", F.lit(False)), "tags": F.coalesce("tags", F.array().cast("array<string>")), "note": F.coalesce("note", F.lit(""))})


def with_child_counts(sessions: DataFrame) -> DataFrame:
    kids = sessions.where("is_subagent AND parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("subagent_count"))
    return sessions.join(kids, "id", "left").withColumn("subagent_count", F.coalesce("subagent_count", F.lit(0)))


def with_panes(sessions: DataFrame, panes: DataFrame) -> DataFrame:
    """The first pane whose command names a session's id. panes has ``ord``, its order."""
    uuid = r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})"
    named = panes.select(F.lower(F.regexp_extract("start_command", uuid, 1)).alias("id"), "session", "ord").where("id <> ''")
    first = named.groupBy("id").agg(F.min_by("session", "ord").alias("tmux_session"))
    s = sessions.join(small(first), "id", "left")
    return s.withColumns({"has_tmux": F.col("tmux_session").isNotNull(), "tmux_session": F.coalesce("tmux_session", F.lit(""))})


def with_live(sessions: DataFrame, processes: DataFrame) -> DataFrame:
    """live_pid, live_exact, live_in_wsx from processes (pid, cwd, resume_id, model, under_wsx).

    By id where a process names one; else a process's folder goes to the newest session there (of several, the first path) that is no subagent and not so named.
    """
    exact = processes.where("resume_id IS NOT NULL").groupBy(F.col("resume_id").alias("id")).agg(F.min_by(F.struct("pid", F.col("model").alias("live_model"), "under_wsx"), "pid").alias("p"))
    s = sessions.join(small(exact), "id", "left")
    s = s.withColumns({"live_exact": F.col("p").isNotNull(), "model": F.coalesce(F.nullif("model", F.lit("")), F.col("p.live_model"), F.lit(""))})
    near = processes.where("resume_id IS NULL AND cwd <> ''").groupBy("cwd").agg(F.min_by(F.struct("pid", "under_wsx"), "pid").alias("q"))
    free = s.where("NOT is_subagent AND cwd <> '' AND NOT live_exact").join(small(near), "cwd")
    newest = free.groupBy("cwd", "q").agg(F.min_by("path", F.struct(-F.col("mtime"), "path")).alias("path")).select("path", "q")
    s = s.join(newest, "path", "left")
    return s.withColumns({"live_pid": F.coalesce("p.pid", "q.pid"), "live_in_wsx": F.coalesce("p.under_wsx", "q.under_wsx", F.lit(False))}).drop("p", "q")


def ancestors(path: Column) -> Column:
    """A folder and all folders above it."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_prefix(rows: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(path, and the columns of the longest prefix that is the path or a folder above it), per distinct path. An equi join on ancestors, not a theta join."""
    keys = rows.select(path).where(F.col(path) != "").distinct().select(path, F.explode(ancestors(F.col(path))).alias("above"))
    hit = keys.join(small(prefixes.withColumnRenamed(prefix, "above")), "above")
    others = [c for c in prefixes.columns if c != prefix]
    return hit.groupBy(path).agg(F.max_by(F.struct(F.col("above").alias(prefix), *others), F.length("above")).alias("place")).select(path, "place.*")


def path_parts(cwd: Column, root: str) -> tuple[Column, Column, Column]:
    """(repo, slug, rest) of a folder under the workspaces' root, else nulls."""
    rest = F.when(cwd.startswith(f"{root}/"), F.substring(cwd, len(root) + 2, 1 << 30))
    p = F.split(rest, "/", 3)
    first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    good = (first != "") & (second != "")
    return F.when(good, first), F.when(good, second), F.when(good, F.coalesce(F.try_element_at(p, F.lit(3)), F.lit("")))


def with_places(sessions: DataFrame, workspaces: DataFrame, checkouts: DataFrame, root: str) -> DataFrame:
    """wsx: {repo, slug, rest, state, worktree, checkout} of each folder, computed once a folder: live in the longest workspace above it, else archived or unknown by its path under the root."""
    live = longest_prefix(sessions, "cwd", workspaces.select("repo", "slug", F.col("path").alias("worktree")), "worktree")
    folders = sessions.select("cwd").where("cwd <> ''").distinct()
    repo, slug, rest = path_parts(F.col("cwd"), root)
    f = folders.join(live, "cwd", "left").withColumns({"p_repo": repo, "p_slug": slug, "p_rest": rest})
    f = f.withColumn("the_repo", F.coalesce("repo", "p_repo")).join(small(checkouts.withColumnRenamed("repo", "the_repo")), "the_repo", "left")
    is_live = F.col("worktree").isNotNull()
    below = F.regexp_replace(F.expr("substring(cwd, length(worktree) + 1)"), "^/", "")
    known = F.when(F.col("checkout").isNotNull(), "archived").otherwise("unknown")
    place = F.struct(F.col("the_repo").alias("repo"), F.coalesce("slug", "p_slug").alias("slug"), F.when(is_live, below).otherwise(F.col("p_rest")).alias("rest"), F.when(is_live, "live").otherwise(known).alias("state"), "worktree", F.when(~is_live, F.col("checkout")).alias("checkout"))
    f = f.select("cwd", F.when(F.col("the_repo").isNotNull(), place).alias("wsx"))
    return sessions.join(f, "cwd", "left")


def place_label(w: Column) -> Column:
    return F.concat_ws("/", w["repo"], w["slug"], F.nullif(w["rest"], F.lit("")))


def place_tag(w: Column) -> Column:
    return F.concat(F.lit(TAG_PREFIX), X.normalize_tag(w["repo"]))


def folder(s_cwd: Column, wsx: Column, home: str, mark: str = "") -> Column:
    return X.drawable(F.when(wsx.isNotNull(), F.concat(F.lit(mark), place_label(wsx))).otherwise(X.short_cwd(s_cwd, home)))


def with_missing_folders(sessions: DataFrame, existing: DataFrame) -> DataFrame:
    """cwd_missing, from the folders (cwd) found to exist: one look a distinct folder."""
    s = sessions.join(existing.select("cwd", F.lit(True).alias("there")).distinct(), "cwd", "left")
    return s.withColumn("cwd_missing", (F.col("cwd") != "") & F.col("there").isNull()).drop("there")


def with_probed_folders(sessions: DataFrame, states: DataFrame) -> DataFrame:
    """cwd_missing from states (cwd, state), as ``side.folders`` finds them: null where it is unknown whether the folder is there."""
    s = sessions.join(states.select("cwd", "state"), "cwd", "left")
    missing = F.when(F.col("cwd") == "", F.lit(False)).when(F.col("state") == "unknown", F.lit(None)).otherwise(F.col("state") == "missing")
    return s.withColumn("cwd_missing", missing).drop("state")


def orphans(sessions: DataFrame) -> DataFrame:
    """Subagents whose parent is no listed session, or who name none."""
    tops = sessions.where("NOT is_subagent").select(F.col("id").alias("parent"))
    return sessions.where("is_subagent").join(tops, "parent", "left_anti")


def marks_summary(marks: DataFrame, sessions: DataFrame) -> DataFrame:
    """favourites and distinct tags of known sessions, and marks of unknown ones."""
    m = marks.join(sessions.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    known = F.coalesce("known", F.lit(False))
    f = m.agg(F.count_if(known & F.col("favorite")).alias("favourites"), F.count_if(~known).alias("orphans"))
    t = m.where(known).select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag").alias("tags"))
    return f.crossJoin(t)  # two single rows


def resumable(sessions: DataFrame) -> DataFrame:
    """Sessions to resume: a subagent stands for its parent; one row an id."""
    tops = sessions.where("NOT is_subagent")
    kids = sessions.where("is_subagent").select(F.col("parent").alias("id"))
    return tops.join(kids.unionAll(tops.select("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])


def newest_by_worktree(sessions: DataFrame) -> DataFrame:
    """The newest session of each live workspace."""
    w = W.partitionBy("wsx.worktree").orderBy(F.desc("mtime"), "path")
    return sessions.where("wsx.state = 'live' AND NOT is_subagent").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
