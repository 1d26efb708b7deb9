"""The short listing and its preview: the least that a line-based picker needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .lines import content_blocks
from .turns import last

# Characters of a title and of a message, messages of a preview, and what stands for none.
TITLE, SAID, SHOWN, UNTITLED, NOWHERE = 110, 400, 8, "(no user message)", "?"


def _parsed(lines: DataFrame) -> DataFrame:
    """(path, offset, type, meta, cwd, said) of lines that are JSON: what a message says is its string, or its text blocks joined."""
    top = F.from_json(X.mend_surrogates(F.col("raw")), "type string, isMeta boolean, cwd string", X.LONG)
    plain, blocks = content_blocks(F.col("raw"))
    said = F.coalesce(plain, F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " "), F.lit(""))
    return lines.select("path", "offset", top["type"].alias("type"), F.coalesce(top["isMeta"], F.lit(False)).alias("meta"), top["cwd"].alias("cwd"), X.squash(said, 1 << 30).alias("said"))


def heads(lines: DataFrame) -> DataFrame:
    """(path, cwd, title): the first folder of each transcript and the first thing really asked in it."""
    asked = (F.col("type") == "user") & ~F.col("meta") & X.is_real_user_text(F.col("said"))
    title = F.rtrim(F.left(F.min_by("said", F.when(asked, F.col("offset"))), F.lit(TITLE)))
    cwd = F.min_by("cwd", F.when(F.coalesce("cwd", F.lit("")) != "", F.col("offset")))
    h = _parsed(lines).groupBy("path").agg(cwd.alias("cwd"), F.when(F.count_if(asked) > 0, title).alias("title"))
    return h.select("path", F.coalesce("cwd", F.lit(NOWHERE)).alias("cwd"), F.coalesce("title", F.lit(UNTITLED)).alias("title"))


def listing(heads_: DataFrame, files: DataFrame, now: int, home: str = "") -> DataFrame:
    """(value, mtime, path): a line per transcript that is no subagent's: age, folder, title; then path, id and folder behind tabs."""
    s = files.where("NOT is_subagent").join(heads_, "path", "left").select("path", "id", "mtime", F.coalesce("cwd", F.lit(NOWHERE)).alias("cwd"), F.coalesce("title", F.lit(UNTITLED)).alias("title"))
    short = X.short_cwd(F.col("cwd"), home)
    folder = F.rpad(F.left(short, F.lit(24)), 24, " ")
    folder = F.when(short.rlike(r"[^\x20-\x7E]"), X.fitted(short, 24, pad=True)).otherwise(folder)
    shown = F.concat(F.lpad(N.reltime(F.col("mtime"), F.lit(now)), 8, " "), F.lit("  "), folder, F.lit("  "), F.col("title"))
    return s.select(F.concat_ws("\t", shown, "path", "id", "cwd").alias("value"), "mtime", "path")


def preview(lines: DataFrame) -> DataFrame:
    """(path, turn_no, role, said): the last messages of either side, the beginning of each."""
    m = _parsed(lines).where(F.col("type").isin("user", "assistant") & ~F.col("meta") & X.is_real_user_text(F.col("said")))
    return last(m, SHOWN).select("path", "turn_no", F.col("type").alias("role"), F.left("said", F.lit(SAID)).alias("said"))
