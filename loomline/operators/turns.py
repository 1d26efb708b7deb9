"""Turns of a transcript, and previews of its last ones."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spot
from ..functions import text as X
from ..sources import transcripts
from ..sources.storage import work_dir
from .lines import parsed_content


def extract(lines: DataFrame) -> DataFrame:
    """(path, offset, role, text): what was said, by ``you`` or the ``assistant``; a tool call is its name in brackets. Injected and empty turns are left out."""
    raw, top, role, said = F.col("raw"), F.col("_json"), F.col("_role"), F.col("_said")
    t = lines.withColumn("_mended", F.when(raw.contains("\\u"), X.mend_surrogates(raw)).otherwise(raw))
    t = t.withColumn("_json", F.from_json("_mended", "type string, isMeta boolean, message struct<content:string>", X.LONG))
    turn = top["type"].isin("user", "assistant") & ~F.coalesce(top["isMeta"], F.lit(False))
    t = t.withColumn("_role", F.when(turn, F.when(top["type"] == "user", "you").otherwise("assistant")))
    plain, blocks = parsed_content(top["message"]["content"], F.col("_mended"))
    spoken = F.filter(blocks, lambda b: (b["type"] == "tool_use") | (b["type"] == "text") & ((role != "you") | X.is_real_user_text(b["text"])))
    text = F.coalesce(plain, F.array_join(F.transform(spoken, lambda b: F.when(b["type"] == "tool_use", F.concat(F.lit("["), b["name"], F.lit("]"))).otherwise(b["text"])), " "), F.lit(""))
    t = t.withColumn("_said", F.when(role.isNotNull(), X.trimmed(text)))
    # one row a line: conditions on what is exploded aren't moved before it, where a line would be parsed again for each
    t = t.select("path", "offset", F.explode(F.array(F.struct(role.alias("role"), said.alias("text")))).alias("t")).select("path", "offset", "t.role", "t.text")
    return t.where((F.col("text") != "") & ((F.col("role") != "you") | X.is_real_user_text(F.col("text"))))


def last(turns: DataFrame, n: int, key: str = "path", order: str = "offset") -> DataFrame:
    """The last n turns of each transcript, with ``turn_no`` from the first of them and ``more`` if there are others before."""
    w = W.partitionBy(key)
    t = turns.withColumn("back", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("back") <= n + 1)
    t = t.withColumn("more", F.max("back").over(w) > n).where(F.col("back") <= n)
    return t.withColumn("turn_no", F.row_number().over(w.orderBy(order))).drop("back")


def preview(turns: DataFrame, query: str = "", n: int = 8) -> DataFrame:
    return last(turns, n).withColumn("text", spot.shown(F.col("text"), query))


# How many times more of a transcript's end is read if there is no turn in it, and what the viewer reads and shows.
GROWN, VIEW_BYTES, VIEW_TURNS = 8, 8 << 20, 400


def tail_turns(spark: SparkSession, root: str, n: int = 8, tail_bytes: int | None = None) -> DataFrame:
    """The last n turns of each transcript under a root, of all its lines.

    With tail_bytes, for a preview alone: those in so many bytes of the files' ends; a file whose end holds no turn, say within one very long line, is read again from GROWN times as far up, and no further.
    """
    if tail_bytes is None:
        return last(extract(transcripts.read(spark, root, partial="true")), n)
    read = lambda size, files=None: extract(transcripts.read(spark, root, tailBytes=str(size), partial="true", **({"files": json.dumps(files)} if files is not None else {})))
    w = W.partitionBy("path").orderBy(F.desc("offset"))
    path = work_dir(spark)
    read(tail_bytes).withColumn("back", F.row_number().over(w)).where(F.col("back") <= n + 1).drop("back").write.parquet(path)  # files are read once
    found = spark.read.schema("path string, offset long, role string, text string").parquet(path)
    large = transcripts.files(spark, root).where(F.col("size") > tail_bytes).select("path")
    silent = [r.path for r in large.join(found.select("path").distinct(), "path", "left_anti").toLocalIterator()]
    if silent:
        found = found.unionByName(read(tail_bytes * GROWN, silent))
    return last(found, n)


def viewer(spark: SparkSession, root: str, path: str, query: str = "", most: int = VIEW_TURNS, max_bytes: int = VIEW_BYTES) -> DataFrame:
    """A transcript's last ``most`` turns from its last ``max_bytes``, marked and cut for a query, with ``more`` if any were left out."""
    size = os.path.getsize(path)
    t = extract(transcripts.read(spark, root, tailBytes=str(max_bytes), partial="true", files=json.dumps([path])))
    t = last(t, most).withColumn("more", F.col("more") | F.lit(size > max_bytes))
    return marked(t, query).withColumn("text", spot.shown(F.col("text"), query))


def marked(turns: DataFrame, query: str) -> DataFrame:
    """Turns with the number of the query's terms they have, and ``focus`` on the first that has the most."""
    t = turns.withColumn("terms", spot.terms_in(F.col("text"), query))
    w = W.partitionBy("path")
    best = F.min_by("offset", F.struct(-F.col("terms"), "offset")).over(w)
    return t.withColumn("focus", (F.col("terms") > 0) & (F.col("offset") == best))
