"""Small side inputs: marks, processes, panes, workspaces, snapshots, settings."""

from __future__ import annotations

import json
import os
import stat
import tomllib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

MARKS = "id string, favorite boolean, tags array<string>, note string"
ENTRY = "struct<id:string,cwd:string,model:string,perms:string,title:string>"
SNAPSHOT = f"current struct<boot:string,saved_at:bigint,sessions:array<{ENTRY}>,dismissed:boolean>, previous struct<boot:string,saved_at:bigint,sessions:array<{ENTRY}>,dismissed:boolean>"


def marks(documents: DataFrame, column: str = "value") -> DataFrame:
    """Rows of an overlay document ``{"sessions": {id: {...}}}``, each field salvaged on its own, with the number of fields of a wrong type in ``bad``."""
    doc = F.from_json(documents[column], "sessions map<string,string>")
    rows = documents.select(F.explode(doc["sessions"]).alias("id", "entry"))
    get = lambda k: F.get_json_object("entry", f"$.{k}")
    given = F.from_json("entry", "favorite string, tags string, note string")
    flag = F.when(get("favorite") == "true", True).when(get("favorite") == "false", False)
    tags = F.from_json(get("tags"), "array<string>")
    list_like = get("tags").startswith("[")
    quoted = F.col("entry").rlike(r'"note"\s*:\s*"')
    bad = sum((c.cast("int") for c in (F.coalesce(given["favorite"].isNotNull() & flag.isNull(), F.lit(False)), F.coalesce(given["tags"].isNotNull() & ~list_like, F.lit(False)), F.coalesce(given["note"].isNotNull() & ~quoted, F.lit(False)))), F.lit(0))
    clean_tags = F.array_sort(F.array_distinct(F.filter(F.transform(F.when(list_like, tags), X.normalize_tag), lambda t: t != "")))
    return rows.select("id", F.coalesce(flag, F.lit(False)).alias("favorite"), F.coalesce(clean_tags, F.array().cast("array<string>")).alias("tags"), F.coalesce(F.when(quoted, X.clean_note(get("note"))), F.lit("")).alias("note"), bad.alias("bad"))


def load_marks(spark: SparkSession, path: str) -> DataFrame:
    """An overlay file; one that can't be read as JSON is set aside as ``.unreadable`` and counts as empty."""
    text = "{}"
    if os.path.exists(path):
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
        try:
            json.loads(text)
        except ValueError:
            os.replace(path, f"{path}.unreadable")
            text = "{}"
    return marks(spark.createDataFrame([(text,)], "value string"))


def command_line(args: Column) -> Column:
    """(resume_id, model) that an argument vector names."""
    flags = ("--resume", "-r", "--session-id")

    def value(names: tuple[str, ...]) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(args) - 1), lambda i: args[i].isin(*names) & (i + 1 < F.size(args)) & ~args[i + 1].startswith("-"))
        joined = F.filter(args, lambda a: F.regexp_extract(a, "^(--[a-z-]+)=", 1).isin(*names))
        return F.coalesce(F.when(F.size(at) > 0, args[at[0] + 1]), F.when(F.size(joined) > 0, F.regexp_extract(joined[0], "=(.*)$", 1)))

    forked = F.array_contains(args, "--fork-session")
    rid = value(flags)
    return F.struct(F.when(~forked & X.looks_like_uuid(rid), rid).alias("resume_id"), value(("--model",)).alias("model"))


def panes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(session, pid, start_command) of tab-separated lines; a command may hold tabs."""
    p = F.split(lines[column], "\t", 3)
    return lines.select(p[0].alias("session"), F.get(p, F.lit(1)).try_cast("int").alias("pid"), F.coalesce(F.try_element_at(p, F.lit(3)), F.lit("")).alias("start_command")).where("pid IS NOT NULL")


def workspaces(lines: DataFrame, column: str = "value") -> DataFrame:
    """(repo, slug, branch, path) of tab-separated lines with an absolute path."""
    p = F.split(lines[column], "\t", 4)
    w = lines.where(F.size(p) == 4).select(p[0].alias("repo"), F.get(p, F.lit(1)).alias("slug"), F.get(p, F.lit(2)).alias("branch"), F.regexp_replace(F.get(p, F.lit(3)), "/+$", "").alias("path"))
    return w.where(F.col("path").startswith("/"))


def _is_folder(path: str) -> str:
    try:
        return "present" if stat.S_ISDIR(os.stat(path).st_mode) else "missing"
    except (FileNotFoundError, NotADirectoryError):
        return "missing"
    except (OSError, ValueError):  # not allowed to look, or no path at all
        return "unknown"


def folders(sessions: DataFrame, seconds: float = 2.0) -> DataFrame:
    """(cwd, state: present, missing or unknown) of the sessions' folders, one look a distinct folder, in tasks. One that takes longer than ``seconds``, as on a mount that hangs, is unknown, and so is what the same task would have to wait for behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(8)
        try:
            for batch in batches:
                paths = batch.column(0).to_pylist()
                looks, states = [pool.submit(_is_folder, p) for p in paths], []
                for look in looks:
                    try:
                        states.append(look.result(timeout=seconds))
                    except TimeoutError:
                        states.append("unknown")
                yield pa.record_batch([batch.column(0), pa.array(states, pa.string())], names=["cwd", "state"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return sessions.select("cwd").where("cwd <> ''").distinct().mapInArrow(run, "cwd string, state string")


def repo_checkouts(lines: DataFrame, repos: DataFrame, column: str = "value") -> DataFrame:
    """(repo, checkout): the first padded line of each repo's name followed by an absolute path. lines has line_no."""
    l = lines.select("line_no", F.regexp_extract(lines[column], r"^(\S+)\s+(/.*)$", 1).alias("repo"), F.rtrim(F.regexp_extract(lines[column], r"^(\S+)\s+(/.*)$", 2)).alias("checkout"))
    first = l.where("repo <> ''").groupBy("repo").agg(F.min_by("checkout", "line_no").alias("checkout"))
    return repos.select("repo").distinct().join(first, "repo")


def shared_sessions(lines: DataFrame, column: str = "value") -> DataFrame:
    """The third field of each line, where it says something."""
    name = F.trim(F.try_element_at(F.split(lines[column], "\t"), F.lit(3)))
    return lines.select(name.alias("session")).where("session <> ''").distinct()


def snapshot(documents: DataFrame, column: str = "value") -> DataFrame:
    """A saved snapshot; one that can't be read is empty. Titles are squashed."""
    s = documents.select(F.from_json(documents[column], SNAPSHOT).alias("s")).select("s.*")

    def tidy(name: str) -> Column:
        c = F.col(name)
        return F.when(c.isNotNull(), c.withField("sessions", F.transform(F.coalesce(c["sessions"], F.array().cast(f"array<{ENTRY}>")), lambda e: e.withField("title", X.squash(F.coalesce(e["title"], F.lit("")), 200)))))

    return s.select(tidy("current").alias("current"), tidy("previous").alias("previous"))


# Settings, their defaults.
SETTINGS = {"theme": "auto", "accent": "", "sort": "recency", "group": False, "subagents": False, "preview": True, "animation": True, "days": 0}


def settings(path: str, known: dict = SETTINGS) -> tuple[dict, list[str]]:
    """Settings of a TOML file, one key at a time: a key that is unknown or of a wrong type is reported and the default stays."""
    out, said = dict(known), []
    if not os.path.exists(path):
        return out, said
    with open(path, encoding="utf-8", errors="replace") as f:
        body = f.read()
    try:
        given = tomllib.loads(body)
    except tomllib.TOMLDecodeError:
        given = {}
        for line in body.splitlines():
            try:
                given |= tomllib.loads(line)
            except tomllib.TOMLDecodeError:
                said.append(f"can't read: {line.strip()}")
    for k, v in given.items():
        if k not in known:
            said.append(f"unknown: {k}")
        elif type(v) is not type(known[k]):
            said.append(f"wrong type: {k}")
        else:
            out[k] = v
    return out, said


# Names of the terminal colours.
COLORS = {"black": (0, 0, 0), "red": (205, 0, 0), "green": (0, 205, 0), "yellow": (205, 205, 0), "blue": (0, 0, 238), "magenta": (205, 0, 205), "cyan": (0, 205, 205), "gray": (229, 229, 229), "white": (255, 255, 255)}


def parse_color(s: str) -> tuple[int, int, int] | None:
    """``#rrggbb`` or a name."""
    s = s.strip().lower()
    if len(s) == 7 and s[0] == "#" and all(c in "0123456789abcdef" for c in s[1:]):
        return tuple(bytes.fromhex(s[1:]))
    return COLORS.get(s)
