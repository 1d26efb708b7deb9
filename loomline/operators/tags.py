"""Marks as data: tag sets, patches over what is stored, and the tag-edit language."""

from __future__ import annotations

import json
import os
import re
import shutil
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "array<string>"


def edited(tags: Column, added: Column, removed: Column) -> Column:
    """A sorted set of tags after taking out and putting in."""
    empty = F.array().cast(NONE)
    return F.array_sort(F.array_distinct(F.array_union(F.array_except(F.coalesce(tags, empty), F.coalesce(removed, empty)), F.coalesce(added, empty))))


def merged(marks: DataFrame, patch: DataFrame) -> DataFrame:
    """marks (id, favorite, tags, note) with a patch (id, favorite?, note?, added, removed) applied over what is stored now; empty entries go."""
    m, p = marks.alias("m"), patch.alias("p")
    out = m.join(p, F.col("m.id") == F.col("p.id"), "full_outer").select(
        F.coalesce("m.id", "p.id").alias("id"),
        F.coalesce("p.favorite", "m.favorite", F.lit(False)).alias("favorite"),
        edited(F.col("m.tags"), F.col("p.added"), F.col("p.removed")).alias("tags"),
        F.coalesce("p.note", "m.note", F.lit("")).alias("note"),
    )
    return out.where("favorite OR size(tags) > 0 OR note <> ''")


def renamed(marks: DataFrame, old: str, new: str) -> DataFrame:
    """A tag renamed, or merged into another, everywhere."""
    t = F.array_sort(F.array_distinct(F.transform("tags", lambda x: F.when(x == old, new).otherwise(x))))
    return marks.withColumn("tags", t)


def tag_counts(marks: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n), most used first, then by name."""
    return marks.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def completions(marks: DataFrame, begun: str, most: int = 8) -> DataFrame:
    return tag_counts(marks).where(F.col("tag").startswith(begun)).limit(most)


@dataclass
class TagEdit:
    add: list[str] = field(default_factory=list)
    remove: list[str] = field(default_factory=list)
    rename: list[tuple[str, str]] = field(default_factory=list)
    refused: list[str] = field(default_factory=list)


def normal(tag: str) -> str:
    return re.sub(r"[^\w/.-]", "", re.sub(r"\s", "-", tag.strip().lower()))


def parse_edit(typed: str, reserved: str = "wsx/") -> TagEdit:
    """``a,b c`` adds, ``-a b`` removes all, ``old>new`` renames everywhere; reserved tags can't be given."""
    out = TagEdit()
    typed = typed.strip()
    if ">" in typed:
        old, _, new = (normal(x) if x != ">" else x for x in typed.partition(">"))
        if new.startswith(reserved):
            out.refused.append(new)
        elif old and new:
            out.rename.append((old, new))
        return out
    names = [t for x in re.split(r"[,\s]+", typed.removeprefix("-")) if (t := normal(x))]
    if typed.startswith("-"):
        out.remove = names
    else:
        out.add, out.refused = [t for t in names if not t.startswith(reserved)], [t for t in names if t.startswith(reserved)]
    return out


def applied(marks: DataFrame, chosen: DataFrame, typed: str) -> DataFrame:
    """marks after a tag edit: what it adds or removes is of the chosen sessions (id), also of those without marks so far; a rename is of all. Empty entries go.

    Each id is edited once however often it is chosen; a null id is none. An edit that says nothing leaves the marks as they are.
    """
    edit = parse_edit(typed)
    for old, new in edit.rename:
        marks = renamed(marks, old, new)
    if edit.add or edit.remove:
        names = lambda tags: F.array(*map(F.lit, tags)).cast(NONE)
        ids = chosen.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
        none = lambda kind, c: F.lit(None).cast(kind).alias(c)
        marks = merged(marks, ids.select("id", none("boolean", "favorite"), none("string", "note"), names(edit.add).alias("added"), names(edit.remove).alias("removed")))
    return marks


def save(marks: DataFrame, path: str, backups: int = 3) -> None:
    """The overlay file, written aside and moved into place, the last few kept. marks is what one person keeps."""
    doc = {"sessions": {r.id: {"favorite": r.favorite, "tags": list(r.tags), "note": r.note} for r in marks.orderBy("id").toLocalIterator()}}
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=1)
        f.flush()
        os.fsync(f.fileno())
    for i in range(backups - 1, 0, -1):
        if os.path.exists(f"{path}.{i}"):
            os.replace(f"{path}.{i}", f"{path}.{i + 1}")
    if os.path.exists(path):
        shutil.copy2(path, f"{path}.1")
    os.replace(f"{path}.tmp", path)
