"""What was open: a snapshot folded over boots, and what of it to offer again."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import same_boot

CAP = 24


def kept(observed: DataFrame, stored: DataFrame, cap: int = CAP) -> DataFrame:
    """Entries seen now, then stored ones not seen, at most ``cap``; both have id and ord, their order."""
    unseen = stored.join(observed, "id", "left_anti")
    both = observed.withColumn("src", F.lit(0)).unionByName(unseen.withColumn("src", F.lit(1)))
    return both.orderBy("src", "ord", "id").limit(cap)


def fold(snapshot: DataFrame, observed: DataFrame, boot: str, now: int) -> DataFrame:
    """A one-row snapshot {current, previous} after seeing ``observed`` (one row, an array of entries) under a boot: another boot's current becomes the previous, unless it is empty."""
    s = snapshot.crossJoin(observed.select(F.col("sessions").alias("seen")))  # two single rows
    cur = F.col("current")
    rolled = cur.isNotNull() & ~same_boot(cur["boot"], F.lit(boot))
    unseen = F.filter(F.coalesce(cur["sessions"], F.array()), lambda e: ~F.exists("seen", lambda o: o["id"] == e["id"]))
    carried = F.when(rolled, F.slice(F.col("seen"), 1, CAP)).otherwise(F.slice(F.concat("seen", unseen), 1, CAP))
    new = F.struct(F.lit(boot).alias("boot"), F.lit(now).cast("bigint").alias("saved_at"), carried.alias("sessions"), F.when(rolled, False).otherwise(F.coalesce(cur["dismissed"], F.lit(False))).alias("dismissed"))
    return s.select(new.alias("current"), F.when(rolled & (F.size(cur["sessions"]) > 0), cur).otherwise(F.col("previous")).alias("previous"))


def pending(snapshot: DataFrame, running: DataFrame, sessions: DataFrame) -> DataFrame:
    """Entries of the boot before that were not dismissed, still exist and don't run."""
    e = snapshot.where("previous IS NOT NULL AND NOT previous.dismissed").select(F.posexplode("previous.sessions").alias("ord", "e")).select("ord", "e.*")
    return e.join(running.select("id"), "id", "left_anti").join(sessions.select("id").distinct(), "id", "left_semi").orderBy("ord")


def open_entries(sessions: DataFrame) -> DataFrame:
    """What runs or has a pane, as entries."""
    return sessions.where("live_exact OR has_tmux").select("id", "cwd", "model", F.col("permission_mode").alias("perms"), "title")


def save(snapshot: DataFrame, path: str) -> None:
    row = snapshot.select(F.to_json(F.struct("current", "previous")).alias("j")).first()
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(row.j if row else json.dumps({}))
    os.replace(f"{path}.tmp", path)


# Permission modes and the flags that bring them back.
MODE_FLAGS = {"bypassPermissions": "--dangerously-skip-permissions", "acceptEdits": "--permission-mode acceptEdits", "plan": "--permission-mode plan"}


def mode_flag(mode):
    out = F.lit("")
    for k, v in MODE_FLAGS.items():
        out = F.when(mode == k, v).otherwise(out)
    return out
