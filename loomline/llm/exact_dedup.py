"""Exact dedup against immutable snapshots, screened by static binary fuse filters.

A snapshot is a Parquet table of distinct SHA-256 digests (count, largest id), dealt
into shards by digest, with one 8-bit 3-wise binary fuse filter a shard. A batch is
grouped by digest first, which collapses its own duplicates (and any hot text, map
side), then each shard's digests meet that shard's filter in cogroups whose size follows
the batch: about 0.4 % of the unseen ones pass by chance. Positives join the snapshot's exact buckets;
negatives are new. Groups of more than one row are confirmed on the bytes: texts
themselves are the grouping key there, and two texts under one digest stop the job.

Defined results: a null text is empty; of equal texts the row with the largest id
stays, a null id losing to any other; rows that repeat id and text count each and are
all reported as the one that stays; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Commits, mix, only, spread_join, stored, work_dir

SHARD_KEYS = 250_000
#: Repeated digests (32 bytes each) that may go to every executor; more of them join in a shuffle.
BROADCAST_DIGESTS = 250_000
FILTER = "shard int, seed long, segment int, segments int, cells binary"


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray:
    """The three cells of each key, in consecutive segments, and its fingerprint."""
    h = mix(keys ^ U64(seed))
    base = ((h >> U64(32)) * U64(segments)) >> U64(32)
    mask = U64(segment - 1)
    cell = [(base + U64(i)) * U64(segment) + ((h >> U64(18 * i)) & mask) for i in range(3)]
    return np.stack(cell).astype(np.int64), ((h ^ (h >> U64(32))) & U64(0xFF)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A static filter over distinct 64-bit keys: (seed, segment length, segments, cells).

    Peeling in waves: every cell that one key alone still uses frees that key; waves
    in reverse fix the fingerprints. A seed that leaves a core is tried no further.
    """
    n = len(keys)
    segment = 1 << int(np.clip(np.floor(np.log(max(n, 4)) / np.log(3.33) + 2.25), 2, 17))
    size = int(np.ceil(max(n, 1) * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4)))))
    segments = max(1, -(-size // segment))
    for seed in range(1, 200):
        cell, finger = _places(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments)
        total = (segments + 2) * segment
        degree = np.bincount(cell.ravel(), minlength=total)
        owner = np.zeros(total, np.int64)
        for c in cell:
            np.bitwise_xor.at(owner, c, np.arange(n))
        waves, left = [], n
        while left:
            lone = np.flatnonzero(degree == 1)
            if not len(lone):
                break
            who, first = np.unique(owner[lone], return_index=True)
            waves.append((who, lone[first]))
            for c in cell[:, who]:
                np.subtract.at(degree, c, 1)
                np.bitwise_xor.at(owner, c, who)
            left -= len(who)
        if left:
            continue
        cells = np.zeros(total, np.uint8)
        for who, at in reversed(waves):
            c = cell[:, who]
            cells[at] = finger[who] ^ cells[c[0]] ^ cells[c[1]] ^ cells[c[2]]
        return seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments, cells.tobytes()
    raise RuntimeError("no seed peels this shard; its keys are not distinct")


def fuse_contains(keys: np.ndarray, seed: int, segment: int, segments: int, cells: bytes) -> np.ndarray:
    c, finger = _places(keys, seed, segment, segments)
    f = np.frombuffer(cells, np.uint8)
    return (f[c[0]] ^ f[c[1]] ^ f[c[2]]) == finger


def digest_keys(digests) -> np.ndarray:
    """The filter's keys: 8 bytes of each digest (others than those that pick the shard)."""
    return np.frombuffer(b"".join(bytes(d)[8:16] for d in digests), "<u8")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, segments, cells = fuse_build(np.unique(digest_keys(pdf["digest"])))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [np.uint64(seed).astype(np.int64)], "segment": [segment], "segments": [segments], "cells": [cells]})


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(batch), bool)
    keys = digest_keys(batch["digest"])
    for f in filters.itertuples():
        hit |= fuse_contains(keys, int(f.seed) % (1 << 64), f.segment, f.segments, f.cells)
    return batch.assign(maybe=hit)[["digest", "n", "max_id", "maybe"]]


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(docs[key].alias("id"), F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256)).alias("digest"))


def grouped(ids: DataFrame) -> DataFrame:
    """Rows a digest: partial counts on the map side, so a hot text is one row a task."""
    return ids.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id"))


class SnapshotStore:
    """Immutable snapshots under ``path``; each has digests and filters, and is never rewritten. A store opened again on its folder has all its snapshots."""

    def __init__(self, spark: SparkSession, path: str | None = None, shard_keys: int = SHARD_KEYS) -> None:
        self.spark, self.shard_keys = spark, shard_keys
        self.log = Commits(spark, path or work_dir(spark))

    @property
    def path(self) -> str:
        return self.log.path

    def _shard(self, df: DataFrame, shards: int) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(shards)).cast("int"))

    def digests(self, snapshot: dict) -> DataFrame:
        return self.spark.read.schema("digest binary, n long, max_id long, shard int").parquet(f"{self.path}/{snapshot['name']}/digests")

    def commit(self, ids: DataFrame) -> None:
        """Adds a snapshot of (id, digest) rows; the number of shards follows its size."""
        after, base = len(self.log.all()), self.log.table("snapshot")
        new = stored(grouped(ids), f"{base}/groups")
        shards = max(1, -(-new.count() // self.shard_keys))
        new = stored(self._shard(new.select("digest", "n", F.col("max_id").cast("long").alias("max_id")), shards), f"{base}/digests")
        new.select("shard", "digest").groupBy("shard").applyInPandas(_build, FILTER).write.parquet(f"{base}/filters")
        self.log.add(after, {"name": base.rpartition("/")[2], "shards": shards})

    def screen(self, groups: DataFrame, snapshot: dict, rows: int) -> DataFrame:
        """groups (digest, n, max_id; ``rows`` of them) with maybe: whether the snapshot's filter passes the digest. A shard's digests meet its filter in as many parts as keep each to about shard_keys."""
        filters = self.spark.read.schema(FILTER).parquet(f"{self.path}/{snapshot['name']}/filters")
        parts = max(1, -(-rows // (snapshot["shards"] * self.shard_keys)))
        mine = self._shard(groups, snapshot["shards"]).withColumn("part", F.pmod(F.conv(F.hex(F.substring("digest", 20, 6)), 16, 10).cast("long"), F.lit(parts)).cast("int"))
        filters = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return mine.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(_screen, "digest binary, n long, max_id long, maybe boolean")

    def match(self, ids: DataFrame) -> DataFrame:
        """Groups of a batch: (digest, n, max_id, old_n, old_max) where old_* come from the snapshots that hold the digest."""
        groups = stored(grouped(ids).select("digest", "n", F.col("max_id").cast("long").alias("max_id")))
        rows, olds = groups.count(), []
        for snapshot in self.log.all():
            positive = self.screen(groups, snapshot, rows).where("maybe").select("digest")
            olds.append(self.digests(snapshot).join(positive, "digest", "left_semi").select("digest", "n", "max_id"))
        if not olds:
            return groups.select("*", F.lit(0).cast("long").alias("old_n"), F.lit(None).cast("long").alias("old_max"))
        old = olds[0]
        for x in olds[1:]:
            old = old.unionAll(x)
        old = old.groupBy("digest").agg(F.sum("n").alias("old_n"), F.max("max_id").alias("old_max"))
        return groups.join(old, "digest", "left").select("digest", "n", "max_id", F.coalesce("old_n", F.lit(0)).alias("old_n"), "old_max")


def confirmed(docs: DataFrame, repeated: DataFrame, key: str, text: str, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """(digest, size, keep_id) of the repeated digests (a stored table), counted on the bytes themselves."""
    if repeated.count() <= broadcast_digests:
        repeated = F.broadcast(repeated)
    t = docs.select(docs[key].alias("id"), F.coalesce(docs[text], F.lit("")).alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    bodies = t.join(repeated, "digest", "left_semi").groupBy("digest", "body").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("keep_id"))
    sure = bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("size"), F.max("keep_id").alias("keep_id"))
    return sure.select("digest", F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error("two texts share a digest").cast("long")).alias("size"), "keep_id")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, digest, keep_id, size, kept.

    The table arrives as two batches (halves by a hash of the key): the first becomes
    a snapshot, the second is matched against it, so every row passes the whole path.
    """
    docs = only(docs, key, text)
    ids = stored(digests(docs, key, text).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")))
    store = SnapshotStore(docs.sparkSession)
    store.commit(ids.where("batch = 0").select("id", "digest"))
    matched = stored(store.match(ids.where("batch = 1").select("id", "digest")))
    repeated = matched.where("n + old_n > 1").select("digest").unionAll(store.digests(store.log.all()[0]).where("n > 1").select("digest")).distinct()
    groups = confirmed(docs, stored(repeated), key, text)
    out = spread_join(ids, stored(groups), "digest")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(key), "digest", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), F.col("id").eqNullSafe(keep).alias("kept"))
