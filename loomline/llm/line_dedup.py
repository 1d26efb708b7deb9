"""Reversible, incremental line dedup: sharded cuckoo filters over exact reference counts.

The exact side is two tables, both only ever added to: holders, one row per (line key,
document) with the number of lines, for each inserted batch; and references, a key's
number of holders and the largest one, for the keys that a batch or deletion touched.
A deletion is a table of document ids; what it touches is counted again from the holders
that are left, so that taking documents out restores what they had displaced.

The filters are derived: per shard of keys, a cuckoo filter of 16-bit fingerprints of the
keys with at least ``min_docs`` references. They change in place: a key that reaches the
threshold is inserted, one that falls below is deleted. A document's lines are screened
against them; only positives look up the exact table.

Filters and exact entries of repeated keys go to executors if a count proves them to be
at most BROADCAST_BYTES; beyond that, the screened keys join the exact table in a
shuffle.

A document is a row: rows that repeat an id count each, and all rows of the largest id
keep their lines. Null or empty text is one empty line; a null id counts as a holder and
is largest only if no other id holds the line. Keys are compared by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, U64, Commits, lean, mix, spread_join, stored, work_dir

BROADCAST_BYTES = 64 << 20
SHARD_KEYS = 100_000
SLOTS = 4
SPACE = b" \t\n\x0b\x0c\r"
HOLDER = "hi long, lo long, id long, lines long"


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, in numpy. Keys are 64-bit hashes."""

    def __init__(self, capacity: int, cells: bytes | None = None) -> None:
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.8)))))
        self.cells = np.zeros((self.buckets, SLOTS), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(-1, SLOTS).copy()
        self.buckets = len(self.cells)

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(np.asarray(keys, U64))
        finger = ((h >> U64(48)) | U64(1)).astype(np.uint16)
        first = (h & U64(self.buckets - 1)).astype(np.int64)
        return finger, first, self._other(first, finger)

    def _other(self, bucket: np.ndarray, finger: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(finger.astype(U64)) & U64(self.buckets - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        """Adds distinct keys: in rounds, one key a bucket; a full bucket hands a random entry on to its other place. Raises OverflowError if they don't fit."""
        finger, here, other = self._where(keys)
        rng = np.random.default_rng(len(finger))
        for turn in range(2000):
            if not len(finger):
                return
            for second in (False, True):
                bucket, one = np.unique(other if second else here, return_index=True)
                free = self.cells[bucket] == 0
                fits = free.any(axis=1)
                bucket, one = bucket[fits], one[fits]
                self.cells[bucket, free[fits].argmax(axis=1)] = finger[one]
                rest = np.ones(len(finger), bool)
                rest[one] = False
                finger, here, other = finger[rest], here[rest], other[rest]
            if len(finger) and turn % 2:
                bucket, one = np.unique(here, return_index=True)
                slot = rng.integers(0, SLOTS, len(bucket))
                out = self.cells[bucket, slot].copy()
                self.cells[bucket, slot] = finger[one]
                finger[one], here[one], other[one] = out, self._other(bucket, out), bucket
                if (out == 0).any():
                    real = finger != 0
                    finger, here, other = finger[real], here[real], other[real]
        if len(finger):
            raise OverflowError("the filter is full")

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        for finger, *places in zip(*self._where(keys), strict=True):
            for b in places:
                slot = np.flatnonzero(self.cells[b] == finger)
                if len(slot):
                    self.cells[b, slot[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        finger, first, second = self._where(keys)
        return (self.cells[first] == finger[:, None]).any(axis=1) | (self.cells[second] == finger[:, None]).any(axis=1)


def filled(keys: np.ndarray) -> Cuckoo:
    """A filter of distinct keys, doubled until they fit."""
    capacity = max(16, len(keys))
    while True:
        f = Cuckoo(capacity)
        try:
            f.insert(keys)
            return f
        except OverflowError:
            capacity *= 2


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The lines of a text, and for each the 128-bit hash of its key as two signed longs; None if the key is shorter than min_chars code points."""
    lines, keys = text.split(b"\n"), []
    digest = xxhash.xxh3_128_intdigest
    for line in lines:
        key = line.strip(SPACE).lower()
        n = len(key)
        if n < min_chars or n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            keys.append(None)
        else:
            h = digest(key)
            keys.append((_signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)))
    return lines, keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def holders(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """One row per line key and row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own: dict[tuple[int, int], int] = {}
                for h in line_keys(t.as_py() or b"", min_chars)[1]:
                    if h:
                        own[h] = own.get(h, 0) + 1
                for (hi, lo), n in own.items():
                    for column, x in zip(out, (hi, lo, k, n), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["hi", "lo", "id", "lines"])

    return docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(lean(run), HOLDER)


REFERENCE = "hi long, lo long, refs long, largest long"
#: Runs of the reference table that are read together; one more merges them.
RUNS = 8


class LineStore:
    """Inserted batches, deletions, reference counts and filters under one shared folder.

    A commit names all tables that make up the state after it, so a store opened again on
    its folder goes on where the last commit ended. An insertion or deletion regroups the
    keys that it touches and no others: their new counts are a run of the reference table,
    where a key's latest run holds. More than RUNS runs are merged into one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = 40, min_docs: int = 5) -> None:
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.log = Commits(spark, path or work_dir(spark))
        if any((c["min_chars"], c["min_docs"]) != (min_chars, min_docs) for c in self.log.all()[:1]):
            raise ValueError(f"the store in {self.path} was made with other limits")

    @property
    def path(self) -> str:
        return self.log.path

    @property
    def state(self) -> dict:
        done = self.log.all()
        return done[-1] if done else {"holders": [], "removed": [], "references": [], "repeated": None, "filters": None, "shards": 1, "n": 0}

    def _write(self, df: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = self.log.table(name)
        return path.rpartition("/")[2], stored(df, path)

    def _table(self, name: str | None, schema: str) -> DataFrame:
        read = self.spark.read.schema(schema)
        return read.parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], schema)

    def _runs(self, runs: list, schema: str) -> DataFrame:
        """The tables of (name, commit) pairs with the number of the commit."""
        out = self._table(None, f"{schema}, at int")
        for name, at in runs:
            out = out.unionAll(self._table(name, schema).withColumn("at", F.lit(at)))
        return out

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Adds the lines of a batch's documents."""
        old, after = self.state, len(self.log.all())
        name, batch = self._write(holders(docs, key, text, self.min_chars), "holders")
        more = batch.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs"), F.max("id").alias("largest"))
        if old["references"]:
            more = stored(more)
            before = self._latest(old["references"], more).select("hi", "lo", F.col("refs").alias("had"), F.col("largest").alias("had_largest"))
            more = more.join(before, ["hi", "lo"], "left").select("hi", "lo", (F.col("refs") + F.coalesce("had", F.lit(0))).alias("refs"), F.greatest("largest", "had_largest").alias("largest"))
        self._commit(old, after, more, {"holders": [*old["holders"], [name, after]]})

    def delete(self, ids: DataFrame, key: str = "doc_id") -> None:
        """Takes the named documents out, as far as inserted before; a later insert brings them back."""
        old, after = self.state, len(self.log.all())
        name, ids = self._write(ids.select(ids[key].cast("long").alias("id")).where("id IS NOT NULL").distinct(), "removed")
        few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        live = self.held()
        touched = stored(live.join(few, "id", "left_semi").select("hi", "lo").distinct())
        left = live.join(few, "id", "left_anti").join(touched, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs"), F.max("id").alias("largest"))
        now = touched.join(left, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"), "largest")
        self._commit(old, after, now, {"removed": [*old["removed"], [name, after]]})

    def held(self) -> DataFrame:
        """The holders that count now: those of no document that was taken out after they came."""
        now = self.state
        rows = self._runs(now["holders"], HOLDER)
        if now["removed"]:
            gone = self._runs(now["removed"], "id long").groupBy("id").agg(F.max("at").alias("gone_at"))
            rows = rows.join(gone, "id", "left").where("gone_at IS NULL OR gone_at < at")
        return rows.select("hi", "lo", "id", "lines")

    def _latest(self, runs: list, touched: DataFrame | None = None) -> DataFrame:
        """Reference counts by each key's latest run; touched: of these keys alone."""
        rows = self._runs(runs, REFERENCE)
        if touched is not None:
            rows = rows.join(touched.select("hi", "lo"), ["hi", "lo"], "left_semi")
        if len(runs) > 1:
            rows = rows.groupBy("hi", "lo").agg(F.max_by(F.struct("refs", "largest"), "at").alias("x")).select("hi", "lo", "x.refs", "x.largest")
        return rows.select("hi", "lo", "refs", "largest")

    def references(self) -> DataFrame:
        """(hi, lo, refs, largest): the exact reference counts of all keys that are held."""
        return self._latest(self.state["references"]).where("refs > 0")

    def repeated(self) -> DataFrame:
        """The references of keys that at least min_docs documents hold."""
        return self._table(self.state["repeated"], REFERENCE)

    def filters(self) -> DataFrame:
        return self._table(self.state["filters"], "shard int, cells binary")

    def _commit(self, old: dict, after: int, now: DataFrame, more: dict) -> None:
        """Takes the new references of touched keys into the exact tables and the filters."""
        run, now = self._write(now, "references")
        runs = [*old["references"], [run, after]]
        before, often = self.repeated(), F.col("refs") >= self.min_docs
        kept = before.join(now, ["hi", "lo"], "left_anti") if old["repeated"] else before
        repeated, heavy = self._write(kept.unionAll(now.where(often).select(*before.columns)), "repeated")
        n = heavy.count()
        shards, fresh = max(1, -(-n // SHARD_KEYS)), old["filters"] is None
        if fresh or shards > 2 * old["shards"]:
            fresh = True
        else:
            shards = old["shards"]
        at = F.pmod("hi", F.lit(shards)).cast("int").alias("shard")
        keys = lambda df, add: df.select(at, "hi", "lo", F.lit(add).alias("add"))
        if fresh:
            filled_in, cells = keys(heavy, True), self._table(None, "shard int, cells binary")
        else:
            up = now.where(often).join(before, ["hi", "lo"], "left_anti")
            down = before.join(now.where(~often), ["hi", "lo"], "left_semi")
            filled_in, cells = keys(up, True).unionAll(keys(down, False)), self.filters()
        new = cells.groupBy("shard").cogroup(filled_in.groupBy("shard")).applyInPandas(_changed, "shard int, cells binary, full boolean")
        filters, new = self._write(new, "filters")
        if new.where("full").limit(1).count():  # a filter that overflows is filled anew from its shard of the exact table
            again = keys(heavy, True).join(new.where("full").select("shard"), "shard", "left_semi").groupBy("shard").applyInPandas(_refilled, "shard int, cells binary")
            filters, _ = self._write(new.where("NOT full").select("shard", "cells").unionAll(again), "filters")
        if len(runs) > RUNS:
            runs = [[self._write(self._latest(runs).where("refs > 0"), "references")[0], after]]
        state = {"holders": old["holders"], "removed": old["removed"]} | more
        self.log.add(after, state | {"references": runs, "repeated": repeated, "filters": filters, "shards": shards, "n": n, "min_chars": self.min_chars, "min_docs": self.min_docs})

    def clean(self, docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """One row per row of docs: id, text (kept lines), n_lines, n_dropped, rest (a struct of docs' other columns)."""
        others = [docs[c] for c in docs.columns if c not in (key, text)]
        rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
        d = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"), rest.alias("rest"))
        if self.state["n"] * 32 <= broadcast_bytes:
            return self._clean_here(d)
        return self._clean_joined(d)

    def _clean_here(self, d: DataFrame) -> DataFrame:
        """With the filters and exact entries of all repeated keys on each executor, as sorted arrays; their size is checked."""
        cells = {r.shard: bytes(r.cells) for r in self.filters().collect()}
        shared = self.spark.sparkContext.broadcast((cells, Largest.of(self.repeated())))
        shards, min_chars = self.state["shards"], self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, exact = shared.value
            filters = {s: Cuckoo(0, c) for s, c in cells.items()}
            for batch in batches:
                docs = [line_keys(t.as_py() or b"", min_chars) for t in batch.column(1).cast(pa.binary())]
                ids = batch.column(0).to_pylist()
                every = [(*h, i) for i, (_, keys) in enumerate(docs) for h in keys if h]
                maybe = np.flatnonzero(screen(filters, shards, [h[:2] for h in every]))
                found = exact.find([every[j][:2] for j in maybe])
                gone = np.zeros(len(every), bool)
                for j, at in zip(maybe, found, strict=True):
                    gone[j] = at >= 0 and exact.id_of(at) != ids[every[j][2]]
                rows, i = [], 0
                for k, (lines, keys) in zip(ids, docs, strict=True):
                    kept = []
                    for line, h in zip(lines, keys, strict=True):
                        if h:
                            i += 1
                            if gone[i - 1]:
                                continue
                        kept.append(line)
                    rows.append((k, b"\n".join(kept), len(lines), len(lines) - len(kept)))
                yield _record(rows, batch.column(2))

        return d.mapInArrow(lean(run), T.StructType([*T.StructType.fromDDL(CLEAN).fields, d.schema["rest"]]))

    def _clean_joined(self, d: DataFrame) -> DataFrame:
        """The same by shuffles: screened keys join the exact table, and what a text loses joins it by its content."""
        filters, shards, min_chars = self.filters(), self.state["shards"], self.min_chars
        d = d.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for k, t, b in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                    rows += [(*h, h[0] % shards, k, b) for h in set(line_keys(t.as_py() or b"", min_chars)[1]) if h]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["hi", "lo", "shard", "id", "blob"])

        lines = d.select("id", "text", "blob").mapInArrow(lean(explode), "hi long, lo long, shard int, id long, blob string")
        present = stored(lines.select("shard", "hi", "lo").distinct())
        # shards follow the repeated keys, of which there may be far fewer than keys: a shard's keys meet its filter in parts
        parts = max(1, -(-present.count() // (shards * SHARD_KEYS)))
        present = present.withColumn("part", F.pmod(F.xxhash64("lo", "hi"), F.lit(parts)).cast("int"))
        filters = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        maybe = present.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(_screened, "hi long, lo long")
        exact = stored(self.repeated().join(maybe, ["hi", "lo"], "left_semi").select("hi", "lo", "largest", F.col("refs").alias("hot_n")))
        lost = spread_join(lines, exact.drop("hot_n"), ["hi", "lo"], "inner", counts=exact.select("hi", "lo", "hot_n")).where(~F.col("largest").eqNullSafe(F.col("id"))).select("id", "blob", "hi", "lo").distinct()
        lost = lost.groupBy("id", "blob").agg(F.collect_list(F.struct("hi", "lo")).alias("lost")).select(F.col("id").alias("lost_id"), F.col("blob").alias("lost_blob"), "lost")
        both = d.join(lost, d["id"].eqNullSafe(lost["lost_id"]) & (d["blob"] == lost["lost_blob"]), "left").select("id", "text", "lost", "rest")

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for k, t, lost in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                    lines, keys = line_keys(t.as_py() or b"", min_chars)
                    gone = {(x["hi"], x["lo"]) for x in lost or ()}
                    kept = [line for line, h in zip(lines, keys, strict=True) if h not in gone]
                    rows.append((k, b"\n".join(kept), len(lines), len(lines) - len(kept)))
                yield _record(rows, batch.column(3))

        return both.mapInArrow(lean(drop), T.StructType([*T.StructType.fromDDL(CLEAN).fields, d.schema["rest"]]))


@dataclass(frozen=True)
class Largest:
    """The largest holder of each repeated key, by (lo, hi) ascending; named: whether it has an id."""

    lo: np.ndarray
    hi: np.ndarray
    id: np.ndarray
    named: np.ndarray

    @classmethod
    def of(cls, repeated: DataFrame) -> "Largest":
        t = repeated.select("lo", "hi", F.coalesce("largest", F.lit(0)).alias("id"), F.col("largest").isNotNull().alias("named")).toPandas()
        lo, hi = t["lo"].to_numpy(np.int64), t["hi"].to_numpy(np.int64)
        by = np.lexsort((hi, lo))
        return cls(lo[by], hi[by], t["id"].to_numpy(np.int64)[by], t["named"].to_numpy(bool)[by])

    def find(self, keys: list[tuple[int, int]]) -> np.ndarray:
        """The places of (hi, lo) keys, -1 where there is none. Keys of equal lo lie side by side."""
        hi, lo = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
        at, out = np.searchsorted(self.lo, lo), np.full(len(lo), -1)
        left = np.arange(len(lo))
        while len(left):
            left = left[at[left] < len(self.lo)]
            left = left[self.lo[at[left]] == lo[left]]
            same = self.hi[at[left]] == hi[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return out

    def id_of(self, at: int) -> int | None:
        return int(self.id[at]) if self.named[at] else None


CLEAN = "id long, text string, n_lines long, n_dropped long"


def _record(rows: list[tuple], rest: pa.Array) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()).cast(pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), rest], names=["id", "text", "n_lines", "n_dropped", "rest"])


def screen(filters: dict[int, Cuckoo], shards: int, keys: list[tuple[int, int]]) -> np.ndarray:
    """Which keys their shard's filter may hold."""
    hi = np.array([h for h, _ in keys], np.int64)
    lo = np.array([x for _, x in keys], np.int64).view(U64)
    out, shard = np.zeros(len(hi), bool), hi % shards
    for s, f in filters.items():
        mine = shard == s
        if mine.any():
            out[mine] = f.contains(lo[mine])
    return out


def _changed(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after insertions and deletions."""
    shard = int((old if len(old) else change)["shard"].iloc[0])
    add = change.loc[change["add"], "lo"].to_numpy(np.int64).view(U64)
    gone = change.loc[~change["add"].astype(bool), "lo"].to_numpy(np.int64).view(U64)
    full = False
    if len(old):
        f = Cuckoo(0, old["cells"].iloc[0])
        f.delete(gone)
        try:
            f.insert(add)
        except OverflowError:
            full = True
    else:
        f = filled(add)
    return pd.DataFrame({"shard": [shard], "cells": [f.cells.tobytes()], "full": [full]})


def _refilled(keys: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "cells": [filled(keys["lo"].to_numpy(np.int64).view(U64)).cells.tobytes()]})


def _screened(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(filters) or not len(keys):
        return keys[["hi", "lo"]].iloc[:0]
    return keys.loc[Cuckoo(0, filters["cells"].iloc[0]).contains(keys["lo"].to_numpy(np.int64).view(U64)), ["hi", "lo"]]


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """A store of one batch, cleaned against itself: (id, text, n_lines, n_dropped) per row."""
    store = LineStore(docs.sparkSession, None, min_chars, min_docs)
    store.insert(docs, key, text)
    return store.clean(docs, key, text)

