"""Incremental refresh: only what was appended is read, and segments merge into the state.

The stream of new lines is folded batch by batch, by comparison and not by counting: a
transcript's lines are appended only if they begin where its stored reading ended, and
replace what is stored if they begin at its first byte. Lines that the state has already are
passed over; where the two don't meet (a state or a checkpoint was lost or is of another
time), that transcript is read again from its start. So a batch that is run twice, two
refreshes at once, a deleted checkpoint and a change of logic all end like a fresh scan.

The state is a folder of tables that numbered commits name: segments, prose and the runs of
the growing index land together or not at all. Only what a batch touches is read and written.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import growing, prose, rollup
from ..operators import lines as L
from ..operators.postings import Index
from ..sources import transcripts
from ..sources.storage import Commits, work_dir

#: What the state's values mean; another number has all transcripts read again, beside the old rows.
LOGIC_VERSION = 2
#: Runs of segments that are read together.
RUNS = 8
#: Times that a commit is tried when other writers are first.
TRIES = 5
#: Seconds that a table stays after no commit names it any more, for readers that began before.
RETAINED = 24 * 3600
PROSE = "path string, gen long, seq long, base long, text string"
#: Besides a segment's fields: bytes read, the commit that read it from its start, words and bytes of prose.
OWN = ("read_to", "gen", "words", "said")
#: Size and time of the file when it was read, where a catching up knows them.
SEEN = ("seen_size", "seen_mtime")


class State:
    """Segments, prose and index of all transcripts under ``path``, a folder that the cluster shares.

    A commit names all tables that count after it. Segments are runs: a batch writes those
    of the transcripts that it touches, whole, and a transcript's latest run holds; more
    than RUNS are merged into one.
    """

    def __init__(self, spark: SparkSession, path: str, folded: bool = True) -> None:
        self.spark, self.log, self.folded = spark, Commits(spark, path), folded

    @property
    def path(self) -> str:
        return self.log.path

    def pointer(self) -> dict:
        done = self.log.all()
        return done[-1] if done else {"segments": [], "prose": [], "index": [], "logic": LOGIC_VERSION}

    @property
    def stale(self) -> bool:
        """Whether some rows may be of other logic: still shown, until a refresh has read all again."""
        return self.pointer()["logic"] != LOGIC_VERSION

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))

    def _write(self, df: DataFrame, name: str) -> str:
        path = self.log.table(name)
        df.write.parquet(path)
        return path.rpartition("/")[2]

    def _commit(self, after: int, entry: dict) -> None:
        self.log.add(after, entry | {"at": time.time()})

    def segments(self, touched: DataFrame | None = None, at: dict | None = None) -> DataFrame | None:
        """The latest segments; touched: of these paths alone; at: of that commit."""
        runs = (at or self.pointer())["segments"]
        rows = None
        for i, name in enumerate(runs):
            run = self._read(name) if touched is None else self._read(name).join(touched.select("path"), "path", "left_semi")
            run = run.withColumn("at", F.lit(i))
            rows = run if rows is None else rows.unionByName(run)
        if rows is None or len(runs) == 1:
            return rows.drop("at") if rows is not None else None
        others = [c for c in rows.columns if c not in ("path", "at")]
        return rows.groupBy("path").agg(F.max_by(F.struct(*others), "at").alias("x")).select("path", "x.*")

    def bodies(self) -> DataFrame:
        """(path, text) of the current readings."""
        now = self.pointer()
        if not now["prose"]:
            return self.spark.createDataFrame([], "path string, text string")
        rows = self.spark.read.schema(PROSE).parquet(*map(self._at, now["prose"]))
        rows = rows.join(self.segments(at=now).select("path", "gen"), ["path", "gen"], "left_semi")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
        return rows.groupBy("path").agg(joined.alias("text"))

    def _live(self, at: dict) -> DataFrame:
        seg = self.segments(at=at)
        return seg.where("said > 0").select("path", "gen", F.col("words").alias("dl")) if seg is not None else self.spark.createDataFrame([], growing.LIVE)

    def index(self) -> Index:
        """The index of all prose, as of the latest commit."""
        now = self.pointer()
        return growing.opened(self.spark, [self._at(r["name"]) for r in now["index"]], self._live(now))

    def apply(self, new: DataFrame, reread: Callable[[list[str]], DataFrame] | None = None, seen: DataFrame | None = None) -> None:
        """Lines read on, as far as the state doesn't have them. reread(paths): the whole transcripts, for those that don't meet what is stored; without it they raise ValueError. seen: (path, size, mtime) of the files before they were read."""
        new = new.persist(StorageLevel.DISK_ONLY)
        try:
            for left in reversed(range(TRIES)):
                try:
                    self._apply(new, reread, seen)
                    return
                except RuntimeError:  # another writer was first: what it did is compared with anew
                    if not left:
                        raise
        finally:
            new.unpersist()

    def _told(self, new: DataFrame, seq: int) -> DataFrame:
        """(path, kind, read_to, gen, base, had) of a batch's transcripts: what is to be done with each."""
        reach = new.groupBy("path").agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("bytes")).alias("read_to"))
        old = self.segments(reach)
        had = old.select("path", *[F.col(c).alias(f"old_{c}") for c in OWN]) if old is not None else reach.select("path", *[F.lit(None).cast("long").alias(f"old_{c}") for c in OWN]).limit(0)
        kind = F.when(F.col("first") == 0, "whole").when(F.col("old_read_to") == F.col("first"), "more").when(F.col("old_read_to") >= F.col("read_to"), "known").otherwise("apart")
        r = reach.join(had, "path", "left").withColumn("kind", kind)
        own = lambda c, none: F.when(F.col("kind") == "more", F.col(f"old_{c}")).otherwise(F.lit(none).cast("long"))
        r = r.select("path", "kind", "read_to", own("gen", seq).alias("gen"), own("words", 0).alias("base"), own("said", 0).alias("had"))
        path = work_dir(self.spark)
        r.write.parquet(path)
        return self.spark.read.schema(r.schema).parquet(path)

    def _apply(self, new: DataFrame, reread: Callable[[list[str]], DataFrame] | None, seen: DataFrame | None) -> None:
        now, seq = self.pointer(), len(self.log.all())
        told = self._told(new, seq)
        apart = [r.path for r in told.where("kind = 'apart'").select("path").collect()]
        if apart:
            if reread is None:
                raise ValueError(f"{len(apart)} transcripts don't go on where the state ends, {apart[0]} among them")
            gone = told.where("kind = 'apart'").select("path")
            new = new.join(gone, "path", "left_anti").unionByName(reread(apart).select(*new.columns))
            told = self._told(new, seq)
        todo = told.where("kind IN ('whole', 'more')")
        if todo.isEmpty():
            return
        typed = L.classify(new.join(todo.select("path"), "path", "left_semi"))
        seg = rollup.segments(typed)
        old = self.segments(todo.where("kind = 'more'"))
        if old is not None:
            seg = rollup.merge(old.drop(*OWN, *SEEN), seg)
        text = prose.bodies(typed).join(todo.select("path", "gen", "base"), "path")
        name = self._write(text.select("path", "gen", F.lit(seq).cast("long").alias("seq"), "base", "text"), "prose")
        said = self._read(name)
        run = self.log.table("index")
        words = growing.run_of(said.select("path", "gen", "base", "text"), run, self.folded).select("path", "words")
        size = said.select("path", F.octet_length("text").cast("long").alias("bytes"))
        zero = F.lit(0).cast("long")
        seg = todo.select("path", "read_to", "gen", "base", "had").join(seg, "path", "left").join(words, "path", "left").join(size, "path", "left")
        seg = seg.withColumns({"words": F.col("base") + F.coalesce("words", zero), "said": F.col("had") + F.coalesce("bytes", zero)}).drop("base", "had", "bytes")
        files = seen.select("path", F.col("size").alias("seen_size"), F.col("mtime").alias("seen_mtime")) if seen is not None else None
        seg = seg.join(files, "path", "left") if files is not None else seg.withColumns({c: F.lit(None).cast("long") for c in SEEN})
        runs = [*now["segments"], self._write(seg, "segments")]
        index = [*now["index"], {"name": run.rpartition("/")[2], "tier": 0}]
        self._commit(seq, now | {"segments": runs, "prose": [*now["prose"], name], "index": index})
        self._tidy()

    def _tidy(self) -> None:
        """Merges runs; left to the next refresh if another writer commits meanwhile."""
        try:
            now, after = self.pointer(), len(self.log.all())
            if len(now["segments"]) > RUNS:
                self._commit(after, now | {"segments": [self._write(self.segments(at=now), "segments")]})
                now, after = self.pointer(), len(self.log.all())
            while same := growing.tiers(now["index"]):
                path = self.log.table("index")
                growing.merge(self.spark, [self._at(r["name"]) for r in same], self._live(now), path)
                kept = [r for r in now["index"] if r not in same]
                self._commit(after, now | {"index": [*kept, {"name": path.rpartition("/")[2], "tier": same[0]["tier"] + 1}]})
                now, after = self.pointer(), len(self.log.all())
        except RuntimeError:
            return

    def settle(self) -> None:
        """All transcripts have been read by today's logic."""
        if self.stale:
            self._commit(len(self.log.all()), self.pointer() | {"logic": LOGIC_VERSION})

    def prune(self, files: DataFrame) -> None:
        """Drops transcripts whose file is gone. Searches that began before go on: their tables stay for vacuum()."""
        now, after = self.pointer(), len(self.log.all())
        if now["segments"]:
            there = files.select("path").distinct()
            self._commit(after, now | {"segments": [self._write(self.segments(at=now).join(there, "path", "left_semi"), "segments")]})

    def vacuum(self, retained: float = RETAINED) -> list[str]:
        """Drops tables that no commit has named for ``retained`` seconds, and as old ones that no commit ever named (of writers that failed). Prose of gone transcripts is written anew without them first."""
        now, after = self.pointer(), len(self.log.all())
        if now["prose"]:
            rows = self.spark.read.parquet(*map(self._at, now["prose"])).join(self.segments(at=now).select("path", "gen"), ["path", "gen"], "left_semi")
            self._commit(after, now | {"prose": [self._write(rows, "prose")]})
        named = lambda c: {*c["segments"], *c["prose"], *(r["name"] for r in c["index"])}
        done, limit = self.log.all(), time.time() - retained
        needed = named(done[-1]) if done else set()
        for c, after_ in zip(done, done[1:], strict=False):
            if after_["at"] > limit:  # it counted until then
                needed |= named(c)
        dropped = [name for name, age in self.log.tables() if name not in needed and age >= retained]
        for name in dropped:
            self.log.drop(name)
        return dropped

    def sessions(self, files: DataFrame) -> DataFrame:
        seg = self.segments()
        return rollup.sessions(seg, files) if seg is not None else rollup.sessions(rollup.segments(L.classify(self.spark.createDataFrame([], transcripts.SCHEMA))), files)


def refresh(spark: SparkSession, root: str, state: State) -> State:
    """Reads what was appended since the last refresh; ends when it is all in. Another logic has a checkpoint of its own, so everything is read again and replaces the old rows, which are shown until then."""
    transcripts.register(spark)
    stream = spark.readStream.format("transcripts").option("path", root).load()
    again = lambda paths: transcripts.read(spark, root, files=json.dumps(paths))
    query = stream.writeStream.foreachBatch(lambda df, n: state.apply(df, again)).option("checkpointLocation", f"{state.path}/checkpoint-{LOGIC_VERSION}").trigger(availableNow=True).start()
    query.awaitTermination()
    state.settle()
    return state


def catch_up(spark: SparkSession, root: str, state: State, subagents: bool = True, split: int = 64 << 20) -> State:
    """The same without a stream: what the state has read is where reading goes on.

    Tasks list the folders, look for the last whole line of files whose size or time differs from what was seen, and read from where the state ends; the driver holds no list of files, and no offset names one. A run that fails leaves the state as it was, or with a commit that the next one goes on from.
    """
    files = transcripts.listed(spark, root, subagents)
    path = work_dir(spark)
    files.write.parquet(path)  # one look at the folders
    files = spark.read.schema(transcripts.LISTED).parquet(path)
    known = state.segments()
    if known is None or state.stale:
        known = spark.createDataFrame([], "path string, read_to long, seen_size long, seen_mtime long")
    same = known.select("path", F.col("seen_size").alias("size"), F.col("seen_mtime").alias("mtime"))
    todo = transcripts.unread(files.join(same, ["path", "size", "mtime"], "left_anti"), known)
    path = work_dir(spark)
    todo.write.parquet(path)
    todo = spark.read.schema("path string, start long, stop long").parquet(path)
    again = lambda paths: transcripts.read(spark, root, files=json.dumps(paths))
    if not todo.isEmpty():
        state.apply(transcripts.spans(todo, split), again, files)
    state.settle()
    return state


def changed_sessions(scanned: DataFrame, cached: DataFrame) -> DataFrame:
    """Scanned rows that differ from what is stored, or are new."""
    c = cached.select("path", *[F.col(x).alias(f"c_{x}") for x in ("size", "mtime", "scanned_len")])
    same = (F.col("size") == F.col("c_size")) & (F.col("mtime") == F.col("c_mtime")) & (F.col("scanned_len") == F.col("c_scanned_len"))
    return scanned.join(c, "path", "left").where(~F.coalesce(same, F.lit(False))).select(*scanned.columns)
