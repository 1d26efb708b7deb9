"""The ``transcripts`` data source: append-only JSON-Lines files, in batch and as a stream.

One row per line: path, line_no (null for lines read from the middle of a file), byte
offset, raw text, terminated, bytes (its line break's included). Layout: ``<root>/<project>/<session>.jsonl`` and
``<root>/<project>/<parent>/subagents/*.jsonl``. A last line without its line break is
left unread unless ``partial`` is set, since its writer isn't done.

With the option pushdown (and spark.sql.python.filterPushdown.enabled), conditions on path,
offset and epoch choose files and byte ranges before anything is opened. Spark keeps what one
plan chose with the DataFrame that was read, so each filtered query needs a ``read`` of its own.

Options: path; subagents (true); tailBytes (read each file's end only, from the first
whole line); splitBytes (64 MB): files are cut into byte ranges, each read from after the
first line break in it on to the end of the line that it ends in. line_no then counts from
the range's start and orders with ``offset``. A task reads one range, or, where there are
more than TASKS, ranges of 64 MB in all, so that small files don't cost a task each.

The stream's offset is the consumed length and epoch of every file; a file that shrank,
or whose byte before the offset is no line break, starts over under the next epoch.
Local and mounted paths only; on a cluster the folder is one that all executors mount.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "path string, offset long, line_no long, raw string, terminated boolean, epoch int, bytes long"


def listing(root: str, subagents: bool = True) -> list[str]:
    """Transcript files under a root, parents and subagents, in order."""
    found = glob.glob(f"{glob.escape(root)}/*/*.jsonl")
    if subagents:
        found += glob.glob(f"{glob.escape(root)}/*/*/subagents/*.jsonl")
    return sorted(p for p in found if os.path.isfile(p))


@dataclass
class Span:
    path: str
    start: int
    end: int
    whole: bool  # start is a line's first byte
    partial: bool
    epoch: int = 0


#: Up to so many ranges a task each; of more, a task takes TASK_BYTES at most, an opening counted as so many bytes.
TASKS, TASK_BYTES, OPENING = 64, 64 << 20, 64 << 10


@dataclass
class Task(InputPartition):
    spans: list[Span]


def tasks(spans: list[Span]) -> list[Task]:
    """Ranges dealt to tasks, in order; one task at least."""
    if len(spans) <= TASKS:
        return [Task([x]) for x in spans] or [Task([])]
    cost = lambda x: x.end - x.start + OPENING
    most = min(TASK_BYTES, sum(map(cost, spans)) / TASKS)
    out, held = [Task([])], 0
    for x in spans:
        if out[-1].spans and held + cost(x) > most:
            out.append(Task([]))
            held = 0
        out[-1].spans.append(x)
        held += cost(x)
    return out


def read_spans(spans: list[Span]) -> Iterator[pa.RecordBatch]:
    """The lines of some ranges, in batches of about 4 MB."""
    rows, size = [], 0
    for span in spans:
        for row in lines(span):
            rows.append(row)
            size += row[-1]
            if size > 4 << 20 or len(rows) >= 10_000:
                yield _lines_batch(rows)
                rows, size = [], 0
    if rows:
        yield _lines_batch(rows)


def lines(span: Span) -> Iterator[tuple]:
    """Lines that begin in the span."""
    with open(span.path, "rb", buffering=1 << 20) as f:
        at = span.start
        if not span.whole and at:
            f.seek(at - 1)
            before = f.readline(span.end - at + 1)
            if not before.endswith(b"\n"):
                return  # within one line
            at += len(before) - 1
        else:
            f.seek(at)
        n = 0
        while at < span.end:
            raw = f.readline()
            if not raw:
                return
            ended = raw.endswith(b"\n")
            if not ended and not span.partial:
                return
            yield span.path, at, n, raw.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace"), ended, span.epoch, len(raw)
            at += len(raw)
            n += 1


class TranscriptReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://")
        self.subagents = options.get("subagents", "true").lower() == "true"
        self.partial = options.get("partial", "false").lower() == "true"
        self.tail, self.split = int(options.get("tailbytes", 0)), int(options.get("splitbytes", 64 << 20))
        self.files = json.loads(options["files"]) if "files" in options else None

    def spans(self) -> list[Span]:
        out = []
        for path in self.files if self.files is not None else listing(self.root, self.subagents):
            size = os.path.getsize(path)
            start = max(0, size - self.tail) if self.tail else 0
            cuts = [*range(start, size, self.split), size]
            out += [Span(path, a, b, a == 0, self.partial) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def partitions(self) -> list[Task]:
        return tasks(self.spans())

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return read_spans(partition.spans)


class PushedReader(TranscriptReader):
    """The same, with conditions of the plan: files by path and epoch (0 in batch), byte ranges by offset. Spark still applies those on offsets, as a range begins with a whole line."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.tests: list = []
        self.lo, self.hi = 0, None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name == "path" and isinstance(f, EqualTo):
                self.tests.append(lambda p, v=value: p == v)
            elif name == "path" and isinstance(f, In):
                self.tests.append(lambda p, v=frozenset(f.value): p in v)
            elif name == "path" and isinstance(f, StringStartsWith):
                self.tests.append(lambda p, v=value: p.startswith(v))
            elif name == "epoch" and isinstance(f, EqualTo):
                self.tests.append(lambda p, v=value: v == 0)
            else:
                if name == "offset" and isinstance(value, int):
                    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                        self.lo = max(self.lo, value + isinstance(f, GreaterThan))
                    elif isinstance(f, LessThan):
                        self.hi = value if self.hi is None else min(self.hi, value)
                    elif isinstance(f, LessThanOrEqual):
                        self.hi = value + 1 if self.hi is None else min(self.hi, value + 1)
                yield f

    def spans(self) -> list[Span]:
        whole, self.files = self.files, [p for p in (self.files if self.files is not None else listing(self.root, self.subagents)) if all(t(p) for t in self.tests)]
        spans = super().spans()
        self.files, out = whole, []
        for s in spans:
            start, end = max(s.start, self.lo), s.end if self.hi is None else min(s.end, self.hi)
            if start < end:
                out.append(Span(s.path, start, end, s.whole and start == s.start, s.partial))
        return out


class TranscriptStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://")
        self.subagents = options.get("subagents", "true").lower() == "true"
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        now = {}
        for path in listing(self.root, self.subagents):
            was, epoch = self.known.get(path, (0, 0))
            end, sound = _consumable(path, was)
            now[path] = [end, epoch if sound else epoch + 1]
        self.known = now
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.known = self.known or new
        out = []
        for path, (to, epoch) in new.items():
            was, before = old.get(path, (0, 0))
            begin = was if epoch == before else 0
            if to > begin:
                out.append(Span(path, begin, to, True, False, epoch))
        return tasks(out) if out else []

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return read_spans(partition.spans)

    def commit(self, end: dict) -> None:
        self.known = json.loads(end["files"])


def _consumable(path: str, was: int) -> tuple[int, bool]:
    """The end of the last whole line, and whether the file only grew since ``was``."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        sound = size >= was
        if sound and was:
            f.seek(was - 1)
            sound = f.read(1) == b"\n"
        at = size
        while at > 0:
            begin = max(0, at - (1 << 16))
            f.seek(begin)
            cut = f.read(at - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1, sound
            at = begin
    return 0, sound


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushedReader if options.get("pushdown", "false").lower() == "true" else TranscriptReader)(options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TranscriptStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Transcripts)


def read(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Lines of all transcripts under a root."""
    register(spark)
    return spark.read.format("transcripts").options(path=root, **options).load()


def read_text(spark: SparkSession, root: str) -> DataFrame:
    """The same columns through the built-in text source, for stores that only Spark reads: (path, offset, raw). offset orders a file's lines; an unterminated last line is included."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    at = F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id() % F.lit(1 << 33)
    return t.select(F.col("_metadata.file_path").alias("path"), at.alias("offset"), F.lit(None).cast("long").alias("line_no"), F.col("value").alias("raw"), F.lit(True).alias("terminated"), F.lit(0).alias("epoch"), (F.octet_length("value") + 1).cast("long").alias("bytes"))


# ---- what has changed, found and read in tasks

LISTED = "path string, size long, mtime long"


def listed(spark: SparkSession, root: str, subagents: bool = True, folders_a_task: int = 32) -> DataFrame:
    """(path, size, mtime in milliseconds) of all transcripts: the driver lists the root alone, tasks list the projects' folders."""
    root = root.removeprefix("file://").rstrip("/")
    folders = sorted(e.path for e in os.scandir(root) if e.is_dir() and not e.name.startswith(".")) if os.path.isdir(root) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = glob.glob(f"{glob.escape(folder)}/*.jsonl") + (glob.glob(f"{glob.escape(folder)}/*/subagents/*.jsonl") if subagents else [])
                rows = []
                for p in found:
                    with contextlib.suppress(FileNotFoundError):  # gone since
                        st = os.stat(p)
                        if stat.S_ISREG(st.st_mode):
                            rows.append((p, st.st_size, st.st_mtime_ns // 1_000_000))
                paths, sizes, times = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.int64())], names=["path", "size", "mtime"])

    at = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, -(-len(folders) // folders_a_task)))
    return at.mapInArrow(run, LISTED)


def unread(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, start, stop) of what files (path, ...) have beyond known (path, read_to): up to the end of the last whole line; from the first byte where the file shrank or the byte before isn't a line break. Tasks look into the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, was in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with contextlib.suppress(FileNotFoundError):
                    end, sound = _consumable(path, was)
                    start = was if sound else 0
                    if end > start:
                        rows.append((path, start, end))
            paths, starts, ends = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["path", "start", "stop"])

    at = files.select("path").join(known.select("path", "read_to"), "path", "left").select("path", F.coalesce("read_to", F.lit(0)).cast("long").alias("was"))
    return at.mapInArrow(run, "path string, start long, stop long")


def spans(unread_: DataFrame, split: int = 64 << 20) -> DataFrame:
    """Lines of stretches (path, start, stop), each cut into pieces that tasks read apart."""
    pieces = unread_.withColumn("from", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(split).cast("long"))))
    pieces = pieces.select("path", "start", "from", F.least(F.col("from") + split, "stop").alias("to")).repartition("path", "from")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, begin, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                for row in lines(Span(path, begin, to, begin == start, False)):
                    rows.append(row)
                    size += row[-1]
                    if size > 4 << 20:
                        yield _lines_batch(rows)
                        rows, size = [], 0
                yield _lines_batch(rows)

    return pieces.mapInArrow(run, SCHEMA)


def _lines_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def files(spark: SparkSession, root: str, subagents: bool = True) -> DataFrame:
    """One row per transcript file with its stat and what its path says. Tasks list the folders, so it is as of when it runs."""
    parts = F.split("path", "/")
    part = lambda n: F.element_at(parts, -n)
    f = listed(spark, root, subagents).withColumn("is_subagent", part(2) == "subagents")
    return f.select(
        "path", "size", F.floor(F.col("mtime") / 1000).alias("mtime"), "is_subagent", F.when(F.col("is_subagent"), part(3)).alias("parent"), F.when(F.col("is_subagent"), part(4)).otherwise(part(2)).alias("project_dir"), F.regexp_replace(part(1), r"\.jsonl$", "").alias("id"),
    )


def unchanged(listing_: DataFrame, state: DataFrame) -> DataFrame:
    """Listed files whose stored row has the same size and time: not to be read again."""
    return listing_.join(state.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")


def changed(listing_: DataFrame, state: DataFrame) -> DataFrame:
    return listing_.join(state.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
