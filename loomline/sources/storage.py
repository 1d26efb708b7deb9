"""Work tables in the folder that the cluster shares, and stores that are added to by commits."""

from __future__ import annotations

import contextlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


_owners: list[str] = []


@contextlib.contextmanager
def owned(spark: SparkSession) -> Iterator[str]:
    """Work tables that are made inside are taken away at its end, so what is to last is written inside too:

    with owned(spark):
        corpus_pipeline.run(spark, folder).write.parquet(result)
    """
    path = work_dir(spark)
    _owners.append(path)
    try:
        yield path
    finally:
        _owners.remove(path)
        drop(spark, path)


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or under the innermost ``owned``'s. Where that is unset, a local one if the session runs on this machine alone (tests); on a cluster an error, as executors wouldn't see each other's files."""
    if _owners:
        return f"{_owners[-1]}/{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomline/{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Takes a folder away."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def versions(spark: SparkSession, paths: list[str]) -> tuple:
    """(path, size, time) of files: another version of a file differs in one of them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in sorted(paths):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(p))
        status = at.getFileSystem(conf).getFileStatus(at)
        out.append((p, status.getLen(), status.getModificationTime()))
    return tuple(out)


class Commits:
    """What a store in a shared folder holds: one small JSON file a commit, numbered from 0.

    A commit's tables are written first, under names of their own; its file comes last,
    moved to the next number in one step that fails if another writer has taken it. So a
    store opened again, by anyone, finds every commit that ended and no other, and nothing
    is ever overwritten. Tables of a commit that failed are never named and never read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        self.path = at.getFileSystem(self._conf).makeQualified(at).toString().rstrip("/")
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        self._plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no option: what exists is not replaced
        self._read: list[dict] = []

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits/{name}" if name else f"{self.path}/_commits")

    def table(self, name: str) -> str:
        """A new place for a table."""
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def all(self) -> list[dict]:
        """The commits so far, in order; only new ones are read."""
        while (entry := self._load(len(self._read))) is not None:
            self._read.append(entry)
        return list(self._read)

    def _load(self, n: int) -> dict | None:
        at = self._at(f"{n:08d}.json")
        files = at.getFileSystem(self._conf)
        if not files.exists(at):
            return None
        stream = files.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, after: int, entry: dict) -> None:
        """Commit number ``after``: the number of commits that the writer has seen. Raises RuntimeError if another writer was first."""
        draft = self._at(f"draft-{uuid.uuid4().hex}")
        stream = draft.getFileSystem(self._conf).create(draft, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        try:
            self._context.rename(draft, self._at(f"{after:08d}.json"), self._plain)
        except Py4JJavaError as e:
            draft.getFileSystem(self._conf).delete(draft, False)
            raise RuntimeError(f"commit {after} of {self.path} exists: another writer was first") from e
        self.all()

    def tables(self) -> list[tuple[str, float]]:
        """Names of the tables in the store's folder, and seconds since each was last written to."""
        at = self._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self._conf)
        found = files.listStatus(at) if files.exists(at) else []
        return [(f.getPath().getName(), time.time() - f.getModificationTime() / 1000) for f in found if f.isDirectory() and re.fullmatch(r"\w+-[0-9a-f]{32}", f.getPath().getName())]

    def drop(self, name: str) -> None:
        """Takes a table's files away. For tables that no commit to come will name."""
        at = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self._conf).delete(at, True)
