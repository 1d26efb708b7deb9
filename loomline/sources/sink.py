"""The ``transcript_files`` sink: lines to transcript files, all of a job's or none.

Rows are (project, session, parent: of a subagent, else null, raw), in the order of their
lines; a file's lines come from one task (``write`` deals them so). Every attempt of a task
writes under a name of its own in a hidden folder, which no listing shows. When all tasks
have ended, a commit moves the files into place; an abort, or a commit that finds one file
written by two tasks or there already (without ``overwrite``), takes the hidden folder away
and leaves what was there as it was. Mounted paths only, as for the source.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Files that a task keeps open: a file's lines are side by side.
HIDDEN = ".writing"


@dataclass
class Written(WriterCommitMessage):
    """(hidden file, final place) of one attempt."""

    files: list[tuple[str, str]]


class TranscriptWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite = options["path"].removeprefix("file://").rstrip("/"), overwrite
        self.hidden = f"{self.root}/{HIDDEN}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        mine, files, now, out = f"{self.hidden}/{uuid.uuid4().hex}", [], None, None
        os.makedirs(mine, exist_ok=True)
        try:
            for project, session, parent, raw in iterator:
                place = f"{self.root}/{project}/{session}.jsonl" if parent is None else f"{self.root}/{project}/{parent}/subagents/{session}.jsonl"
                if place != now:
                    if out is not None:
                        out.close()
                    files.append((f"{mine}/{len(files)}", place))
                    now, out = place, open(files[-1][0], "wb", buffering=1 << 20)  # noqa: SIM115
                out.write(raw.encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m for x in m.files]
        places = [p for _, p in files]
        twice = len(places) - len(set(places))
        there = [p for p in places if os.path.exists(p)] if not self.overwrite else []
        if twice or there:
            self.abort(messages)
            raise FileExistsError(f"{twice} files were written by two tasks" if twice else f"{there[0]} exists")
        for folder in {os.path.dirname(p) for p in places}:
            os.makedirs(folder, exist_ok=True)
        for hidden, place in files:
            os.replace(hidden, place)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Takes away what isn't in place."""
        shutil.rmtree(self.hidden, ignore_errors=True)


class TranscriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_files"

    def schema(self) -> str:
        return "project string, session string, parent string, raw string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TranscriptWriter(dict(self.options), overwrite)


def write(lines: DataFrame, root: str, order: str = "offset", overwrite: bool = False) -> None:
    """lines (project, session, parent, ``order``, raw) to files under a root; a null line is left out."""
    lines.sparkSession.dataSource.register(TranscriptFiles)
    file = ["project", "parent", "session"]
    dealt = lines.where("raw IS NOT NULL").repartition(*file).sortWithinPartitions(*file, order)
    rows = dealt.select("project", "session", F.col("parent").cast("string").alias("parent"), "raw")
    rows.write.format("transcript_files").option("path", root).mode("overwrite" if overwrite else "append").save()
