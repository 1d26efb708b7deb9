"""A full-text index that grows: immutable runs of postings, joined with what is alive.

A document grows by pieces. A piece's postings are a run's rows and never change: positions
count from the document's first word, so a phrase may cross from piece to piece, and ``gen``
names the reading that the piece belongs to. What is alive is a small table, (path, gen, dl):
a document that is read anew gets another gen, one that is gone has no row; postings of
other gens are dead, and a search's join leaves them out. Runs of one tier are merged when
there are FAN of them, which drops the dead and joins a document's pieces; so a refresh
writes what was appended and, over time, each posting once a tier.

A run's files are sorted by term where their pieces are, as the index's that is built at once are: a
search reads the row groups of its terms in each file. Only a merge deals postings, once, by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.memory import lean
from ..sources.storage import work_dir
from . import postings as P

POSTING = "term string, path string, gen long, tf long, positions array<int>"
LIVE = "path string, gen long, dl long"
#: Runs of a tier that are merged into one of the next.
FAN = 6


def piece_rows(texts: DataFrame, folded: bool = True) -> DataFrame:
    """Postings of pieces (path, gen, base: words before, text), and for each piece a row without a term whose tf is its number of words."""
    low = X.fold(F.col("text")) if folded else F.lower("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False), dtype=np.int64)))
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(at, at[row] + P.BYTES, "right")) - 1)
                words, lengths = P._words(batch.column(3).slice(row, end - row))
                made = P._sorted(pa.array(range(row, end), pa.int64()), words, lengths)
                term, of, tf, positions, dl = made.columns
                base = batch.column(2).take(of).to_numpy().astype(np.int64)
                sizes = np.diff(positions.offsets.to_numpy())
                moved = positions.flatten().to_numpy() + np.repeat(base, sizes)
                positions = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(moved, pa.int32()))
                tf = pc.if_else(pc.is_null(term), dl, tf)
                yield pa.record_batch([term, batch.column(0).take(of), batch.column(1).take(of), tf, positions], names=["term", "path", "gen", "tf", "positions"])
                row = end

    some = texts.where("text <> ''").select("path", F.col("gen").cast("long").alias("gen"), F.col("base").cast("long").alias("base"), low.alias("low"))
    return some.mapInArrow(lean(run), POSTING)


def run_of(texts: DataFrame, path: str, folded: bool = True) -> DataFrame:
    """Writes the pieces' postings as a run; (path, gen, words) of the pieces, one row a path and gen, in a work table. A partition of texts should be small enough to sort its postings in memory."""
    spark, at = texts.sparkSession, work_dir(texts.sparkSession)
    _put(piece_rows(texts, folded).where("term IS NOT NULL").sortWithinPartitions("term"), path)
    pieces = texts.where("text <> ''").select("path", F.col("gen").cast("long").alias("gen"), F.lit(0).cast("long").alias("words"))  # some have no word
    found = spark.read.schema(POSTING).parquet(path).select("path", "gen", F.col("tf").alias("words"))
    pieces.unionAll(found).groupBy("path", "gen").agg(F.sum("words").alias("words")).write.parquet(at)
    return spark.read.schema("path string, gen long, words long").parquet(at)


def _put(sorted_rows: DataFrame, path: str) -> None:
    sorted_rows.write.options(**P.FILES).parquet(path)


def _alive(spark: SparkSession, runs: list[str], live: DataFrame) -> DataFrame:
    return _rows(spark, runs).join(live.select("path", "gen", "dl"), ["path", "gen"])


def _rows(spark: SparkSession, runs: list[str]) -> DataFrame:
    return spark.read.schema(POSTING).parquet(*runs) if runs else spark.createDataFrame([], POSTING)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows (term, path, gen, positions) of one term, path and gen as one; the last ones wait for the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        keys = [rows.column(i) for i in range(3)]
        new = np.concatenate(([True], np.any([pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False) for k in keys], axis=0)))
        first = np.flatnonzero(new)
        yield _at(rows.slice(0, first[-1]), first[:-1])
        held = rows.slice(first[-1])
    if held is not None:
        yield _at(held, np.zeros(1, np.int64))


def _at(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
    """Rows from each of ``first`` to the next as one: places stand one after another as they are."""
    positions, at = rows.column(3), pa.array(first, pa.int64())
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(positions).to_numpy(zero_copy_only=False), dtype=np.int64)))[np.append(first, len(positions))]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), positions.flatten())
    return pa.record_batch([*(rows.column(i).take(at) for i in range(3)), pa.array(np.diff(ends), pa.int64()), lists], names=["term", "path", "gen", "tf", "positions"])


def merge(spark: SparkSession, runs: list[str], live: DataFrame, path: str) -> None:
    """Runs as one, without what is dead; a document's pieces become one posting a term. Dealt by document, so that the join with what is alive and the pieces' meeting share a shuffle."""
    rows = _rows(spark, runs).repartition("path", "gen").join(live.select("path", "gen"), ["path", "gen"], "left_semi")
    rows = rows.select("term", "path", "gen", "positions").sortWithinPartitions("term", "path", "gen", F.element_at("positions", 1))
    _put(rows.mapInArrow(lean(_joined), POSTING), path)


def opened(spark: SparkSession, runs: list[str], live: DataFrame) -> P.Index:
    """Runs and what is alive as an index that searches take. A word's rows are chosen before the join."""
    postings = _alive(spark, runs, live).select("term", "path", "tf", "positions", "dl")
    terms = postings.groupBy("term").agg(F.count_distinct("path").alias("docs"), F.sum("tf").alias("occurrences"))
    lengths = live.where("dl IS NOT NULL").select("path", "dl")
    return P.Index(postings, lengths, terms, P._totals(lengths))


def tiers(runs: list[dict]) -> list[dict] | None:
    """The runs to merge now: all of the lowest tier that has FAN of them. Entries: name, tier."""
    for t in sorted({r["tier"] for r in runs}):
        same = [r for r in runs if r["tier"] == t]
        if len(same) >= FAN:
            return same
    return None
