"""Runs of the growing index: written where their pieces are, merged in one shuffle."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.operators import growing

SCHEMA = "path string, gen long, base long, text string"


def posted(df):
    return sorted((r.term, r.path, r.gen, r.tf, list(r.positions)) for r in df.where("term IS NOT NULL").collect())


def test_a_run_moves_no_posting(spark, tmp_path):
    texts = spark.createDataFrame([(f"d{i}", 0, 0, f"lamp oil lamp w{i % 7}") for i in range(60)] + [("blank", 0, 0, " - "), ("empty", 0, 0, "")], SCHEMA).repartition(3)
    words = growing.run_of(texts, str(tmp_path / "r"))
    assert sorted(map(tuple, words.collect())) == sorted([("blank", 0, 0), *((f"d{i}", 0, 4) for i in range(60))])
    rows = spark.read.schema(growing.POSTING).parquet(str(tmp_path / "r"))
    files = rows.select("path", F.input_file_name().alias("at")).distinct().collect()
    assert len(files) == 60 and len({r.at for r in files}) == 3
    assert rows.where("term = 'lamp' AND tf = 2 AND positions = array(0, 2)").count() == 60


@pytest.mark.parametrize("batch", ["3", "1000"])
def test_merged_runs(spark, tmp_path, batch):
    """Pieces meet in order; another gen's and a gone document's are left out."""
    runs = [[("a", 0, 0, "x y x"), ("b", 0, 0, "x"), ("gone", 0, 0, "x z")], [("a", 0, 3, "y x"), ("b", 0, 1, "q q")], [("a", 0, 5, "x"), ("b", 2, 0, "x q"), ("c", 1, 0, "z")]]
    for i, rows in enumerate(runs):
        growing.run_of(spark.createDataFrame(rows, SCHEMA), str(tmp_path / f"r{i}"))
    live = spark.createDataFrame([("a", 0, 6), ("b", 2, 2), ("c", 1, 1), ("new", 0, 4)], growing.LIVE)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        growing.merge(spark, [str(tmp_path / f"r{i}") for i in (2, 0, 1)], live, str(tmp_path / "m"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    want = [("q", "b", 2, 1, [1]), ("x", "a", 0, 4, [0, 2, 4, 5]), ("x", "b", 2, 1, [0]), ("y", "a", 0, 2, [1, 3]), ("z", "c", 1, 1, [0])]
    assert posted(spark.read.schema(growing.POSTING).parquet(str(tmp_path / "m"))) == want


def test_neighbours_meet_across_batches():
    rows = [("x", "a", 0, [0]), ("x", "a", 0, [4, 9]), ("x", "a", 0, [11]), ("x", "a", 1, [2]), ("x", "b", 1, [3]), ("y", "b", 1, [1])]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32())]
    for size in (1, 2, 4, 6):
        batches = [pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names=["term", "path", "gen", "positions"]) for i in range(0, 6, size)]
        got = [r for b in growing._joined(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert got == [("x", "a", 0, 4, [0, 4, 9, 11]), ("x", "a", 1, 1, [2]), ("x", "b", 1, 1, [3]), ("y", "b", 1, 1, [1])]
    assert list(growing._joined(iter([]))) == []
