"""Bitmaps by blocks of documents: literal search and the best k against the plain ways."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.functions.query import Query, Term
from loomline.operators import blocks, postings, search
from loomline.sources import storage

WORDS = ["lamp", "Copper", "f++", "é", "日本語", "a", "co", "copperplate", "harbour,", "==>", "x.y", "LAMP"]


@pytest.fixture(scope="module")
def bodies(spark):
    r = random.Random(1)
    rows = [(f"d{i:04}", " ".join(r.choices(WORDS, weights=[9, 7, 1, 3, 1, 9, 5, 1, 1, 1, 2, 1], k=r.randint(0, 30) if i % 50 else 3))) for i in range(1500)]
    return spark.createDataFrame([*rows, ("none", None)], "path string, text string").repartition(3)


def test_trigrams_find_what_a_scan_finds(spark, bodies, tmp_path):
    grams = blocks.Grams.build(bodies, str(tmp_path / "g"))
    loaded = blocks.Grams.load(spark, str(tmp_path / "g"))
    assert grams.texts.count() < 1501  # empty texts have no place
    for typed in ["f++ lamp", "日本語", "copperplate harbour,", '"Copper lamp"', "==> f++ x.y", "É lamp", "co", "nowhere+", "==>"]:
        q = Query.parse(typed)
        want = sorted((r.path, round(r.score, 9)) for r in search.literal(bodies, q).collect())
        for g in (grams, loaded):
            assert sorted((r.path, round(r.score, 9)) for r in g.search(q).collect()) == want, typed
    assert grams.candidates(Query((Term("co"),), "co")) is None  # too short to restrict: all texts are read
    rare = grams.candidates(Query((Term("nowhere"),), "nowhere"))
    assert rare.count() == 0
    some = grams.candidates(Query.parse("copperplate ==>"))
    bits = some.select(sum((F.bit_count(b) for b in blocks.BITS), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    assert 0 < bits < 600 < grams.texts.count()  # texts are chosen before they are looked at


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_best_equals_the_first_of_all(spark, bodies, tmp_path, k, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    index = postings.build(bodies)
    ranked = blocks.Ranked.build(index, str(tmp_path / "r"))
    for typed in ["lamp", "lamp copper", "copper f", "co lamp a", "日本語 é", "nowhere", '"copper lamp"', "nowhere lamp"]:
        q = Query.parse(typed)
        every = sorted(((round(r.score, 9), r.path) for r in search.indexed(index, q).collect()), reverse=True)
        want = sorted(x for x in every if x[0] >= every[min(k, len(every)) - 1][0]) if every else []
        assert sorted((round(r.score, 9), r.path) for r in ranked.best(q, k, index).collect()) == want, typed


def test_common_words_skip_blocks(spark, tmp_path, monkeypatch):
    """A word in every document, often in few: the other blocks are bounded away."""
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rows = [(f"d{i:04}", "lamp " * (9 if i % 400 == 7 else 1) + "oil " * (20 + i // 16)) for i in range(1600)]
    ranked = blocks.Ranked.build(postings.build(spark.createDataFrame(rows, "path string, text string")), str(tmp_path / "r"))
    read = []
    monkeypatch.setattr(blocks, "_in_blocks", lambda df, chosen, was=blocks._in_blocks: read.append(chosen.count()) or was(df, chosen))
    best = [r.path for r in ranked.best(Query.parse("lamp"), 3).collect()]
    assert set(best) <= {"d0007", "d0407", "d0807", "d1207"} and len(best) >= 3
    assert sum(read) < 20 < ranked.blocks()
    with pytest.raises(ValueError, match="positions"):
        ranked.best(Query.parse('"lamp oil"'), 3)


def test_owned_work_tables_go(spark, bodies, tmp_path):
    with storage.owned(spark) as path:
        index = postings.build(bodies)
        postings.save(index, storage.work_dir(spark))
        search.indexed(index, Query.parse("lamp")).write.parquet(str(tmp_path / "kept"))
        assert len(storage.versions(spark, spark.read.parquet(f"{path}/*/postings").inputFiles())) > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert spark.read.parquet(str(tmp_path / "kept")).count() > 100
    assert not storage.work_dir(spark).startswith(path)


def test_the_kernel_takes_little_at_once(spark, sf):
    import pyarrow as pa

    from loomline.plans.base import table

    batch = pa.record_batch([pa.array([f"d{i}" for i in range(40)]), pa.array(["lamp oil " * 22_000] * 40)], names=["path", "low"])
    made = list(postings._postings(iter([batch])))
    assert sum(m.num_rows for m in made) == 40 * 3 and max(m.num_rows for m in made) <= 3 * 5  # 200 KB a text
    table(spark, sf, "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
