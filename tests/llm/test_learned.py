"""Classifiers by held-out accuracy, kernels by brute force, and the pipeline's stages."""

import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import boosted_trees, jaccard_join, queries, quality, toxicity
from loomline.llm.common import blocks

SF = "/root/testdata/sf0.01"


def held_out_accuracy(spark, result, label):
    y = spark.read.parquet(f"{SF}/labels.parquet")
    rows = result.join(y, "doc_id").where("held_out").select("predicted", F.col(label).alias("y")).collect()
    return np.mean([r.predicted == r.y for r in rows]), len(rows)


@pytest.mark.parametrize("name,label,folds,fold,threshold,least", [("op9_quality_classifier", "quality", 4, 2, 0.7, 0.95), ("op4_toxicity", "toxic", 5, 0, 0.5, 0.93)])
def test_classifiers(spark, name, label, folds, fold, threshold, least):
    out = queries.QUERIES[name](spark, SF).cache()
    accuracy, n = held_out_accuracy(spark, out, label)
    assert n > 50 and accuracy >= least
    rows = out.collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifiers_take_odd_rows(spark, classify):
    schema = "doc_id long, text string, score double, s string, c0 long"
    docs = spark.createDataFrame([(1, "", 0.1, "x", 1), (2, None, 0.1, None, 1), (None, "a b", 0.1, "x", 1), (3, "word " * 20_000, 0.1, "x", None), (3, "word", 0.1, "x", 1)], schema)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(str(r.doc_id) for r in classify(docs, labels).collect()) == ["1", "2", "3", "3", "None"]
    assert classify(docs, labels.limit(0)).count() == 5
    assert classify(docs.limit(0), labels).count() == 0


def test_accepted_keeps_all_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"s": F.lit("mine"), "score": F.lit(2)})
    kept = quality.accepted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept.columns == docs.columns and 700 < kept.count() < 1000


def test_trees_learn_and_traverse():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosted_trees.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.93

    def slow(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += v[node - len(f)]
        return total

    assert np.allclose(model.margin(x[:20]), [slow(row) for row in x[:20]])


def test_statistics_of_a_text():
    s = ["One two two.\n12 | LOUD", "", "é é"]
    got = [row for b in blocks(pa.array(s)) for row in quality.statistics(b)]
    w = s[0].split()
    assert np.isclose(got[0][1], np.log1p(len(w))) and np.isclose(got[0][2], np.mean([len(x) for x in w])) and np.isclose(got[0][7], 1 / 6)
    assert got[1][0] == 0 and not np.isnan(np.array(got)).any() and len(got[0]) == quality.WIDTH


def test_label_model_finds_rates_and_correlations():
    r = np.random.default_rng(1)
    n, prior = 200_000, 0.15
    y = r.random(n) < prior
    on, off = np.array([0.6, 0.5, 0.4, 0.7, 0.3, 0.5]), np.array([0.02, 0.05, 0.01, 0.1, 0.02, 0.03])
    votes = (r.random((n, 6)) < np.where(y[:, None], on, off)).astype(float)
    votes = np.column_stack([votes, np.where(r.random(n) < 0.9, votes[:, 3], r.random(n) < 0.1)])  # a near copy of one voter
    m = toxicity.label_model(n, votes.T @ votes, prior)
    assert np.abs(m.on[[0, 1, 2, 4, 5]] - on[[0, 1, 2, 4, 5]]).max() < 0.06 and np.abs(m.off[:3] - off[:3]).max() < 0.02
    assert m.correlated[3, 6] > 0.1 and m.weight[3] < m.weight[0]
    assert ((m.log_odds(votes) > 0) == y).mean() > 0.9


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_oracles(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toArrow()
    want = c.sql(queries.ORACLE[name]).to_arrow_table().select(got.column_names)
    rows = lambda t: sorted(str(tuple(r.values())) for r in t.to_pylist())
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    at, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{i}")
        out.append((docs, docs := spark.read.parquet(f"{at}/{i}")))
    return out


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stages(spark, staged):
    from tests.llm.test_exact_results import components, decontaminated, kept_lines

    table = lambda df: {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    assert all(a.columns == b.columns for a, b in staged[:4])
    first = table(staged[0][1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(i in first for i, q in labels.items() if q) > 0.99 * sum(labels.values()) and sum(i in first for i, q in labels.items() if not q) < 0.1 * sum(1 - q for q in labels.values())
    lines = {i: x[0] for i, x in kept_lines(table(staged[1][0])).items()}
    assert table(staged[1][1]) == lines
    assert all(r.n_chars == len(r.text) for r in staged[1][1].collect())
    comp = {r.id: r.component_id for r in jaccard_join.linked(staged[2][0]).collect()}
    assert table(staged[2][1]).keys() == {i for i, c in comp.items() if i == c}
    some = {i: t for i, t in table(staged[2][0]).items() if i % 4 == 0}
    small = staged[2][0].where("doc_id % 4 = 0")
    assert {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(small).collect()} == components(some, 5, 80)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, x in decontaminated(table(staged[3][0]), items, 10).items() if x[1]}
    assert hit and table(staged[3][1]).keys() == table(staged[3][0]).keys() - hit
    packed = {r.doc_id for r in staged[4][1].select("doc_id").distinct().collect()}
    assert packed == table(staged[4][0]).keys()


def test_words_of_the_classifier_are_letters():
    for b in blocks(pa.array(["Idiot! ÉTÉ x1y", ""])):
        owner, bins, n = toxicity._words(b)
        assert n.tolist() == [len(re.findall(r"[^\W\d_]+", "Idiot! ÉTÉ x1y")), 0] and len(owner) == 4 and bins[0][0] == toxicity._bin(np.array([toxicity._hash("idiot")], np.uint64))[0]


def test_voters_can_outweigh_a_label():
    one = lambda x: np.full(4, x)
    model = toxicity.LabelModel(one(0.6), one(0.01), one(1.0), 0.1, np.zeros((4, 4)))
    p = toxicity.posteriors(model, np.array([[1, 1, 1, 1], [0, 0, 0, 0], [1, 0, 0, 0]], bool), np.array([0.0, 1.0, 1.0]))
    assert p[0] > 0.9 and p[1] < 0.5
    alone = toxicity.posteriors(model, np.array([[1, 0, 0, 0]], bool))[0]
    assert np.isclose(np.log(p[2] / (1 - p[2])) - np.log(alone / (1 - alone)), np.log(toxicity.GOLD / (1 - toxicity.GOLD)))


def test_voters_teach_words_that_no_label_has(spark):
    r = np.random.default_rng(5)
    plain = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrt"]
    text = lambda *toxic: " ".join([*r.choice(plain, 30), *toxic])
    rows = [(i, text(*r.choice(["idiot", "moron", "scum", "loser"], 3, replace=False)) if i % 5 == 0 else text()) for i in range(800)]  # labelled
    rows += [(1000 + i, text(*r.choice(["idiot", "moron", "scum", "loser"], 2, replace=False), "abschaum", "widerlich") if i % 5 == 0 else text()) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(800)], "doc_id long, toxic int")
    model, _, _ = toxicity.train(docs, labels)
    clean, toxic = model.score(next(blocks(pa.array(["bal bel bil", "bal bel bil abschaum widerlich"]))))
    assert toxic > clean + 0.2


@pytest.mark.parametrize("written", [True, False])
def test_stages_drop_rows_not_ids(spark, tmp_path, written):
    passage, clean = " ".join(f"b{i}" for i in range(20)), " ".join(f"c{i}" for i in range(20))
    copy, other = " ".join(f"d{i}" for i in range(20)), " ".join(f"e{i}" for i in range(20))
    rows = [(1, copy), (None, copy), (None, clean), (None, passage), (7, other), (7, other), (8, passage), (8, "short"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if written:
        docs.write.parquet(f"{tmp_path}/d")
        docs = spark.read.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    show = lambda df: sorted(map(str, map(tuple, df.collect())))
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert show(kept) == sorted(map(str, [(1, copy), (None, clean), (8, passage), (7, other), (8, "short"), (None, None)]))
    left = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert show(left) == sorted(str(r) for r in rows if r[1] != passage)


def test_labelled_rows_correct_rates_and_abstentions():
    one = lambda x: np.full(4, x)
    model = toxicity.LabelModel(one(0.5), one(0.01), one(1.0), 0.1, np.zeros((4, 4)))
    y = np.repeat([1.0, 0.0], [400, 4000])
    votes = np.zeros((4400, 4), bool)
    votes[:200, :2], votes[200:390, 2:] = True, True  # two languages: a toxic text wakes one pair of voters
    heard = model.heard(votes, y)
    assert np.abs(heard.on - 0.48).max() < 0.03 and heard.off.max() < 0.005 and heard.quiet > 0.9
    alone = heard.log_odds(np.zeros((1, 4), bool))[0]
    a1, a0 = (390 + 1) / 402, 1 / 4002
    assert alone >= np.log(0.1 / 0.9) + np.log((1 - a1) / (1 - a0)) - 1e-9
    votes[:40, :2] = False  # toxic texts that no voter knows: silence says less
    assert model.heard(votes, y).quiet < 0.9


def test_many_different_words_that_begin_alike():
    text = "gundrop gundrol gundral plain gundrop"
    for b in blocks(pa.array([text, "gundrop gundrop gundrop"])):
        o, f = toxicity._presence(b)
        stem = toxicity.BINS + toxicity._bin(toxicity.span_hashes(np.frombuffer(b"gund", np.uint8), np.array([0]), np.array([4])) + np.uint64(4))[0]
        assert (o[f == stem]).tolist() == [0]


@pytest.mark.parametrize("files", [0, 1000])
def test_rows_are_numbered_once_whatever_the_files(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(corpus_pipeline, "FILES", files)
    path = str(tmp_path / "docs")
    spark.range(90).withColumn("row_key", F.lit("clash")).repartition(4).write.parquet(path)
    for docs in (spark.read.parquet(path), spark.range(90).withColumn("row_key", F.lit("clash"))):
        rows, key = corpus_pipeline.keyed(docs)
        assert key == "row_key_" and rows.select(key).distinct().count() == rows.count() == 90


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, row_key string, row string, c0 string, s double, rest string, component_id long, label string, y double"
    good = " ".join(f"word{i % 50}" for i in range(60))
    line = "a line of more than forty characters that many rows of this table hold"
    one = lambda i, t: (i, t, None, "x", None if t is None else len(t), 7, "mine", None, "c", 0.5, None, 3, "l", 1.0)
    rows = [one(1, good), one(1, good), one(None, good), one(2, None), one(3, ""), one(None, None), one(4, "z " * 20_000), one(5, line)] + [one(10 + i, f"own words {i} of it\n{line}\nend {i}") for i in range(6)]
    docs = spark.createDataFrame(rows, schema).repartition(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, 0, None), (10, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "never here"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    show = lambda df: sorted(map(str, map(tuple, df.collect())))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = show(out)
        if name == "line dedup":
            texts = sorted(t or "" for t in [r.text for r in out.collect()])
            cut = [t if i in (5, 15) or t is None else "\n".join(x for x in t.split("\n") if x != line) for i, t, *_ in rows]
            cut[7] = ""  # the sixth holder is the largest
            assert texts == sorted(t or "" for t in cut)
        elif name == "n-gram Jaccard join":
            others = list(rows)
            others.remove(one(1, good))
            others.remove(one(None, good))
            assert set(kept) <= set(map(str, rows)) and str(one(4, "z " * 20_000)) in kept and kept.count(str(one(1, good))) == 1 and str(one(None, good)) not in kept
        elif name == "benchmark decontamination":
            assert kept == sorted(map(str, rows))
        else:
            assert set(kept) <= set(map(str, rows))
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    pack = corpus_pipeline.STAGES[4][1]
    pieces = pack(spark, docs, str(tmp_path))
    assert sorted({str(r.doc_id) for r in pieces.collect()}) == sorted({str(r[0]) for r in rows})
    assert pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_training_rows_are_bounded_though_ids_repeat(spark):
    from loomline.llm.folds import training_rows

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "two"), (3, None), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 30 + [(2, 0), (2, 1), (3, 1), (None, 1)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, "toxic", 1, 7, 100).collect()
    assert sorted((r.doc_id, r.y) for r in rows) == [(1, 1.0), (2, 0.0), (2, 1.0), (3, 1.0)]
    assert len(training_rows(docs, labels, "toxic", 1, 7, 2).collect()) == 2
    again = training_rows(docs.repartition(5), labels, "toxic", 1, 7, 100).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_one_unlabelled_row_of_a_repeated_id_is_drawn(spark):
    voters = toxicity.Voters(np.zeros(2 * toxicity.BINS, np.int64), np.zeros(toxicity.BINS, bool), 0)
    rows = [(7, "word again", None)] * 300 + [(7, "another word", None), (8, None, None), (9, "", None), (None, "no id", None), (10, "has a label", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    draw = lambda d: toxicity._unlabelled(d, docs.where("toxic IS NOT NULL"), "toxic", "doc_id", 5, -1, voters, np.array([1.0]))
    bins, votes = draw(docs)
    assert len(bins) == 3 and votes.shape == (3, 4)  # 7 once, 8 and 9
    again, _ = draw(docs.repartition(3))
    assert [list(b) for b in again] == [list(b) for b in bins]
    assert len(draw(docs.limit(0))[0]) == 0
