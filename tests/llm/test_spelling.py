"""Spelling variants against every pair compared in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from loomline.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(x, y):
    if len(x) < len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def plain(rows):
    """word -> (form, root, n, n_near, form_n)."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            n[w] += len(w) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    around = {w: [y for y in n if one_edit(w, y)] for w in n}
    best = {w: min(ys, key=lambda y: (-n[y], y), default=None) for w, ys in around.items()}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n}


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = ["".join(r.choice("abé") for _ in range(r.randint(7, 9))) for _ in range(60)]
    base += ["x" * 80 + "a" + "x" * 5, "x" * 80 + "b" + "x" * 5, "x" * 86, "y" * 64, "y" * 65, "y" * 66, "ssssssssss", "sssssssss"]
    out = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = base[min(int(r.paretovariate(0.6)) - 1, len(base) - 1)]
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "z", w[k] * 2, "A", "ÿ"]) + w[k + 1 :]
            words.append(w.upper() if r.random() < 0.1 else w)
        out.append((i if i else None, " ".join(words)))
    return [*out, (7, None), (8, ""), (9, "q" * 100_000), (9, "q" * 100_000), (5, out[5][1]), (5, out[5][1]), (11, "éÉxx-naïve_Straßen Straßen straßen÷× straßen÷×")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that carry the operator's own names."""
    return spark.createDataFrame([(*r, "w", 1, "k") for r in rows], "doc_id long, text string, word string, n int, key string").repartition(3)


def test_variants_equal_all_pairs(docs, rows):
    want = plain(rows)
    assert sum(1 for w in want.values() if w[0] and w[1] != w[0]), "the fixture has chains"
    assert got(spelling.variants(docs)) == want


def test_hot_segments_are_halved_until_few_share_them(docs, rows):
    """Segments of two words at most and automata of thirty patterns: the same near words."""
    vocabulary = spelling.words(docs)
    rows_ = spelling.segments(vocabulary, hot=2)
    assert rows_.where("size = length AND b - a > 1").groupBy("size", "a", "key").count().where("count > 2").isEmpty()
    assert not rows_.where("b - a = 1").isEmpty()
    found = {r.word: (r.n_near, r.best_n) for r in spelling.near_words(vocabulary, hot=2, shard=30).collect()}
    want = plain(rows)
    assert {w: k for w, (k, _) in found.items()} == {w: x[3] for w, x in want.items() if x[3]}


def test_one_shared_half_in_a_third_of_all_words(spark):
    """A segment that thousands of words share makes few candidates a word."""
    r = random.Random(5)
    words = ["prefix" + "".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    vocabulary = spark.createDataFrame([(w, 2 + i % 7) for i, w in enumerate(dict.fromkeys(words))], "word string, n long")
    rows = spelling.segments(vocabulary)
    most = rows.where("size = length AND b - a > 1").groupBy("size", "a", "key").count().agg({"count": "max"}).first()[0]
    assert most <= spelling.HOT
    by = {w: 0 for w in words}
    cut = Counter((i, w[:i] + w[i + 1 :]) for w in by for i in range(len(w)))
    want = {w: sum(cut[i, w[:i] + w[i + 1 :]] - 1 for i in range(len(w))) for w in by}
    found = {x.word: x.n_near for x in spelling.near_words(vocabulary).collect()}
    assert found == {w: k for w, k in want.items() if k}


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, text string"
    for rows in ([], [(1, None), (None, ""), (2, "short w0rds 1234567890")]):
        out = spelling.variants(spark.createDataFrame(rows, schema))
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
