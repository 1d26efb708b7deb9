"""Quality classifier: boosted trees over statistics of whole documents.

The statistics come from the bytes of a block of texts at once: shares of character
classes, lengths of words and lines, repetition of words, word pairs and lines, words
that are all capitals or begin with one, closing punctuation. Nothing but the text is an
input. Training takes at most ``bound`` labelled rows; the model is a few kilobytes and
goes to every executor.

Defined results: null or empty text has all statistics 0 and is scored as such; repeated
rows are scored each; without labels every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosted_trees
from .common import ASCII_LOWER, U64, Block, blocks, lean, mix, runs, span_hashes
from .folds import is_held_out, training_rows

BOUND = 12_000
_SINGLE = b".,!?;:|#$%&*@/\\<>{}()[]\"'-_=+~^"
_KIND = np.zeros(256, np.uint8)  # 0 other, then the classes below
_UPPER, _LOWER, _DIGIT, _BLANK, _BREAK, _HIGH, _CONTROL = range(1, 8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWER, _DIGIT
_KIND[[0x20, 9]], _KIND[[10, 13]] = _BLANK, _BREAK
_KIND[128:] = _HIGH
_KIND[[*range(9), 11, 12, *range(14, 32), 127]] = _CONTROL
_CODE = _KIND.copy()
_CODE[list(_SINGLE)] = np.arange(8, 8 + len(_SINGLE))
CLASSES = 8 + len(_SINGLE)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: distinct keys, and the count of its commonest key."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))))
    most = np.zeros(n)
    np.maximum.at(most, o[new], np.diff(np.concatenate((new, [len(k)]))))
    return np.bincount(o[new], minlength=n).astype(float), most


def statistics(block: Block) -> np.ndarray:
    """One row of statistics per text."""
    n, buf, at = block.n, block.buf, block.at
    size = np.maximum(np.diff(at) - 1, 0)
    owner = np.repeat(np.arange(n), np.diff(at))
    code = _CODE[buf]
    counts = np.bincount(owner * CLASSES + code, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    counts[:, _BLANK] -= 1  # the block's own separator
    chars = np.maximum(size, 1)[:, None]
    share = counts / chars
    punctuation = counts[:, 8:].sum(axis=1) / chars[:, 0]

    space = (code == _BLANK) | (code == _BREAK)
    start, end = runs(~space)
    word_of, length = owner[start], (end - start).astype(float)
    words = np.bincount(word_of, minlength=n).astype(float)
    w = np.maximum(words, 1)
    mean = np.bincount(word_of, length, n) / w
    spread = np.sqrt(np.maximum(np.bincount(word_of, length**2, n) / w - mean**2, 0))
    first, last = code[start], code[end - 1]
    tally = lambda flag: np.bincount(word_of, flag.astype(float), n) / w
    upper = np.concatenate(([0], np.cumsum(code == _UPPER)))
    lower = np.concatenate(([0], np.cumsum(code == _LOWER)))
    loud = (upper[end] - upper[start] > 1) & (lower[end] == lower[start])
    closed = last >= 8
    stop = np.isin(buf[end - 1], list(b".!?"))
    hashes = span_hashes(ASCII_LOWER[buf], start, end)
    kinds, most = _distinct(hashes, word_of, n)
    same = word_of[1:] == word_of[:-1]
    pairs = mix(hashes[1:] * U64(3) + hashes[:-1])[same]
    pair_kinds, pair_most = _distinct(pairs, word_of[1:][same], n)
    stutter = np.bincount(word_of[1:], (same & (hashes[1:] == hashes[:-1])).astype(float), n) / w

    inside = buf != 10
    inside[at[1:] - 1] = False
    line_start, line_end = runs(inside)
    line_of = owner[line_start]
    cut = line_end - line_start
    lines = np.maximum(counts[:, _BREAK] + 1, 1)
    line_kinds, _ = _distinct(span_hashes(buf, line_start, line_end), line_of, n)
    runs_of_lines = np.maximum(np.bincount(line_of, minlength=n), 1)
    longest = np.zeros(n)
    np.maximum.at(longest, line_of, cut)
    letters = np.maximum(counts[:, _UPPER] + counts[:, _LOWER] + counts[:, _HIGH], 1)
    columns = [
        np.log1p(size), np.log1p(words), mean, spread, punctuation, counts[:, _UPPER] / letters, counts[:, _HIGH] / letters,
        tally(loud), tally(first == _UPPER), tally(closed), tally(stop), tally(length <= 3), tally(length >= 12), tally((first == _DIGIT) | (last == _DIGIT)), tally((length == 1) & (first >= 8)),
        kinds / w, most / w, pair_kinds / np.maximum(words - 1, 1), pair_most / w, stutter,
        np.log1p(lines), size / lines, line_kinds / runs_of_lines, np.log1p(longest),
    ]
    return np.column_stack([*columns, share])


WIDTH = 24 + CLASSES


def features(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and x: the statistics of ``text``."""
    schema = T.StructType([*[texts.schema[k] for k in keep], T.StructField("x", T.ArrayType(T.FloatType()))])
    index = texts.columns.index(text)
    places = [texts.columns.index(k) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(index)):
                x = statistics(block).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1) * WIDTH, pa.int32()), pa.array(x.ravel()))
                yield pa.record_batch([*[batch.column(p).slice(block.first, block.n) for p in places], lists], names=[*keep, "x"])

    return texts.mapInArrow(lean(run), schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2, bound: int = BOUND, key: str = "doc_id") -> boosted_trees.Trees:
    rows = features(training_rows(docs, labels, label, folds, fold, bound, key), [key, "y"]).toPandas().sort_values([key, "y"])
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, WIDTH), np.float32)
    return boosted_trees.fit(x.astype(float), (rows["y"].to_numpy(float) > 0).astype(float))


def scored(docs: DataFrame, model: boosted_trees.Trees, text: str = "text") -> DataFrame:
    """The columns of docs as c0, c1, ... and their score s, one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    index, names = docs.columns.index(text), [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    schema = T.StructType([*plain.schema.fields, T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.score(statistics(b).astype(np.float32).astype(float)) for b in blocks(batch.column(index))]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(s) if s else np.zeros(0))], names=[*names, "s"])

    return plain.mapInArrow(lean(run), schema)


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score ``threshold`` or more."""
    model = train(docs.select(docs[key].alias(key), docs[text].alias("text")), labels, key=key)
    return scored(docs, model, text).where(F.col("s") >= threshold).drop("s").toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    d = docs.select(docs[key].alias(key), docs[text].alias("text"))
    s = scored(d, train(d, labels, key=key)).toDF(key, "text", "score")
    return s.select(key, is_held_out(F.col(key), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
