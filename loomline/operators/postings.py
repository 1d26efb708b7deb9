"""The full-text index: postings with positions, document lengths and counts, as Parquet tables.

A document is one row, so its words are grouped where they are: an Arrow kernel cuts and
sorts the words of some rows at once, and no posting crosses the network: a partition of documents
becomes one file, sorted by term. A posting carries its document's length, so that ranking joins nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.memory import lean

POSTING = "term string, path string, tf long, positions array<int>, dl long"
#: Bytes of text that the kernel takes at once; a longer document is taken alone.
BYTES = 1 << 20
#: How postings are written: small row groups, of which a word or a prefix reads one or two in each file.
FILES = {"compression": "zstd", "parquet.block.size": str(4 << 20)}


@dataclass(frozen=True)
class Index:
    """postings: term, path, tf, positions, dl; lengths: path, dl; terms: term, docs, occurrences; totals: one row of docs, mean. rows: of an index that isn't saved, postings and lengths as one table."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    totals: DataFrame
    rows: DataFrame | None = None


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)))
        row, n = 0, batch.num_rows
        while row < n:
            end = max(row + 1, int(np.searchsorted(at, at[row] + BYTES, "right")) - 1)
            words, lengths = _words(batch.column(1).slice(row, end - row))
            yield _sorted(batch.column(0).slice(row, end - row), words, lengths)
            row = end


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts one after another, runs of letters and digits, and how many each text has."""
    split = pc.split_pattern_regex(texts, r"[^\p{L}\p{N}]+")
    words = split.flatten()
    real = pc.not_equal(words, "")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    return words.filter(real), np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _sorted(paths: pa.Array, words: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
    """Postings of some documents, from their words one after another, and a row without a term for each document."""
    coded = words.dictionary_encode()
    code, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
    key = doc * max(1, len(coded.dictionary)) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1)) if len(key) else np.zeros(0, np.int64)
    ends = np.concatenate((first, [len(key)]))
    place = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    one = order[first]
    n, none = len(lengths), np.full(len(lengths), len(key))
    columns = [
        pa.concat_arrays([coded.dictionary.take(pa.array(code[one])), pa.nulls(n, words.type)]), pa.concat_arrays([paths.take(pa.array(doc[one])), paths]), pa.array(np.concatenate((np.diff(ends), np.zeros(n, np.int64)))),
        pa.ListArray.from_arrays(pa.array(np.concatenate((ends, none)), pa.int32()), pa.array(place[order], pa.int32())), pa.array(np.concatenate((lengths[doc[one]], lengths)), pa.int64()),
    ]
    return pa.record_batch(columns, names=["term", "path", "tf", "positions", "dl"])


def build(bodies: DataFrame, key: str = "path", text: str = "text", folded: bool = True) -> Index:
    """An index of (key, text) rows, one a key; empty texts have no row, nor a place in averages."""
    low = X.fold(bodies[text]) if folded else F.lower(bodies[text])
    docs = bodies.where((F.coalesce(bodies[text], F.lit("")) != "") & bodies[key].isNotNull()).select(bodies[key].cast("string").alias("path"), low.alias("low"))
    return _index(docs.mapInArrow(lean(_postings), POSTING))


def _index(rows: DataFrame) -> Index:
    """From the kernel's rows."""
    postings, lengths = rows.where("term IS NOT NULL"), rows.where("term IS NULL").select("path", "dl")
    return Index(postings, lengths, _terms(postings), _totals(lengths), rows)


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


def _totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("mean"))


def save(index: Index, path: str) -> None:
    """Postings are written once, each partition's sorted by term where it is, so that the files' statistics prune a word's or a prefix's read to its own row groups; of an index that isn't saved, lengths lie among them, without a term. Counts are stored with them. A partition of texts should be small enough to sort in memory."""
    put = lambda df, name: df.write.mode("overwrite").options(**FILES).parquet(f"{path}/{name}")
    put((index.postings if index.rows is None else index.rows).sortWithinPartitions("term"), "postings")
    if index.rows is not None:  # texts are read once
        index = _index(index.rows.sparkSession.read.schema(POSTING).parquet(f"{path}/postings"))
    put(index.lengths, "lengths")
    put(index.terms, "terms")
    put(index.totals, "totals")


def load(spark: SparkSession, path: str) -> Index:
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Index(table("postings", POSTING).where("term IS NOT NULL"), table("lengths", "path string, dl long"), table("terms", "term string, docs long, occurrences long"), table("totals", "docs long, mean double"))


def document_frequency(index: Index) -> DataFrame:
    """(term, docs, occurrences)."""
    return index.terms
