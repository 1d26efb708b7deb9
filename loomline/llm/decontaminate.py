"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a segment holds some documents' token postings,
as a sorted term dictionary (64-bit term ids, posting counts) and each term's ascending
positions in the segment's token stream. Segments are rows of a Parquet table; building
one needs no shuffle, a document is never split, and a hot passage only lengthens some
posting lists.

Test items become windows of terms. Terms are ranked by their posting counts over the
whole index; within each segment a window starts from its rarest term's positions,
shifted by the term's offset in the window, and intersects the shifted list of the next
rarest, until it is empty or all terms have agreed: exact phrase matches. A proximity
match, for callers who ask, has every term of the window within ``slop`` more words.

The benchmark's windows go to every executor, so their size is checked; a larger
benchmark is matched in groups of items, one after another, a pass over the index each.
A very long item is cut into pieces first, each window in one of them.

Terms are equal if their 64-bit hashes are. Defined results: a null or wordless text has
no words and no hits; an item without words never occurs; repeated rows of an item
count once; repeated documents get a row each; a null item id takes part in hits but
not in the list of items; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, U64, blocks, lean, runs, span_hashes, stored

#: Bytes of window terms that one pass sends to each executor.
BROADCAST_BYTES = 64 << 20
SEGMENT_BYTES = 2 << 20
#: Words of an item that stay together; a longer one is cut into pieces whose windows, together, are its own.
PIECE_WORDS = 20_000
SEGMENT = "segment long, doc_id array<bigint>, doc_at array<bigint>, terms binary, counts binary, positions binary"

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def block_terms(block) -> tuple[np.ndarray, np.ndarray]:
    """Term ids of a block's words, and where each text's words begin (n + 1)."""
    b = ASCII_LOWER[block.buf]
    start, end = runs(_WORD[b])
    return span_hashes(b, start, end), np.searchsorted(start, block.at)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The stored index of all tokens of all documents."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("doc_at", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])
        ids: list = []
        parts: list[np.ndarray] = []
        words: list[np.ndarray] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def segment() -> pa.RecordBatch:
            """The texts held so far; hashed in small blocks, sorted as one."""
            terms = np.concatenate(parts)
            order = np.argsort(terms)
            ordered = terms[order]
            new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
            # positions ascend within each term; in place, as these are a worker's largest arrays
            positions = np.cumsum(new)
            positions <<= 32
            positions |= order
            positions.sort()
            positions &= 0xFFFFFFFF
            counts = np.diff(np.concatenate((np.flatnonzero(new), [len(ordered)])))
            at = np.concatenate(([0], np.cumsum(np.concatenate(words))))
            row = [[number], [ids], [at.tolist()], [ordered[new].tobytes()], [counts.astype("<u4").tobytes()], [positions.astype("<u4").tobytes()]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                terms, at = block_terms(block)
                ids += keys[block.first : block.first + block.n]
                parts.append(terms)
                words.append(np.diff(at))
                size += len(block.buf)
                if size >= SEGMENT_BYTES:
                    yield segment()
                    ids, parts, words, size, number = [], [], [], 0, number + 1
        if ids:
            yield segment()

    return stored(docs.select(docs[key].cast("long").alias(key), docs[text].alias(text)).mapInArrow(lean(segments), SEGMENT), path, large_rows=True)


@dataclass(frozen=True)
class Windows:
    """terms: n x k term ids, rarest first; offsets: their places in the window (-1: none); item: index into items; length: words."""

    items: list
    item: np.ndarray
    length: np.ndarray
    terms: np.ndarray
    offsets: np.ndarray


def item_windows(items: pd.DataFrame, size: int) -> Windows:
    """Windows of (item, text) rows: ``size`` words, or all of a shorter item's."""
    ids, owner, length, terms, places = [], [], [], [], []
    for item, text in items.itertuples(index=False):
        for block in blocks(pa.array([text], pa.string())):
            t, _ = block_terms(block)
            n = min(size, len(t))
            for i in range(len(t) - n + 1 if n else 0):
                owner.append(len(ids))
                length.append(n)
                terms.append(np.concatenate((t[i : i + n], np.zeros(size - n, U64))))
                places.append(np.concatenate((np.arange(n), np.full(size - n, -1))))
        ids.append(None if item is None or item != item else item)
    shape = (len(owner), size)
    return Windows(ids, np.array(owner, np.int64), np.array(length, np.int64), np.array(terms, U64).reshape(shape), np.array(places, np.int64).reshape(shape))


def rarest_first(w: Windows, index: DataFrame) -> Windows:
    """Orders each window's terms by their postings over the whole index. What comes to the driver has the size of the benchmark's vocabulary."""
    vocabulary = np.unique(w.terms[w.offsets >= 0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                t, c = np.frombuffer(terms.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<u4")
                if len(t):
                    at = np.minimum(np.searchsorted(t, vocabulary), len(t) - 1)
                    total += np.where(t[at] == vocabulary, c[at], 0)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    df = np.zeros(len(vocabulary), np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(lean(count), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        df[term] = n
    known = df[np.minimum(np.searchsorted(vocabulary, w.terms), max(0, len(vocabulary) - 1))] if len(vocabulary) else np.zeros(w.terms.shape, np.int64)
    order = np.argsort(np.where(w.offsets < 0, np.iinfo(np.int64).max, known), axis=1, kind="stable")
    return Windows(w.items, w.item, w.length, np.take_along_axis(w.terms, order, 1), np.take_along_axis(w.offsets, order, 1))


def _member(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a is in ascending b."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return b[at] == a


def _exact(offsets: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Starts of a window: its lists, rarest first, shifted by their offsets and intersected."""
    starts = lists[0] - offsets[0]
    for o, p in zip(offsets[1:], lists[1:], strict=True):
        if len(p) < len(starts):
            shifted = p - o
            starts = shifted[_member(shifted, starts)]
        else:
            starts = starts[_member(starts + o, p)]
        if not len(starts):
            break
    return starts


def match(index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", size: int = 10, slop: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, near_items, n_items.

    hit: words inside an exact occurrence of a window. items: distinct ids of items with an exact window. near_items: with ``slop``, those with a window's terms within size + slop words, exact ones included.
    """
    dealt, passes = _item_groups(items.select(items[item].cast("string").alias("item"), items[text].alias("text")).distinct(), size)
    count = F.size("items").cast("long").alias("n_items")
    if passes == 1:
        one = _match(index, rarest_first(item_windows(dealt.drop("g").toPandas(), size), index), slop)
        return one.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "items", "near_items", count)
    found = None
    for g in range(passes):  # one group of windows at a time on the driver and the executors
        w = rarest_first(item_windows(dealt.where(F.col("g") == g).drop("g").toPandas(), size), index)
        part = stored(_match(index, w, slop).where("size(hits) > 0 OR size(near_items) > 0").drop("doc_id", "n_words"))
        found = part if found is None else found.unionAll(part)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = found.groupBy("segment", "nth").agg(*map(merged, ("hits", "items", "near_items")))
    at = F.arrays_zip(F.col("doc_id").alias("id"), F.slice("doc_at", 1, F.size("doc_id")).alias("at"), F.slice("doc_at", 2, F.size("doc_id")).alias("end"))
    every = index.select("segment", F.posexplode(at).alias("nth", "d")).select("segment", F.col("nth").cast("long").alias("nth"), F.col("d.id").alias("doc_id"), (F.col("d.end") - F.col("d.at")).alias("n_words"))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    out = every.join(found, ["segment", "nth"], "left").select("doc_id", "n_words", F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hit"), some("items"), some("near_items"))
    return out.select("*", count)


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """rows (item, text) with long texts cut so that each window of ``size`` words lies in one piece."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                start, end = runs(_WORD[ASCII_LOWER[block.buf]])
                at = np.searchsorted(start, block.at)
                for i in range(block.n):
                    s, e = start[at[i] : at[i + 1]], end[at[i] : at[i + 1]]
                    cuts = range(0, max(1, len(s) - size + 1), PIECE_WORDS)
                    texts = [block.buf[s[c] : e[min(len(s), c + PIECE_WORDS + size - 1) - 1]].tobytes() if len(s) else b"" for c in cuts]
                    keys = batch.column(0).slice(block.first + i, 1).take(pa.array([0] * len(texts)))
                    yield pa.record_batch([keys, pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    return rows.mapInArrow(lean(run), rows.schema)


def _item_groups(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The items' pieces with g, the group that each is in, and the number of groups: the windows of one keep to about BROADCAST_BYTES (one group for usual benchmarks)."""
    rows = stored(_pieces(rows, size))
    sized = rows.select((F.length(F.coalesce("text", F.lit(""))) + 2) / 2 * (size * 16 + 16))
    total = sized.agg(F.sum(sized.columns[0])).first()[0] or 0
    n = max(1, -(-int(total) // BROADCAST_BYTES))
    return stored(rows.withColumn("g", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int"))), n


def _match(index: DataFrame, w: Windows, slop: int | None) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(w)
    schema = "doc_id long, n_words long, hits array<bigint>, items array<string>, near_items array<string>, segment long, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for segment, docs, at, terms, counts, positions in zip(*batch.columns, strict=True):
                yield from one(w, segment.as_py(), docs.as_py(), np.array(at.as_py()), np.frombuffer(terms.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<u4"), np.frombuffer(positions.as_buffer(), "<u4"))

    def one(w, segment, docs, at, terms, counts, positions):
        n = len(docs)
        hit: list[np.ndarray] = []
        found: dict[int, set[int]] = {}
        near: dict[int, set[int]] = {}
        if len(terms) and len(w.item):
            begin = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
            place = np.minimum(np.searchsorted(terms, w.terms), len(terms) - 1)
            there = ((terms[place] == w.terms) | (w.offsets < 0)).all(axis=1)
            for k in np.flatnonzero(there):
                m = w.length[k]
                lists = [positions[begin[p] : begin[p + 1]].astype(np.int64) for p in place[k, :m]]
                starts = _exact(w.offsets[k, :m], lists)
                if len(starts):
                    d = np.searchsorted(at, starts, "right") - 1
                    inside = (starts >= 0) & (starts + m <= at[np.minimum(d + 1, n)])
                    starts, d = starts[inside], d[inside]
                    if len(starts):
                        hit.append((starts[:, None] + np.arange(m)).ravel())
                        for x in np.unique(d):
                            found.setdefault(int(x), set()).add(int(w.item[k]))
                if slop is not None and m > 1:
                    for x in _near_docs(lists, at, m - 1 + slop):
                        near.setdefault(int(x), set()).add(int(w.item[k]))
        words = np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
        cut = np.searchsorted(words, at)
        named = lambda s: sorted({str(w.items[i]) for i in s if w.items[i] is not None})
        yield pa.record_batch(
            [
                pa.array(docs, pa.int64()),
                pa.array(np.diff(at)[:n], pa.int64()),
                pa.array([(words[cut[i] : cut[i + 1]] - at[i]).tolist() for i in range(n)], pa.list_(pa.int64())),
                pa.array([named(found.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                pa.array([named(near.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                pa.array([segment] * n, pa.int64()),
                pa.array(range(n), pa.int64()),
            ],
            names=["doc_id", "n_words", "hits", "items", "near_items", "segment", "nth"],
        )

    return index.mapInArrow(lean(run), schema)


def _near_docs(lists: list[np.ndarray], at: np.ndarray, reach: int) -> np.ndarray:
    """Documents with a proximity match: each other term's nearest occurrence to one of the rarest term's."""
    anchor = lists[0]
    d = np.searchsorted(at, anchor, "right") - 1
    low, high, ok = anchor, anchor, np.ones(len(anchor), bool)
    for p in lists[1:]:
        i = np.searchsorted(p, anchor)
        after, before = p[np.minimum(i, len(p) - 1)], p[np.maximum(i - 1, 0)]
        nearest = np.where(np.abs(after - anchor) < np.abs(before - anchor), after, before)
        low, high = np.minimum(low, nearest), np.maximum(high, nearest)
        ok &= (high - low <= reach) & (nearest >= at[d]) & (nearest < at[np.minimum(d + 1, len(at) - 1)])
        if not ok.any():
            break
    return np.unique(d[ok])


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", size: int = 10) -> DataFrame:
    """Index, then match: one row per row of docs."""
    return match(build_index(docs, key, text), items, size=size)
