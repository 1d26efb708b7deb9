"""Documents in blocks of 256, with a bitmap a term or trigram and block: literal search, and the best k without scoring all.

A block's bitmap is four longs. Conditions on terms are ANDs and ORs of bitmaps, summed up
by block in one aggregate of native functions; texts or postings are read only of blocks
that a bitmap leaves.

``Grams``: byte trigrams of lower-cased texts. A spelling can only be where all its
trigrams are; what the bitmaps leave is checked as written. Spellings under three bytes
restrict nothing, so a query of nothing else reads all texts, as it did without an index.

``Ranked``: a term's postings by block, and for each the largest tf and the smallest length.
They bound the score of any document in the block. The blocks of the highest bounds are
scored first; the k-th best score among them is a threshold, below whose blocks nothing can
rank, ties included, so the second and last round reads only blocks that reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.query import Query
from ..sources.storage import work_dir
from .postings import Index
from .search import bm25, indexed, literal

BLOCK = 256
BITS = ("b0", "b1", "b2", "b3")
#: Blocks that may be named in a filter of the scan; more are joined.
NAMED = 1_000
#: Blocks of the first round, for each of the k.
FIRST = 2
_GRAM = "gram int, block long, b0 long, b1 long, b2 long, b3 long"


def _put(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _and(a: list[Column], b: list[Column]) -> list[Column]:
    return [x.bitwiseAND(y) for x, y in zip(a, b, strict=True)]


def _or(a: list[Column], b: list[Column]) -> list[Column]:
    return [x.bitwiseOR(y) for x, y in zip(a, b, strict=True)]


def _has(slot: Column, bits: list[Column]) -> Column:
    """Whether a slot's bit is set."""
    word = F.element_at(F.array(*bits), F.shiftright(slot, 6).cast("int") + 1)
    return F.getbit(word, slot.bitwiseAND(63)) == 1


def _in_blocks(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows of the chosen blocks: few are named to the scan, whose files are sorted by block; chosen is small or joined by the planner."""
    few = [r.block for r in chosen.select("block").limit(NAMED + 1).collect()]
    return rows.where(F.col("block").isin(few)) if len(few) <= NAMED else rows.join(chosen.select("block"), "block", "left_semi")


# ---- literal search


def grams_of(spelling: str) -> list[int]:
    b = spelling.encode()
    return sorted({b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)})


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = TaskContext.get().partitionId() << 33
    for batch in batches:
        at = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield pa.record_batch([pa.array(at // BLOCK), pa.array((at % BLOCK).astype(np.int32)), *batch.columns], names=["block", "slot", "path", "text", "low"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of blocks, the trigrams of each block with the bitmap of its documents."""
    block, codes = None, []

    def out() -> pa.RecordBatch:
        code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        gram, slot = code // BLOCK, code % BLOCK
        first = np.flatnonzero(np.diff(gram, prepend=-1))
        of = np.cumsum(np.diff(gram, prepend=-1) != 0) - 1
        bits = np.zeros((len(first), 4), np.uint64)
        np.bitwise_or.at(bits, (of, slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
        return pa.record_batch([pa.array(gram[first].astype(np.int32)), pa.array(np.full(len(first), block or 0, np.int64)), *[pa.array(bits[:, i].view(np.int64)) for i in range(4)]], names=["gram", "block", *BITS])

    for batch in batches:
        for b, slot, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b != block:
                if codes:
                    yield out()
                block, codes = b, []
            raw = np.frombuffer(low.as_buffer(), np.uint8).astype(np.int64) if low.is_valid and low.as_buffer() else np.zeros(0, np.int64)
            if len(raw) > 2:
                codes.append(np.unique((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]) * BLOCK + slot)
    if codes:
        yield out()


@dataclass(frozen=True)
class Grams:
    """grams: gram, block, bitmap, sorted by gram; texts: block, slot, path, text, low, sorted by block."""

    grams: DataFrame
    texts: DataFrame

    @staticmethod
    def build(bodies: DataFrame, path: str, key: str = "path", text: str = "text") -> Grams:
        """Of (key, text) rows; null and empty texts have no place."""
        rows = bodies.where(F.coalesce(bodies[text], F.lit("")) != "").select(bodies[key].cast("string").alias("path"), bodies[text].alias("text"), X.ascii_lower(bodies[text]).alias("low"))
        texts = _put(rows.mapInArrow(_number, "block long, slot int, path string, text string, low string"), f"{path}/texts")
        made = texts.select("block", "slot", "low").mapInArrow(_bitmaps, _GRAM)
        made = made.groupBy("gram", "block").agg(*[F.bit_or(b).alias(b) for b in BITS])  # a block may come from two splits of a file
        return Grams(_put(made.repartitionByRange("gram").sortWithinPartitions("gram"), f"{path}/grams"), texts)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Grams:
        return Grams(spark.read.schema(_GRAM).parquet(f"{path}/grams"), spark.read.schema("block long, slot int, path string, text string, low string").parquet(f"{path}/texts"))

    def candidates(self, query: Query) -> DataFrame | None:
        """(block, bitmap) of where every term may be; None if no spelling restricts."""
        ways = [[grams_of(s.translate(str.maketrans(X.UPPER, X.LOWER))) for s in dict.fromkeys(t.spellings())] for t in query.terms]
        ways = [w for w in ways if all(w)]  # a term with a short spelling may be anywhere
        if not ways:
            return None
        aggs, told = [], []
        for i, term in enumerate(ways):
            for j, g in enumerate(term):
                one = F.col("gram").isin(g)
                aggs += [F.count_if(one).alias(f"n{i}_{j}"), *[F.bit_and(F.when(one, F.col(b))).alias(f"{b}{i}_{j}") for b in BITS]]
            each = [[F.when(F.col(f"n{i}_{j}") == len(g), F.col(f"{b}{i}_{j}")).otherwise(F.lit(0)) for b in BITS] for j, g in enumerate(term)]
            told.append(reduce(_or, each))
        every = sorted({x for term in ways for g in term for x in g})
        found = self.grams.where(F.col("gram").isin(every)).groupBy("block").agg(*aggs)
        bits = reduce(_and, told)
        return found.select("block", *[x.alias(b) for x, b in zip(bits, BITS, strict=True)]).where(" OR ".join(f"{b} <> 0" for b in BITS))

    def search(self, query: Query) -> DataFrame:
        """(path, text, score): the rows of ``literal`` over all texts."""
        chosen = self.candidates(query)
        rows = self.texts
        if chosen is not None:
            chosen = _put(chosen, work_dir(rows.sparkSession))
            rows = _in_blocks(rows, chosen).join(chosen, "block").where(_has(F.col("slot"), [F.col(b) for b in BITS]))
        return literal(rows, query, low="low")


# ---- the best k


@dataclass(frozen=True)
class Ranked:
    """bounds: term, block, bitmap, most (largest tf), least (smallest length), sorted by term; postings: term, block, slot, tf, dl, sorted by block; docs: block, slot, path; totals as an index's."""

    bounds: DataFrame
    postings: DataFrame
    docs: DataFrame
    totals: DataFrame

    @staticmethod
    def build(index: Index, path: str) -> Ranked:
        """Documents are numbered by length, so that a block's are alike and its bounds close."""
        docs = index.lengths.repartitionByRange("dl", "path").sortWithinPartitions("dl", "path").withColumn("at", F.monotonically_increasing_id())
        docs = _put(docs.select(F.floor(F.col("at") / BLOCK).alias("block"), (F.col("at") % BLOCK).cast("int").alias("slot"), "path"), f"{path}/docs")
        rows = _put(index.postings.select("term", "path", "tf", "dl").join(docs, "path").select("term", "block", "slot", "tf", "dl").repartitionByRange("block").sortWithinPartitions("block", "term"), f"{path}/postings")
        word = lambda i: F.when(F.shiftright("slot", 6) == i, F.expr("shiftleft(1L, slot & 63)")).otherwise(F.lit(0).cast("long"))
        bounds = rows.groupBy("term", "block").agg(*[F.bit_or(word(i)).alias(b) for i, b in enumerate(BITS)], F.max("tf").alias("most"), F.min("dl").alias("least"))
        return Ranked(_put(bounds.repartitionByRange("term").sortWithinPartitions("term"), f"{path}/bounds"), rows, docs, index.totals)

    @staticmethod
    def load(spark: SparkSession, path: str, totals: DataFrame) -> Ranked:
        table = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        return Ranked(table("bounds", "term string, block long, b0 long, b1 long, b2 long, b3 long, most long, least long"), table("postings", "term string, block long, slot int, tf long, dl long"), table("docs", "block long, slot int, path string"), totals)

    def best(self, query: Query, k: int, index: Index | None = None) -> DataFrame:
        """(path, score) of the k best by score and then path, with all that tie with the last. Phrases of several words are ranked by the whole index, whose counts they need."""
        terms = [t.phrases() for t in query.terms if t.has_words]
        if not terms or any(len(words) > 1 for t in terms for words, _ in t):
            if index is None:
                raise ValueError("a phrase needs the index with positions")
            return _first(indexed(index, query), k)
        phrases = [(t[0], p) for ways in terms for t, p in ways]
        match = [F.col("term").startswith(w) if p else F.col("term") == w for w, p in phrases]
        any_of = reduce(lambda a, b: a | b, match)
        zero = F.lit(0).cast("long")
        aggs = [x for i, m in enumerate(match) for x in (*[F.bit_or(F.when(m, F.col(b)).otherwise(zero)).alias(f"{b}_{i}") for b in BITS], F.sum(F.when(m, F.col("most")).otherwise(zero)).alias(f"most_{i}"), F.min(F.when(m, F.col("least"))).alias(f"least_{i}"))]
        by = _put(self.bounds.where(any_of).groupBy("block").agg(*aggs), work_dir(self.docs.sparkSession))
        bits = [[F.col(f"{b}_{i}") for b in BITS] for i in range(len(phrases))]
        count = lambda x: sum((F.bit_count(b) for b in x), F.lit(0))
        having = by.agg(*[F.coalesce(F.sum(count(x)), zero).alias(f"n{i}") for i, x in enumerate(bits)])
        numbers = _put(having.crossJoin(self.totals), work_dir(self.docs.sparkSession)).first()  # one row
        at, every = 0, None
        for ways in terms:
            some = reduce(_or, bits[at : at + len(ways)])
            every, at = some if every is None else _and(every, some), at + len(ways)
        number = lambda x: F.lit(numbers[x]).cast("double")
        share = lambda f, dl, i: bm25(f.cast("double"), dl, number("docs"), number("mean"), number(f"n{i}"))
        bound = sum((F.when(F.col(f"most_{i}") > 0, share(F.col(f"most_{i}"), F.col(f"least_{i}"), i)).otherwise(0.0) for i in range(len(phrases))), F.lit(0.0))
        by = by.where(count(every) > 0).select("block", *[x.alias(b) for x, b in zip(every, BITS, strict=True)], bound.alias("bound"))
        by = _put(by, work_dir(self.docs.sparkSession))

        def scored(chosen: DataFrame) -> DataFrame:
            rows = _in_blocks(self.postings, chosen).where(any_of).join(chosen, "block").where(_has(F.col("slot"), [F.col(b) for b in BITS]))
            f = rows.groupBy("block", "slot").agg(F.max("dl").alias("dl"), *[F.sum(F.when(m, F.col("tf")).otherwise(0)).alias(f"f{i}") for i, m in enumerate(match)])
            score = sum((share(F.col(f"f{i}"), F.col("dl"), i) for i in range(len(phrases))), F.lit(0.0))
            return f.select("block", "slot", score.alias("score"))

        order = [F.desc("bound"), F.col("block")]
        head = _put(by.orderBy(*order).limit(FIRST * k), work_dir(self.docs.sparkSession))
        first = _put(scored(head), work_dir(self.docs.sparkSession))
        top = first.orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        rest = by.join(head.select("block"), "block", "left_anti")
        if top.n == k:
            rest = rest.where(F.col("bound") >= top.least * (1 - 1e-12))  # a bound may be rounded a little under the score that it bounds
        rows = first.unionAll(scored(_put(rest, work_dir(self.docs.sparkSession))))
        kept = _first(rows.select(F.struct("block", "slot").alias("path"), "score"), k)
        return kept.select("path.*", "score").join(self.docs, ["block", "slot"]).select("path", "score")

    def blocks(self) -> int:
        return self.bounds.select("block").distinct().count()


def _first(rows: DataFrame, k: int) -> DataFrame:
    """Those that score as much as the k-th, or more."""
    least = rows.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("least"))
    return rows.join(F.broadcast(least), F.col("score") >= F.col("least")).drop("least")
