"""Known-item evaluation: ask for a session by its rarest words, see where it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import work_dir
from .postings import Index, document_frequency

#: Frequent words whose counts every task holds, at most.
COMMON = 200_000
#: Postings of rarer words, for each word that is asked of a document, at least.
RARER = 8
#: Documents short of rarer words that every task holds, at most; more are joined by the planner.
SHORT = 200_000


def _bound(terms: DataFrame, wanted: int) -> int:
    """The least power of two such that at most COMMON words are in as many documents or more, and the others have ``wanted`` postings, if there are."""
    bits = F.length(F.bin("docs"))
    sizes = {r.bits: r for r in terms.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("postings")).collect()}
    common, rarer, bit = sum(r.n for r in sizes.values()), 0, 1
    while common > COMMON or (common and rarer < wanted):
        if bit in sizes:
            common, rarer = common - sizes[bit].n, rarer + sizes[bit].postings
        bit += 1
    return 1 << (bit - 1)


def rarest_words(index: Index, n: int = 2, least: int = 3) -> DataFrame:
    """(path, rank, term, docs): each document's n rarest words of at least ``least`` letters, ties by the word.

    Most documents have n words that are rare, so only rare words' postings are shuffled: by term, to get
    their counts, then by document. Documents that have fewer are few; their frequent words, whose counts
    are broadcast, stand behind their rare ones, as each is in more documents. Rare words' counts are many
    and never broadcast.
    """
    spark = index.postings.sparkSession
    long = F.length("term") >= least
    terms, postings = document_frequency(index).where(long).select("term", "docs"), index.postings.where(long).select("path", "term")
    bound = _bound(terms, RARER * n * index.totals.first().docs)
    common = F.broadcast(terms.where(F.col("docs") >= bound))
    rank = F.row_number().over(W.partitionBy("path").orderBy("docs", "term"))
    first = lambda rows: rows.withColumn("rank", rank).where(F.col("rank") <= n).select("path", "rank", "term", "docs")
    at = work_dir(spark)
    first(postings.join(common, "term", "left_anti").join(terms.where(F.col("docs") < bound).hint("merge"), "term")).write.parquet(at)
    rare = spark.read.schema("path string, rank int, term string, docs long").parquet(at)
    short = index.lengths.select("path").join(rare.where(F.col("rank") == n).select("path"), "path", "left_anti")
    few = short.limit(SHORT + 1).count() <= SHORT
    rest = postings.join(F.broadcast(short) if few else short, "path", "left_semi").join(common, "term")
    return first(rare.drop("rank").unionByName(rest.select("path", "term", "docs")))


def answer_rank(answers: DataFrame) -> DataFrame:
    """(question, rank) of the wanted answer among answers (question, path, score, wanted); null if it isn't there."""
    place = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), "path"))
    ranked = answers.withColumn("place", place)
    return ranked.groupBy("question").agg(F.min(F.when(F.col("path") == F.col("wanted"), F.col("place"))).alias("rank"))
