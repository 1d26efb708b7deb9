"""The corpus pipeline: documents to packed training sequences.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from loomline.llm.common import stored, table, without


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier rejects go; a null text is scored as an empty one, and without labels none scores enough."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that five documents share, but for the last holder's. No document goes; n_chars follows the text."""
    store = line_dedup.LineStore(spark)
    store.insert(docs)
    kept = store.clean(docs).select(F.col("id").alias("doc_id"), "text", "rest.*")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


#: Files of a table whose rows are numbered by file and place; of more, a plan would name too many, and the table is written once more with a number in each row.
FILES = 1_000


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row, and the name of that column, which is none of docs'. A table of few files has its rows' places; any other table is written with numbers first."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    try:
        files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().limit(FILES + 1).collect())
        place = F.col("_metadata.row_index")
        docs.select(place)
    except AnalysisException:
        files = None
    if files is None or len(files) > FILES:
        return stored(docs.withColumn(key, F.monotonically_increasing_id())), key
    nth = F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (f, i)])[F.col("_metadata.file_path")] if files else F.lit(0)
    return docs.withColumn(key, F.shiftleft(nth.cast("long"), 40) + place), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id stays, null being the largest; of equal ids, the first row."""
    rows, key = keyed(docs)
    linked = stored(jaccard_join.linked(rows, key=key).select(F.col("id").alias("row"), "component_id"))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    linked = linked.join(rows.select(F.col(key).alias("row"), "doc_id"), "row")
    first = linked.groupBy("component_id").agg(F.min(rank)["row"].alias("first"))
    others = linked.join(first, "component_id").where("row <> first").select("row")
    return without(rows, others, key).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a ten-word passage of the benchmark go, whatever ids they have."""
    rows, key = keyed(docs)
    hits = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), key=key)
    return without(rows, hits.where("n_hit > 0").select("doc_id"), key).select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; each row is an example, a null text the end token alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: The classifier and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again as the next one's. Every stage takes nulls, repeated rows, further columns and empty tables."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
