"""The pipeline over documents: quality, exact dedup, near dedup, mixing to target weights, packing.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns of
documents, whatever other columns there are and whatever they are called. A row that is repeated, or has nulls in any
column, is a document like any other; an empty table stays empty. Texts are taken whole, however long. Of documents that
tie, the one with the smaller id stays, and of rows that are alike any one, which the place of a row in its file decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import exact_dedup, mixing, near_dedup, packing, quality
from frostline.llm.common import row_key, small_batches, stage_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SIMHASH_WORDS = 3  # of a shingle for fingerprints, as in operation 6
MOST_BROADCAST, ROW_BYTES = 32 << 20, 64  # bytes of rows in memory, and what one takes beside its file's name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels of those it is given."""
    net = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keyed = row_key(docs)
    texts = keyed.select(F.col("_doc.text").alias("text"), "_file", "_row")
    with small_batches(spark):
        found = stage_table(quality.score(texts, net, keep=("_file", "_row")))
    return _kept(keyed, found.withColumn("kept", F.col("score") >= quality.THRESHOLD))


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    keyed = row_key(docs)
    found = exact_dedup.exact_dedup(keyed.select("_doc.doc_id", "_doc.text", "_file", "_row"), carry=("_file", "_row"))
    return _kept(keyed, found)


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose SimHash fingerprints differ in two bits or fewer, as in operation 6, or
    whose five-word shingles are similar by 0.8 or more.

    Pairs of the second kind differ in too many bits for fingerprints (the README has the figures), so MinHash bands find
    them beside. Both kinds of links count at once, so that no component is cut where one kind alone would end it.
    """
    keyed = row_key(docs)
    found = near_dedup.near_dedup(keyed.select("_doc.doc_id", "_doc.text", "_file", "_row"), carry=("_file", "_row"), simhash=SIMHASH_WORDS)
    return _kept(keyed, found)


def _kept(keyed: DataFrame, found: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The rows of keyed that are kept. Those that go are fewer, so they are what is joined. Spark may broadcast them, as
    their file is small, but a row takes far more memory than in the file: beyond most bytes both sides are shuffled."""
    gone = stage_table(found.where("NOT kept").select("_file", "_row"))
    size = gone.agg(F.sum(F.octet_length("_file") + ROW_BYTES)).first()[0] or 0
    return keyed.join(gone.hint("merge") if size > most else gone, ["_file", "_row"], "left_anti").select("_doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix_sources(docs).where("_copies > 0")
    return mixed.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_filter),
    ("SimHash near-dedup", near_filter),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier, nor MinHash bands, nor the tokenizer; tests/llm holds the run against a
#: brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
