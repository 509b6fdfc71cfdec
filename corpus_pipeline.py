"""From documents to packed training sequences: rules, near duplicates, repeated passages, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import common, mixing, packing, partenum, rules, substring_dedup


#: What near-duplicate stages on word shingles take unless a contract says otherwise; op9's query has its own.
SHINGLE, PERCENT = 5, 80


def _ready(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.ARROW_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or a certified cutoff go."""
    return rules.apply_rules(docs, common.table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that link at 80 percent of 5-word shingles the one with the least doc_id stays."""
    _ready(spark)
    return partenum.join_components(docs, PERCENT, shingle=SHINGLE).where("is_first").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur earlier go; a text that lost none stays as it is, byte for byte."""
    _ready(spark)
    out = substring_dedup.dedup(docs)
    cut = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; documents it leaves out go.

    The columns are the documents' own, so the order of the rows is what carries epoch and position:
    they are range-sorted by training position, and packing goes by their place in the stored table.
    """
    planned = mixing.plan(docs, common.n_words(common.text_or_empty()))
    return mixing.curriculum(planned).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets, in training order: each copy's ``position`` in it
    (unique, so copies of a document are told apart), and sequences numbered by their first position."""
    _ready(spark)
    return packing.pack_in_order(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("substring dedup", repeated_passages),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokens are beyond SQL; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
