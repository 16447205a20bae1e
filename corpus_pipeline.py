"""From documents to packed sequences: toxicity, line dedup, near-duplicate removal, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import line_dedup, mixing, near_dedup, packing, toxicity
from recollect.plans.shared import discard, ship, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a classifier trained on the labelled ones rejects, by their worst window. Null, empty and blank texts stay; see toxicity.drop_toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lines that repeat an earlier one, and without documents of nothing else. Rows with a null doc_id or text stay as they are; see line_dedup.drop_repeated_lines."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each class of near duplicates. Rows with a null doc_id, or a text without a word, stay; see near_dedup.drop_near_duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as docs has, of the sources in proportion to the square root of their rows, longer texts more often. A null source is one like others; see mixing.mixed."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs and the sequences that hold them. Null, empty and blank texts have no piece; repeated rows are packed one by one; see packing.packed."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier and online packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written to the shared folder, read again by the next, and deleted when that is written.

    Nulls in any column, empty and very long texts, repeated rows and further columns are handled as each stage says; an
    empty documents table gives no rows.
    """
    ship(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            discard(last)
        last = docs
    return docs
