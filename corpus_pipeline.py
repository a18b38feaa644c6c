"""From raw documents to token ids: five stages, each over all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents. run applies them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm import decontaminate, lines, near, pieces, quality
from docpipe.llm.shared import written


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted on the labelled ones among docs; blank texts are rejected."""
    return quality.accepted(docs, quality.fit(docs, read(spark, sf_dir, "labels"), toxic_z=quality.TOXIC_Z))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are like an earlier one; n_chars follows the text. A document of which nothing is left goes."""
    out = lines.dedup(docs)
    left = F.regexp_replace("text", r"\s+", "") != ""
    n = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    out = out.where((F.col("__removed") == 0) | left)
    if n is not None:
        out = out.withColumn("n_chars", F.when(F.col("__removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(n)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near duplicates of one of a lesser doc_id."""
    return near.first_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids."""
    return pieces.encode(docs).select("doc_id", "ids", F.size("ids").alias("n_ids"))


STAGES = [
    ("quality classifier", good),
    ("line dedup", unrepeated_lines),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("sentencepiece", encoded),
]

#: SQL has no Zstandard, BagMinHash or Viterbi: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
