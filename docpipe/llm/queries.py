"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html, lines, lm, near, pieces, quality, urls, warc


#: Searches ask for the rows whose id is divisible by this, against all rows.
EVERY = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, among all vectors, of those whose id is divisible by EVERY."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), every=EVERY)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose id is divisible by EVERY, scored by all others."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return lm.each(docs, every=EVERY).withColumnRenamed("id", "doc_id")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), back=pieces.MODEL)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels"), toxic_z=quality.TOXIC_Z))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pack(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", F.col("__removed").alias("removed"))


def url_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: labels of the documents that the urls name."""
    named = pages.select("page_id", F.expr(f"try_cast(regexp_extract(url, r'{urls.NUMBER}', 1) as bigint)").alias("doc_id"))
    marks = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select("doc_id", F.expr("case when quality = 0 or toxic = 1 then 1 else 0 end").alias("bad"))
    return named.join(marks, "doc_id").select("page_id", "bad")


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.templates(pages, url_labels(pages, table(spark, sf_dir, "labels")))


QUERIES = {"op1_html_extraction": op1_html_extraction, "op2_nearest_vectors": op2_nearest_vectors, "op3_lm_scores": op3_lm_scores, "op4_near_duplicates": op4_near_duplicates, "op5_sentencepiece": op5_sentencepiece, "op6_quality": op6_quality, "op7_warc": op7_warc, "op8_decontamination": op8_decontamination, "op9_url_templates": op9_url_templates, "op10_line_dedup": op10_line_dedup}
ORACLE = {"op9_url_templates": urls.sql()}
