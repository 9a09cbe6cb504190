"""Queries over documents as source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.files import numbered_lines


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return numbered_lines(files).groupBy("repo", "path").agg(F.max("line").cast("long").alias("n_lines"), F.sum(F.length("text")).cast("long").alias("n_chars"))


QUERIES = {"source_lines": source_lines}

ORACLE_SQL = {
    "source_lines": r"""
WITH s AS (SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, regexp_split_to_array(text, '\r?\n') AS a FROM documents WHERE text IS NOT NULL)
SELECT repo, path, CAST(len(a) AS BIGINT) AS n_lines, CAST(list_sum(list_transform(a, lambda x: length(x))) AS BIGINT) AS n_chars FROM s
""",
}
