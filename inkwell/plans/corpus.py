"""The document table that searches run on, mapped from the test tables, and the same mapping as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import spread

#: The instant that every age is measured from.
NOW = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """(doc_id, source, name, path, extension, size, modified_at, content). dealt: over all cores; else as the scan gives them, for reads of a few."""
    ext = F.element_at(F.array(*(F.lit(x) for x in ("md", "txt", "pdf", "csv"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name)
    modified = F.lit(NOW).cast("timestamp") - F.make_interval(days=(F.col("doc_id") % 900).cast("int"))
    rows = table(spark, sf_dir, "documents")
    return (spread(rows) if dealt else rows).select("doc_id", "source", name.alias("name"), path.alias("path"), F.concat(F.lit("."), ext).alias("extension"), F.col("n_chars").alias("size"), modified.alias("modified_at"), F.col("text").alias("content"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, doc_id, query, opened_at): events dealt over the documents."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).select("event_id", (F.col("event_id") % F.col("n")).alias("doc_id"), F.col("event_type").alias("query"), F.col("ts").cast("timestamp").alias("opened_at"))


DOCS_SQL = """docs AS (
    SELECT doc_id, source, 'doc_' || doc_id || '.' || ext AS name, '/' || source || '/' || lang || '/doc_' || doc_id || '.' || ext AS path,
           '.' || ext AS extension, n_chars AS size, TIMESTAMP '2024-01-01 00:00:00' - to_days((doc_id % 900)::INT) AS modified_at, text AS content
    FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'pdf' ELSE 'csv' END AS ext FROM documents))"""
USAGE_SQL = "usage AS (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS doc_id, event_type AS query, ts AS opened_at FROM events)"
#: DuckDB's counterparts of functions/text.py.
TOK_INDEX_SQL = "regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"
TOK_RANK_SQL = "regexp_extract_all(replace(lower(replace(coalesce({x}, ''), '_', ' ')), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"
TOK_FOLD_SQL = "regexp_extract_all(strip_accents(replace(lower(coalesce({x}, '')), 'ß', 'ss')), '[\\p{{L}}\\p{{N}}_]+')"
TOK_GRAM_SQL = "array_to_string(regexp_extract_all(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+'), ' ')"
