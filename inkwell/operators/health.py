"""Checks and statistics of a document table and what is derived from it, as relational queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators import ingest, organize
from inkwell.session import written


def missing(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the left that the right lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def duplicates(docs: DataFrame) -> DataFrame:
    """(source, path, n) that occurs more than once; equal paths of two sources are legitimate."""
    return docs.groupBy("source", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def counted(docs: DataFrame, by: str) -> DataFrame:
    """(by, n), most frequent first."""
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def by_root(docs: DataFrame, roots: DataFrame, stale_before: str) -> DataFrame:
    """(root, documents, bytes, stale, by_type, by_source): each root's documents; nested ones count for the inner root. The maps have a key for each kind."""
    held = ingest.owners(docs, roots).where(F.col("root").isNotNull())
    cells = held.groupBy("root", "extension", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_if(F.col("modified_at") < F.lit(stale_before).cast("timestamp")).alias("stale"))
    out = cells.groupBy("root").agg(F.sum("n").alias("documents"), F.sum("bytes").alias("bytes"), F.sum("stale").alias("stale"))
    for name, key in (("by_type", "extension"), ("by_source", "source")):
        kinds = cells.groupBy("root", F.coalesce(key, F.lit("")).alias("k")).agg(F.sum("n").alias("n")).groupBy("root").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(name))
        out = out.join(kinds, "root")
    return out


def unhashed(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id) of documents that have a text but no content hash."""
    return docs.join(texts, "doc_id").where(F.col("content_hash").isNull() & (F.col("content") != "")).select("doc_id")


def orphan_page(rows: DataFrame, docs: DataFrame, after: object | None = None, size: int = 128) -> DataFrame:
    """(doc_id, name, path): the next page, by id, of ids among rows that no document has; for work through all of them page by page."""
    named = rows.groupBy("doc_id").agg(F.max("name").alias("name"), F.max("path").alias("path"))
    return organize.page_after(named.join(docs.select("doc_id"), "doc_id", "left_anti"), "doc_id", after, size)


def keys_with(table: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Rows whose key starts with the prefix, which a scan can prune by; what follows it as `rest`."""
    return table.where(F.startswith(key, F.lit(prefix))).withColumn("rest", F.substring(key, len(prefix) + 1, 1 << 30))


def load_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON objects, one a line; torn lines and what is no object are skipped."""
    torn = "_torn"
    rows = spark.read.schema(f"{schema}, {torn} string").option("columnNameOfCorruptRecord", torn).json(path)
    named = [f.name for f in rows.schema if f.name != torn]
    return rows.where(F.col(torn).isNull() & reduce(Column.__or__, (F.col(c).isNotNull() for c in named))).drop(torn)


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def uniform(rows: DataFrame, column: str) -> DataFrame:
    """(n, lowest, highest) of a version column in one pass."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lowest"), F.max(column).alias("highest"))


def snapshot_key(rows: DataFrame, column: str) -> DataFrame:
    """(n, newest): what a cache of the rows is valid for."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(column).cast("string"), F.lit("")).alias("newest"))


def report(tables: dict[str, DataFrame], docs: DataFrame) -> DataFrame:
    """(check, problems): rows of each table without a document, documents without a row in it, repeated identities."""
    rows = [duplicates(docs).select(F.lit("duplicate_identity").alias("check"))]
    for name, t in tables.items():
        rows += [missing(t, docs).select(F.lit(f"orphans:{name}").alias("check")), missing(docs, t).select(F.lit(f"missing:{name}").alias("check"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("check").agg(F.count(F.lit(1)).alias("problems"))


def metrics_summary(records: DataFrame) -> DataFrame:
    """(kind, n, total, mean, most, last) of (kind, seq, value)."""
    return records.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.max_by("value", "seq").alias("last"))


def compacted(records: DataFrame, keep: int = 200) -> DataFrame:
    """The newest records, as many as are kept when a log grows too long."""
    return records.orderBy(F.desc("seq")).limit(keep)


def percentiles(values: DataFrame, by: str, value: str, fractions: tuple[float, ...]) -> DataFrame:
    """(by, p_...) without interpolation: the value at place floor(f * (n - 1)) in order.

    Equal values are counted before anything meets. Distinct values are dealt over ranges of (by, value); each range's counts tell how many stand before it, so
    that a key of very many values is placed range by range and no task has all of them.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_m"))
    dealt = written(counted.repartitionByRange(by, value).withColumn("_p", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy(by, "_p").agg(F.sum("_m").alias("_in"))
    of_key = Window.partitionBy(by)  # a row for each range
    before = ranges.withColumn("_before", F.sum("_in").over(of_key.orderBy("_p")) - F.col("_in")).withColumn("_n", F.sum("_in").over(of_key)).drop("_in")
    end = F.sum("_m").over(Window.partitionBy(by, "_p").orderBy(value))
    upto = dealt.withColumn("_end", end).join(before.select(F.col(by).alias("_by"), F.col("_p").alias("_q"), "_before", "_n"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q")))
    at = lambda f: F.least(F.col("_n") - 1, F.floor(F.lit(f) * (F.col("_n") - 1)))
    return upto.groupBy(by).agg(*(F.min(F.when(F.col("_before") + F.col("_end") > at(f), F.col(value))).alias(f"p{round(f * 100)}") for f in fractions))
