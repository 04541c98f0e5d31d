"""How good rankings are: precision, recall and reciprocal rank, margins, and accuracy of filters and empty results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def ranked(results: DataFrame) -> DataFrame:
    """(query, doc_id, score, path) with rank from 1."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "path")))


def quality(results: DataFrame, relevant: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(query, p_k, r_k for each cut, rr) from ranked results and relevant (query, doc_id); queries: every query asked.

    A query without relevant documents scores 1 if nothing was returned, else 0.
    """
    judged = results.join(relevant.withColumn("hit", F.lit(1)), ["query", "doc_id"], "left").groupBy("query").agg(
        F.count(F.lit(1)).alias("returned"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), *(F.count_if((F.col("hit") == 1) & (F.col("rank") <= k)).alias(f"h_{k}") for k in cuts)
    )
    wanted = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    joined = queries.select("query").join(judged, "query", "left").join(wanted, "query", "left").na.fill(0, ["returned", "wanted", *(f"h_{k}" for k in cuts)])
    empty = F.when(F.col("returned") == 0, 1.0).otherwise(0.0)
    value = lambda x: F.when(F.col("wanted") == 0, empty).otherwise(x)
    return joined.select("query", *(value(F.col(f"h_{k}") / k).alias(f"p_{k}") for k in cuts), *(value(F.col(f"h_{k}") / F.col("wanted")).alias(f"r_{k}") for k in cuts), value(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"))


def means(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in per_query.columns if c != "query"))


def margins(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query, margin, spread): best relevant score over the best other, and first over last."""
    hit = results.join(relevant.withColumn("hit", F.lit(True)), ["query", "doc_id"], "left")
    return hit.groupBy("query").agg((F.max(F.when(F.col("hit"), F.col("score"))) - F.max(F.when(F.col("hit").isNull(), F.col("score")))).alias("margin"), (F.max("score") - F.min("score")).alias("spread"))


def zero_results(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(n, accuracy): of queries (query, expects_none), those that returned nothing exactly when they should."""
    got = queries.join(results.select("query").distinct().withColumn("got", F.lit(True)), "query", "left")
    return got.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("got").isNull() == F.col("expects_none"), 1.0).otherwise(0.0)).alias("accuracy"))


def exact_matches(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """(n, accuracy, failures): of queries (query, doc_id) that name one document, those whose first result it is, and the others by name."""
    first = results.where("rank = 1").select("query", F.col("doc_id").alias("first"))
    got = wanted.join(first, "query", "left").withColumn("right", F.coalesce(F.col("first") == F.col("doc_id"), F.lit(False)))
    return got.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("right").cast("double")).alias("accuracy"), F.sort_array(F.collect_list(F.when(~F.col("right"), F.col("query")))).alias("failures"))


def filter_accuracy(results: DataFrame, holds: dict[str, Column]) -> DataFrame:
    """(query, n, accuracy): share of each query's results that satisfy its filter."""
    first, *rest = holds.items()
    test = reduce(lambda c, kv: c.when(F.col("query") == kv[0], kv[1]), rest, F.when(F.col("query") == first[0], first[1]))
    return results.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(test, 1.0).otherwise(0.0)).alias("accuracy"))
