"""How results are shown: sorted, grouped, paged; saved and recent searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = ("relevance", "name", "modified", "size")
GROUPS = ("folder", "type", "source", "date")


def pool_size(limit: int, sort: str) -> int:
    """Results to rank before another order than relevance cuts them."""
    return limit if sort == "relevance" else min(500, limit * 5)


def sorted_by(results: DataFrame, sort: str, limit: int | None = None) -> DataFrame:
    orders = {
        "relevance": [F.desc("score"), F.asc("path")],
        "name": [F.lower("name").asc(), F.asc("name"), F.asc("path")],
        "modified": [F.col("modified_at").desc_nulls_last(), F.asc("path")],
        "size": [F.col("size").desc_nulls_last(), F.asc("path")],
    }
    out = results.orderBy(*orders[sort])
    return out.limit(limit) if limit is not None else out


def group_key(by: str) -> Column:
    return {
        "folder": F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)[\\\\/][^\\\\/]*$", 1), F.lit("")), F.lit("/")),
        "type": F.coalesce(F.nullif(F.lower("extension"), F.lit("")), F.lit("(none)")),
        "source": F.coalesce("source", F.lit("(unknown)")),
        "date": F.coalesce(F.date_format("modified_at", "yyyy-MM"), F.lit("(undated)")),
    }[by]


def grouped(results: DataFrame, by: str) -> DataFrame:
    """(group_key, n, total_size); every result is in one group."""
    return results.groupBy(group_key(by).alias("group_key")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size")).orderBy("group_key")


def count_invariants(results: DataFrame, groups: DataFrame) -> DataFrame:
    """(n_results, n_grouped, kept): whether grouping, as (group_key, n), lost no result and invented none."""
    n = results.agg(F.count(F.lit(1)).alias("n_results"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_grouped"))
    return n.crossJoin(F.broadcast(total)).withColumn("kept", F.col("n_results") == F.col("n_grouped"))


def group_members(page: DataFrame, by: str) -> DataFrame:
    """(group_key, members): names of a page of results, in their order."""
    return page.groupBy(group_key(by).alias("group_key")).agg(F.sort_array(F.collect_list(F.struct("path", "name"))).alias("m")).select("group_key", F.col("m.name").alias("members"))


def page_after(df: DataFrame, key: str, cursor: object | None, size: int = 128) -> DataFrame:
    """The next page in order of a unique key."""
    rows = df if cursor is None else df.where(F.col(key) > cursor)
    return rows.orderBy(key).limit(size)


@dataclass(frozen=True)
class SavedSearch:
    name: str
    query: str
    sort: str = "relevance"
    group: str = ""


def save_search(saved: list[SavedSearch], new: SavedSearch) -> list[SavedSearch]:
    """Replace the search of that name, whatever its case, in its place, or append."""
    same = [s.name.casefold() == new.name.casefold() for s in saved]
    return [new if hit else s for s, hit in zip(saved, same, strict=True)] + ([] if any(same) else [new])


def delete_search(saved: list[SavedSearch], name: str) -> list[SavedSearch]:
    return [s for s in saved if s.name.casefold() != name.casefold()]


def remember(recent: list[str], query: str, most: int = 20) -> list[str]:
    """The query first, once, and the others after it."""
    return [query, *(q for q in recent if q != query)][:most]
