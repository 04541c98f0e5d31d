"""Exact search of vectors: blocks of queries meet blocks of all rows, and each pair of blocks is one product of matrices in a task."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, of all rows and of queries; queries of a block that are compared at once.
ROWS, QUERIES, AT_ONCE = 8192, 2048, 128


def cosine_topk(rows: DataFrame, asked: Column, k: int, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, similarity) of the k rows of (vec_id, embedding) nearest to each that `asked` holds for, by similarity rounded to `digits`, then vec_id.

    Every query is compared with every other row, so the work grows with their product; a task holds one block of each.
    """
    doubles = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("u"))
    queries = doubles.where(asked)
    n, m = rows.count(), queries.count()
    blocks, groups = max(8, -(-n // ROWS)), max(1, -(-m // QUERIES))
    dealt = lambda t, n: t.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt(queries, groups).withColumnRenamed("i", "g").withColumn("b", each(blocks))
    right = dealt(doubles, blocks).withColumnRenamed("i", "b").withColumn("g", each(groups))
    parts = min(blocks * groups, max(rows.sparkSession.sparkContext.defaultParallelism, blocks * groups // 4))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def best(q: pa.Table, t: pa.Table) -> pa.Table:
        return nearest(q, t, k, digits)

    met = left.repartition(parts, "b", "g").groupBy("b", "g").cogroup(right.repartition(parts, "b", "g").groupBy("b", "g")).applyInArrow(best, f"query_id {kind}, vec_id {kind}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def units(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one as rows, and which rows have no vector or a null in it; a vector of zeros has NaN."""
    vectors = t.column("u").to_pylist()
    none = np.array([v is None or None in v for v in vectors], bool)
    width = max((len(v) for v in vectors if v is not None), default=0)
    x = np.array([[0.0] * width if bad else v for v, bad in zip(vectors, none, strict=True)], np.float64).reshape(len(vectors), width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1:]) if width else x, none


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds doubles: half up of the shortest decimal."""
    unique, place = np.unique(values, return_inverse=True)
    step = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(float(v))).quantize(step, ROUND_HALF_UP)) if np.isfinite(v) else v for v in unique])[place]


def nearest(queries: pa.Table, rows: pa.Table, k: int, digits: int) -> pa.Table:
    """The k nearest rows of a block for each query of a block. A product of matrices tells which rows can be among them; these are summed in order, as SQL does."""
    ids, others = queries.column("vec_id").combine_chunks(), rows.column("vec_id").combine_chunks()
    rank = np.empty(len(others), np.int64)
    rank[pc.sort_indices(others).to_numpy()] = np.arange(len(others))
    place = pc.index_in(ids, value_set=others).to_numpy(zero_copy_only=False)
    (q, no_q), (x, no_x) = units(queries), units(rows)
    found: tuple[list, list, list] = ([], [], [])
    margin = 2 * 10.0**-digits
    for start in range(0, len(q) if len(x) else 0, AT_ONCE):
        near = q[start : start + AT_ONCE] @ x.T
        for i, s in enumerate(near, start):
            # NaN stands before all numbers, null after them.
            s = np.where(no_x | no_q[i], -np.inf, np.where(np.isnan(s), np.inf, s))
            may = np.ones(len(s), bool)
            if not np.isnan(place[i]):
                may[int(place[i])] = False
            if may.sum() > k:
                may &= s >= np.partition(s[may], -k)[-k] - margin
            at = np.flatnonzero(may)
            exact = np.add.accumulate(q[i] * x[at], axis=1)[:, -1] if x.shape[1] else np.zeros(len(at))
            exact = np.where(np.isinf(s[at]), s[at], rounded(exact, digits))
            first = np.lexsort((rank[at], -exact))[:k]
            found[0].extend([i] * len(first))
            found[1].extend(at[first])
            found[2].extend(None if v == -np.inf else float("nan") if v == np.inf else v for v in exact[first])
    return pa.table({"query_id": ids.take(pa.array(found[0], pa.int64())), "vec_id": others.take(pa.array(found[1], pa.int64())), "similarity": pa.array(found[2], pa.float64())})
