"""Approximate nearest neighbours by collision counting.

Largest inner products become smallest distances by one more component, sqrt(M^2 - |x|^2) with M the largest norm of a block, and
queries scaled to norm M. Each of `LINES` random lines has a sorted array of the block's projected vectors; a vector's place in each is
kept. Around a query's own projection a window opens on each line, as wide as the radius asks for; virtual rehashing widens all
windows with the radius. Where windows newly take in a small part of the lines, only those places are counted; where they take in much, as in a query's first round, all places of
a line are compared with the window at once, which costs less for each (`SCAN`). A vector that lies in at least a share `SHARE` of the windows has collided often enough and is verified on the original
vectors in double precision. A query is done once its k-th best found is no farther than the radius. Until k are found the radius grows by
`FACTOR`; then the running k-th distance is the next radius, and the last. Most queries start from the usual distance of some pilot queries and need one round or two.

A vector within the radius lies in a window with a chance of 0.89, so in less than `SHARE` of the lines with one of about 1 in 12 at the radius itself, and
less nearer to the query; unrelated vectors of 64 dimensions pass in 1 of 20 cases. What is verified so is a small part of all, which `search` can report.
Nothing is capped: a query that does not get done verifies every vector of the block.

Vectors are dealt into bands of like norm, each with an M of its own, and bands into blocks by a hash of the id; queries into blocks of their own.
Each block of one meets each of the other, and the blocks' k best for each query are merged by rank.

Null, zero or non-finite vectors and rows without an id take no part. Vectors meet those of their own dimension. Of rows
that repeat a query's id one query is made (the smallest vector); of rows that repeat a candidate's id the best counts. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LINES, SEED = 128, 42
#: Width of a window at radius 1, share of the lines on which a candidate collides, factor of the radius until k are found.
WIDTH, SHARE, FACTOR = 3.2, 0.852, 1.25
#: Vectors and queries of a block at most, on average; numbers in them at most; queries that tell the others where to start.
VECTORS, NUMBERS, PILOTS = 16384, 1 << 22, 32
#: Queries that are open at once: each holds a flag and a count for each vector of the block.
OPEN = 1024
#: Places that are compared in the time that one is counted by itself.
SCAN = 16
#: Bands of like norm at most.
BANDS = 16


class Lines:
    """A block's vectors as sorted arrays on random lines."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        self.x, self.ids, self.verified, self.counted = x, ids, 0, 0
        self.repeated = len(np.unique(ids)) < len(ids)
        norms = (x**2).sum(axis=1)
        self.most = float(np.sqrt(norms.max()))
        self.directions = np.random.default_rng(SEED).standard_normal((x.shape[1] + 1, LINES))
        on = x @ self.directions[:-1] + np.sqrt(np.maximum(self.most**2 - norms, 0))[:, None] * self.directions[-1]
        self.order = np.ascontiguousarray(np.argsort(on, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(on.T, self.order, axis=1)
        self.places = np.empty(self.order.shape, np.uint16 if len(x) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, self.order, np.arange(len(x), dtype=self.places.dtype)[None, :], axis=1)
        self.space = np.empty(len(x), self.places.dtype), np.empty(len(x), bool)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and inner products of each query's k best, best first, ties to smaller ids; ids equal to own are left out."""
        found = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        scale = self.most / np.linalg.norm(queries, axis=1)
        on = (queries * scale[:, None]) @ self.directions[:-1]
        pilots = np.arange(min(PILOTS, len(queries)))
        far = self.rounds(queries, own, k, scale, on, pilots, np.full(len(queries), self.most / 8), found)
        usual = float(np.median(far)) if len(far) else self.most
        for start in range(len(pilots), len(queries), OPEN):
            self.rounds(queries, own, k, scale, on, np.arange(start, min(start + OPEN, len(queries))), np.full(len(queries), usual), found)
        return found

    def rounds(self, queries: np.ndarray, own: np.ndarray, k: int, scale: np.ndarray, on: np.ndarray, open_: np.ndarray, radius: np.ndarray, found: list) -> np.ndarray:
        """Search the open queries, each from its radius; gives their k-th distances."""
        seen, far, windows = {i: self.ids == own[i] for i in open_.tolist()}, [], {}
        while len(open_):
            half = radius[open_] * (WIDTH / 2)
            low, high = (np.stack([np.searchsorted(v, on[open_, j] + sign * half, side) for j, v in enumerate(self.values)], axis=1) for sign, side in ((-1, "left"), (1, "right")))
            left = []
            for at, i in enumerate(open_.tolist()):
                last = radius[i] >= 2 * self.most
                if not last and (high[at] - low[at]).sum() < SHARE * LINES * k:
                    radius[i] *= FACTOR  # too few collisions for k candidates
                    left.append(i)
                    continue
                new = np.flatnonzero(~seen[i] if last else (self.widened(windows, i, low[at], high[at]) >= SHARE * LINES) & ~seen[i])
                seen[i][new] = True
                self.verified += len(new)
                found[i] = self.best(*found[i], new, queries[i], k)
                kth = float(np.sqrt(max(2 * self.most**2 - 2 * scale[i] * found[i][1][-1], 0))) if len(found[i][0]) >= k else None
                if last or (kth is not None and kth <= radius[i]):
                    far.append(kth or radius[i])
                    del seen[i]
                    windows.pop(i, None)
                else:
                    radius[i] = radius[i] * FACTOR if kth is None else kth
                    left.append(i)
            open_ = np.array(left, np.int64)
        return np.array(far)

    def widened(self, windows: dict[int, list[np.ndarray]], i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """On how many lines each vector lies in query i's windows, now [low, high) of the sorted arrays: what they newly take in on either side is added."""
        counts, left, right = windows.get(i) or (np.zeros(len(self.x), np.uint8), low, low)
        grown = int((left - low).sum() + (high - right).sum())
        if grown * SCAN > self.places.size:
            counts[:] = 0
            (away, inside), kind = self.space, self.places.dtype.type
            for place, a, n in zip(self.places, low.astype(kind), (high - low).astype(kind), strict=True):
                np.subtract(place, a, out=away)  # below a it wraps to a large number
                np.less(away, n, out=inside)
                np.add(counts, inside.view(np.uint8), out=counts)
            self.counted += self.places.size
        elif grown:
            new = np.concatenate([o[a:z] for o, a, z in zip(self.order, low, left, strict=True)] + [o[a:z] for o, a, z in zip(self.order, right, high, strict=True)])
            counts += np.bincount(new, minlength=len(counts)).astype(np.uint8)
            self.counted += grown
        windows[i] = [counts, low, high]
        return counts

    def best(self, at: np.ndarray, scores: np.ndarray, new: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those at hand and the new ones."""
        at, scores = np.concatenate((at, new)), np.concatenate((scores, (self.x[new] * q).sum(axis=1)))
        if not self.repeated and len(at) > k:
            good = scores >= np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[good], scores[good]
        rank = np.lexsort((self.ids[at], -scores))
        at, scores = at[rank], scores[rank]
        if self.repeated:
            keep = np.sort(np.unique(self.ids[at], return_index=True)[1])
            at, scores = at[keep], scores[keep]
        return at[:k], scores[:k]


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.astype(np.float64).reshape(len(column), -1))


def blocks_for(count: Column, dim: Column) -> Column:
    """Blocks that so many vectors of a dimension fill."""
    return F.greatest(F.lit(1), F.ceil(count / F.greatest(F.lit(1), F.least(F.lit(VECTORS), F.floor(F.lit(NUMBERS) / dim))))).cast("long")


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", tally: Accumulator | None = None, places: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of each row where is_query holds. tally: gets the number of verified vectors; places: of counted places of the sorted arrays."""
    spark = vectors.sparkSession
    common.prepare(spark)
    valid = vectors.where(F.col(key).isNotNull() & F.coalesce(usable(vector), F.lit(False)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    given = valid.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.size(vector).alias("dim")).withColumn("norm", norm)
    given = common.written(given, "vectors")
    n, steps = given.agg(F.count(F.lit(1)), F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 1000)).first()  # at most BANDS numbers
    n_bands = min(BANDS, -(-n // VECTORS))  # a block has the neighbours' radius small where it has many vectors
    edges = [steps[i * BANDS // n_bands - 1] for i in range(1, n_bands)]
    band = sum((F.when(F.col("norm") > e, 1).otherwise(0) for e in edges), F.lit(0))
    deal = lambda count: F.pmod(F.xxhash64("id"), count)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    banded = given.withColumn("band", band)
    plan = common.written(banded.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("n_asks")), "bands")
    n_blocks = plan.select("dim", "band", "n_asks", blocks_for(F.col("n"), F.col("dim")).alias("n_blocks"))
    of_dim = n_blocks.groupBy("dim").agg(F.sum("n_blocks").alias("all_blocks"), F.sum("n_asks").alias("asked"))
    wide = F.ceil(F.lit(common.partitions(spark)) / F.col("all_blocks"))  # few blocks of vectors meet more blocks of queries
    query_blocks = F.greatest(blocks_for(F.col("asked"), F.col("dim")), F.least(F.ceil(F.col("asked") / (4 * PILOTS)), wide), F.lit(1)).cast("long")
    dims = of_dim.select("dim", query_blocks.alias("query_blocks"))
    data = banded.join(n_blocks, ["dim", "band"]).join(dims, "dim").select("dim", "band", deal(F.col("n_blocks")).alias("d"), every(F.col("query_blocks")).alias("q"), "id", "v")
    once = given.where("asks").groupBy("dim", "id").agg(F.min("v").alias("v"))
    asks = once.join(dims, "dim").select("dim", "id", "v", deal(F.col("query_blocks")).alias("q")).join(n_blocks, "dim").select("dim", "band", every(F.col("n_blocks")).alias("d"), "q", "id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        ids, own = left.column("id").to_numpy(), right.column("id").to_numpy()
        lines = Lines(matrix(left.column("v")), ids)
        found = lines.search(matrix(right.column("v")), own, k)
        if tally is not None:
            tally.add(lines.verified)
        if places is not None:
            places.add(lines.counted)
        return pa.table([np.repeat(own, [len(at) for at, _ in found]), np.concatenate([ids[at] for at, _ in found]), np.concatenate([s for _, s in found])], schema=schema)

    keys = ["dim", "band", "d", "q"]
    asks = asks.select(*(F.col(c).alias(c) for c in asks.columns))  # columns of its own: both sides come from one table
    pairs = data.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    # A query has k rows from each block at most, and one for each id.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
