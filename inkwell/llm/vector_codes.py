"""Vector codes: product quantisation in whole numbers, screened by float32 matrix products.

A component x becomes floor(scale * x). A vector is cut into parts; each place of a part has a codebook of its own, which starts as the parts of the
first vectors by id and is improved by rounds of assigning and averaging (rounded down). All that decides is exact.

Nearest entries: |c|^2 - 2 p.c orders the entries c of a part p as their squared distances do. A float32 matrix product of (p, 1) and (-2c, |c|^2)
gives it for many parts and all entries at once. With u = 2^-24 each of the m + 1 products is off by the rounding of its two factors and of at most m + 1 operations,
whatever their order, so the value lies within g * (2 |p| |c| + |c|^2) of the exact one, g = (m + 3) u / (1 - (m + 3) u); the largest |c| gives one width for a part.
Every entry whose interval reaches below the best one's upper end is evaluated again in 64-bit integers, and of equal distances the smallest index counts.
Vectors with components so large that 64 bits could overflow are compared in Python's integers.

A pass over the vectors gives each task's sums and counts for each entry, text of bounded size, which are added up in two levels; the vectors themselves never cross the
network, and only codebooks reach the driver.

Vectors that are null or hold null or non-finite components are left out; zero vectors stay. Vectors of different lengths have codebooks of their own
(`MOST_LENGTHS` lengths at most, else an error); a length that the parts do not divide is cut as evenly as it goes, an empty vector into empty parts. Equal ids are ordered by their vectors, null ids come last.
Fewer vectors than entries give a codebook of as many entries. Null labels are one label. An error beyond 64 bits is null, and so is its label's. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Unit roundoff of float32, and a factor that covers the bound's own rounding in float64.
UNIT, SLACK = 2.0**-24, 1 + 1e-9
#: Different lengths of vectors at most: each has codebooks in every task.
MOST_LENGTHS = 1000
#: Parts compared at once.
ROWS = 4096
#: Groups that a part's sums are added up in first.
SALTS = 64


@dataclass
class Codebooks:
    """parts[p]: the entries of part p, one in each row; int64, or Python's integers where 64 bits could overflow."""

    width: int
    parts: list[np.ndarray]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.parts for x in part.reshape(-1).tolist()).encode()).hexdigest()

    def decoded(self, code: bytes) -> list[int]:
        """The whole-number vector that a code stands for."""
        return [x for part, i in zip(self.parts, code, strict=True) for x in part[i].tolist()]


def cuts(width: int, parts: int) -> list[int]:
    return [p * width // parts for p in range(parts + 1)]


def small_enough(width: int) -> int:
    """Components below this leave a vector's squared distance within 63 bits."""
    return math.isqrt(2**61 // max(width, 1))


def whole(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)


def integers(vectors: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in int64, and which rows are too large for that (zero there)."""
    scaled = np.floor(vectors * float(scale))
    large = (np.abs(scaled) >= small_enough(vectors.shape[1])).any(axis=1)
    scaled[large] = 0
    return scaled.astype(np.int64), large


def narrow(rows: list[list[int]], width: int) -> np.ndarray:
    """Entries as int64 where they are small enough for vectors of this length."""
    wide = np.array(rows, dtype=object)
    wide = wide.reshape(len(rows), -1)
    most = max((abs(x) for x in wide.reshape(-1)), default=0)
    return wide.astype(np.int64) if most < small_enough(width) else wide


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry, ties to the smaller index."""
    if parts.dtype == object or entries.dtype == object:
        return exact(parts, entries)
    m = parts.shape[1]
    squares = (entries * entries).sum(axis=1)
    right = np.concatenate((-2 * entries, squares[:, None]), axis=1).astype(np.float32)
    growth = (m + 3) * UNIT / (1 - (m + 3) * UNIT)
    longest = math.sqrt(float(squares.max(initial=0)))
    index, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for start in range(0, len(parts), ROWS):
        p = parts[start : start + ROWS]
        left = np.concatenate((p, np.ones((len(p), 1), p.dtype)), axis=1).astype(np.float32)
        screened = left @ right.T
        norms = np.sqrt((p.astype(np.float64) ** 2).sum(axis=1))
        width = growth * SLACK * (2 * norms * longest + longest * longest) * SLACK
        row, entry = np.nonzero(screened <= (screened.min(axis=1).astype(np.float64) + 2 * width)[:, None])
        off = p[row] - entries[entry]
        found = (off * off).sum(axis=1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(found, first)
        # Entries ascend within a part, so its first one at the best distance has the smallest index.
        hit = np.flatnonzero(found == best[row])
        at = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        index[start : start + len(p)], distance[start : start + len(p)] = entry[at], best
    return index, distance


def exact(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, distance = [], []
    for p in parts.astype(object):
        all_d = [sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in entries]
        index.append(min(range(len(all_d)), key=all_d.__getitem__))
        distance.append(all_d[index[-1]])
    return np.array(index, np.int64), np.array(distance, dtype=object)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their vectors in float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        yield rows, flat[starts[rows][:, None] + np.arange(width)]


def assigned(vectors: np.ndarray, books: Codebooks, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, rows, values, index, distance) for each part, rows of large components apart."""
    small, large = integers(vectors, scale)
    edges = cuts(books.width, len(books.parts))
    fits, wide = np.flatnonzero(~large), np.flatnonzero(large)
    huge = np.array([[whole(x, scale) for x in v] for v in vectors[wide].tolist()], dtype=object).reshape(len(wide), books.width)
    for p, entries in enumerate(books.parts):
        at = slice(edges[p], edges[p + 1])
        for rows, values in ((fits, small[fits, at]), (wide, huge[:, at])):
            if len(rows):
                yield p, rows, values, *nearest(values, entries)


def kept(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    return vectors.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def first_books(given: DataFrame, parts: int, entries: int, scale: int) -> dict[int, Codebooks]:
    order = Window.partitionBy("width").orderBy(F.asc_nulls_last("id"), "v")
    first = given.select("id", "v", F.size("v").alias("width")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= entries)
    of: dict[int, list] = {}
    for r in first.orderBy("width", "r").collect():  # `entries` rows for each length
        of.setdefault(r.width, []).append([whole(x, scale) for x in r.v])
        if len(of) > MOST_LENGTHS:
            raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    return {width: Codebooks(width, [narrow([v[a:b] for v in rows], width) for a, b in zip(cuts(width, parts), cuts(width, parts)[1:], strict=False)]) for width, rows in of.items()}


SUMS = pa.schema([("width", pa.int64()), ("part", pa.int64()), ("salt", pa.int64()), ("counts", pa.string()), ("sums", pa.string())])
SUMS_DDL = "width long, part long, salt long, counts string, sums string"
texted = lambda numbers: ",".join(map(str, numbers))
numbers = lambda text: np.array([int(x) for x in text.split(",") if x], dtype=object)


def improved(given: DataFrame, books: dict[int, Codebooks], scale: int) -> dict[int, Codebooks]:
    """One round: assign every part, then average."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, sums = TaskContext.get().partitionId() % SALTS, {}
        for b in batches:
            for _, vectors in by_length(b.column(0)):
                own = books[vectors.shape[1]]
                for p, _, values, index, _ in assigned(vectors, own, scale):
                    k, m = own.parts[p].shape
                    n, total = sums.setdefault((own.width, p), [np.zeros(k, np.int64), np.zeros((k, m), dtype=object)])
                    n += np.bincount(index, minlength=k)
                    batch = np.zeros((k, m), values.dtype)
                    np.add.at(batch, index, values)
                    total += batch
        yield common.batch_of(SUMS, [(width, p, salt, texted(n.tolist()), texted(total.reshape(-1).tolist())) for (width, p), (n, total) in sums.items()])

    def added(group: pa.Table) -> pa.Table:
        width, part, salt = (group.column(c)[0].as_py() for c in ("width", "part", "salt"))
        both = (sum(map(numbers, group.column(c).to_pylist())) for c in ("counts", "sums"))
        return pa.Table.from_batches([common.batch_of(SUMS, [(width, part, salt, *map(texted, both))])])

    tasks = given.select("v").mapInArrow(partial, SUMS_DDL)
    salted = tasks.groupBy("width", "part", "salt").applyInArrow(lambda t: added(t), SUMS_DDL)
    out = {width: Codebooks(width, list(own.parts)) for width, own in books.items()}
    for r in salted.groupBy("width", "part").applyInArrow(lambda t: added(t), SUMS_DDL).collect():  # one row for each codebook
        old = out[r.width].parts[r.part]
        n, total = numbers(r.counts), numbers(r.sums).reshape(old.shape)
        out[r.width].parts[r.part] = narrow([[x // c for x in row] if c else was for row, c, was in zip(total.tolist(), n.tolist(), old.tolist(), strict=True)], r.width)
    return out


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[dict[int, Codebooks], DataFrame]:
    """The codebooks by length of vector, and (key, label, code, error, label_error, codebooks_sha256); a code has a byte for each part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    spark = vectors.sparkSession
    common.prepare(spark)
    given = kept(vectors, vector).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    books = first_books(given, parts, entries, scale)
    for _ in range(rounds):
        books = improved(given, books, scale)
    id_type, label_type = (given.schema[c].dataType for c in ("id", "label"))
    schema = pa.schema([("id", to_arrow_type(id_type)), ("label", to_arrow_type(label_type)), ("code", pa.binary()), ("error", pa.int64()), ("codebooks_sha256", pa.string())])
    digests = {width: own.sha256() for width, own in books.items()}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error, digest = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, dtype=object), np.empty(b.num_rows, dtype=object)
            for rows, found in by_length(b.column(2)):
                own = books[found.shape[1]]
                digest[rows] = digests[own.width]
                for p, at, _, index, distance in assigned(found, own, scale):
                    code[rows[at], p] = index
                    error[rows[at]] += distance
            bounded = [int(e) if e < 2**63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.types[0]), b.column(1).cast(schema.types[1]), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(bounded, pa.int64()), pa.array(digest.tolist(), pa.string())], schema=schema)

    rows = given.mapInArrow(coded, f"id {id_type.simpleString()}, label {label_type.simpleString()}, code binary, error long, codebooks_sha256 string")
    rows = common.written(rows.withColumn("named", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    total = F.when(F.count_if(F.col("error").isNull()) == 0, F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    sums = common.written(rows.groupBy("named").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    out = common.salted_join(rows, sums, "named", "n", F.xxhash64("id"), "inner")
    return books, out.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error", "label_error", "codebooks_sha256")
