"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling polynomial hash; of each window of w hashes the smallest is kept, the
rightmost of equal ones, with its position. Any passage of w + k - 1 code points that two texts share leaves a common
hash in both. The comparison to the next document runs over a range partitioning by id: within a
partition each text meets the next as the sorted rows stream by, and only the last text of each partition is joined to the first of the next,
so that each text crosses the network once.

Null texts count as empty. An empty text has no hashes; one shorter than k has the hash of the whole text. Two empty fingerprints
are alike (1.0). Rows are in order of id and then of a hash of the text, null ids first; repeated rows follow one another; the last row's next is the first. Columns other than id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, W = 24, 27
#: Odd multiplier of the rolling hash, and one that mixes its result.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: A hash has 40 bits; the rest of a 64-bit word holds the place within a segment of this many k-grams.
SEGMENT = 1 << 20
PLACE = (1 << 24) - 1


def doubled(x: np.ndarray, n: int, join) -> np.ndarray:
    """Combine each n neighbours of x by doubling; join(left, right, number on the right)."""
    out, size, piece = None, 0, x
    step = 1
    while step <= n:
        if n & step:
            out, size = (piece, step) if out is None else (join(piece[: len(x) - size - step + 1], out[step:][: len(x) - size - step + 1], size), size + step)
        if step * 2 <= n:
            piece = join(piece[: len(x) - 2 * step + 1], piece[step:][: len(x) - 2 * step + 1], step)
        step *= 2
    return out


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram, 40 bits."""
    join = lambda a, b, n: a * np.uint64(pow(BASE, n, 1 << 64)) + b
    h = doubled(codes.astype(np.uint64) + np.uint64(1), k, join)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(24)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, in order of position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, len(codes))
    n = len(codes) - k + 1
    w = min(w, n)
    hashes, places = [], []
    for at in range(0, n - w + 1, SEGMENT):
        h = rolling(codes[at : at + SEGMENT + w + k - 2], k)
        keys = (h << np.uint64(24)) | (np.uint64(PLACE) - np.arange(len(h), dtype=np.uint64))
        least = doubled(keys, w, lambda a, b, _: np.minimum(a, b))
        kept = least[np.concatenate(([True], least[1:] != least[:-1]))]
        hashes.append(kept >> np.uint64(24))
        places.append(at + (PLACE - (kept & np.uint64(PLACE)).astype(np.int64)))
    h, p = np.concatenate(hashes), np.concatenate(places)
    new = np.concatenate(([True], p[1:] != p[:-1]))
    return h[new], p[new]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes, each sorted and distinct."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = K, w: int = W, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hashes, positions) for each row of docs."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [winnow(t, k, w) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))], names=[key, "hashes", "positions"])

    return rows.mapInArrow(each, f"{key} {rows.schema[key].dataType.simpleString()}, hashes array<long>, positions array<long>")


class Printed:
    """A text with its fingerprint."""

    def __init__(self, text: str, k: int, w: int) -> None:
        self.text = text
        hashes, places = winnow(text, k, w)
        self.digest = hashlib.sha256(hashes.tobytes() + places.tobytes()).hexdigest()
        self.hashes, self.n = np.unique(hashes), len(hashes)


def compared(doc: Printed, following: Printed, k: int, w: int) -> tuple:
    n = len(doc.text)
    edited = Printed(doc.text[: n - n // 4] + following.text[: n // 4], k, w)
    return n, hashlib.sha256(edited.text.encode("utf-8", "surrogatepass")).hexdigest(), doc.digest, edited.digest, likeness(doc.hashes, edited.hashes), likeness(doc.hashes, following.hashes), doc.n


def edited_and_next(docs: DataFrame, k: int = K, w: int = W, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint against that of its edited text, whose last quarter is the start of the next document, and of the next document."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind_of_id = rows.schema["id"].dataType.simpleString()
    # Range partitioning samples its keys to the driver: a hash of the text, not the text, breaks ties of the id.
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    order = (F.col("id").asc_nulls_first(), F.col("tie"))
    ordered = keyed.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order, "text").drop("tie")
    results = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long"
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    nothing = (None,) * len(types)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, schema = TaskContext.get().partitionId(), None, None
        for b in batches:
            out = []
            schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("id", b.schema.field(0).type), ("text", pa.string()), *((str(i), t) for i, t in enumerate(types))])
            for id_, body in common.rows(b):
                doc = Printed(body, k, w)
                if held is None:
                    out.append(("first", part, id_, body, *nothing))
                else:
                    out.append(("done", part, held[0], None, *compared(held[1], doc, k, w)))
                held = id_, doc
            yield common.batch_of(schema, out)
        if held is not None:
            yield common.batch_of(schema, [("last", part, held[0], held[1].text, *nothing)])

    tagged = common.written(ordered.mapInArrow(stream, f"kind string, part int, id {kind_of_id}, text string, {results}"), "winnowed")
    done = tagged.where("kind = 'done'").drop("kind", "part", "text")
    used = sorted(r[0] for r in tagged.where("kind = 'first'").select("part").collect())  # a number for each partition
    after = F.create_map(*(F.lit(x) for pair in zip(used, used[1:] + used[:1], strict=True) for x in pair))[F.col("part")] if used else F.lit(0)
    ends = tagged.where("kind = 'last'").select("id", "text", after.alias("part"))
    starts = tagged.where("kind = 'first'").select("part", F.col("text").alias("following"))
    # A text for each partition: joined by shuffle, as it grows with them.
    seams = ends.join(starts.hint("merge"), "part").select("id", "text", "following")

    def seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([("id", b.schema.field("id").type), *((str(i), t) for i, t in enumerate(types))])
            yield common.batch_of(schema, [(id_, *compared(Printed(a, k, w), Printed(n, k, w), k, w)) for id_, a, n in common.rows(b)])

    return done.unionByName(seams.mapInArrow(seam, f"id {kind_of_id}, {results}")).withColumnRenamed("id", key)
