"""A toxicity classifier that swapped identity terms do not move.

Texts become sets of features: words of three letters and more, and their first four to six letters. Learning takes
a bounded sample of labelled rows (all other steps see every row): documents' feature counts by label are summed by
Spark, the features that speak most for either label are kept, and a logistic model over them is fitted. For each
sentence of the sample with an identity term, the term is swapped for others of its list; the loss has a penalty on
the squared change of the linear score between the sentence and its counterfactual. A group's mention alone so gains no weight,
however often toxic sentences mention it.

A swap changes the score only by the features of the two terms that nothing else in the sentence has, so swaps are counted by that
difference: of these there are few, however many sentences mention a group, and all swaps of the sample count.

Scores come from the whole text. Labels that are null or whose document is missing are not used; of several labels of a document the
highest counts. Null and empty texts have no features and get the model's prior. Without labels of both kinds every score is 1 / (1 + e^30), next to 0.
Rows are kept as they come, repeated ones and null ids too; other columns are kept, but for those named as the results, which these replace.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import common

#: Labelled rows of each label that learning uses at most, unless `train` is given another number or None for all; chosen by a hash of the id.
SAMPLE = 4000
#: Features that the model holds at most, unless `train` is given another number or None for all; and documents of the sample that a feature needs.
FEATURES, SUPPORT = 4096, 4
#: Log odds ratio that a feature needs: words of every text speak for no label.
LEAST_ODDS = 1.5
#: Words whose features a scoring task remembers.
REMEMBERED = 100_000
#: Terms of one list stand for one another.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"), ("black", "white", "asian", "latino"), ("immigrants", "citizens", "refugees"), ("old", "young"), ("deaf", "blind", "disabled"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
WORD = re.compile(r"[^\W\d_]{3,}")
SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: str) -> tuple[str, ...]:
    return (f"={word}", *(word[:n] for n in (4, 5, 6) if len(word) >= n))


def features(text: str | None) -> set[str]:
    return {f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)}


def counterfactuals(text: str | None, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> Iterator[tuple[set[str], set[str]]]:
    """Feature sets of each sentence with an identity term and of the sentence with the term swapped."""
    others = {w: [o for o in group if o != w] for group in identities for w in group}
    for sentence in SENTENCE.split((text or "").lower()):
        words = WORD.findall(sentence)
        for w in dict.fromkeys(words):
            for other in others.get(w, ()):
                yield {f for x in words for f in features_of(x)}, {f for x in words for f in features_of(other if x == w else x)}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def linear(self, found: set[str]) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in found)


def largest(at: np.ndarray, of: np.ndarray, by: np.ndarray, n: int, size: int, rounds: int = 40) -> float:
    """Largest eigenvalue of A'A by power iteration; A has by[i] in row at[i] and column of[i]."""
    v, value = np.ones(size), 0.0
    for _ in range(rounds):
        v = np.bincount(of, np.bincount(at, v[of] * by, n)[at] * by, size)
        value = float(np.linalg.norm(v))
        if not value:
            return 0.0
        v /= value
    return value


def fit(rows: list[tuple[int, list[int]]], swaps: list[tuple[list[int], list[int], int]], size: int, penalty: float, ridge: float = 0.1, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights by accelerated gradient steps on: mean log loss + ridge / 2 * |w|^2 / rows + penalty * mean squared score change over the swaps.

    swaps: features that a swap takes away, features that it adds, and how many swaps do so.
    """
    y = np.array([r[0] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    of = np.array([i for r in rows for i in r[1]], dtype=np.int64)
    s_at = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b, _ in swaps])
    s_of = np.array([i for a, b, _ in swaps for i in (*a, *b)], dtype=np.int64)
    share = np.array([n for _, _, n in swaps], float) / max(1, sum(n for _, _, n in swaps))
    s_by = np.array([x for a, b, _ in swaps for x in (*[1.0] * len(a), *[-1.0] * len(b))]) * np.sqrt(share)[s_at]
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    w, bias, v, vb = np.zeros(size), base, np.zeros(size), base
    n = len(y)
    curve = 0.25 / n * largest(np.concatenate((at, np.arange(n))), np.concatenate((of, np.full(n, size))), np.ones(len(at) + n), n, size + 1) + ridge / n
    if len(swaps):
        curve += 2 * penalty * largest(s_at, s_of, s_by, len(swaps), size)
    step = 1.0 / (1.2 * curve)  # 1.2: power iteration comes from below
    for k in range(rounds):
        z = np.bincount(at, v[of], len(y)) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        grad = np.bincount(of, g[at], size) + ridge / n * v
        if len(swaps):
            change = np.bincount(s_at, v[s_of] * s_by, len(swaps))
            grad += 2 * penalty * np.bincount(s_of, change[s_at] * s_by, size)
        new_w, new_b = v - step * grad, vb - step * g.sum()
        v, vb = new_w + k / (k + 3) * (new_w - w), new_b + k / (k + 3) * (new_b - bias)
        w, bias = new_w, new_b
    return w, bias


def train(docs: DataFrame, labels: DataFrame, penalty: float = 1.0, identities: tuple[tuple[str, ...], ...] = IDENTITIES, key: str = "doc_id", text: str = "text", sample_rows: int | None = SAMPLE, most_features: int | None = FEATURES) -> Model:
    """Learn from the labelled rows of docs, at most sample_rows of each label."""
    common.prepare(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max("toxic") > 0).cast("int").alias("y")).where(F.col("k").isNotNull())
    ids = docs.select(F.col(key).alias("k")).join(known, "k", "left_semi").distinct().join(known, "k")
    sample = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y)
        part = part if sample_rows is None else part.orderBy(F.xxhash64("k"), "k").limit(sample_rows)
        sample = part if sample is None else sample.unionByName(part)
    sample = common.written(sample, "sample")
    few = sample_rows is not None and sample_rows <= 1 << 16  # then at most 2 * sample_rows rows of two numbers
    taken = common.written(docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(sample) if few else sample, "k").dropDuplicates(["k"]).select("y", "text"), "labelled")
    totals = dict(taken.groupBy("y").count().collect())
    if len(totals) < 2:
        return Model({}, -30.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: tuple[Counter, Counter] = (Counter(), Counter())
            for y, body in common.rows(b):
                by[y].update(features(body))
            names = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in by)], names=["feature", "n0", "n1"])

    counts = taken.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= SUPPORT)
    odds = F.log((F.col("n1") + 0.5) / (totals[1] - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (totals[0] - F.col("n0") + 0.5))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = counts.withColumn("z", F.abs(odds) / error).where((F.col("z") > 2) & (F.abs(odds) > LEAST_ODDS))
    best = best if most_features is None else best.orderBy(F.desc("z"), "feature").limit(most_features)
    names = sorted(r[0] for r in best.select("feature").collect())
    place = {n: i for i, n in enumerate(names)}
    pick = lambda found: sorted(place[f] for f in found if f in place)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for y, body in common.rows(b):
                out.append((y, pick(features(body)), None))
                out += [(y, pick(a - c), pick(c - a)) for a, c in counterfactuals(body, identities)]
            yield common.batch_of(pa.schema([("y", pa.int32()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]), out)

    # A list for each row of the sample, and the few differences that the identity terms' own features can give.
    vectored = common.written(taken.mapInArrow(vectors, "y int, a array<int>, b array<int>"), "vectors")
    rows = sorted((r.y, r.a) for r in vectored.where("b is null").select("y", "a").collect())
    swaps = sorted((r.a, r.b, r.n) for r in vectored.where("b is not null and size(a) + size(b) > 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect())
    w, bias = fit(rows, swaps, len(names), penalty)
    return Model({n: float(x) for n, x in zip(names, w, strict=True)}, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the score and whether it reaches the threshold, as columns of these names."""
    common.prepare(docs.sparkSession)
    docs, weights, bias = docs.drop(*names), model.weights, model.bias
    result = StructType([*docs.schema, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    at = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[str, ...]] = {}
        for b in batches:
            out = []
            for body in b.column(at).to_pylist():
                found: set[str] = set()
                for w in set(WORD.findall((body or "").lower())):
                    hit = memory.get(w)
                    if hit is None:
                        if len(memory) >= REMEMBERED:
                            memory.clear()
                        hit = memory[w] = tuple(f for f in features_of(w) if f in weights)
                    if hit:
                        found.update(hit)
                out.append(bias + sum(weights[f] for f in sorted(found)))
            scores = 1 / (1 + np.exp(-np.clip(np.array(out), -60, 60)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=result.names)

    return docs.mapInArrow(each, result)
