"""Similarity by weighted character n-grams: the fallback where no word matches.

A document keeps its most frequent n-grams; weights are (1 + ln tf) * idf over the kept ones. Vectors stay rows
(doc_id, gram, weight), a query's few grams are broadcast, and cosine is a grouped sum. Of a stored index a search reads
the frequencies and kept grams of its own grams, and norms and words by document.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.session import from_each, with_count, written

#: N-gram length, n-grams and words kept for a document, least cosine, word lengths.
N, MOST_GRAMS, MOST_WORDS, LEAST_COSINE, CONTENT_WORD, STEM_WORD = 3, 200, 200, 0.12, 3, 5
#: Different n-grams whose frequencies every task may hold; more meet the documents' n-grams by a join that deals both.
MOST_HELD = 500_000
#: N-grams that a scan is told at most.
MOST_PUSHED = 1000


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def gram_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a document's words, joined by one space."""
    return docs.select("doc_id", T.gram_text(F.concat_ws(" ", F.col("name"), T.text_of(F.col("content")))).alias("text"))


def top_grams(text: str, n: int, most: int) -> list[tuple[str, int]]:
    """The most frequent n-grams of a text with their counts; those of up to three characters are counted as numbers."""
    if n > 3 or len(text) < n:
        return Counter(T.one_grams(text, n)).most_common(most)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    packed = reduce(lambda a, k: (a << 21) | points[k : len(points) - n + 1 + k], range(1, n), points[: len(points) - n + 1])
    _, first, counts = np.unique(packed, return_index=True, return_counts=True)
    order = np.lexsort((first, -counts))[:most]
    return [(text[i : i + n], c) for i, c in zip(first[order].tolist(), counts[order].tolist(), strict=True)]


def kept_grams(docs: DataFrame, n: int = N, most: int = MOST_GRAMS) -> DataFrame:
    """(doc_id, gram, tf): each document's `most` most frequent n-grams, ties to the first seen. They are counted where the text is read, so that no occurrence is a row."""
    return from_each(gram_text(docs), lambda text: top_grams(text, n, most), "gram string, tf long")


def content_words(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(doc_id, words): what the precision gate compares."""

    def of(text: str) -> list[tuple]:
        words = [w for w, _ in Counter(w for w in text.split(" ") if len(w) >= CONTENT_WORD).most_common(most)]
        return [(words,)] if words else []

    return from_each(gram_text(docs), of, "words array<string>")


@dataclass
class SemanticIndex:
    """weights: (doc_id, gram, weight). norms: (doc_id, norm). frequency: (gram, df). words: (doc_id, words). n_docs: one row.

    kept: (doc_id, gram, tf), where it is stored; then a search looks up the frequencies of its grams alone. known: the number of documents, once it is read.
    """

    weights: DataFrame
    norms: DataFrame
    frequency: DataFrame
    words: DataFrame
    n_docs: DataFrame
    kept: DataFrame | None = None
    known: list[int] = field(default_factory=list)


def grams_and_words(docs: DataFrame, n: int = N, most: int = MOST_GRAMS) -> dict[str, DataFrame]:
    """What a document gives by itself: kept (doc_id, gram, tf) and words (doc_id, words)."""
    return {"kept": kept_grams(docs, n, most), "words": content_words(docs)}


def sums(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Document frequencies and the number of documents; parts of them add up."""
    return {"frequency": tables["kept"].groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "n_docs": tables["seen"].agg(F.count(F.lit(1)).alias("N"))}


def lost(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What documents that go take from the sums."""
    return {"frequency": tables["kept"].groupBy("gram").agg((-F.count(F.lit(1))).alias("df")), "n_docs": tables["seen"].agg((-F.count(F.lit(1))).alias("N"))}


def weighed(kept: DataFrame, frequency: DataFrame, n_docs: DataFrame, words: DataFrame, counted: bool = False) -> SemanticIndex:
    """Weights and norms from kept grams and their frequencies; each gram has one frequency. counted: the frequencies are a written table, so they go to the documents' grams where they are few enough, and else very common grams are found and dealt over several tasks."""
    if counted and frequency.limit(MOST_HELD + 1).count() <= MOST_HELD:
        met = kept.join(F.broadcast(frequency), "gram")
    else:
        met = with_count(kept, "gram", "doc_id", "df", counts=frequency) if counted else kept.join(frequency, "gram")
    rows = met.crossJoin(F.broadcast(n_docs))  # one row
    weights = rows.select("doc_id", "gram", ((1 + F.log("tf")) * idf(F.col("N"), F.col("df"))).alias("weight"))
    return SemanticIndex(weights, weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")), frequency, words, n_docs)


def index_of(docs: DataFrame, n: int = N, most: int = MOST_GRAMS) -> SemanticIndex:
    tables = grams_and_words(docs, n, most)
    tables["kept"] = written(tables["kept"], "kept")
    made = sums(tables | {"seen": docs})
    return weighed(tables["kept"], written(made["frequency"], "frequency"), made["n_docs"], tables["words"], counted=True)


def opened(tables: dict[str, DataFrame]) -> SemanticIndex:
    """An index over the stored layer: sums of all generations, weights and norms from the kept grams."""
    frequency = tables["frequency"].groupBy("gram").agg(F.sum("df").alias("df")).where("df > 0")
    index = weighed(tables["kept"], frequency, tables["n_docs"].agg(F.sum("N").alias("N")), tables["words"])
    return replace(index, kept=tables["kept"])


def shares_word(query: Column, words: Column) -> Column:
    """Whether a word is common to both, or starts one of the other where both have five letters and more."""
    long = lambda a: F.filter(a, lambda w: F.length(w) >= STEM_WORD)
    stems = F.exists(long(query), lambda q: F.exists(long(words), lambda d: F.startswith(q, d) | F.startswith(d, q)))
    return F.arrays_overlap(query, words) | stems


def search(index: SemanticIndex, query: str, limit: int = 20, least: float = LEAST_COSINE, n: int = N) -> DataFrame:
    """(doc_id, similarity): documents like the query that pass the gate, best first."""
    spark = index.weights.sparkSession
    text = T.one_gram_text(query)
    tf = Counter(T.one_grams(text, n))
    words = sorted({w for w in text.split() if len(w) >= CONTENT_WORD})
    if not tf or not words:
        return spark.createDataFrame([], "doc_id long, similarity double")
    asked = spark.createDataFrame(sorted(tf.items()), "gram string, tf long")
    grams = list(tf)[:MOST_PUSHED]
    only = (lambda d: d.where(F.col("gram").isin(grams))) if len(tf) <= MOST_PUSHED else (lambda d: d)
    met = only(index.frequency).join(F.broadcast(asked), "gram")
    # As many rows as the query has grams.
    if index.kept is None:
        known = met.crossJoin(F.broadcast(index.n_docs)).select("gram", ((1 + F.log("tf")) * idf(F.col("N"), F.col("df"))).alias("q"))
        norm = known.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
        dots = only(index.weights).join(F.broadcast(known), "gram").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot")).crossJoin(F.broadcast(norm))
    else:
        if not index.known:
            index.known.append(index.n_docs.first().N or 0)
        of = {r.gram: (r.tf, math.log((index.known[0] + 1) / (r.df + 1)) + 1) for r in met.collect()}
        q = {g: (1 + math.log(n)) * weight for g, (n, weight) in of.items()}
        norm = math.sqrt(math.fsum(x * x for x in q.values()))
        factors = spark.createDataFrame([(g, x * of[g][1]) for g, x in q.items()], "gram string, factor double")
        dots = only(index.kept).join(F.broadcast(factors), "gram").groupBy("doc_id").agg(F.sum((1 + F.log("tf")) * F.col("factor")).alias("dot")).withColumn("q_norm", F.lit(norm))
    similar = dots.join(index.norms, "doc_id").withColumn("similarity", F.col("dot") / (F.col("norm") * F.col("q_norm"))).where(F.col("similarity") >= least)
    passed = similar.join(index.words, "doc_id").where(shares_word(F.array(*(F.lit(w) for w in words)), F.col("words")))
    return passed.select("doc_id", "similarity").orderBy(F.desc("similarity"), "doc_id").limit(limit)
