"""Twelve signals of a candidate, and their weighted mean as its score."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T


@dataclass(frozen=True)
class Weights:
    """What each signal counts."""

    filename_exact: float = 3.0
    filename_tokens: float = 2.0
    path_match: float = 0.8
    phrase_exact: float = 2.0
    term_freq: float = 1.5
    proximity: float = 1.5
    bm25: float = 2.0
    doc_type: float = 0.5
    source: float = 0.4
    recency: float = 0.3
    usage: float = 0.0
    context: float = 0.0

    def active(self, usage: bool = False, context: bool = False) -> Weights:
        """Usage and context count only where there is something to count."""
        return replace(self, usage=0.25 if usage and not self.usage else self.usage, context=1.0 if context and not self.context else self.context)


def share(terms: Column, tokens: Column) -> Column:
    """Share of the terms that are among the tokens."""
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.array_contains(tokens, t))) / F.size(terms)).otherwise(0.0)


def contains_run(tokens: Column, terms: Column) -> Column:
    """Whether the terms stand in the tokens one after another: no token holds a space."""
    bounded = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.contains(bounded(tokens), bounded(terms))


def smallest_window(tokens: Column, terms: Column) -> Column:
    """Tokens of the shortest stretch that has every term, null if there is none: one pass that keeps each term's last place."""
    empty = F.struct(F.transform(terms, lambda _: F.lit(-1)).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(state: Column, token: Column) -> Column:
        last = F.transform(terms, lambda t, i: F.when(t == token["t"], token["i"]).otherwise(F.get(state["last"], i)))
        width = F.when(F.array_min(last) >= 0, token["i"] - F.array_min(last) + 1)
        return F.struct(last.alias("last"), F.least(state["best"], width).alias("best"))

    placed = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: F.array_contains(terms, x["t"]))
    return F.aggregate(placed, empty, step, lambda s: s["best"])


def recency(modified: Column, now: Column) -> Column:
    days = F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(modified)) / 86400), F.lit(0))
    return F.when(modified.isNull(), 0.75).otherwise(0.5 + 0.5 * F.exp(-days / 180))


def with_signals(candidates: DataFrame, terms: Column, now: str, usage: Column | None = None, context: Column | None = None) -> DataFrame:
    """candidates (name, path, content, modified_at, bm25) with a column for each signal; terms: distinct words in order."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    prepared = candidates.withColumns(
        {
            "_terms": terms,
            "_text": T.tok_rank(F.col("content")),
            "_name": T.tok_rank(F.col("name")),
            "_stem": T.tok_rank(F.regexp_replace("name", "\\.[^.]*$", "")),
            "_dirs": F.array_distinct(T.tok_rank(F.regexp_replace("path", "[^\\\\/]*$", ""))),
        }
    )
    q, body, n = F.col("_terms"), F.col("_text"), F.size("_terms")
    joined = F.array_join(q, " ")
    exact = F.when((n > 0) & ((joined == F.array_join("_name", " ")) | (joined == F.array_join("_stem", " "))), 1.0).otherwise(0.0)
    long_terms = F.filter(q, lambda t: F.length(t) >= 2)
    counts = F.transform(q, lambda t: F.least(F.size(F.filter(body, lambda w: w == t)) / F.lit(10.0), F.lit(1.0)))
    window = smallest_window(body, q)
    b = F.greatest(-F.col("bm25"), F.lit(0.0))
    signals = {
        "filename_exact": exact,
        "filename_tokens": share(q, F.col("_name")),
        "path_match": share(long_terms, F.col("_dirs")),
        "phrase_exact": F.when((n > 0) & contains_run(body, q), 1.0).otherwise(0.0),
        "term_freq": F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0),
        "proximity": F.when((n == 0) | window.isNull(), 0.0).otherwise(F.least(n / window, F.lit(1.0))),
        "bm25": b / (1 + b),
        "doc_type": F.when(F.length(T.text_of(F.col("content"))) > 0, 1.0).otherwise(0.4),
        "source": F.lit(1.0),
        "recency": recency(F.col("modified_at"), F.lit(now).cast("timestamp")),
        "usage": F.when(exact == 1.0, 0.0).otherwise(clamp(usage)) if usage is not None else F.lit(0.0),
        "context": clamp(context) if context is not None else F.lit(0.0),
    }
    return prepared.select(*candidates.drop("bm25").columns, *(v.alias(f"s_{k}") for k, v in signals.items()))


def score(weights: Weights) -> Column:
    w = asdict(weights)
    return reduce(Column.__add__, (F.col(f"s_{k}") * v for k, v in w.items() if v)) / sum(w.values())


def explanation(weights: Weights) -> Column:
    """Each signal's part of the score."""
    w = asdict(weights)
    total = sum(w.values())
    return F.map_from_arrays(F.array(*(F.lit(k) for k in w)), F.array(*(F.col(f"s_{k}") * (v / total) for k, v in w.items())))
