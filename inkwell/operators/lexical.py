"""The search index as a postings table, and BM25 over it for any number of queries at once.

An index is computed as it is used, or stored (`stored.py`), where a handful of query tokens prunes what is read. Queries
are a small table of phrases; they meet the postings by token, and everything else is grouping. Nothing here runs Python on executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.plans.language import Plan, filters_column
from inkwell.session import written

#: Fixed values of the ranking formula.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("name", "path", "content")
#: Phrases of one batch of queries at most: what is broadcast is bounded by it.
MOST_PHRASES = 100_000
#: Tokens that a scan of the postings is told at most.
MOST_PUSHED = 1000


@dataclass
class Index:
    """docs: the document table. postings: (doc_id, col, pos, token), with n_tokens where that is at hand. lengths: (doc_id, n_tokens)."""

    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame

    def totals(self) -> DataFrame:
        """One row (N, avg): documents and their mean length."""
        return self.lengths.agg(F.count(F.lit(1)).alias("N"), F.avg("n_tokens").alias("avg"))

    def metadata(self) -> DataFrame:
        """The documents' columns that filters and order need."""
        return self.docs.select("doc_id", "path", "extension", "source", "size", "modified_at")

    def narrowed(self, plans: dict[str, Plan]) -> Index:
        """The index with the plans' tokens alone, where they are few enough to reach the scan as a filter."""
        tokens = tokens_of(plans)
        return replace(self, postings=self.postings.where(F.col("token").isin(tokens))) if len(tokens) <= MOST_PUSHED else self

    def best(self, plans: dict[str, Plan], size: int, docs: DataFrame | None = None) -> DataFrame:
        """(query, doc_id, bm25): each query's best `size` matches by rank, then path."""
        ranked = matches(self, plans, docs).join(self.metadata().select("doc_id", "path"), "doc_id")
        best = Window.partitionBy("query").orderBy("bm25", "path")
        return ranked.withColumn("n", F.row_number().over(best)).where(F.col("n") <= size).select("query", "doc_id", "bm25")

    def pool(self, plans: dict[str, Plan], size: int, docs: DataFrame | None = None) -> DataFrame:
        """The documents of each query's best, with query and bm25."""
        return self.docs.join(self.best(plans, size, docs), "doc_id")


@dataclass
class Computed(Index):
    """An index computed as it is used."""

    def narrowed(self, plans: dict[str, Plan]) -> Index:
        """What a batch needs, written: each text is read and cut once, and columns in which no phrase may stand are only counted."""
        held = {p.column for plan in plans.values() for p in plan.phrases}
        rows = postings(self.docs, COLUMNS if "" in held else [c for c in COLUMNS if c in held], lone=True)
        tokens = ["", *tokens_of(plans)]
        if len(tokens) <= MOST_PUSHED:
            rows = rows.where(F.col("token").isin(tokens))
        else:  # MOST_PHRASES and one at most
            rows = rows.join(F.broadcast(self.docs.sparkSession.createDataFrame([(t,) for t in tokens], "token string")), "token", "left_semi")
        table = written(rows.select("doc_id", "n_tokens", "col", "pos", "token"), "asked")
        return Index(self.docs, table.where("col <> ''"), table.where("col = ''").select("doc_id", "n_tokens"))


def tokens_of(plans: dict[str, Plan]) -> list[str]:
    return sorted({t for p in plans.values() for phrase in p.phrases for t in phrase.tokens})


def postings(docs: DataFrame, columns: Sequence[str] = COLUMNS, lone: bool = False) -> DataFrame:
    """(doc_id, n_tokens, col, pos, token) of some columns; positions count from 0 in each, n_tokens is of all three.

    lone: each document also has a row with an empty column and token, so that one without any token has its length.
    """
    n_others = reduce(Column.__add__, (T.n_tok_index(F.col(c)) for c in COLUMNS if c not in columns), F.lit(0))
    cut = docs.select("doc_id", n_others.alias("n_others"), *(T.tok_index(F.col(c)).alias(c) for c in columns))
    sized = cut.select("doc_id", reduce(Column.__add__, (F.size(c) for c in columns), F.col("n_others")).cast("long").alias("n_tokens"), *columns)
    own = [(F.lit(c), F.col(c)) for c in columns] + [(F.lit(""), F.array(F.lit("")))] * lone
    each = F.explode(F.array(*(F.struct(c.alias("col"), tokens.alias("tokens")) for c, tokens in own))).alias("c")
    return sized.select("doc_id", "n_tokens", each).select("doc_id", "n_tokens", F.col("c.col").alias("col"), F.posexplode("c.tokens").alias("pos", "token"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", reduce(Column.__add__, (T.n_tok_index(F.col(c)) for c in COLUMNS)).cast("long").alias("n_tokens"))


def index_of(docs: DataFrame) -> Index:
    """An index computed as it is used; `stored` keeps one."""
    return Computed(docs, postings(docs), lengths(docs))


def phrase_table(spark: SparkSession, plans: dict[str, Plan]) -> DataFrame:
    """(query, phrase, k, token, only, n): the k-th token of n of each phrase; only: the column it is held to, or ''."""
    rows = [(q, i, k, token, p.column, len(p.tokens)) for q, plan in plans.items() for i, p in enumerate(plan.phrases) for k, token in enumerate(p.tokens)]
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"{len(rows)} phrase tokens in one batch; split it into batches of {MOST_PHRASES}")
    return spark.createDataFrame(rows, "query string, phrase int, k int, token string, only string, n int")


def occurrences(index: Index, phrases: DataFrame) -> DataFrame:
    """(query, phrase, doc_id, f): how often a document has each phrase, its tokens adjacent and in order within one column."""
    of = ["query", "phrase", "doc_id", *(c for c in ("n_tokens",) if c in index.postings.columns)]
    met = index.postings.join(phrases, "token").where((F.col("only") == "") | (F.col("only") == F.col("col")))
    whole = met.where("n = 1").groupBy(*of).agg(F.count(F.lit(1)).alias("f"))
    starts = met.where("n > 1").groupBy(*of, "col", (F.col("pos") - F.col("k")).alias("start"), "n").agg(F.count(F.lit(1)).alias("hits")).where("hits = n")
    return whole.unionByName(starts.groupBy(*of).agg(F.count(F.lit(1)).alias("f")))


def matches(index: Index, plans: dict[str, Plan], docs: DataFrame | None = None) -> DataFrame:
    """(query, doc_id, bm25): documents that satisfy each query, with FTS-style rank (0 or less, smaller is better).

    docs: those that may be returned; document frequencies and lengths still count the whole index.
    """
    spark = index.docs.sparkSession
    index = index.narrowed(plans)
    found = occurrences(index, F.broadcast(phrase_table(spark, plans)))
    stats = index.totals()
    frequency = found.groupBy("query", "phrase").agg(F.count(F.lit(1)).alias("n_p"))
    scoring = [(q, i) for q, plan in plans.items() for i in plan.scoring()]
    scored = spark.createDataFrame(scoring, "query string, phrase int").withColumn("scores", F.lit(True))
    idf = F.log((F.col("N") - F.col("n_p") + 0.5) / (F.col("n_p") + 0.5))
    # One row for each phrase of the batch.
    weights = frequency.join(F.broadcast(scored), ["query", "phrase"], "left").crossJoin(F.broadcast(stats)).select("query", "phrase", "avg", F.when(F.col("scores"), F.when(idf > 0, idf).otherwise(LEAST_IDF)).otherwise(0.0).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avg")))
    sized = found.where("doc_id IS NOT NULL") if "n_tokens" in found.columns else found.join(index.lengths, "doc_id")
    rated = sized.join(F.broadcast(weights), ["query", "phrase"])
    rows = rated.groupBy("query", "doc_id").agg((-F.sum(part)).alias("bm25"), F.collect_set("phrase").alias("has"))
    # Queries of one shape have one condition: a phrase is named by its place in its query.
    shapes = {repr((p.match, p.exclude)): p.condition(lambda i: F.array_contains("has", i)) for p in plans.values()}
    filters = {repr(p.filters): filters_column(p.filters) for p in plans.values()}
    place = {k: i for group in (shapes, filters) for i, k in enumerate(group)}
    kinds = spark.createDataFrame([(q, place[repr((p.match, p.exclude))], place[repr(p.filters)]) for q, p in plans.items()], "query string, shape int, kept_by int")
    pick = lambda column, tests: reduce(lambda c, x: c.when(F.col(column) == place[x[0]], x[1]), list(tests.items())[1:], F.when(F.col(column) == 0, next(iter(tests.values()))))
    out = rows.join(F.broadcast(kinds), "query").where(pick("shape", shapes)).drop("has", "shape")  # one row for each query of the batch
    filtered = any(p.filters for p in plans.values())
    if filtered or docs is not None:
        allowed = docs if docs is not None else index.metadata()
        out = out.join(allowed.select("doc_id", "extension", "source", "size", "modified_at"), "doc_id")
        if filtered:
            out = out.where(pick("kept_by", filters))
    return out.select("query", "doc_id", "bm25")


def pool(index: Index, plans: dict[str, Plan], limit: int = 20, size: int | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Each query's best max(5 * limit, 50) matches by rank, then path, with the documents' columns; filters hold before the cut."""
    return index.pool(plans, size or max(limit * 5, 50), docs)


def best_of_any(index: Index, queries: DataFrame) -> DataFrame:
    """(query, doc_id, bm25): the best document, by rank, then path, of each query of (query, tokens), any of whose tokens may match.

    Queries of any number: they stay a table, and meet the postings by token.
    """
    phrases = queries.select("query", F.explode(F.array_distinct("tokens")).alias("token"))
    of = ["token", "doc_id", *(c for c in ("n_tokens",) if c in index.postings.columns)]
    # Written, as frequencies and ranks both need it and texts are to be cut once.
    found = written(index.postings.join(phrases.select("token").distinct(), "token", "left_semi").groupBy(*of).agg(F.count(F.lit(1)).alias("f")), "found")
    sized = found.where("doc_id IS NOT NULL") if "n_tokens" in of else found.join(index.lengths.select("doc_id", "n_tokens"), "doc_id")
    stats = index.totals()
    idf = F.log((F.col("N") - F.col("n_p") + 0.5) / (F.col("n_p") + 0.5))
    # One row of statistics.
    weights = found.groupBy("token").agg(F.count(F.lit(1)).alias("n_p")).crossJoin(F.broadcast(stats)).select("token", "avg", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avg")))
    parts = sized.join(weights, "token").select("token", "doc_id", part.alias("part"))
    # Queries of the same tokens are one.
    asked = phrases.groupBy("query").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    rated = asked.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(parts, "token").groupBy("tokens", "doc_id").agg((-F.sum("part")).alias("bm25"))
    best = rated.join(index.docs.select("doc_id", "path"), "doc_id").groupBy("tokens").agg(F.min(F.struct("bm25", "path", "doc_id")).alias("best"))
    return asked.join(best, "tokens").select("query", "best.doc_id", "best.bm25")


def vocabulary(index: Index, limit: int | None = 50_000) -> DataFrame:
    """(token, occurrences): the most frequent first, or all of them, in no order, without a limit."""
    counts = index.postings.groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts if limit is None else counts.orderBy(F.desc("occurrences"), "token").limit(limit)


def filter_only(docs: DataFrame, plan: Plan, limit: int = 20) -> DataFrame:
    """Documents by filters alone, newest first."""
    return docs.where(filters_column(plan.filters)).orderBy(F.desc("modified_at"), "path").limit(limit)
