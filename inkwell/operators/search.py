"""The search itself: parse, retrieve, rank, explain, and fall back where nothing matches."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import fuzzy, lexical, ranking, semantic, usage
from inkwell.plans import language

RESULT = ("doc_id", "path", "name", "source", "extension", "size", "modified_at", "score", "snippet", "layer")


@dataclass
class Engine:
    """An index with its optional layers. now: the instant that ages are measured from."""

    index: lexical.Index
    now: str
    weights: ranking.Weights = field(default_factory=ranking.Weights)
    semantic: semantic.SemanticIndex | None = None
    prints: DataFrame | None = None
    events: DataFrame | None = None
    context: usage.Context | None = None

    def search(self, query: str, limit: int = 20, source: str | None = None, doc_type: str | None = None, pool: int | None = None) -> DataFrame:
        """The best results. The fallbacks run only where the words match nothing and no filter is given."""
        plan, docs = planned(query, source, doc_type), self.index.docs
        if plan.match is None:
            found = lexical.filter_only(docs, plan, limit) if plan.filters and plan.exclude is None else docs.limit(0)
            return self.shown(found.withColumn("score", F.lit(0.0)), [], "filter")
        page = self.ranked(query, plan, limit, pool)
        if plan.filters or (self.semantic is None and self.prints is None):
            return page
        page = self.held(page)
        if not page.isEmpty():
            return page
        if self.semantic is not None:
            # At most `limit` rows.
            alike = docs.join(F.broadcast(semantic.search(self.semantic, query, limit).withColumnRenamed("similarity", "score")), "doc_id")
            alike = self.held(self.shown(alike, plan.terms, "semantic").orderBy(F.desc("score"), "doc_id"))
            if self.prints is None or not alike.isEmpty():
                return alike
        return self.shown(fuzzy.search(docs, self.prints, query, limit), plan.terms, "fuzzy").orderBy(F.desc("score"), F.lower("name"), "path")

    def held(self, page: DataFrame) -> DataFrame:
        """A page's rows, so that they are found once."""
        return page.sparkSession.createDataFrame(page.collect(), page.schema)

    def widened(self, plan: language.Plan) -> language.Plan:
        """The plan that also finds the context's related words; they don't rank."""
        extra = self.context.expansions(plan.terms) if self.context else []
        tokens = [t for t in (tuple(T.one_tok_index(w)) for w in extra) if t]
        if not tokens:
            return plan
        phrases = plan.phrases + [language.Phrase(t) for t in tokens]
        added = [("phrase", len(plan.phrases) + i) for i in range(len(tokens))]
        return replace(plan, phrases=phrases, match=("any", [plan.match, *added]))

    def signals(self, query: str, plan: language.Plan, limit: int, pool: int | None = None) -> tuple[DataFrame, ranking.Weights]:
        """The pool with its signals, and the weights that hold for it."""
        candidates = lexical.pool(self.index, {"q": self.widened(plan)}, limit, pool)
        weights, opened = self.weights.active(context=self.context is not None), None
        if self.events is not None:
            signals = usage.signals(self.events, query, self.now).where("boost > 0").select("doc_id", "boost")
            candidates = candidates.join(signals, "doc_id", "left")
            opened, weights = F.coalesce("boost", F.lit(0.0)), weights.active(usage=True)
        terms = F.array(*(F.lit(t) for t in plan.terms)).cast("array<string>")
        return ranking.with_signals(candidates, terms, self.now, opened, self.context.boost(self.now) if self.context else None), weights

    def ranked(self, query: str, plan: language.Plan, limit: int, pool: int | None = None) -> DataFrame:
        rated, weights = self.signals(query, plan, limit, pool)
        best = rated.withColumn("score", ranking.score(weights)).orderBy(F.desc("score"), "path").limit(limit)
        return self.shown(best, plan.terms, "lexical").orderBy(F.desc("score"), "path")

    def explain(self, query: str, limit: int = 20) -> DataFrame:
        """(doc_id, path, score, parts) of the first page."""
        rated, weights = self.signals(query, language.plan(query), limit)
        return rated.select("doc_id", "path", ranking.score(weights).alias("score"), ranking.explanation(weights).alias("parts")).orderBy(F.desc("score"), "path").limit(limit)

    def shown(self, results: DataFrame, terms: list[str], layer: str) -> DataFrame:
        text = fuzzy_snippet if layer == "fuzzy" else (lambda c: T.snippet(c, terms))
        return results.select("doc_id", "path", "name", "source", "extension", "size", "modified_at", "score", text(F.col("content")).alias("snippet"), F.lit(layer).alias("layer"))

    def suggestions(self, query: str, most: int = fuzzy.MOST_SUGGESTIONS) -> list[dict]:
        """Corrected queries that have results, nearest first; none if an unknown word has no correction."""
        vocabulary = lexical.vocabulary(self.index, limit=None).persist()
        tokens = [t for t in dict.fromkeys(T.one_tok_fold(query)) if len(t) >= fuzzy.LEAST_WORD]
        known = {r[0] for r in vocabulary.where(T.fold(F.col("token")).isin(tokens)).select(T.fold(F.col("token"))).collect()}
        unknown = [t for t in tokens if t not in known]
        offers: dict[str, list] = {}
        if unknown:
            for r in fuzzy.corrections(vocabulary, unknown).orderBy("token", "distance", F.desc("occurrences"), "word").collect():
                offers.setdefault(r.token, []).append(r)
        vocabulary.unpersist()
        if not unknown or len(offers) < len(unknown):
            return []
        tried = [(t, r.word, r.distance, " ".join(r.word if T.one_tok_fold(w) == [t] else w for w in query.split())) for t in unknown for r in offers[t]]
        plans = {q: p for _, _, _, q in tried if (p := language.plan(q)).match is not None}
        # One job counts the results of every corrected query.
        counts = dict(lexical.matches(self.index, plans).groupBy("query").count().collect()) if plans else {}
        first: dict[str, dict] = {}
        for token, word, distance, corrected in tried:
            if counts.get(corrected) and token not in first:
                first[token] = {"query": corrected, "token": token, "replacement": word, "distance": distance, "results": counts[corrected]}
        return sorted(first.values(), key=lambda s: (s["distance"], -s["results"], s["query"]))[:most]


def planned(query: str, source: str | None = None, doc_type: str | None = None) -> language.Plan:
    """The plan of a query with filters given beside its text."""
    plan = language.plan(query)
    if source:
        plan.filters.append(("source", "=", source))
    if doc_type:
        plan.filters.append(("type", "=", f".{doc_type.lstrip('.').lower()}"))
    return plan


def fuzzy_snippet(content):  # noqa: ANN001, ANN201
    return T.short_snippet(content)
