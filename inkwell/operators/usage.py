"""What earlier openings say about a document: decayed counts, their boost, and personal contexts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as T

#: An opening's weight by age in days, and the share of openings for the same query.
DECAY = ((30, 1.0), (90, 0.6), (365, 0.3))
OLD, SAME_QUERY, ANY_QUERY = 0.1, 0.8, 0.2
LEAST, FULL = 2.0, 4.0
UNKNOWN_AGE = 10_000.0
#: Parts of a context's boost.
ROOT, SUBJECT, TYPE, SOURCE, RECENT = 0.5, 0.25, 0.15, 0.10, 0.10
#: Letters of a query that an event keeps.
MOST_QUERY = 200


def age_days(opened: Column, now: str) -> Column:
    return F.coalesce((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(opened)) / 86400e6, F.lit(UNKNOWN_AGE))


def decay(age: Column) -> Column:
    return reduce(lambda c, step: c.when(age <= step[0], step[1]), DECAY[1:], F.when(age <= DECAY[0][0], DECAY[0][1])).otherwise(OLD)


def boost(effective: Column) -> Column:
    return F.when(effective < LEAST, 0.0).otherwise(F.least(F.log1p(effective) / F.log1p(F.lit(FULL)), F.lit(1.0)))


def signals(events: DataFrame, query: str | None, now: str) -> DataFrame:
    """(doc_id, query_events, global_events, effective, boost) from (doc_id, query, opened_at)."""
    weight = decay(age_days(F.col("opened_at"), now))
    same = T.normal_query(F.col("query")) == T.normal_query(F.lit(query or ""))
    sums = events.groupBy("doc_id").agg(F.sum(F.when(same, weight).otherwise(0.0)).alias("query_events"), F.sum(weight).alias("global_events"))
    effective = SAME_QUERY * F.col("query_events") + ANY_QUERY * F.col("global_events")
    return sums.withColumn("effective", effective).withColumn("boost", boost(F.col("effective")))


def effects(events: DataFrame, docs: DataFrame, now: str) -> DataFrame:
    """(doc_id, query, name, events, effective, boost) for each pair that was opened, strongest first; documents that are gone are named by their id."""
    weight = decay(age_days(F.col("opened_at"), now))
    keyed = events.withColumn("query", T.normal_query(F.col("query"))).withColumn("w", weight)
    by_query = keyed.groupBy("doc_id", "query").agg(F.count(F.lit(1)).alias("events"), F.sum("w").alias("q"))
    by_doc = by_query.groupBy("doc_id").agg(F.sum("q").alias("g"))
    rated = by_query.join(by_doc, "doc_id").withColumn("effective", SAME_QUERY * F.col("q") + ANY_QUERY * F.col("g")).withColumn("boost", boost(F.col("effective")))
    named = rated.join(docs.select("doc_id", "name"), "doc_id", "left")
    return named.select("doc_id", "query", F.coalesce("name", F.col("doc_id").cast("string")).alias("name"), "events", "effective", "boost").orderBy(F.desc("boost"), F.desc("effective"), "doc_id", "query")


def opened(spark: SparkSession, rows: list[tuple[int, int, str]], at: str) -> DataFrame:
    """(event_id, doc_id, query, opened_at) to append: a query is cut to 200 letters and kept as it compares."""
    return spark.createDataFrame(rows, "event_id long, doc_id long, query string").select("event_id", "doc_id", F.substring(T.normal_query(F.col("query")), 1, MOST_QUERY).alias("query"), F.lit(at).cast("timestamp").alias("opened_at"))


def first_queries(docs: DataFrame, events: DataFrame) -> DataFrame:
    """(doc_id, first_query): what each document was first opened for, or null."""
    first = events.groupBy("doc_id").agg(F.min(F.struct("opened_at", "event_id", "query")).alias("first"))
    return docs.select("doc_id").join(first, "doc_id", "left").select("doc_id", F.col("first.query").alias("first_query"))


def record(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def clear(spark: SparkSession, path: str) -> int:
    """Forget all events under path; gives how many there were."""
    events = spark.read.parquet(path)
    n = events.count()
    spark.createDataFrame([], events.schema).coalesce(1).write.mode("overwrite").parquet(path)
    return n


@dataclass
class Contexts:
    """Named contexts, and those that are active; they hold in the order in which they were activated."""

    known: dict[str, Context] = field(default_factory=dict)
    active: list[str] = field(default_factory=list)

    def add(self, text: str) -> Context:
        """A context from a JSON object, in place of one of its name. Unknown fields and a missing name are errors."""
        given = json.loads(text)
        unknown = set(given) - set(Context.__dataclass_fields__)
        if unknown or not given.get("name"):
            raise ValueError(f"a context has a name and no {sorted(unknown)}")
        lists = {k: tuple(v) for k, v in given.items() if k in ("roots", "subjects", "sources", "types")}
        related = {k: tuple(v) for k, v in given.get("related", {}).items()}
        self.known[given["name"]] = made = Context(given["name"], related=related, recent_days=given.get("recent_days"), **lists)
        return made

    def activate(self, name: str) -> None:
        if name not in self.known:
            raise KeyError(name)
        self.active = [*(n for n in self.active if n != name), name]

    def deactivate(self, name: str) -> None:
        self.active = [n for n in self.active if n != name]

    def remove(self, name: str) -> None:
        self.known.pop(name, None)
        self.deactivate(name)

    def merged(self) -> Context | None:
        """What holds: the active contexts together, or None."""
        return reduce(Context.merged, (self.known[n] for n in self.active)) if self.active else None


@dataclass(frozen=True)
class Context:
    """What a person works on."""

    name: str = ""
    roots: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    related: dict[str, tuple[str, ...]] = field(default_factory=dict)
    recent_days: int | None = None

    def merged(self, other: Context) -> Context:
        """Both contexts' entries, each once; the other's name and days hold where it has them."""
        union = lambda a, b: tuple(dict.fromkeys((*a, *b)))
        related = {k: union(self.related.get(k, ()), other.related.get(k, ())) for k in (*self.related, *other.related)}
        return Context(other.name or self.name, union(self.roots, other.roots), union(self.subjects, other.subjects), union(self.sources, other.sources), union(self.types, other.types), related, other.recent_days if other.recent_days is not None else self.recent_days)

    def expansions(self, terms: list[str]) -> list[str]:
        """Related words of the terms that are not among them; they widen what is found, never how it scores."""
        by = {k.casefold(): v for k, v in self.related.items()}
        return [w for w in dict.fromkeys(w for t in terms for w in by.get(t.casefold(), ())) if w.casefold() not in terms]

    def boost(self, now: str) -> Column:
        under = lambda root: (F.col("path") == root) | F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/"))
        any_of = lambda tests: reduce(Column.__or__, tests, F.lit(False))
        words = F.array_union(T.tok_rank(F.col("name")), T.tok_rank(F.col("path")))
        parts = [
            (ROOT, any_of(under(r) for r in self.roots)),
            (SUBJECT, any_of(F.arrays_overlap(words, T.tok_rank(F.lit(s))) for s in self.subjects)),
            (TYPE, F.col("extension").isin(*(f".{t.lstrip('.').lower()}" for t in self.types)) if self.types else F.lit(False)),
            (SOURCE, F.col("source").isin(*self.sources) if self.sources else F.lit(False)),
            (RECENT, F.coalesce(age_days(F.col("modified_at"), now) <= self.recent_days, F.lit(False)) if self.recent_days is not None else F.lit(False)),
        ]
        return F.least(reduce(Column.__add__, (F.when(c, w).otherwise(0.0) for w, c in parts)), F.lit(1.0))
