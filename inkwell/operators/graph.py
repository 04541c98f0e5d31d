"""A bounded graph of related documents: candidates by shared keys, scored by eight signals, pruned to each document's strongest edges.

Candidate generation caps each key's postings at its strongest documents before the self-join, so that a key in every
document makes at most that many pairs; this cap is part of the graph's definition, and Spark applies it in each task before keys are dealt. The rows that a very common key has on the other side of
that join are split by Spark's handling of skewed joins. Of a document's candidates the first `COUNTED` by key are counted, and the `CANDIDATES` that share most are compared; those that name each other come first.

What documents give by themselves (`Kept`) can be stored: after a change only the changed documents are read, and only their keys are looked up.
`every.edges` gives all edges, without these bounds.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkwell.functions import text as T
from inkwell.operators import intelligence
from inkwell.session import from_each, written

#: Bounds of the graph.
MOST_TERMS, MOST_LEXICAL, MOST_PHRASES, PHRASE_TRIALS, POSTINGS, CANDIDATES, EDGES, ALL_EDGES, LEAST_WEIGHT, ALIAS_LETTERS = 32, 128, 24, 512, 64, 64, 32, 100_000, 0.12, 4
COUNTED, REFERENCES, ALIAS_WORDS = 256, 16, 4
#: Pairs that are scored first to find what the strongest edges weigh at least; common keys whose documents every task may hold.
TRIALS, MOST_COMMON = 4 * ALL_EDGES, 10_000
#: Kinds of keys, in the order in which their candidates are counted.
KINDS = ("term", "phrase", "dir")
#: Aliases that each task may hold as an automaton; more are met by a join.
MOST_ALIASES = 200_000
#: What each signal counts; the first six are strong.
SIGNALS = {"explicit_reference": 0.34, "phrase_overlap": 0.18, "shared_terms": 0.25, "keyword_overlap": 0.25, "lexical_similarity": 0.14, "title_heading_overlap": 0.16, "directory_relationship": 0.04, "provider_context": 0.02}
STRONG = tuple(SIGNALS)[:6]


def content_word(word: Column) -> Column:
    return (F.length(word) >= intelligence.TERM_LETTERS) & ~word.isin(*intelligence.stopwords())


def content_words(content: Column) -> Column:
    return F.filter(T.tok_rank(intelligence.sample(content)), content_word)


def one_phrases(words: list[str]) -> list[str]:
    """The first different runs of two, then of three content words."""
    runs = [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]
    return list(dict.fromkeys(runs[:PHRASE_TRIALS]))[:MOST_PHRASES]


def phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, n, phrase): each document's phrases, counted from 1."""
    words = F.array_join(F.slice(content_words(F.col("content")), 1, PHRASE_TRIALS + 2), " ")
    return from_each(docs.select("doc_id", words.alias("words")), lambda words: list(enumerate(one_phrases(words.split()), 1)), "n long, phrase string")


def one_node(name: str, path: str, source: str, dirs: list, body: str, first: str, labels: str) -> list[tuple]:
    counts = Counter(body.split())
    weighed = {t: float(n) for t, n in intelligence.strongest(counts, intelligence.MOST_TERMS)}
    for t in labels.split():
        weighed[t] = weighed.get(t, 0.0) + 2.0
    terms = intelligence.strongest(weighed, MOST_TERMS)
    held = {t: float(n) for t, n in counts.items()} | {t: max(float(counts[t]), 1.0) for t, _ in terms}
    return [(name, path, source, dirs, one_phrases(first.split()), sorted(terms), sorted(intelligence.strongest(held, MOST_LEXICAL)), sorted(set(labels.split())))]


def nodes(docs: DataFrame) -> DataFrame:
    """What scoring compares: (doc_id, name, path, source, dirs, phrases, terms, lexical, title_terms); vectors are maps from word to weight. All of it is made where a document is read."""
    joined = lambda words: F.array_join(words, " ")
    dirs = F.filter(F.slice(F.split(F.lower("path"), "[\\\\/]"), 1, F.greatest(F.size(F.split("path", "[\\\\/]")) - 1, F.lit(0))), lambda p: p != "")
    read = docs.select("doc_id", "name", "path", "source", dirs.alias("dirs"), content_words(F.col("content")).alias("words"), intelligence.headings(F.col("content")).alias("headings"), "content")
    titled = read.withColumn("title", intelligence.title(F.col("content"), F.col("name"), F.col("headings")))
    labels = F.filter(T.tok_rank(F.concat_ws(" ", F.col("title"), F.col("name"), joined("headings"))), content_word)
    cut = titled.select("doc_id", "name", "path", "source", "dirs", joined(F.filter("words", lambda w: ~w.rlike(intelligence.NUMBER))).alias("body"), joined(F.slice("words", 1, PHRASE_TRIALS + 2)).alias("first"), joined(labels).alias("labels"))
    made = "name string, path string, source string, dirs array<string>, phrases array<string>, terms map<string,double>, lexical map<string,double>, title_terms array<string>"
    return from_each(cut, one_node, made)


@dataclass
class Kept:
    """What documents give by themselves. nodes: as `nodes`. keys: (kind, key, doc_id, w). aliases: (alias, doc_id) that a document goes by. hits: (doc_id, alias) that its text has."""

    nodes: DataFrame
    keys: DataFrame
    aliases: DataFrame
    hits: DataFrame


def keys(nodes: DataFrame) -> DataFrame:
    """(kind, key, doc_id, w): terms, phrases and the last directory of each document."""
    entry = lambda kind, key, w: F.struct(F.lit(kind).alias("kind"), key.alias("key"), w.alias("w"))
    of = F.concat(
        F.transform(F.map_entries("terms"), lambda e: entry("term", e["key"], e["value"])),
        F.transform("phrases", lambda p: entry("phrase", p, F.lit(1.0))),
        F.transform(F.slice("dirs", F.greatest(F.size("dirs"), F.lit(1)), 1), lambda d: entry("dir", d, F.lit(1.0))),
    )
    return nodes.select("doc_id", F.explode(of).alias("k")).select("k.kind", "k.key", "doc_id", "k.w")


def capped(rows: DataFrame) -> DataFrame:
    """Each key's strongest documents, with their rank r."""
    order = Window.partitionBy("kind", "key").orderBy(F.desc("w"), "doc_id")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= POSTINGS)


def postings(nodes: DataFrame) -> DataFrame:
    """(kind, key, doc_id, w): each key's strongest documents."""
    return capped(keys(nodes)).drop("r")


def candidates(keys: DataFrame, references: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, named) with a < b: pairs by number of shared keys, each document's best; referenced pairs come first.

    references: (doc_id, target) where one document names another. only: documents (doc_id) whose candidates are wanted, whichever end has the smaller id; else an ordinary pair counts from its smaller id.
    """
    if only is not None:
        own = keys.join(only.select("doc_id"), "doc_id", "left_semi")
        mine, keys = own, keys.join(own.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    else:
        mine = keys
    strongest, common, known = shared_keys(keys)
    flagged = mine.select("kind", "key", "doc_id").join(F.broadcast(common.withColumn("common", F.lit(True))), ["kind", "key"], "left")
    none = F.lit(None).cast(strongest.schema["others"].dataType)
    rows = flagged.where("common").withColumn("others", none).drop("common").unionByName(flagged.where("common IS NULL").drop("common").join(strongest, ["kind", "key"]))
    number = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    asked = rows.groupBy("doc_id").agg(F.collect_list(F.struct(number.alias("kind"), "key", "others")).alias("keys"))
    if references is not None:
        both = references.select("doc_id", F.col("target").alias("other"))
        both = both.unionByName(both.select(F.col("other").alias("doc_id"), F.col("doc_id").alias("other"))).where("doc_id != other").distinct()
        both = both.join(only.select("doc_id"), "doc_id", "left_semi") if only is not None else both
        asked = asked.join(both.groupBy("doc_id").agg(F.collect_list("other").alias("named")), "doc_id", "full")
    else:
        asked = asked.withColumn("named", none)
    every, bounds = only is not None, (COUNTED, CANDIDATES)
    kind = keys.schema["doc_id"].dataType.simpleString()
    best = from_each(asked.select("doc_id", F.col("doc_id").alias("me"), "keys", "named"), lambda me, of, names: one_candidates(me, of or [], names or [], known.value, every, *bounds), f"other {kind}, shared long, named int")
    return best.groupBy(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).agg(F.max("shared").alias("shared"), F.max("named").alias("named"))


def shared_keys(keys: DataFrame) -> tuple[DataFrame, DataFrame, Broadcast]:
    """(kind, key, others): the strongest documents of each key that several have, best first; (kind, key) of the commonest keys; and what every task is told of these, by the kind's number and key.

    A document's row then need not carry the list of a key that very many others carry too.
    """
    spark = keys.sparkSession
    lists = capped(keys).groupBy("kind", "key").agg(F.sort_array(F.collect_list(F.struct("r", "doc_id"))).alias("o")).where(F.size("o") > 1)
    strongest = written(lists.select("kind", "key", F.col("o.doc_id").alias("others")), "strongest")
    counts = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > POSTINGS)
    common = written(counts.orderBy(F.desc("n"), "kind", "key").limit(MOST_COMMON).select("kind", "key"), "common")
    told = strongest.join(F.broadcast(common), ["kind", "key"]).collect()  # MOST_COMMON lists of POSTINGS ids
    return strongest, common, spark.sparkContext.broadcast({(KINDS.index(r.kind) + 1, r.key): r.others for r in told})


def one_candidates(me: object, keys: list[dict], named: list, common: dict[tuple[int, str], list], every: bool, most: int = COUNTED, best: int = CANDIDATES) -> list[tuple]:
    """(other, shared, named) of a document: the first `most` others by key, named ones before, and of these the `best` that share most. every: whichever end has the smaller id."""
    shared: dict = {}
    for k in sorted(keys, key=lambda k: (k["kind"], k["key"])):
        for other in common[k["kind"], k["key"]] if k["others"] is None else k["others"]:
            shared[other] = shared.get(other, 0) + 1
    shared.pop(me, None)
    names = set(named)
    order = [o for o in shared if o in names] + sorted(o for o in names if o not in shared)
    counted = (order + [o for o in islice(shared, most + len(order)) if o not in names])[:most]
    found = heapq.nsmallest(best, ((o not in names, -shared.get(o, 0), o) for o in counted))
    return [(o, -n, int(not unnamed)) for unnamed, n, o in found if every or not unnamed or me < o]


def known_as(words: int | None = ALIAS_WORDS) -> Column:
    """What a document goes by: its name and its stem, read as words; four letters and more, so many words at most (None: any)."""
    alias = lambda x: F.array_join(T.tok_rank(x), " ")
    both = F.array_distinct(F.array(alias(F.col("name")), alias(F.regexp_replace("name", "\\.[^.]*$", ""))))
    return F.filter(both, lambda x: (F.length(x) >= ALIAS_LETTERS) & (F.size(F.split(x, " ")) <= words if words else F.lit(True)))


def aliases(nodes: DataFrame, words: int | None = ALIAS_WORDS) -> DataFrame:
    """(alias, doc_id): what each document goes by."""
    return nodes.select(F.explode(known_as(words)).alias("alias"), "doc_id")


def one_runs(words: list[str], starts: set[str] | None, most: int = ALIAS_WORDS) -> list[tuple]:
    """The different runs of up to so many words that start with one of starts, or all."""
    return [(r,) for r in {" ".join(words[i : i + n]) for i, w in enumerate(words) if starts is None or w in starts for n in range(1, min(most, len(words) - i) + 1)}]


def hits(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, alias): the aliases that a document's text has, word for word.

    An automaton of all aliases runs once over each text, where a task can hold it; beyond `MOST_ALIASES` the texts' runs of as many words as the longest has are joined to them, those alone that start as an alias does where aliases have few first words.
    """
    distinct = aliases.select("alias").distinct()
    known = [r.alias for r in distinct.limit(MOST_ALIASES + 1).collect()]
    words = T.tok_rank(intelligence.sample(F.col("content")))
    if len(known) > MOST_ALIASES:
        found = [r.w for r in distinct.select(F.substring_index("alias", " ", 1).alias("w")).distinct().limit(MOST_ALIASES + 1).collect()]
        starts = set(found) if len(found) <= MOST_ALIASES else None
        most = distinct.agg(F.max(F.size(F.split("alias", " ")))).first()[0]
        runs = from_each(docs.select("doc_id", F.array_join(words, " ").alias("text")), lambda text: one_runs(text.split(), starts, most), "alias string")
        return runs.join(distinct, "alias", "left_semi").select("doc_id", "alias")
    rows = docs.select("doc_id", F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("alias", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for a in known:
            machine.add_word(f" {a} ", a)
        machine.make_automaton()
        for b in batches:
            ids, met = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                of = {a for _, a in machine.iter(text)} if known else ()
                ids += [i] * len(of)
                met += of
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.types[0]), pa.array(met, pa.string())], schema=schema)

    return rows.mapInArrow(found, f"doc_id {kind.simpleString()}, alias string")


def named(hits: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, target): documents that a text names, the first ones by id of each alias and of each text."""
    first = aliases.withColumn("r", F.row_number().over(Window.partitionBy("alias").orderBy("doc_id"))).where(F.col("r") <= POSTINGS).select("alias", F.col("doc_id").alias("target"))
    pairs = hits.join(first, "alias").where("doc_id != target").select("doc_id", "target").distinct()
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("target"))).where(F.col("r") <= REFERENCES).drop("r")


def mentions(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, target): documents whose text has another's name or stem in it."""
    of = aliases(nodes)
    return named(hits(docs, of), of)


def signal_columns(left: str = "l", right: str = "r") -> dict[str, Column]:
    """Value of each signal for two nodes held as structs; 0 where it is absent."""
    a, b = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    common = lambda c: F.array_intersect(F.map_keys(a(c)), F.map_keys(b(c)))
    at = lambda m, k: F.element_at(m, k)
    jaccard = lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)
    shared = common("terms")
    least_sum = F.least(total(F.map_values(a("terms"))), total(F.map_values(b("terms"))))
    overlap = total(F.transform(shared, lambda t: F.least(at(a("terms"), t), at(b("terms"), t)))) / least_sum
    norm = lambda m: F.sqrt(total(F.transform(F.map_values(m), lambda x: x * x)))
    dot = total(F.transform(common("lexical"), lambda t: at(a("lexical"), t) * at(b("lexical"), t)))
    steps = F.zip_with(a("dirs"), b("dirs"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    prefix = F.aggregate(steps, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"), (s["on"] & same).alias("on")), lambda s: s["n"])
    bounded = lambda x: F.least(F.coalesce(x, F.lit(0.0)), F.lit(1.0))
    return {
        "phrase_overlap": jaccard(a("phrases"), b("phrases")),
        "shared_terms": F.least(F.size(shared) / F.lit(4.0), F.lit(1.0)),
        "keyword_overlap": F.when(F.size(shared) > 0, bounded(overlap)).otherwise(0.0),
        "lexical_similarity": F.when(dot > 0, bounded(dot / (norm(a("lexical")) * norm(b("lexical"))))).otherwise(0.0),
        "title_heading_overlap": jaccard(a("title_terms"), b("title_terms")),
        "directory_relationship": F.when((F.size(a("dirs")) > 0) & (F.size(b("dirs")) > 0), prefix / F.greatest(F.size(a("dirs")), F.size(b("dirs")))).otherwise(0.0),
        "provider_context": F.when(a("source") == b("source"), 0.6).otherwise(0.0),
    }


def scored(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, weight, edge_type, evidence) of the candidate pairs that reach the least weight with a strong signal."""
    held = F.struct(*nodes.columns)
    joined = beside(pairs, nodes.select("doc_id", held.alias("held")))
    values = {"explicit_reference": F.when(F.col("named") == 1, 1.0).otherwise(0.0)} | signal_columns()
    rated = joined.select("a", "b", *(values[k].alias(k) for k in SIGNALS))
    weight = total_weight({k: F.col(k) for k in SIGNALS})
    strong = reduce(Column.__or__, (F.col(k) > 0 for k in STRONG))
    parts = F.array(*(F.struct((-F.col(k) * w).alias("part"), F.lit(i).alias("i"), F.lit(k).alias("kind"), F.col(k).alias("value")) for i, (k, w) in enumerate(SIGNALS.items())))
    evidence = F.filter(F.array_sort(parts), lambda p: p["value"] > 0)
    out = rated.withColumn("weight", weight).where(strong & (F.col("weight") >= LEAST_WEIGHT))
    return out.select("a", "b", "weight", F.get(evidence, F.lit(0))["kind"].alias("edge_type"), F.transform(evidence, lambda p: F.struct(p["kind"].alias("kind"), p["value"].alias("weight"))).alias("evidence"))


def beside(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs with what both documents hold (doc_id, held), as l and r."""
    return pairs.join(held.select(F.col("doc_id").alias("a"), F.col("held").alias("l")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("held").alias("r")), "b")


def total_weight(values: dict[str, Column]) -> Column:
    return F.least(reduce(Column.__add__, (values[k] * w for k, w in SIGNALS.items())), F.lit(1.0))


def bounded(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with the weight that each can have at most (bound): all signals but lexical similarity, which needs a document's longest vector, from hashes in place of words."""
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    held = F.struct(F.transform_keys("terms", lambda k, _: F.xxhash64(k)).alias("terms"), hashed("phrases").alias("phrases"), hashed("title_terms").alias("title_terms"), "dirs", "source", F.create_map().cast("map<bigint,double>").alias("lexical"))
    values = signal_columns() | {"explicit_reference": F.when(F.col("named") == 1, 1.0).otherwise(0.0), "lexical_similarity": F.lit(1.0)}
    return beside(pairs, nodes.select("doc_id", held.alias("held"))).select(*pairs.columns, (total_weight(values) + 1e-9).alias("bound"))


def contenders(nodes: DataFrame, pairs: DataFrame, most: int, trials: int) -> DataFrame:
    """The pairs that can be among the strongest `most` edges after pruning, so that whole nodes are dealt to these alone.

    The pairs of the highest bounds are scored and pruned first. Of their kept edges, each is among the strongest of an end, and a node keeps as many or more when the other pairs
    come in; as an edge is counted at two ends at most, half as many edges of a weight are kept in the whole graph at least. So none below the weight of the 2 * most-th can be among the first `most`.
    """
    rated = written(bounded(nodes, pairs).where(F.col("bound") >= LEAST_WEIGHT), "bounds")
    tried = pruned(scored(nodes, rated.orderBy(F.desc("bound")).limit(trials)), most=None)
    enough = tried.select("weight").orderBy(F.desc("weight")).limit(2 * most).agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least")).first()
    return rated.where(F.col("bound") >= enough.least) if enough.n == 2 * most else rated


def pruned(edges: DataFrame, per_node: int = EDGES, most: int | None = ALL_EDGES, parts: int | None = None) -> DataFrame:
    """Edges that are among the strongest of either end, and the strongest of all; most: None keeps all of those. parts: by how many the ends are dealt, where the edges are counted."""
    ends = edges.withColumn("node", F.explode(F.array("a", "b")))
    ends = ends.repartition(parts, "node") if parts else ends
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "a", "b")
    kept = ends.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_node).drop("r", "node").dropDuplicates(["a", "b"])
    return kept if most is None else kept.orderBy(F.desc("weight"), "a", "b").limit(most)


def kept(docs: DataFrame) -> Kept:
    made = written(nodes(docs), "nodes")
    of = aliases(made)
    return Kept(made, keys(made), of, hits(docs, of))


def edges_of(kept: Kept, most: int | None = ALL_EDGES, trials: int = TRIALS) -> DataFrame:
    pairs = written(candidates(kept.keys, named(kept.hits, kept.aliases)), "pairs")
    if most is not None and pairs.count() > trials:
        pairs = contenders(kept.nodes, pairs, most, trials)
    return pruned(scored(kept.nodes, pairs), most=most)


def build(docs: DataFrame, most: int | None = ALL_EDGES) -> DataFrame:
    return edges_of(kept(docs), most)


def related(edges: DataFrame, docs: DataFrame, doc_id: int, limit: int = 10) -> DataFrame:
    """(doc_id, path, weight, edge_type): neighbours of a document, strongest first."""
    around = edges.where((F.col("a") == doc_id) | (F.col("b") == doc_id)).select(F.when(F.col("a") == doc_id, F.col("b")).otherwise(F.col("a")).alias("doc_id"), "weight", "edge_type")
    return around.join(docs.select("doc_id", "path"), "doc_id", "left").select("doc_id", F.coalesce("path", F.lit("")).alias("path"), "weight", "edge_type").orderBy(F.desc("weight"), "path", "doc_id").limit(limit)


def repaired(edges: DataFrame, kept: Kept, changed: DataFrame, most: int | None = ALL_EDGES) -> DataFrame:
    """The edges after the documents of changed (doc_id) were added, altered or removed; kept: as it is now.

    Changed documents and their former neighbours, who may have lost an edge, are compared anew with what shares a bounded posting
    with them; edges between others stay. No text is read. Where very many have changed all is compared anew.
    """
    ids, many = affected(edges, changed)
    if many:
        return edges_of(kept, most)
    of = named(kept.hits, kept.aliases)
    touching = of.join(ids, "doc_id", "left_semi").unionByName(of.join(ids.withColumnRenamed("doc_id", "target"), "target", "left_semi")).distinct()
    pairs = candidates(kept.keys, touching, ids)
    touch = lambda e, c: e.join(ids.select(F.col("doc_id").alias(c)), c, "left_anti")
    return pruned(touch(touch(edges, "a"), "b").unionByName(scored(kept.nodes, pairs).select(*edges.columns)), most=most)


def affected(edges: DataFrame, changed: DataFrame, most: int = CANDIDATES + 2) -> tuple[DataFrame, bool]:
    """(doc_id): changed documents and their neighbours, and whether there are so many that a full rebuild is due."""
    around = edges.join(changed.select(F.col("doc_id").alias("a")), "a", "left_semi").select(F.col("b").alias("doc_id")).unionByName(edges.join(changed.select(F.col("doc_id").alias("b")), "b", "left_semi").select(F.col("a").alias("doc_id")))
    ids = changed.select("doc_id").unionByName(around).distinct()
    return ids, changed.select("doc_id").distinct().limit(most + 1).count() > most
