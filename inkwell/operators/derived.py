"""Derived layers, stored: built from the documents once, kept in step by document, and rebuilt where that is not possible.

A layer is a base and a few deltas. A delta holds the rows of changed documents and the ids that it replaces or removes (`gone`); a read leaves out what later deltas replace. A layer
knows each document by a hash of its metadata (`seen`), so that a read finds what has changed without reading contents. Tables without a document id are sums: a delta adds what its documents count and
takes away what they counted before. Many deltas are folded into a new base. A layer that is not a function of single documents (`whole`) is built anew.

A stamp names each base or delta, in order; a layer is what its stamps say, so a build that is cut off leaves the one before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import fuzzy, graph, intelligence, lexical, semantic
from inkwell.operators import stored as store
from inkwell.session import written

STAMPS = "n long, layer string, version int, snapshot string, folder string, tables array<string>, kind string"
DIRTY = "n long, layer string, doc_id string"
#: Deltas of a layer before they are folded; share of the documents above which a change builds anew; ids pushed into scans at most.
MOST_DELTAS, MOST_SHARE, MOST_IDS = 8, 0.2, 1000
BASE, DELTA, MARKED, REMOVED = "base", "delta", "dirty", "removed"
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Layer:
    """build: tables with a doc_id from documents. more: further ones, step by step, from documents, what is written, and the tables before a delta. sums: tables without, from those with; lost: what documents that go take from them.

    order: columns by which a table is sorted, so that reads prune. dealt: tables that a base keeps as their tasks make them, in order already. whole: any change builds the layer anew.
    """

    name: str
    version: int
    build: Callable[[DataFrame], Tables]
    order: dict[str, tuple[str, ...]] = field(default_factory=dict)
    more: tuple[Callable[[DataFrame, Tables, Tables], Tables], ...] = ()
    sums: Callable[[Tables], Tables] = lambda tables: {}
    lost: Callable[[Tables], Tables] = lambda tables: {}
    whole: bool = False
    dealt: tuple[str, ...] = ()


def graph_rows(docs: DataFrame) -> Tables:
    made = graph.nodes(docs)
    return {"nodes": made, "aliases": graph.aliases(made)}


def graph_hits(docs: DataFrame, made: Tables, before: Tables) -> Tables:
    """Keys of the written nodes, and what the texts name: a changed text may name any document, old or new."""
    known = made["aliases"].unionByName(before["aliases"]) if before else made["aliases"]
    return {"keys": graph.keys(made["nodes"]), "hits": graph.hits(docs, known)}


LAYERS = {
    layer.name: layer
    for layer in (
        Layer("lexical", 3, store.about, {"postings": ("token", "block", "doc_id"), "entries": ("token", "block", "doc_id"), "heads": ("token", "block"), "about": ("doc_id",)}, (store.postings, store.entries), store.sums, store.lost, dealt=("postings", "entries", "heads", "about")),
        Layer("semantic", 2, semantic.grams_and_words, {"kept": ("gram", "doc_id"), "words": ("doc_id",), "frequency": ("gram",)}, sums=semantic.sums, lost=semantic.lost),
        Layer("fuzzy", 1, lambda docs: {"prints": fuzzy.fingerprints(docs)}, {"prints": ("gram", "doc_id")}, whole=True),
        Layer("analysis", 1, lambda docs: {"analysis": intelligence.analysis(docs)}, {"analysis": ("doc_id",)}),
        Layer("graph", 2, graph_rows, {"keys": ("key", "kind", "doc_id"), "nodes": ("doc_id",), "aliases": ("alias",), "hits": ("alias",)}, (graph_hits,)),
    )
}


def identity(docs: DataFrame) -> Column:
    """A hash of what tells a document's states apart: its content hash, or size and time, or else its content."""
    state = ("content_hash",) if "content_hash" in docs.columns else ("size", "modified_at") if {"size", "modified_at"} <= set(docs.columns) else ("content",)
    return F.xxhash64(*(c for c in ("doc_id", "name", "path", "source", *state) if c in docs.columns))


def snapshot(docs: DataFrame) -> str:
    """Rows and a sum of their hashes: equal for the same documents in any order."""
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(identity(docs).cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n}:{total}"


def log(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).json(f"{path}/{name}")
    except Exception as e:  # the reader names a missing path by an error class
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def stamps(spark: SparkSession, path: str) -> DataFrame:
    return log(spark, path, "_stamps", STAMPS)


def last(spark: SparkSession, path: str, name: str):
    """A layer's newest stamp, or None."""
    return stamps(spark, path).where(F.col("layer") == name).orderBy(F.desc("n")).first()


def chain(spark: SparkSession, path: str, name: str) -> list:
    """The stamps of a layer's base and deltas, and of a mark that it is dirty as a whole; none where it is not stored."""
    rows = stamps(spark, path).where(F.col("layer") == name).orderBy("n").collect()  # one for each build or update
    start = max((i for i, r in enumerate(rows) if r.kind in (BASE, REMOVED)), default=None)
    return [] if start is None or rows[start].kind == REMOVED else rows[start:]


def stamp(spark: SparkSession, path: str, layer: str, version: int, of: str, folder: str, tables: list[str], kind: str) -> None:
    n = (stamps(spark, path).agg(F.max("n")).first()[0] or 0) + 1
    spark.createDataFrame([(n, layer, version, of, folder, tables, kind)], STAMPS).coalesce(1).write.mode("append").json(f"{path}/_stamps")


def mark_dirty(spark: SparkSession, path: str, *layers: str, ids: DataFrame | None = None) -> None:
    """The next read of these layers, or of all that are stored, renews the documents of ids (doc_id), or the whole layer."""
    for name in layers or [r.layer for r in stamps(spark, path).select("layer").distinct().collect()]:
        if (now := last(spark, path, name)) is None:
            continue
        if ids is None:
            stamp(spark, path, name, now.version, now.snapshot, now.folder, now.tables, MARKED)
        else:
            ids.select(F.lit(now.n).alias("n"), F.lit(name).alias("layer"), F.col("doc_id").cast("string").alias("doc_id")).write.mode("append").json(f"{path}/_dirty")


def few(ids: DataFrame) -> list | None:
    """The ids, where they are few enough to reach a scan as a filter."""
    rows = [r[0] for r in ids.select("doc_id").limit(MOST_IDS + 1).collect()]
    return rows if len(rows) <= MOST_IDS else None


def within(rows: DataFrame, ids: DataFrame, known: list | None) -> DataFrame:
    """Rows of some documents."""
    return rows.where(F.col("doc_id").isin(known)) if known is not None else rows.join(ids.select("doc_id"), "doc_id", "left_semi")


def put(table: DataFrame, path: str, order: tuple[str, ...] | None, small: bool = False, dealt: bool = False) -> DataFrame:
    """Write a table sorted by its order; a small one as one file. dealt: as it comes.

    A table of several columns of order is dealt by a hash of the first two, so that the commonest key fills many files and nothing is computed twice to find ranges; filters prune pages in either case.
    """
    if order and (small or not dealt):
        parts = table.coalesce(1) if small else table.repartition(*order[:2]) if len(order) > 1 else table.repartitionByRange(*order)
        table = parts.sortWithinPartitions(*order)
    table.write.mode("overwrite").options(**(store.FINE if order else {})).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def fill(docs: DataFrame, path: str, folder: str, layer: Layer, held: Tables | None = None, lost: Tables | None = None, small: bool = False, before: Tables | None = None) -> list[str]:
    """Write a base or a delta; gives its tables' names. held: the tables with a doc_id, where they are known."""
    made: Tables = {}

    def each(tables: Tables) -> None:
        for name, table in tables.items():
            if lost and name in lost:
                table = table.unionByName(lost[name])
            made[name] = put(table, f"{path}/{folder}/{name}", layer.order.get(name), small, name in layer.dealt and (held is None or name not in held))

    if held is None:
        each(layer.build(docs) | {"seen": docs.select("doc_id", identity(docs).alias("state"))})
        for step in layer.more:
            each(step(docs, made, before or {}))
    else:
        each(held)
    each(layer.sums(made))
    return sorted(made)


def write(docs: DataFrame, path: str, layer: Layer) -> None:
    """Build a layer as a new base, and name it."""
    spark, of = docs.sparkSession, snapshot(docs)
    folder = next_folder(spark, path, layer)
    stamp(spark, path, layer.name, layer.version, of, folder, fill(docs, path, folder, layer), BASE)


def next_folder(spark: SparkSession, path: str, layer: Layer) -> str:
    before = last(spark, path, layer.name)
    return f"{layer.name}-{0 if before is None else int(before.folder.rpartition('-')[2] or 0) + 1}"


def update(docs: DataFrame, path: str, layer: Layer, ids: DataFrame, of: str | None = None) -> None:
    """Renew the documents of ids (doc_id) by a delta: those that docs has are written, the others go. of: the documents' snapshot, where it is known."""
    spark = docs.sparkSession
    if layer.whole:
        return write(docs, path, layer)
    before, folder = tables_of(spark, path, chain(spark, path, layer.name)), next_folder(spark, path, layer)
    gone = put(ids.select("doc_id").distinct(), f"{path}/{folder}/gone", None)
    known = few(gone)
    old = {name: within(t, gone, known) for name, t in before.items() if "doc_id" in t.columns}
    names = fill(within(docs, gone, known), path, folder, layer, lost=layer.lost(old), small=known is not None, before=before)
    stamp(spark, path, layer.name, layer.version, of or snapshot(docs), folder, [*names, "gone"], DELTA)


def compact(spark: SparkSession, path: str, layer: Layer) -> None:
    """Fold a layer's deltas into a new base; no document is read."""
    stamped = chain(spark, path, layer.name)
    held = {name: t for name, t in tables_of(spark, path, stamped).items() if "doc_id" in t.columns}
    folder = next_folder(spark, path, layer)
    stamp(spark, path, layer.name, layer.version, stamped[-1].snapshot, folder, fill(None, path, folder, layer, held), BASE)


def tables_of(spark: SparkSession, path: str, stamped: list) -> Tables:
    """A layer's tables: the base and its deltas, without rows of documents that a later delta renews."""
    parts = [s for s in stamped if s.kind in (BASE, DELTA)]
    read = lambda s, name: spark.read.parquet(f"{path}/{s.folder}/{name}")
    out: Tables = {}
    for name in parts[0].tables if parts else ():
        for i, s in enumerate(parts):
            table = read(s, name)
            if "doc_id" in table.columns and i + 1 < len(parts):
                table = table.join(spark.read.parquet(*(f"{path}/{later.folder}/gone" for later in parts[i + 1 :])), "doc_id", "left_anti").select(*table.columns)
            out[name] = out[name].unionByName(table) if name in out else table
    return out


def changed(docs: DataFrame, seen: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id): documents that are new, altered, marked or gone."""
    now = docs.select("doc_id", identity(docs).alias("now"))
    both = seen.join(now, "doc_id", "full").where(~F.col("state").eqNullSafe(F.col("now"))).select("doc_id")
    known = seen.join(marked.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").cast("string") == F.col("_id"), "left_semi").select("doc_id")
    return both.unionByName(known).distinct()


def refresh(docs: DataFrame, path: str, layer: Layer) -> None:
    """Bring a layer in step with the documents: nothing where they are as they were, a delta for a few changes, else a new base."""
    spark = docs.sparkSession
    stamped = chain(spark, path, layer.name)
    if not stamped or stamped[-1].kind == MARKED or stamped[-1].version != layer.version:
        return write(docs, path, layer)
    marked = log(spark, path, "_dirty", DIRTY).where((F.col("layer") == layer.name) & (F.col("n") >= stamped[-1].n))
    of = snapshot(docs)
    if stamped[-1].snapshot == of and marked.isEmpty():
        return None
    if layer.whole:
        return write(docs, path, layer)
    seen = tables_of(spark, path, stamped)["seen"]
    ids = written(changed(docs, seen, marked), "changed")
    if ids.count() > MOST_SHARE * int(of.partition(":")[0]):
        return write(docs, path, layer)
    update(docs, path, layer, ids, of)
    if len(stamped) > MOST_DELTAS:
        compact(spark, path, layer)
    return None


def read(docs: DataFrame, path: str, layer: Layer, rebuild: bool = True) -> Tables:
    """A layer's tables, brought in step first. rebuild: else they are taken as they are."""
    spark = docs.sparkSession
    if rebuild:
        refresh(docs, path, layer)
    elif not chain(spark, path, layer.name):
        write(docs, path, layer)
    return {name: t for name, t in tables_of(spark, path, chain(spark, path, layer.name)).items() if name != "seen"}


def remove(spark: SparkSession, path: str, *layers: str) -> None:
    """Forget layers; a later read builds them anew."""
    for name in layers:
        if (now := last(spark, path, name)) is not None:
            stamp(spark, path, name, 0, "removed", now.folder, [], REMOVED)


def lexical_index(docs: DataFrame, path: str, rebuild: bool = True) -> store.Stored:
    return store.opened(docs, read(docs, path, LAYERS["lexical"], rebuild))


def graph_edges(docs: DataFrame, path: str) -> DataFrame:
    """The stored graph's edges, in step with the documents: repaired around those that have changed since, or compared anew."""
    spark, layer = docs.sparkSession, LAYERS["graph"]
    refresh(docs, path, layer)
    stamped, before = chain(spark, path, layer.name), last(spark, path, "edges")
    now = graph.Kept(**{n: t for n, t in tables_of(spark, path, stamped).items() if n != "seen"})
    later = [s for s in stamped if before is not None and s.n > int(before.snapshot)]
    if before is not None and not later:
        return spark.read.parquet(f"{path}/{before.folder}/edges")
    if before is not None and all(s.kind == DELTA for s in later):
        ids = spark.read.parquet(*(f"{path}/{s.folder}/gone" for s in later)).distinct()
        edges = graph.repaired(spark.read.parquet(f"{path}/{before.folder}/edges"), now, ids)
    else:
        edges = graph.edges_of(now)
    folder = f"edges-{stamped[-1].n}"
    made = put(edges, f"{path}/{folder}/edges", None)
    stamp(spark, path, "edges", layer.version, str(stamped[-1].n), folder, ["edges"], BASE)
    return made


def semantic_index(docs: DataFrame, path: str, rebuild: bool = True) -> semantic.SemanticIndex:
    tables = read(docs, path, LAYERS["semantic"], rebuild)
    index = semantic.opened(tables)
    return replace(index, norms=norms(docs.sparkSession, path, index))


def norms(spark: SparkSession, path: str, index: semantic.SemanticIndex) -> DataFrame:
    """The documents' norms in the layer's present state. All depend on the frequencies of all grams, so a change computes them anew from the stored grams; searches read them."""
    now, before = chain(spark, path, "semantic")[-1], last(spark, path, "norms")
    if before is not None and before.kind == BASE and before.snapshot == str(now.n):
        return spark.read.parquet(f"{path}/{before.folder}/norms")
    folder = f"norms-{now.n}"
    counted = semantic.weighed(index.kept, written(index.frequency, "frequency"), index.n_docs, index.words, counted=True)
    made = put(counted.norms, f"{path}/{folder}/norms", ("doc_id",))
    stamp(spark, path, "norms", now.version, str(now.n), folder, ["norms"], BASE)
    return made
