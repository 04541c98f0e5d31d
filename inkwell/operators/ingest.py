"""Keeping a document table in step with what is on disk: reconciliation as joins, for batch and for streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source", "path"]
#: Tables that hold a document's rows, by their id column.
ACTIONS = ("created", "updated", "unchanged", "deleted")


def below(path: Column, root: Column) -> Column:
    """Whether a path is a root or lies in it: a sibling with the same start doesn't."""
    return (path == root) | F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def classify(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """scan's rows (source, path, size, mtime_ns, availability) with action: unchanged where all metadata is as stored and the last extraction wasn't cancelled."""
    old = stored.select(*KEY, *(F.col(c).alias(f"o_{c}") for c in ("size", "mtime_ns", "availability", "content_hash", "status")))
    same = (F.col("size") == F.col("o_size")) & (F.col("mtime_ns") == F.col("o_mtime_ns")) & (F.col("availability") == F.col("o_availability")) & ~F.coalesce(F.col("o_status") == "cancelled", F.lit(False))
    return scan.join(old, KEY, "left").withColumn("action", F.when(F.col("o_availability").isNull(), "created").when(same, "unchanged").otherwise("updated"))


def settle(read: DataFrame) -> DataFrame:
    """After reading: an update whose content hash is as stored counts as unchanged."""
    return read.withColumn("action", F.when((F.col("action") == "updated") & F.col("content_hash").eqNullSafe(F.col("o_content_hash")), "unchanged").otherwise(F.col("action")))


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with new rows in place of those of the same key."""
    return stored.join(new.select(*KEY), KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def metadata_only(stored: DataFrame, scan: DataFrame) -> DataFrame:
    """stored with size, time and availability of the scan where it has the row; content stays."""
    fresh = scan.select(*KEY, *(F.col(c).alias(f"n_{c}") for c in ("size", "mtime_ns", "availability")))
    joined = stored.join(fresh, KEY, "left")
    return joined.withColumns({c: F.coalesce(f"n_{c}", c) for c in ("size", "mtime_ns", "availability")}).select(*stored.columns)


def vanished(stored: DataFrame, scan: DataFrame, root: str, source: str | None = None) -> DataFrame:
    """Stored rows under root that the scan no longer has."""
    mine = stored.where(below(F.col("path"), F.lit(root)))
    return (mine.where(F.col("source") == source) if source else mine).join(scan.select(*KEY), KEY, "left_anti")


def counters(classified: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(action, n) of a pass."""
    rows = classified.select("action")
    if gone is not None:
        rows = rows.unionByName(gone.select(F.lit("deleted").alias("action")))
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def reconcile(scan: DataFrame, stored: DataFrame, root: str, complete: bool = True) -> DataFrame:
    """The stored table after a pass. Rows are deleted only if the pass saw everything under its root."""
    merged = upserted(stored, scan)
    if not complete:
        return merged
    return merged.join(vanished(stored, scan, root).select(*KEY), KEY, "left_anti")


def without(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of these documents."""
    return {name: t.join(ids.select(key), key, "left_anti") for name, t in tables.items()}


def forgotten(docs: DataFrame, reference: str) -> DataFrame:
    """(doc_id): every copy at a path, or, where no path matches, the first document of that name."""
    by_path = docs.where(F.col("path") == reference).select("doc_id")
    by_name = docs.where(F.col("name") == reference).orderBy("path", "doc_id").limit(1).select("doc_id")
    any_path = F.broadcast(by_path.agg(F.count(F.lit(1)).alias("n_paths")))
    return by_path.unionByName(by_name.crossJoin(any_path).where("n_paths = 0").select("doc_id"))


def owners(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """docs with root: the longest configured root that holds the path, or null.

    A path's ancestors meet the roots by equality, so no pair of path and root is tried in vain.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ancestors = docs.select("doc_id", F.explode(F.filter(up, lambda p: p != "")).alias("root"))
    held = ancestors.join(roots.select(F.rtrim(F.col("root"), F.lit("/")).alias("root")).distinct(), "root").groupBy("doc_id").agg(F.max_by("root", F.length("root")).alias("root"))
    return docs.join(held, "doc_id", "left")


def without_root(docs: DataFrame, roots: DataFrame, root: str) -> DataFrame:
    """docs without what a root owns: rows of a nested root, and of none, stay."""
    owned = owners(docs, roots).where(F.col("root") == root.rstrip("/")).select("doc_id")
    return docs.join(owned, "doc_id", "left_anti")


def forgotten_batch(docs: DataFrame, references: list[str], confirmed: bool = False, most: int = 50) -> DataFrame:
    """(reference, doc_id): what each reference, a path or a name, stands for; one that stands for nothing has null. A batch must be confirmed and is bounded."""
    if not confirmed:
        raise ValueError("forgetting a batch must be confirmed")
    if len(references) > most:
        raise ValueError(f"{len(references)} references; a batch takes {most}")
    asked = docs.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(references)], "reference string")
    by_path = asked.join(docs.select(F.col("path").alias("reference"), "doc_id"), "reference")
    by_name = asked.join(by_path, "reference", "left_anti").join(docs.select(F.col("name").alias("reference"), "doc_id", "path"), "reference").groupBy("reference").agg(F.min(F.struct("path", "doc_id")).alias("m")).select("reference", "m.doc_id")
    return asked.join(by_path.unionByName(by_name), "reference", "left")


def diagnosed(stored: DataFrame, read: DataFrame) -> DataFrame:
    """stored diagnostics (doc_id, status, warnings, truncated, size) with those of rows just read in place of older ones; warnings are bounded."""
    bounded = F.transform(F.slice("warnings", 1, 20), lambda w: F.substring(F.trim(F.regexp_replace(w, "[\\x00-\\x1f\\x7f]", " ")), 1, 300))
    fresh = read.withColumn("warnings", bounded).select(*stored.columns)
    return stored.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)


def latest(records: DataFrame, by: list[str], order: str) -> DataFrame:
    """The newest record of each key."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
