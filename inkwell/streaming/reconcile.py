"""Ingestion as a Structured Streaming job, and passes that keep the stored table in step with a tree.

The stream takes in files as they arrive. The file source remembers paths, so it does not see that a known file has changed: a
pass compares a listing with the table, by metadata alone, reads what is new or changed, and drops what has vanished
below its own root; rows of other roots stay. A pass that may have missed files deletes nothing. `watch.py` takes notices of changes instead.

The table is Parquet, a folder for each batch, and a log of them. A batch writes its own rows alone, once, and its counters are observed on that write; a read leaves out what later
batches replace. Where later batches hold a share of the table they are folded into a new first one, and folders that no reader needs any more go.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators import ingest
from inkwell.operators.derived import log as read_log
from inkwell.session import delete
from inkwell.sources import files
from inkwell.sources.rules import Ignore

RAW = "path string, modificationTime timestamp, length long, content binary"
STORED = "path string, name string, extension string, size long, modified_at timestamp, content string, status string, content_hash string, warnings array<string>, truncated boolean, structure array<string>"
BATCHES = "n long, folder string, rows long, first boolean"
#: Later batches are folded where they hold a quarter of the rows of the first, or are this many.
FOLDED_SHARE, MOST_BATCHES = 0.25, 64
#: What a pass counts.
COUNTERS = ("created", "updated", "unchanged", "deleted", "ignored", "cloud_only", "errors", "dropped_errors", "extraction_errors")


def batches(spark: SparkSession, state: str) -> list:
    """The batches that make up the table, in order: the last first one and those after it."""
    rows = read_log(spark, state, "_batches", BATCHES).orderBy("n").collect()  # MOST_BATCHES for each time that the table was folded
    start = max((i for i, r in enumerate(rows) if r["first"]), default=0)
    return rows[start:]


def current(spark: SparkSession, state: str) -> DataFrame:
    """The stored table; empty before the first batch."""
    return held(spark, state, batches(spark, state))


def held(spark: SparkSession, state: str, parts: list) -> DataFrame:
    out = None
    read = lambda folders: spark.read.schema(f"{STORED}, gone boolean").parquet(*(f"{state}/{f}" for f in folders))
    for i, part in enumerate(parts):
        rows = read([part.folder])
        if i + 1 < len(parts):
            rows = rows.join(read([later.folder for later in parts[i + 1 :]]).select("path"), "path", "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], STORED) if out is None else out.where(~F.col("gone")).drop("gone")


def put(spark: SparkSession, state: str, fresh: DataFrame | None = None, gone: DataFrame | None = None, counts: dict[str, Column] | None = None) -> dict[str, int]:
    """One batch: fresh rows take the place of stored ones of their paths, the paths of gone are dropped. counts: observed over fresh as it is written, other columns of it too."""
    before, observed = batches(spark, state), Observation()
    n = before[-1].n + 1 if before else 1
    none = spark.createDataFrame([], f"{STORED}, gone boolean")
    rows = none
    if fresh is not None:
        rows = fresh.withColumn("gone", F.lit(False))
        rows = rows.observe(observed, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in (counts or {}).items())).select(*none.columns)
    if gone is not None:
        rows = rows.unionByName(gone.select("path").distinct().withColumn("gone", F.lit(True)), allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{state}/b{n}")  # a batch that is run again gives the same table
    got = observed.get if fresh is not None else {}
    size = spark.read.parquet(f"{state}/b{n}").count()
    if size:
        named(spark, state, n, size, not before)
        if before and (len(before) >= MOST_BATCHES or size + sum(b.rows for b in before[1:]) > FOLDED_SHARE * before[0].rows):
            fold(spark, state)
    return {k: got[k] for k in counts or {}}


def named(spark: SparkSession, state: str, n: int, rows: int, first: bool) -> None:
    spark.createDataFrame([(n, f"b{n}", rows, first)], BATCHES).coalesce(1).write.mode("append").json(f"{state}/_batches")


def fold(spark: SparkSession, state: str) -> None:
    """Write the table as one batch, and delete the folders that it no longer consists of but for the last ones, which may still be read."""
    parts = batches(spark, state)
    n = parts[-1].n + 1
    held(spark, state, parts).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{state}/b{n}")
    named(spark, state, n, spark.read.parquet(f"{state}/b{n}").count(), True)
    every = read_log(spark, state, "_batches", BATCHES).where(F.col("n") < parts[0].n).collect()
    for old in every:
        delete(spark, f"{state}/{old.folder}")


def newest(rows: DataFrame) -> DataFrame:
    """One row for each path: the last state of a file that came more than once."""
    order = Window.partitionBy("path").orderBy(F.desc("modified_at"), F.desc("size"), "content_hash")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def merge(batch: DataFrame, state: str) -> None:
    """Rows of a batch of raw files take the place of stored ones with their path."""
    put(batch.sparkSession, state, fresh=newest(files.extracted(batch)))


def arrivals(spark: SparkSession, root: str, state: str, checkpoint: str, files_per_batch: int = 10_000, every: str | None = None):
    """Start the stream of files that arrive under root: until all are taken in, or, with `every` (such as "1 second"), on and on."""
    stream = spark.readStream.format("binaryFile").schema(RAW).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(lambda batch, _: merge(batch, state)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def compared(spark: SparkSession, root: str, state: str, ignore: Ignore | None = None, there: DataFrame | None = None) -> DataFrame:
    """(path, action, o_hash): the listing under root as created, updated, unchanged, ignored, cloud_only or errors; stored paths below root that it lacks are deleted. Contents are not read.

    there: the listing (path, size, modified_at) with availability where that is known; a row without size or time is an error.
    """
    there = files.walked(spark, root, ignore) if there is None else there
    seen = there.select("path", "size", "modified_at", (F.col("availability") if "availability" in there.columns else F.lit("available")).alias("availability"), F.lit(True).alias("seen"))
    mine = current(spark, state).where(ingest.below(F.col("path"), F.lit(files.within(root)))).select("path", F.col("size").alias("o_size"), F.col("modified_at").alias("o_at"), F.col("content_hash").alias("o_hash"), F.lit(True).alias("known"))
    skipped = ignore.column("path", files.within(root)) if ignore else F.lit(False)
    same = (F.col("size") == F.col("o_size")) & (F.col("modified_at") == F.col("o_at"))
    action = (
        F.when(F.col("seen").isNull() | (skipped & F.col("known").isNotNull()), "deleted")
        .when(skipped, "ignored")
        .when(F.col("size").isNull() | F.col("modified_at").isNull(), "errors")
        .when(F.col("availability") != "available", "cloud_only")
        .when(F.col("known").isNull(), "created")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    return seen.join(mine, "path", "full").select("path", action.alias("action"), "o_hash")


def chunks(rows: Iterator, size: int) -> Iterator[list[str]]:
    """Paths, some at a time: the driver holds no more of them than one read is told."""
    while some := [r.path for r in islice(rows, size)]:
        yield some


def reconcile(spark: SparkSession, root: str, state: str, complete: bool = True, files_per_batch: int = 10_000, ignore: Ignore | None = None, there: DataFrame | None = None, most_errors: int = 100) -> DataFrame:
    """One pass over a root; gives its counters (action, n). complete: the listing is whole, so what it lacks has vanished. Errors beyond most_errors count as dropped."""
    actions = compared(spark, root, state, ignore, there).persist()
    try:
        out = dict.fromkeys(COUNTERS, 0) | {r.action: r.n for r in actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        out |= {"updated": 0, "errors": min(out["errors"], most_errors), "dropped_errors": max(0, out["errors"] - most_errors)}
        wanted = actions.where("action in ('created', 'updated')")
        same = (F.col("action") == "updated") & F.col("content_hash").eqNullSafe(F.col("o_hash"))
        counts = {"updated": F.count_if((F.col("action") == "updated") & ~same), "unchanged": F.count_if(same), "extraction_errors": F.count_if(F.col("status") == "failed")}
        for paths in chunks(wanted.orderBy("path").toLocalIterator(), files_per_batch):
            read = files.extracted(spark.read.format("binaryFile").load([escaped(p) for p in paths]))
            for k, n in put(spark, state, fresh=read.join(wanted, "path"), counts=counts).items():
                out[k] += n
        if not complete:
            out["deleted"] = 0
        elif out["deleted"]:
            put(spark, state, gone=actions.where("action = 'deleted'"))
    finally:
        actions.unpersist()
    return spark.createDataFrame([(a, n) for a, n in sorted(out.items()) if n], "action string, n long")


def escaped(path: str) -> str:
    """A path as the reader takes it literally: it reads wildcards otherwise."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def passes(spark: SparkSession, roots: list[str], state: str, ignore: Ignore | None = None) -> DataFrame:
    """(root, action, n, error): a complete pass over each root; one that fails has its error as its only row, deletes nothing and stops no other."""
    rows = []
    for root in roots:
        try:
            rows += [(root, r.action, r.n, None) for r in reconcile(spark, root, state, ignore=ignore).collect()]
        except Exception as e:  # a root that is not there
            rows.append((root, "error", 1, files.one_line(str(e))))
    return spark.createDataFrame(rows, "root string, action string, n long, error string")


def run_once(spark: SparkSession, root: str, state: str, checkpoint: str, complete: bool = False, files_per_batch: int = 10_000, ignore: Ignore | None = None) -> DataFrame:
    """Take in what has arrived under root since the last run, then what has changed; complete: then drop what has vanished. Gives the pass's counters."""
    arrivals(spark, root, state, checkpoint, files_per_batch).awaitTermination()
    return reconcile(spark, root, state, complete, files_per_batch, ignore)
