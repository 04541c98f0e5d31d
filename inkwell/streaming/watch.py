"""Changes as a stream, taken in once a file has been quiet.

A notice says that a file was seen with a size and a time. The stream keeps the last notice of each path as state and emits the path when none has come for `quiet`
of event time; a notice of another state sets the timer anew, so a file that is written several times in a row is read once. What is not due yet waits in the checkpoint, over restarts too.
Notices are rows of JSON files in a folder; `note` writes those of a listing's differences, and a heartbeat that moves time on where nothing has changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.sources import files
from inkwell.sources.rules import Ignore
from inkwell.streaming import reconcile

NOTICES = "path string, size long, modified_at timestamp, gone boolean, seen_at timestamp"
SETTLED = "path string, size long, modified_at timestamp, gone boolean, notices long"
HELD = "size long, modified_at timestamp, gone boolean, seen_at timestamp, notices long"
#: The path of a heartbeat: of no file.
BEAT = ""


def note(spark: SparkSession, root: str, state: str, notices: str, seen_at: str, ignore: Ignore | None = None) -> None:
    """Write notices of what differs between the tree and the stored table, and a heartbeat."""
    there = files.walked(spark, root, ignore).persist()
    try:
        actions = reconcile.compared(spark, root, state, ignore, there).where("action in ('created', 'updated', 'deleted')")
        found = actions.join(there, "path", "left").select("path", "size", "modified_at", (F.col("action") == "deleted").alias("gone"))
        beat = spark.createDataFrame([(BEAT, None, None, False)], "path string, size long, modified_at timestamp, gone boolean")
        found.unionByName(beat).withColumn("seen_at", F.lit(seen_at).cast("timestamp")).coalesce(1).write.mode("append").json(notices)
    finally:
        there.unpersist()


def settled(notices: DataFrame, quiet: str) -> DataFrame:
    """(path, size, modified_at, gone, notices): each path's last notice, once no other has come for `quiet`."""
    wait = pd.Timedelta(quiet)

    def keep(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            size, modified_at, gone, _, n = state.get
            state.remove()
            if key[0] != BEAT:
                yield pd.DataFrame({"path": [key[0]], "size": pd.array([size], "Int64"), "modified_at": [modified_at], "gone": [gone], "notices": [n]})
            return
        last, n = (state.get[:4], state.get[4]) if state.exists else (None, 0)
        for part in parts:
            n += len(part)
            for row in part.sort_values("seen_at").itertuples():
                now = (None if pd.isna(row.size) else int(row.size), None if pd.isna(row.modified_at) else row.modified_at.to_pydatetime(), bool(row.gone))
                if key[0] == BEAT or last is None or (row.seen_at >= last[3] and now != tuple(last[:3])):  # a notice of the same state is no change
                    last = (*now, row.seen_at.to_pydatetime())
        state.update((*last, n))
        due = int((pd.Timestamp(last[3]) + wait).timestamp() * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    timed = notices.withWatermark("seen_at", "0 seconds").groupBy("path")
    return timed.applyInPandasWithState(keep, SETTLED, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def take(batch: DataFrame, state: str, files_per_read: int = 10_000) -> None:
    """Read the settled files of a batch, each once, and drop those that are gone."""
    spark = batch.sparkSession
    rows = batch.persist()
    try:
        for paths in reconcile.chunks(rows.where("not gone").orderBy("path").toLocalIterator(), files_per_read):
            reconcile.merge(spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load([reconcile.escaped(p) for p in paths]), state)
        if not (gone := rows.where("gone")).isEmpty():
            reconcile.put(spark, state, gone=gone)
    finally:
        rows.unpersist()


def changes(spark: SparkSession, notices: str, state: str, checkpoint: str, quiet: str = "1 second", every: str | None = None):
    """Start the stream of settled changes: until all notices are read, or, with `every`, on and on."""
    stream = spark.readStream.schema(NOTICES).json(notices)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return settled(stream, quiet).writeStream.foreachBatch(lambda batch, _: take(batch, state)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
