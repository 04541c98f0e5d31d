"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation many times, each time a few turns longer. Every prefix of a conversation gets a
rolling hash: the running sum, over its turns in order, of a 128-bit hash of (position, role, text), kept as four
32-bit sums so that it never overflows. A conversation whose whole hash is a proper prefix of another's is a snapshot
of a longer one; an anti-join drops it. Of equal conversations that with the smallest id stays. What remains is
rendered by a template. Hashes are made by windows that stream over a conversation, and prefixes are reduced to
distinct hashes before they meet, so neither a very long conversation nor a very common one lands whole in memory
before its own text is rendered.

Turns are ordered by (turn, role, text), nulls first; repeated rows count as further turns. Null roles and texts count as empty.
Rows with a null conv_id form one conversation. Columns other than the four are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longs that hold the four running sums.
PARTS = ("h0", "h1", "h2", "h3")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with pos from 1, the hash of the prefix that ends here, and whether more turns follow."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("pos", F.row_number().over(order).cast("long"))
    digest = F.sha2(F.concat_ws("\x00", F.col("pos").cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text")).cast("binary"), 256)
    hashed = numbered.withColumn("digest", digest)
    for k, part in enumerate(PARTS):
        hashed = hashed.withColumn(part, F.sum(F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long")).over(running))
    return hashed.withColumn("more", F.lead("pos").over(order).isNotNull()).drop("digest")


def render(role: Column, text: Column) -> Column:
    """One turn in a plain chat markup."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_snapshots, rendered): a row for each maximal conversation; n_snapshots counts conversations equal to it, itself included."""
    hashed = prefix_hashes(turns)
    last = hashed.where(~F.col("more")).select("conv_id", F.col("pos").alias("n_turns"), *PARTS)
    whole = last.groupBy("n_turns", *PARTS).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_snapshots"))
    proper = hashed.where("more").select(F.col("pos").alias("n_turns"), *PARTS).distinct()
    maximal = whole.join(proper, ["n_turns", *PARTS], "left_anti").select("conv_id", "n_turns", "n_snapshots")
    kept = maximal.withColumnRenamed("conv_id", "kept_id")
    lines = hashed.select("conv_id", "pos", render(F.col("role"), F.col("text")).alias("line"))
    joined = lines.join(kept, lines["conv_id"].eqNullSafe(kept["kept_id"])).groupBy("kept_id", "n_turns", "n_snapshots").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return joined.select(F.col("kept_id").alias("conv_id"), "n_turns", "n_snapshots", F.array_join(F.col("lines.line"), "").alias("rendered"))
