"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share, by weight, of `factor` times all words, at most `most` times its own size; what is
cut off is shared again by weight among the rest until none is above. Each document of the source then expects
target / size copies: the whole part is taken, and the fractional part is rounded by the pivotal method. Two
documents with fractional probabilities p and q meet; mass moves from one to the other at random, without changing
either expectation, until one is 0 or 1, and the other goes on. As p + q is kept, the number of copies of a source
is its expectation rounded; as neighbours in size meet first, so is, nearly, the number of words.

The pairs are made by a reduction tree: groups of documents of one source and of like size leave one residual each,
FAN residuals meet at each level above, and the last one is rounded alone. Groups come from a hash of the
document, in numbers that follow from exact counts, so that reruns agree and a source with any share of the rows
is dealt over many tasks. Levels grow with the logarithm of the largest source.

Null texts have size 0; null sources form a source of their own, last in order. Repeated rows are documents of their own. Documents of size 0 take 0 words.
A table without words gives targets of 0.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources by code point of their names, again and again.
WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of a group on the lowest level, and residuals that meet on each level above.
FAN = 4096
BLANKS = " \t\n\x0b\f\r"
#: A word with the white space after it.
WORD = "[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"


def n_words(text: str) -> Column:
    """Number of words: the length of the text with one letter for each word. (regexp_count makes an array of all words.)"""
    return F.length(F.regexp_replace(F.ltrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS)), WORD, "x")).cast("long")


def identity(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's columns; rows that are equal in all columns have the same."""
    columns = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema]
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *reversed(columns))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank from 0 in ascending order, null last, by range partitions and their counts."""
    spread = common.written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    sizes = dict(spread.groupBy("part").count().collect())  # one number a partition
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    start = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))[F.col("part")] if starts else F.lit(0)
    return spread.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + start).drop("part")


def targets(sizes: DataFrame, factor: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); each round caps the sources above and shares the rest again."""
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = common.written(ranked(sizes).select("source", "source_size", weight.alias("weight")), "weights")
    cap = F.col("source_size") * F.lit(float(most))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * factor
    level, capped = 0.0, -1
    while True:  # a source once above stays above, as the level only rises: ends after at most as many rounds as there are sources, in practice a few
        above = F.col("weight") * F.lit(level) > cap if capped >= 0 else F.lit(False)
        n, held, free = table.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - float(held or 0)) / float(free)
    return table.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def chain(p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round p along its order; gives 0/1 for the settled, and the place of the one that stays fractional, or -1."""
    out, at = p.copy(), -1
    for i, q in enumerate(p):
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[i] = round(q)
            continue
        if at < 0:
            at = i
            continue
        a, b = out[at], q
        s = a + b
        if s < 1 - 1e-12:  # one of them ends at 0
            gone, stays = (at, i) if draws[i] < b / s else (i, at)
            out[gone], out[stays], at = 0.0, s, stays
        elif s > 1 + 1e-12:  # one of them ends at 1
            full, stays = (at, i) if draws[i] < (1 - b) / (2 - s) else (i, at)
            out[full], out[stays], at = 1.0, s - 1, stays
        else:
            first = draws[i] < a
            out[at], out[i], at = float(first), float(not first), -1
    return out, at


def rounded(seed: int, level: int):
    """Round one group; the residual stays open unless it is the last of its source."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie", "r1"], ascending=[False, True, True], kind="stable")
        first = int(pdf["tie"].iloc[0]) & 0x7FFFFFFFFFFFFFFF
        draws = np.random.default_rng([seed, level, first, len(pdf)]).random(len(pdf) + 1)
        p, at = chain(pdf["p"].to_numpy(copy=True), draws[:-1])
        pdf["open"] = False
        if at >= 0:
            if pdf["last"].iloc[0]:
                p[at] = float(draws[-1] < p[at])
            else:
                pdf.iloc[at, pdf.columns.get_loc("open")] = True
        pdf["p"] = p
        return pdf

    return group


def mix(docs: DataFrame, factor: float = 1.5, most: float = 2.0, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs' (key, source) with size, source_size, target, copies (0 .. most), taken = copies * size, and r1 and r2, hashes of the row."""
    common.prepare(docs.sparkSession)
    sized = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), n_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.col(source)).alias("tie"), *(h.alias(n) for h, n in zip(identity(docs), ("r1", "r2"), strict=True)))
    sized = common.written(sized, "sizes")
    band = F.floor(F.log2(F.col("size") + 1) * 2)
    counts = sized.groupBy("source", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    counts = common.written(counts.withColumn("n_groups", F.ceil(F.col("n") / FAN).cast("long")), "bands")
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), factor, most)
    plan = counts.withColumnRenamed("source", "s").join(goal.withColumnRenamed("source", "g"), F.col("s").eqNullSafe(F.col("g"))).select("s", "band", "n_groups", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    tree = sized.withColumn("b", band).join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("band")))
    tree = tree.select("id", "source", "size", "tie", "r1", "r2", "source_size", "target", F.floor(rate).cast("long").alias("whole"), (rate - F.floor(rate)).alias("p"), "band", F.pmod(F.xxhash64("tie"), F.col("n_groups")).alias("node"))
    columns = "id {id}, source string, size long, tie long, r1 long, r2 long, source_size long, target double, whole long, p double, band long, node long, last boolean, open boolean"
    columns = columns.format(id=tree.schema["id"].dataType.simpleString())
    level, nodes, done = 0, int(counts.agg(F.max("n_groups")).first()[0] or 1), []
    while True:
        last = nodes == 0
        ready = tree.withColumns({"last": F.lit(last), "open": F.lit(False)})
        if last:  # above the bands there is one node for each source
            ready = ready.withColumn("band", F.lit(-1).cast("long"))
        tree_out = common.written(ready.groupBy("source", "band", "node").applyInPandas(rounded(seed, level), columns), f"level{level}")
        done.append(tree_out.where(~F.col("open")))
        if last:
            break
        tree = tree_out.where("open").drop("last", "open").withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        nodes, level = (0 if nodes == 1 else -(-nodes // FAN)), level + 1
    copies = (F.col("whole") + F.round("p").cast("long")).alias("copies")
    out = reduce(DataFrame.unionByName, done).select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies, "r1", "r2")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def expanded(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; mixed is what `mix` gave for docs. Rows equal in all columns are one, with the copies of all."""
    times = mixed.groupBy("r1", "r2").agg(F.sum("copies").alias("n")).where("n > 0")
    marked = docs.select(F.struct(*docs.columns).alias("row"), *(h.alias(n) for h, n in zip(identity(docs), ("r1", "r2"), strict=True)))
    joined = marked.join(times, ["r1", "r2"]).dropDuplicates(["r1", "r2"])  # dealt by both, so texts cross once
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")
