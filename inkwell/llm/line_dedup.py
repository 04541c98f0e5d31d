"""Dropping lines that many documents share, by levelled sorted runs of line hashes.

A line's key is the line without blanks at its ends and with A-Z in lower case. Documents come in batches, those of the largest ids
first. Each batch is merge-anti-joined to the runs: what they lack is new, its largest document keeps the line, and a sorted run of the new hashes joins the runs.
A level that is full is merged into one run of the next. Runs are tables bucketed and sorted by hash, so that joining them neither shuffles
nor sorts them again. A line that its document does not keep is a repeat; where a key has enough repeats, their lines go.

Keys are 128-bit hashes and lines never cross the network; a text crosses it once, to meet the hashes that it loses. A key of very many
documents is counted before anything is dealt by it, and its repeats are salted.

Null texts count as empty, which is one empty line. Rows of one id count as one document: a key that two of them hold is found in one document, and
stays in both where no larger id has it. Null ids are one document, smaller than all. Repeated rows are kept as they come. Columns other than
id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

BLANK = " \t\n\x0b\x0c\r"
#: Batches of one table, and runs of a level that are merged into one of the next.
BATCHES, FAN_IN = 8, 3


class LineRuns:
    """Sorted runs of (hash, last): a line's hash and the document that keeps it; no hash is in two runs. levels: the runs' tables, new ones first."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN) -> None:
        self.spark, self.fan_in, self.levels = spark, fan_in, [[]]
        self.buckets = common.partitions(spark)
        self.places: dict[str, str] = {}
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # the runs' order is used, not made again

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def put(self, rows: DataFrame, level: int) -> None:
        """Write a run."""
        name, path = f"line_run_{uuid.uuid4().hex}", common.new_folder(self.spark, f"line-run-{level}")
        rows.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        self.places[name] = path
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of (hash, id): what no run has becomes a run, kept by its largest id."""
        new = lines.groupBy("hash").agg(F.max("id").alias("last"))
        for run in self.runs():
            new = new.join(run.select("hash"), "hash", "left_anti")
        self.put(new, 0)
        for level, names in enumerate(self.levels):
            if len(names) >= self.fan_in:
                self.merge(level)

    def merge(self, level: int) -> None:
        """Merge a level's runs into one of the next level."""
        names, self.levels[level] = self.levels[level], []
        self.put(self.union(names), level + 1)
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            common.delete(self.spark, self.places.pop(name))

    def union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def kept(self) -> DataFrame:
        """(hash, last) of all runs."""
        return self.union([name for level in self.levels for name in level])


def keyed(line: str, least: int) -> bytes | None:
    """The hash of a line's key; None where the key is too short."""
    key = line.strip(BLANK)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= least else None


def identity(key: str, text: Column) -> Column:
    """A row's digest: equal for rows of equal id and text, whose results are equal too."""
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    return F.unhex(F.sha2(F.concat(named, F.lit("\0"), text).cast("binary"), 256))


def batches_of(ids: DataFrame, batches: int) -> Column:
    """A number from 0 for each id, larger ids first, so that batches hold about as many rows each."""
    ranged = ids.repartitionByRange(batches, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("least"))
    edges = sorted(r.least for r in ranged.collect() if r.least is not None)  # one for each batch
    edges = edges[:: max(1, -(-len(edges) // batches))][1:]
    return sum((F.when(F.col("id") >= F.lit(e), 0).otherwise(1) for e in edges), F.lit(0))


def shared_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = BATCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, hashes): for each row that loses lines, by its identity, their hashes."""
    spark = docs.sparkSession
    common.prepare(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), identity(key, body).alias("row"), body.alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("row", pa.binary()), ("hashes", pa.list_(pa.binary()))])

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = [list({h for line in t.split("\n") if (h := keyed(line, least_chars))}) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.types[0]), b.column(1).cast(pa.binary()), pa.array(found, schema.types[2])], schema=schema)

    spread = rows.mapInArrow(hashed, f"id {kind.simpleString()}, row binary, hashes array<binary>")
    batch = batches_of(docs.select(F.col(key).alias("id")), batches)
    path = common.new_folder(spark, "lines")
    spread.select(batch.alias("batch"), "id", "row", F.explode("hashes").alias("hash")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"id {kind.simpleString()}, row binary, hash binary, batch int").parquet(path)
    runs = LineRuns(spark)
    for n in range(batches):
        runs.add(lines.where(F.col("batch") == n))
    keeper = runs.kept().withColumnRenamed("hash", "kept")
    repeats = common.written(lines.drop("batch").join(keeper, (F.col("hash") == F.col("kept")) & F.col("id").eqNullSafe(F.col("last")), "left_anti"), "repeats")
    # A key has one document more than those that repeat it.
    counts = repeats.select("hash", "id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("others")).where(F.col("others") >= least_docs - 1)
    rows_of = repeats.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    common_lines = common.written(rows_of.join(counts, "hash").select("hash", "n"), "shared-lines")
    lost = common.salted_join(repeats, common_lines, "hash", "n", F.xxhash64("row"), "inner")
    return lost.groupBy("row").agg(F.collect_set("hash").alias("hashes"))


def deduplicate(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = BATCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_dropped, kept) for each row of docs: a key of least_chars code points and more that least_docs documents hold loses its lines in all but the one of the largest id."""
    lost = shared_lines(docs, least_chars, least_docs, batches, key, text)
    body = F.coalesce(F.col(text), F.lit(""))
    both = docs.select(F.col(key).alias("id"), body.alias("text"), identity(key, body).alias("row")).join(lost, "row", "left").select("id", "text", "hashes")
    kind = both.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for t, hashes in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines, gone = t.split("\n"), set(hashes or ())
                kept = [x for x in lines if keyed(x, least_chars) not in gone] if gone else lines
                out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.types[0]), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True))], schema=schema)

    return both.mapInArrow(cut, f"id {kind.simpleString()}, n_lines long, n_dropped long, kept string").withColumnRenamed("id", key)
