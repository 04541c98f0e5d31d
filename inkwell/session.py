"""What a session needs before the package's Python functions run on executors, and where tables of an application lie."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a key that one task joins in any case.
HOT_ROWS = 100_000
#: Rows that a task sorts or groups at once.
PART_ROWS = 250_000
#: Rows that a Python function turns into a batch at once.
SLICE_ROWS = 256
#: Set on a SparkContext that has this package.
SHIPPED = "inkwell_shipped"
#: Folders of this application's tables, and temporary folders of local sessions that name none, by application.
TOPS: set[str] = set()
LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, once for each SparkContext."""
    context = spark.sparkContext
    if not getattr(context, SHIPPED, False):
        top = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "inkwell.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        context.addPyFile(path)
        setattr(context, SHIPPED, True)
    return spark


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as the session has cores, where a scan has fewer: a small file of one row group is else one task's work."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def parts_of(rows: DataFrame, each: int = PART_ROWS) -> int:
    """Parts in which a task holds about `each` of the rows, however many there are."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share. Where it is unset a local session (tests) gets a temporary one; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        base = LOCAL.get(application) or LOCAL.setdefault(application, tempfile.mkdtemp(prefix="spark-"))
    return base.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path for a table of this application; all of them go when the application ends, or by `clean`."""
    top = f"{shared_folder(spark)}/inkwell-{spark.sparkContext.applicationId}"
    if top not in TOPS:
        TOPS.add(top)
        atexit.register(clean, spark)
    return f"{top}/{what}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete the tables that this application has written to the shared folder. Results that are not read yet are lost."""
    with contextlib.suppress(Exception):  # at the end of an application its JVM may be gone
        delete(spark, f"{shared_folder(spark)}/inkwell-{spark.sparkContext.applicationId}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_count(rows: DataFrame, key: str, by: str, n: str, hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """rows with, in column n, how many of them have their key; rows without a key go.

    Keys are counted before rows are dealt by them. The rows of a key that has more than hot_rows and a thousandth of all, of which there are fewer than a thousand, are dealt by a hash of
    column `by` over several tasks, and its count is repeated for each. counts: (key, n), where they are written already.
    """
    counts = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias(n)), "counts") if counts is None else counts
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    least = max(hot_rows, (total or 0) // 1000)
    if (most or 0) <= least:
        return rows.join(counts, key)
    hot = [r[0] for r in counts.where(F.col(n) > least).select(key).collect()]
    salts = F.when(F.col(key).isin(hot), -(-most // least)).otherwise(1)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), salts))
    repeated = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))
    return dealt.join(repeated, [key, "_salt"]).drop("_salt")


def from_each(rows: DataFrame, function: Callable[..., list[tuple]], made: str) -> DataFrame:
    """The first column of rows, with the tuples (made: their names and types) that function gives for the others of each row. A row's whole work is done where it is read."""
    schema = StructType([rows.schema[0], *StructType.fromDDL(made)])
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                first, *others = batch.slice(start, SLICE_ROWS).columns
                found = [function(*values) for values in zip(*(c.to_pylist() for c in others), strict=True)]
                keys = first.take(pa.array(list(chain.from_iterable(repeat(i, len(f)) for i, f in enumerate(found))), pa.int64()))
                columns = list(zip(*chain.from_iterable(found), strict=True)) or [()] * (len(arrow) - 1)
                yield pa.RecordBatch.from_arrays([keys.cast(arrow.types[0]), *(pa.array(c, t) for c, t in zip(columns, arrow.types[1:], strict=True))], schema=arrow)

    return rows.mapInArrow(each, schema)
