"""Helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import ship, spread

#: Bytes of one Arrow batch handed to a Python worker; long texts then come in small batches.
BATCH_BYTES = 4 << 20
#: Rows of one Arrow batch at most.
BATCH_ROWS = 2048
#: Rows that the Parquet reader decodes at once: its buffers hold their whole texts.
READER_ROWS = 512
#: A key is hot where it has more rows than this and than a thousandth of all.
HOT_ROWS = 1000
#: Folders of this application's tables.
TOPS: set[str] = set()
#: Temporary folders of local sessions that name none, by application.
LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound what one Python worker holds at once, whatever the texts' lengths."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


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


def salted_join(left: DataFrame, right: DataFrame, on: str, n: str, spread: Column, how: str = "left") -> DataFrame:
    """left joined to right, which has one row for each key and, in column n, how many rows of left have it.

    Rows of hot keys are dealt by `spread` over several tasks, and their row of right is repeated. There are fewer than 1000 such keys.
    """
    total, most = right.agg(F.sum(n), F.max(n)).first()
    least = max(HOT_ROWS, (total or 0) // 1000)
    held = right.drop(n)
    if (most or 0) <= least:
        return left.join(held, on, how)
    hot = [bytes(k) if isinstance(k, bytearray) else k for (k,) in right.where(F.col(n) > least).select(on).collect()]
    salts = -(-most // max(HOT_ROWS, total // (2 * partitions(left.sparkSession))))
    of_key = F.when(F.col(on).isin(hot), F.lit(salts)).otherwise(F.lit(1))
    dealt = left.withColumn("__salt", F.pmod(spread, of_key))
    repeated = held.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), of_key.cast("long") - 1)))
    return dealt.join(repeated, [on, "__salt"], how).drop("__salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key's text modulo `folds`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batch_of(schema: pa.Schema, out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
