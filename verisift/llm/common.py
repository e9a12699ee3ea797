"""Shared-folder tables and helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: This process' folder below the shared one.
RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one is made if driver and
    executors are one process (master local); elsewhere there is no folder that all can see, and that is an error."""
    sc, key = spark.sparkContext, "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or sc.getConf().get(key)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='verisift-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/verisift/{RUN}/{name}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Deletes all that this process has saved; results that have not been written yet cannot be read after it."""
    remove(spark, f"{shared_dir(spark)}/verisift/{RUN}")


def save(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, and any executor may be lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str | None) -> None:
    if path:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def drop(df: DataFrame) -> None:
    """Deletes what save() wrote, once nothing reads it any more."""
    remove(df.sparkSession, getattr(df, "saved_at", None))


def row_id():
    """A number for each row, so that rows with equal or null ids stay apart. Use it only up to the next shuffle."""
    return F.monotonically_increasing_id()


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Lets Arrow batches hold so many rows and BATCH_BYTES at most, as texts can be long: the defaults suit numbers.
    Settings of the session that are smaller stay."""
    key, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    known = re.fullmatch(r"(\d+)b?", spark.conf.get(size))
    if not known or int(known[1]) > BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")
