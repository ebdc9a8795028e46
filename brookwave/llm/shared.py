"""Helpers that several operators share: tables in the shared folder, words, arrow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_ROWS = 1_000  # of texts that go to a Python worker at once; by default it is ten times as many


def small_batches(spark: SparkSession) -> None:
    """Bounds what workers hold of texts: rows can be a hundred kilobytes long."""
    if not 0 < int(spark.conf.get(BATCH, "10000")) <= MOST_ROWS:
        spark.conf.set(BATCH, str(MOST_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where a local session names none (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brookwave-"))
        made = spark.sparkContext.getCheckpointDir()
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, a lost executor loses nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by stored() that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "stored_at", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text, null as empty; A-Z are lowered on these bytes without touching other letters."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
