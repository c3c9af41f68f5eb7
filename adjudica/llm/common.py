"""Shared helpers: reading a table, whole-text columns, reliable intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters between words, as in the class [\x20\x09-\x0D]; bytes.split() cuts at the same six.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only; a null text is an empty one. Other columns of any name are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def quoted(name: str) -> str:
    """A column name as Spark reads it whole, with whatever dots and backticks it has."""
    return "`" + name.replace("`", "``") + "`"


def in_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that a task has few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the fold of a row. A null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as spark.checkpoint.dir names it.

    Where it is unset, a local session takes a folder of its warehouse; on a cluster that could be any machine's own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: later plans start from files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written(), through the file system that holds it."""
    spark = df.sparkSession
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
