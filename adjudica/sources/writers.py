"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from adjudica.operators.fill import upsert
from adjudica.session import cut_lineage


def _flat(df: DataFrame) -> DataFrame:
    """Arrays become comma-joined cells."""
    return df.select(*[
        F.array_join(F.col(f"`{f.name}`").cast("array<string>"), ",", "").alias(f.name)
        if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    writer = _flat(df).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_texts(df: DataFrame, path: str) -> str:
    """One JSON document per line from a prepared ``value`` column."""
    df.select("value").write.mode("overwrite").text(path)
    return path


def upsert_partitions(path: str, updates: DataFrame, key: str, partition: str, order: str) -> str:
    """Keyed upsert into a stored table: only partitions that updates name are read and written again.

    Update values win where they are present. Rows that were there keep their place in ``order``; new ones follow the last
    of their partition in the order of the updates. A key belongs to one partition and occurs once on each side.
    """
    spark = updates.sparkSession
    # As many values as there are partition folders to write.
    touched = [r[0] for r in updates.select(partition).distinct().collect()]
    current = spark.read.parquet(path).where(F.col(partition).isin(touched))
    merged = upsert(current.drop(order, partition), updates.drop(order, partition), key)
    old, asked = current.select(key, partition, F.col(order).alias("_at")), updates.select(key, partition, F.col(order).alias("_asked"))
    placed = old.join(asked, [key, partition], "full_outer")
    ends = placed.groupBy(partition).agg(
        F.coalesce(F.max("_at") + 1, F.lit(0)).alias("_end"), F.min(F.when(F.col("_at").isNull(), F.col("_asked"))).alias("_first"))
    at = F.coalesce("_at", F.col("_end") + F.col("_asked") - F.col("_first")).cast("long").alias(order)
    rows = merged.join(placed.join(ends, partition).select(key, partition, at), key)
    # What is written over is read here, so the rows are stored elsewhere first.
    cut_lineage(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return path
