"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: prefix of working columns, so that columns of the caller never clash with them
PRE = "__llm_"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing the plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch, budget: int):
    """The rows of an Arrow batch in pieces of at most ``budget`` bytes (or of one row), so that
    what a task holds as Python objects does not follow the number of rows in a batch."""
    if batch.num_rows > 1 and batch.nbytes > budget:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), budget)
        yield from slices(batch.slice(half), budget)
    else:
        yield batch


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(col: str = "text") -> Column:
    """The whole text as UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit("").cast("binary"))
