"""Incremental cleaning of posting files with Structured Streaming.

New posting files landing in a folder are cleaned with the same projection the batch reports
use and appended to a curated parquet table. The stream's checkpoint (under the shared
``spark.checkpoint.dir``) records which files were processed, so a restarted or failed run
neither skips nor duplicates a file; ``availableNow`` processes everything present and stops,
which suits scheduled refreshes.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..plans.views import report_clean
from ..session import scratch_path
from ..sources.schemas import SCHEMAS


def clean_postings_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                          checkpoint: str | None = None, fmt: str = "parquet",
                          max_files_per_trigger: int = 64) -> None:
    """Run the cleaning stream until every file present in ``source_dir`` is in ``sink_dir``."""
    ckpt = checkpoint or scratch_path(spark, "streams/" + os.path.basename(os.path.normpath(sink_dir)))
    src = (spark.readStream.schema(SCHEMAS["postings"]).format(fmt)
           .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir))
    q = (report_clean(src).writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def streamed_report_postings(spark: SparkSession, postings_dir: str) -> DataFrame:
    """Clean the stored postings through the stream and read the curated table back."""
    import uuid
    sink = scratch_path(spark, f"curated-postings-{uuid.uuid4().hex[:12]}")
    clean_postings_stream(spark, postings_dir, sink, checkpoint=sink + "-checkpoint")
    return spark.read.parquet(sink)
