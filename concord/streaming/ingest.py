"""Source files as a stream: a split's folder is read file by file as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.records import normalize_records
from concord.schema import SOURCE_SCHEMA
from concord.sources.tsv import READ


def stream_source(spark: SparkSession, folder: str, files_per_batch: int = 1, normalize: bool = True) -> DataFrame:
    """Records of the files of ``folder``, ``files_per_batch`` in each micro-batch, as ``tsv.read_source`` gives them."""
    if files_per_batch < 1:
        raise ValueError("files_per_batch must be positive")
    frame = spark.readStream.schema(SOURCE_SCHEMA).options(**READ, maxFilesPerTrigger=files_per_batch).csv(folder)
    frame = frame.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in frame.columns))
    return normalize_records(frame) if normalize else frame


def write_records(records: DataFrame, path: str, checkpoint: str):
    """Append a stream's records to Parquet, each file's once, until all files that are there are read."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
