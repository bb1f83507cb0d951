"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.store import cut  # noqa: F401

#: White space of the word rule shared by the operators: a word is a run of anything else.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


class Held:
    """Tables that several steps of an operator read, kept by the executors until its result is written.

    A lost one is made again from its lineage.
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(df.persist())
        return self.tables[-1]

    def __enter__(self) -> Held:
        return self

    def __exit__(self, *_: object) -> None:
        for df in self.tables:
            df.unpersist()


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the Arrow batches of Python stages by bytes, so that very long texts don't meet in one.

    It is a setting of the session, as a stage reads it when it runs; a smaller one is left as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= size:
        spark.conf.set(key, f"{size}b")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
