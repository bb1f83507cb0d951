"""Tables that several steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: For each open ``scratch``, the tables that were cut inside it: (table, its checkpoint's path).
_open: list[list[tuple[DataFrame, str]]] = []


def _checkpoint_folder(spark: SparkSession) -> None:
    """See that there is one: ``spark.checkpoint.dir``, or on one machine (tests) a temporary folder."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() is not None:
        return
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster reaches")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="concord-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that the cluster shares and go on from there.

    Partitions are those of its last stage: after a shuffle as many as their bytes ask for (adaptive execution), after
    a scan one for each split. RuntimeError where a cluster has no such folder.
    """
    _checkpoint_folder(df.sparkSession)
    written = df.checkpoint()
    if _open and (path := checkpoint_path(written)):
        _open[-1].append((written, path))
    return written


def cut_dealt(df: DataFrame) -> DataFrame:
    """``cut`` of a table whose last step is a shuffle by key: joins and groups by that key needn't deal it again.

    Adaptive execution would hide how the table is dealt, so it is off while this one table is written. Shuffle files go
    as those of ``cut_freed`` do.
    """
    return _cut_with(df, {"spark.sql.adaptive.enabled": "false"})


def cut_freed(df: DataFrame) -> DataFrame:
    """``cut``, after which the shuffle files that the table was made from go.

    They would else stay until the driver's garbage collector finds that nothing refers to them, which on a cluster was a
    step too late. Those of persisted tables that ``df`` reads stay.
    """
    return _cut_with(df, {})


def _cut_with(df: DataFrame, settings: dict[str, str]) -> DataFrame:
    spark = df.sparkSession
    settings = settings | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return cut(df.select("*"))  # a query takes its settings when it is made
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def checkpoint_path(df: DataFrame) -> str | None:
    """Where the table of a ``cut`` lies."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def discard(df: DataFrame) -> None:
    """Delete a table that ``cut`` has written and that nothing reads any more."""
    if path := checkpoint_path(df):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Delete all tables cut inside, at the end, but those in the list that this gives (and ``keep``)."""
    kept = list(keep)
    _open.append([])
    try:
        yield kept
    finally:
        for df, path in _open.pop():
            if not any(df is k for k in kept):
                _delete(df.sparkSession, path)
            elif _open:
                _open[-1].append((df, path))


@contextmanager
def shared_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own beside the checkpoints, for files that the whole cluster reads; deleted at the end."""
    _checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _delete(spark, path)
