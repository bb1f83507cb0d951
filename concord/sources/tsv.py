"""Tab-separated sources and sinks, and artifacts that are kept between steps."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators.records import format_ids, normalize_records, parse_ids, union_sources
from concord.schema import CANDIDATE_COLUMNS, MATCH_COLUMNS, PAIR_FEATURES, PAIR_IDS, SOURCE_COLUMNS, SOURCES, SPLITS, require_columns

READ = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "mode": "FAILFAST", "encoding": "UTF-8"}
IDF_VERSION = 1


def source_path(root: str, split: str, source: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    return f"{root}/{split}/{split}_{source}.tsv"


def header(spark: SparkSession, path: str) -> list[str]:
    return [c.removeprefix("\ufeff") for c in spark.read.options(**READ, multiLine=True).csv(path).columns]


def read_tsv(spark: SparkSession, path: str, wanted: list[str], multiline: bool = True, position: bool = False) -> DataFrame:
    """All columns of a file as text, empty fields as empty text; rows of another length are an error.

    Without ``multiline`` quoted fields hold no line ends and Spark splits the file. ``position`` adds a column by which
    rows stand in the file's order.
    """
    columns = header(spark, path)
    require_columns(columns, wanted)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    frame = spark.read.schema(schema).options(**READ, enforceSchema=True, multiLine=multiline).csv(path)
    place = [F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("position")] * position
    return frame.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns), *place)


def file_order(spark: SparkSession, path: str) -> DataFrame:
    """entity_id and position of a source's rows."""
    return read_tsv(spark, path, ["entity_id"], position=True).select("entity_id", "position")


def read_source(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    frame = read_tsv(spark, path, SOURCE_COLUMNS)
    return normalize_records(frame) if normalize else frame


def load_split(spark: SparkSession, root: str, split: str = "train", normalize: bool = True) -> DataFrame:
    """The three sources of a split with their source_name."""
    return union_sources({s: read_source(spark, source_path(root, split, s), normalize) for s in SOURCES})


def load_training(spark: SparkSession, root: str, normalize: bool = True) -> DataFrame:
    return load_split(spark, root, "train", normalize)


def entity_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ["entity_id"]).select("entity_id")


def read_lists(spark: SparkSession, path: str, columns: list[str] = CANDIDATE_COLUMNS) -> DataFrame:
    """A list file's rows with the ids as an array, in order and once each."""
    frame = read_tsv(spark, path, columns)
    return frame.select(columns[0], parse_ids(F.col(columns[1])).alias(columns[1]))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_lists(spark, path, MATCH_COLUMNS)


def guard_overwrite(output: str, inputs: list[str]) -> None:
    if output.rstrip("/") in {p.rstrip("/") for p in inputs}:
        raise ValueError(f"{output} is one of the inputs")


def write_tsv(frame: DataFrame, path: str, inputs: list[str] = (), order: str | None = None) -> None:
    """``frame`` as one file at ``path``, in the order of a column that isn't written, if one is given.

    Its tasks write parts beside it; these are joined and take the file's place by one rename, so that a reader sees the
    old file or the new one, whole.
    """
    guard_overwrite(path, list(inputs))
    spark = frame.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    options = {"sep": "\t", "header": False, "emptyValue": "", "nullValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target, folder = hadoop.Path(path), hadoop.Path(aside)
    fs = target.getFileSystem(conf)
    rows = frame if order is None else frame.orderBy(order).drop(order)
    try:
        rows.write.options(**options).csv(aside)
        whole = hadoop.Path(f"{aside}/whole")
        out = fs.create(whole, True)
        try:
            out.write(bytearray("\t".join(rows.columns) + "\n", "utf-8"))
            for part in sorted(str(x.getPath()) for x in fs.globStatus(hadoop.Path(f"{aside}/part-*.csv"))):
                read = fs.open(hadoop.Path(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, False)
                finally:
                    read.close()
        finally:
            out.close()
        rename = getattr(hadoop, "Options$Rename")
        over = spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(whole), fs.makeQualified(target), over)
    finally:
        fs.delete(folder, True)


def write_lists(lists: DataFrame, path: str, inputs: list[str] = (), order: DataFrame | None = None) -> None:
    """Lists (id, array of ids) as text, in the order of ``file_order`` if that is given."""
    ids, column = lists.columns[0], lists.columns[1]
    text = lists.select(ids, format_ids(F.col(column)).alias(column))
    if order is None:
        return write_tsv(text, path, inputs)
    placed = text.join(order.select(F.col("entity_id").alias(ids), "position"), ids, "left")
    write_tsv(placed.select(ids, column, "position"), path, inputs, "position")


def _short(number: Column) -> Column:
    """A number with eight significant digits, without trailing zeros."""
    digits = F.regexp_replace(F.format_string("%.8g", number.cast("double")), r"(\.\d*?)0+(?=e|$)", "$1")
    return F.regexp_replace(digits, r"\.(?=e|$)", "")


def write_features(features: DataFrame, path: str, inputs: list[str] = ()) -> None:
    """Pair features, tab-separated where ``path`` ends in .tsv, else Parquet; ``path`` must not be an input."""
    if path.endswith(".tsv"):
        return write_tsv(features.select(*PAIR_IDS, *(_short(F.col(c)).alias(c) for c in PAIR_FEATURES)), path, inputs)
    guard_overwrite(path, list(inputs))
    features.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_features`` wrote; features from text are doubles, and an error where one isn't a number."""
    if path.endswith(".tsv"):
        rows = read_tsv(spark, path, [*PAIR_IDS, *PAIR_FEATURES], multiline=False)
        return rows.select(*PAIR_IDS, *(F.col(c).cast("double").alias(c) for c in PAIR_FEATURES))
    frame = spark.read.parquet(path)
    require_columns(frame.columns, [*PAIR_IDS, *PAIR_FEATURES])
    return frame


def save_idf(idf: DataFrame, path: str, split: str, n_records: int, config) -> None:
    meta = {"format_version": IDF_VERSION, "fit_split": split, "n_records": n_records, "n_features": config.n_features, "ngrams": list(config.ngrams)}
    idf.select("field", "feature", "df", "idf").write.mode("overwrite").parquet(f"{path}/table")
    idf.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_idf(spark: SparkSession, path: str, config) -> tuple[DataFrame, int]:
    """The table and the number of records it was fitted on; ValueError if it was made with other parameters."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if (meta["format_version"], meta["n_features"], tuple(meta["ngrams"])) != (IDF_VERSION, config.n_features, config.ngrams):
        raise ValueError(f"the idf table at {path} was made with {meta}")
    return spark.read.parquet(f"{path}/table"), meta["n_records"]


def is_stale(spark: SparkSession, path: str, inputs: list[str]) -> bool:
    """Whether ``path`` is missing or older than one of ``inputs``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def time(p: str) -> int | None:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        return fs.getFileStatus(at).getModificationTime() if fs.exists(at) else None

    own = time(path)
    return own is None or any((t := time(p)) is not None and t > own for p in inputs)
