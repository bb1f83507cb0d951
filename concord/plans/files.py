"""The engine's files as queries: the driver's tables are written as sources, lists, features and tables, and read back.

Files lie in the folder that the cluster shares for checkpoints and go once their rows have been read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import blocking, idf
from concord.operators import features as pairwise
from concord.operators.records import exploded_candidates, format_ids, keyed_records
from concord.operators.store import cut, shared_folder
from concord.plans import catalog
from concord.schema import CANDIDATE_COLUMNS, MATCH_COLUMNS, PAIR_FEATURES, PAIR_IDS, SOURCE_COLUMNS, SOURCES, BlockingConfig
from concord.sources import fixtures, tsv

Query = Callable[[SparkSession, str], DataFrame]


@contextmanager
def _folder(spark: SparkSession) -> Iterator[str]:
    with shared_folder(spark, "files") as path:
        yield path


def _write_sources(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The records as three files of the training split; rows stand in the order of their ids' MD5."""
    each = fixtures.entities(spark, sf_dir)
    for source in SOURCES:
        rows = each.where(F.col("source_name") == source).select(*SOURCE_COLUMNS, F.md5("entity_id").alias("at"))
        tsv.write_tsv(rows, tsv.source_path(root, "train", source), order="at")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of a split, read from its three files."""
    with _folder(spark) as root:
        _write_sources(spark, sf_dir, root)
        return cut(tsv.load_training(spark, root, normalize=False).select("source_name", *SOURCE_COLUMNS))


def source_file_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names and addresses of the records of a split's files."""
    with _folder(spark) as root:
        _write_sources(spark, sf_dir, root)
        return cut(tsv.load_training(spark, root).select("entity_id", "business_name_normalized", "business_address_normalized"))


def source_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of source 1 and the line, from 1, where each stands in its file."""
    with _folder(spark) as root:
        _write_sources(spark, sf_dir, root)
        return cut(_lines(tsv.file_order(spark, tsv.source_path(root, "train", "source1"))))


def _lines(rows: DataFrame) -> DataFrame:
    """``rows`` with the line of each instead of its position: a file read whole is one task's, its rows numbered from 0."""
    return rows.withColumn("line", F.col("position.row") + 1).drop("position")


def _written_lists(spark: SparkSession, sf_dir: str, root: str, lists: DataFrame) -> str:
    _write_sources(spark, sf_dir, root)
    path = f"{root}/lists.tsv"
    tsv.write_lists(lists, path, order=tsv.file_order(spark, tsv.source_path(root, "train", "source1")))
    return path


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = keyed_records(fixtures.entities(spark, sf_dir))
    return blocking.candidate_lists(records, blocking.generate_candidates(records))


def candidate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate lists as their file has them, in the order of source 1's file."""
    with _folder(spark) as root:
        path = _written_lists(spark, sf_dir, root, _candidates(spark, sf_dir))
        return cut(_lines(tsv.read_tsv(spark, path, CANDIDATE_COLUMNS, position=True)))


def candidate_file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs read from the file of lists."""
    with _folder(spark) as root:
        path = _written_lists(spark, sf_dir, root, _candidates(spark, sf_dir))
        return cut(exploded_candidates(tsv.read_lists(spark, path)))


def match_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match lists as their file has them, in the order of source 1's file."""
    with _folder(spark) as root:
        path = _written_lists(spark, sf_dir, root, catalog.matches(spark, sf_dir))
        return cut(_lines(tsv.read_tsv(spark, path, MATCH_COLUMNS, position=True)))


def truth_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true links of every record of source 1, read from their file."""
    with _folder(spark) as root:
        path = _written_lists(spark, sf_dir, root, fixtures.ground_truth(spark, sf_dir))
        lists = tsv.read_truth(spark, path)
        return cut(lists.select("source1_entity_id", format_ids(F.array_sort("matched_entity_ids")).alias("matched_entity_ids"), F.size("matched_entity_ids").alias("n_links")))


def _through_file(spark: SparkSession, features: DataFrame) -> DataFrame:
    """``features`` with six decimals, written as text and read back.

    They are rounded before they are written: the file's eight significant digits hold six decimals of what is below 100
    whole, while rounding eight digits again could go up twice.
    """
    kinds = dict(features.dtypes)
    rounded = features.select(*PAIR_IDS, *(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in PAIR_FEATURES))
    with _folder(spark) as root:
        tsv.write_features(rounded, f"{root}/features.tsv")
        found = tsv.read_features(spark, f"{root}/features.tsv")
        return cut(found.select(*PAIR_IDS, *(F.col(c).cast(kinds[c]) for c in PAIR_FEATURES)))


def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all pairs, read from their text file, with six decimals."""
    records = keyed_records(fixtures.entities(spark, sf_dir))
    return _through_file(spark, pairwise.pair_features(cut(blocking.generate_candidates(records)), records))


def idf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of inverse document frequencies, read with the number of records it was fitted on."""
    records, config = keyed_records(fixtures.entities(spark, sf_dir)), BlockingConfig()
    with _folder(spark) as root:
        n = records.count()
        tsv.save_idf(idf.smoothed_idf(idf.document_frequency(records, config), n), f"{root}/idf", "train", n, config)
        table, fitted = tsv.load_idf(spark, f"{root}/idf", config)
        return cut(table.select("field", "feature", "df", F.round("idf", 6).alias("idf"), F.lit(fitted).cast("long").alias("n_records")))


QUERIES: dict[str, Query] = {
    "source_files": source_files,
    "source_file_normalized": source_file_normalized,
    "source_file_lines": source_file_lines,
    "candidate_file": candidate_file,
    "candidate_file_pairs": candidate_file_pairs,
    "match_file": match_file,
    "truth_file": truth_file,
    "feature_file": feature_file,
    "idf_file": idf_file,
}
