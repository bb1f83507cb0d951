"""Checks of match and candidate lists against the records: a report of (rule, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.records import bad_id
from concord.schema import ID_PREFIX


def _report(rows: DataFrame, rule: str, key, detail) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.coalesce(key.cast("string"), F.lit("")).alias("key"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


def _ids(records: DataFrame, first: bool) -> DataFrame:
    return records.where((F.col("source_name") == "source1") if first else (F.col("source_name") != "source1")).select("entity_id").distinct()


def exploded(lists: DataFrame, column: str) -> DataFrame:
    return lists.select("source1_entity_id", F.explode(column).alias("candidate_entity_id"))


def coverage_gaps(lists: DataFrame, records: DataFrame) -> DataFrame:
    """(entity_id, gap): entities of source 1 without a list, and lists of others."""
    ids, listed = _ids(records, True), lists.select(F.col("source1_entity_id").alias("entity_id")).distinct()
    missing = ids.join(listed, "entity_id", "left_anti").select("entity_id", F.lit("missing").alias("gap"))
    return missing.unionByName(listed.join(ids, "entity_id", "left_anti").select("entity_id", F.lit("unknown").alias("gap")))


def unknown_targets(lists: DataFrame, records: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """source1_entity_id, candidate_entity_id of listed ids that sources 2 and 3 don't have."""
    each = exploded(lists, column)
    return each.join(_ids(records, False).withColumnRenamed("entity_id", "candidate_entity_id"), "candidate_entity_id", "left_anti").select("source1_entity_id", "candidate_entity_id")


def matches_not_in_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that aren't candidates, of entities that have a candidate list."""
    each = exploded(matches, "matched_entity_ids").distinct().join(candidates.select("source1_entity_id").distinct(), "source1_entity_id", "left_semi")
    return each.join(exploded(candidates, "candidate_entity_ids"), ["source1_entity_id", "candidate_entity_id"], "left_anti")


def validation_report(lists: DataFrame, records: DataFrame, column: str = "matched_entity_ids", candidates: DataFrame | None = None) -> DataFrame:
    """All violations in ``lists`` (source1_entity_id, ids as array); no rows if there are none."""
    key, ids = F.col("source1_entity_id"), F.col(column)
    padded = F.filter(ids, lambda x: x.isNull() | (x == "") | (x != F.trim(x)))
    prefixed = F.filter(ids, lambda x: ~(x.startswith(ID_PREFIX["source2"]) | x.startswith(ID_PREFIX["source3"])))
    gaps = coverage_gaps(lists, records)
    found = [
        _report(lists.where(bad_id(key)), "bad_source1_id", key, key),
        _report(lists.where(ids.isNull()), "null_list", key, F.lit("")),
        _report(lists.groupBy("source1_entity_id").count().where("count > 1"), "repeated_source1_id", key, F.col("count")),
        _report(gaps, "coverage", F.col("entity_id"), F.col("gap")),
        _report(lists.where(F.size(padded) > 0), "malformed_id", key, F.array_join(padded, "|")),
        _report(lists.where(F.size(F.array_distinct(column)) < F.size(column)), "repeated_id", key, F.size(column) - F.size(F.array_distinct(column))),
        _report(lists.where(F.size(prefixed) > 0), "id_prefix", key, F.array_join(prefixed, "|")),
        _report(unknown_targets(lists, records, column), "unknown_target", key, F.col("candidate_entity_id")),
    ]
    if candidates is not None:
        found.append(_report(matches_not_in_candidates(lists, candidates), "not_a_candidate", key, F.col("candidate_entity_id")))
    return reduce(DataFrame.unionByName, found)


def raise_if_any(report: DataFrame) -> None:
    if found := report.limit(10).collect():
        raise ValueError("; ".join(f"{r.rule}: {r.key} {r.detail}".strip() for r in found))


def header_violations(spark: SparkSession, found: list[str], wanted: list[str]) -> DataFrame:
    """(rule, key, detail): a row if the columns aren't exactly those wanted."""
    bad = [("header", ",".join(found), f"expected {','.join(wanted)}")] if found != wanted else []
    return spark.createDataFrame(bad, "rule string, key string, detail string")


def field_count_violations(lines: DataFrame, fields: int = 2) -> DataFrame:
    """(rule, key, detail) of raw lines (value) without exactly ``fields`` tab-separated fields."""
    n = F.size(F.split("value", "\t", -1))
    return _report(lines.where(n != fields), "field_count", F.col("value"), n)
