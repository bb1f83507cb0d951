"""Records: normalisation, checks of ids, lists of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.normalize import country_key, normalize_address, normalize_name
from concord.schema import BAD_ID, SOURCE_COLUMNS, require_columns


def normalize_records(records: DataFrame) -> DataFrame:
    """``records`` with business_name_normalized and business_address_normalized; other columns are untouched."""
    require_columns(records.columns, SOURCE_COLUMNS)
    return records.withColumns({"business_name_normalized": normalize_name(F.col("business_name")), "business_address_normalized": normalize_address(F.col("business_address"))})


def keyed_records(records: DataFrame) -> DataFrame:
    """entity_id, source_name, name, address, country: the normalised form that the other operators read."""
    require_columns(records.columns, ["source_name", *SOURCE_COLUMNS])
    return records.select(
        "entity_id", "source_name", normalize_name(F.col("business_name")).alias("name"), normalize_address(F.col("business_address")).alias("address"), country_key(F.col("country")).alias("country")
    )


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources' records with their source_name; columns that a source lacks are null."""
    out = None
    for name, frame in sources.items():
        one = frame.withColumn("source_name", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def source_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_records"))


def bad_id(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "") | value.rlike(BAD_ID)


def id_violations(records: DataFrame) -> DataFrame:
    """(entity_id, rule, n): ids that are null, blank or hold a separator, and ids that several records have."""
    malformed = records.where(bad_id(F.col("entity_id"))).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).select("entity_id", F.lit("malformed").alias("rule"), "n")
    repeated = records.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity_id", F.lit("repeated").alias("rule"), "n")
    return malformed.unionByName(repeated)


def check_ids(records: DataFrame) -> DataFrame:
    """``records``, or ValueError where an id is malformed or repeated."""
    if found := id_violations(records).limit(5).collect():
        raise ValueError(f"bad entity ids: {[(r.entity_id, r.rule) for r in found]}")
    return records


def parse_ids(text: Column) -> Column:
    """Ids of a comma list, in order, once each, without empty ones."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != ""))


def format_ids(ids: Column) -> Column:
    return F.array_join(ids, ",")


def exploded_candidates(lists: DataFrame) -> DataFrame:
    """source1_entity_id, candidate_entity_id, candidate_rank (from 1) of ranked lists (source1_entity_id, candidate_entity_ids)."""
    each = lists.select("source1_entity_id", F.posexplode("candidate_entity_ids").alias("at", "candidate_entity_id"))
    return each.select("source1_entity_id", "candidate_entity_id", (F.col("at") + 1).alias("candidate_rank"))
