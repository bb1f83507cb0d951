"""Entities and their links as views of the driver's web pages.

A page is a record: its title is the name, its address the address, its language the country; its id deals it to one of
three sources. Two records are linked if their whole articles are equal, which no step of the pipeline looks at. Many
pages share a title but not the article.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _id() -> list:
    n = (F.col("page_id") % 3 + 1).cast("string")
    return [F.concat(F.lit("S"), n, F.lit("-"), F.col("page_id").cast("string")).alias("entity_id"), F.concat(F.lit("source"), n).alias("source_name")]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, source_name, business_name, business_address, country."""
    return pages(spark, sf_dir).select(
        *_id(),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("business_name"),
        F.col("url").alias("business_address"),
        F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("country"),
    )


def truth_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source1_entity_id, matched_entity_id of records of source 1 and the others whose articles are equal."""
    key = F.struct(F.regexp_extract("html", '<html lang="([a-z]*)"', 1), F.sha2(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), 256))
    each = pages(spark, sf_dir).select(*_id(), key.alias("key"))
    left = each.where("source_name = 'source1'").select(F.col("entity_id").alias("source1_entity_id"), "key")
    right = each.where("source_name <> 'source1'").select(F.col("entity_id").alias("matched_entity_id"), "key")
    return left.join(right, "key").select("source1_entity_id", "matched_entity_id")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source1_entity_id, matched_entity_ids (sorted array) of every record of source 1."""
    ids = entities(spark, sf_dir).where("source_name = 'source1'").select(F.col("entity_id").alias("source1_entity_id"))
    lists = truth_links(spark, sf_dir).groupBy("source1_entity_id").agg(F.array_sort(F.collect_set("matched_entity_id")).alias("matched_entity_ids"))
    return ids.join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("matched_entity_ids", F.array().cast("array<string>")).alias("matched_entity_ids"))
