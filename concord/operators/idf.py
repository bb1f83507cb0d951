"""Document frequencies, inverse document frequencies and weights of hashed n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.grams import features
from concord.schema import BlockingConfig

FIELDS = ("name", "address")


def term_counts(records: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """entity_id, field (0 name, 1 address), feature, tf: counts of the features in each record (``keyed_records``)."""
    each = [F.struct(F.lit(i).alias("field"), features(F.col(f), config.n_features, config.ngrams).alias("ids")) for i, f in enumerate(FIELDS)]
    rows = records.select("entity_id", F.explode(F.array(*each)).alias("x")).select("entity_id", "x.field", F.explode("x.ids").alias("feature"))
    return rows.groupBy("entity_id", "field", "feature").agg(F.count(F.lit(1)).alias("tf"))


def distinct_terms(records: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """entity_id, source_name, country, field, feature: each feature of a record once, found row by row."""
    each = [F.struct(F.lit(i).alias("field"), F.array_distinct(features(F.col(f), config.n_features, config.ngrams)).alias("ids")) for i, f in enumerate(FIELDS)]
    return records.select("entity_id", "source_name", "country", F.explode(F.array(*each)).alias("x")).select("entity_id", "source_name", "country", "x.field", F.explode("x.ids").alias("feature"))


def document_frequency(records: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """field, feature, df: in how many records a feature stands."""
    return distinct_terms(records, config).groupBy("field", "feature").agg(F.count(F.lit(1)).alias("df"))


def smoothed_idf(frequencies: DataFrame, n_records: int) -> DataFrame:
    """``frequencies`` with idf = ln((1 + N) / (1 + df)) + 1; a feature that isn't there has that of df 0."""
    return frequencies.withColumn("idf", F.log((1 + F.lit(n_records)) / (1 + F.col("df"))) + 1)


def with_frequencies(terms: DataFrame, frequencies: DataFrame, how: str = "inner") -> DataFrame:
    # at most 2 * n_features rows of 16 bytes: the hash space bounds the table
    return terms.join(F.broadcast(frequencies), ["field", "feature"], how)


def top_features(records: DataFrame, frequencies: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """entity_id, field, feature, df, feature_rank: the rarest features of each record and field, ties by feature.

    Rarest first is greatest weight first, as term frequencies are binary here.
    """
    order = Window.partitionBy("entity_id", "field").orderBy("df", "feature")
    ranked = with_frequencies(distinct_terms(records, config).drop("country", "source_name"), frequencies).withColumn("feature_rank", F.row_number().over(order))
    most = max(config.max_name_features, config.max_address_features)
    own = F.when(F.col("field") == 0, config.max_name_features).otherwise(config.max_address_features)
    return ranked.where(F.col("feature_rank") <= most).where(F.col("feature_rank") <= own)


def unit_weights(records: DataFrame, idf: DataFrame, n_records: int, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """entity_id, field, feature, w: tf * idf over the length of the record's vector; ``n_records`` is what idf was fitted on."""
    unseen = F.log(1 + F.lit(n_records)) + 1
    # records are dealt by id before their n-grams are made, so all below, and a join by id after it, stays in place
    terms = term_counts(records.repartition("entity_id"), config)
    weighed = with_frequencies(terms, idf.select("field", "feature", "idf"), "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("entity_id", "field")))
    return weighed.select("entity_id", "field", "feature", (F.col("w") / norm).alias("w"))
