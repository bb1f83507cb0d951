"""Candidate pairs: records meet in buckets of equal names, equal addresses and MinHash bands, inside countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.grams import minhash
from concord.operators.idf import distinct_terms, document_frequency, with_frequencies
from concord.schema import BlockingConfig


def signatures(records: DataFrame, frequencies: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """entity_id, source_name, country, signature over the rarest features of both fields, addresses' in a range of their own.

    Records are dealt by id before their n-grams are made, so these never move: they gather in their record's row, where
    the cut, the signature and the bands are found.
    """
    terms = with_frequencies(distinct_terms(records.repartition("entity_id"), config), frequencies)
    sorted_ = F.array_sort(F.collect_list(F.struct("field", "df", "feature")))
    gathered = terms.groupBy("entity_id", "source_name", "country").agg(sorted_.alias("terms"))

    def rarest(field: int, limit: int) -> Column:
        own = F.filter("terms", lambda t: t["field"] == field)
        return F.transform(F.slice(own, 1, limit), lambda t: t["feature"] + field * config.n_features)

    ids = F.concat(rarest(0, config.max_name_features), rarest(1, config.max_address_features))
    return gathered.select("entity_id", "source_name", "country", ids.alias("ids")).select("entity_id", "source_name", "country", minhash(F.col("ids"), config.num_perm).alias("signature"))


def lsh_buckets(signed: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """entity_id, source_name, bucket, exact_match (0) of each band."""
    rows = config.num_perm // config.bands
    band = F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), lambda b: F.concat_ws("/", F.lit("m"), F.col("country"), b.cast("string"), F.array_join(F.slice("signature", b * rows + 1, F.lit(rows)), "/")))
    return signed.select("entity_id", "source_name", F.explode(band).alias("bucket"), F.lit(0).alias("exact_match"))


def exact_buckets(records: DataFrame) -> DataFrame:
    """entity_id, source_name, bucket, exact_match (1) of names and addresses that aren't empty.

    Lengths stand before the country, so that no two keys are alike by chance.
    """
    key = lambda field: F.concat_ws("/", F.lit("e"), F.length("country").cast("string"), F.col("country"), F.lit(field), F.col(field))
    keys = F.array_compact(F.array(*(F.when(F.col(f) != "", key(f)) for f in ("name", "address"))))
    return records.select("entity_id", "source_name", F.explode(keys).alias("bucket"), F.lit(1).alias("exact_match"))


def record_buckets(records: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """entity_id, source_name, bucket, exact_match of all ``records`` (``keyed_records``, ids once each).

    Keys say their kind and band or field, so no record has a bucket twice.
    """
    signed = signatures(records, document_frequency(records, config), config)
    return lsh_buckets(signed, config).unionByName(exact_buckets(records))


def bucket_sizes(buckets: DataFrame) -> DataFrame:
    """bucket, n_source1, n_targets of buckets that join records: where skew would come from."""
    left = F.col("source_name") == "source1"
    sizes = buckets.groupBy("bucket").agg(F.count_if(left).alias("n_source1"), F.count_if(~left).alias("n_targets"))
    return sizes.where("n_source1 > 0 and n_targets > 0")


def collision_votes(buckets: DataFrame) -> DataFrame:
    """source1_entity_id, candidate_entity_id, exact_hits, lsh_votes of records that share a bucket.

    The equi-join leaves skewed buckets to adaptive splitting; hits add up before they are shuffled by pair.
    """
    left = buckets.where("source_name = 'source1'").select("bucket", F.col("entity_id").alias("source1_entity_id"), "exact_match")
    right = buckets.where("source_name <> 'source1'").select("bucket", F.col("entity_id").alias("candidate_entity_id"))
    exact = F.sum("exact_match")
    return left.join(right, "bucket").groupBy("source1_entity_id", "candidate_entity_id").agg(exact.alias("exact_hits"), (F.count(F.lit(1)) - exact).alias("lsh_votes"))


def ranked_candidates(votes: DataFrame, limit: int | None = 500) -> DataFrame:
    """``votes`` with candidate_rank: by exact hits, then votes, then id; at most ``limit`` for a record, all if None."""
    order = Window.partitionBy("source1_entity_id").orderBy(F.desc("exact_hits"), F.desc("lsh_votes"), "candidate_entity_id")
    ranked = votes.withColumn("candidate_rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("candidate_rank") <= limit)


def ordered_ids(rank: Column, id: Column) -> Column:
    """Aggregate: ids as an array in order of rank, then id."""
    return F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), id.alias("id")))), lambda x: x["id"])


def candidate_lists(records: DataFrame, ranked: DataFrame) -> DataFrame:
    """source1_entity_id, candidate_entity_ids (array, by rank) of every record of source 1, empty if it has none."""
    ids = records.where("source_name = 'source1'").select(F.col("entity_id").alias("source1_entity_id"))
    lists = ranked.groupBy("source1_entity_id").agg(ordered_ids(F.col("candidate_rank"), F.col("candidate_entity_id")).alias("ids"))
    return ids.join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("ids", F.array().cast("array<string>")).alias("candidate_entity_ids"))


def generate_candidates(records: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """Ranked pairs (source1_entity_id, candidate_entity_id, exact_hits, lsh_votes, candidate_rank) of ``keyed_records``."""
    return ranked_candidates(collision_votes(record_buckets(records, config)), config.max_candidates)
