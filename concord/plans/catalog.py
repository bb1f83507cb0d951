"""The engine's operators as queries over the driver's tables (``concord.sources.fixtures``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.grams import char_grams, features
from concord.operators import blocking, idf, labels, matcher, results, tuning, validate
from concord.operators import features as pairwise
from concord.operators.records import exploded_candidates, format_ids, id_violations, keyed_records, normalize_records, parse_ids, source_counts, union_sources
from concord.operators.store import cut
from concord.plans.linkage import train
from concord.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
LIMIT = 5  # a cap small enough to cut lists of the test data
THRESHOLD = 0.3


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_records(fixtures.entities(spark, sf_dir))


def source_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = fixtures.entities(spark, sf_dir)
    return source_counts(union_sources({s: each.where(F.col("source_name") == s).drop("source_name") for s in ("source1", "source2", "source3")}))


def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_records(fixtures.entities(spark, sf_dir)).select("entity_id", "business_name_normalized")


def normalized_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_records(fixtures.entities(spark, sf_dir)).select("entity_id", "business_address_normalized")


def country_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy("country").agg(F.count(F.lit(1)).alias("n_records"))


def id_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as ids: many are blank, hold commas or repeat."""
    return id_violations(fixtures.entities(spark, sf_dir).select(F.col("business_name").alias("entity_id")))


def id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as comma lists, parsed and written again."""
    text = F.translate("business_address", "/.?=", ",,,,")
    return fixtures.entities(spark, sf_dir).select("entity_id", format_ids(parse_ids(text)).alias("ids"), F.size(parse_ids(text)).alias("n_ids"))


def character_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _records(spark, sf_dir).select(F.explode(char_grams(F.col("name"))).alias("gram"))
    return each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def hashed_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idf.term_counts(_records(spark, sf_dir))


def binary_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _records(spark, sf_dir).select("entity_id", F.size(F.array_distinct(features(F.col("name")))).alias("name_features"), F.size(F.array_distinct(features(F.col("address")))).alias("address_features"))
    return each


def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idf.document_frequency(_records(spark, sf_dir))


def inverse_document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return idf.smoothed_idf(idf.document_frequency(records), records.count()).select("field", "feature", "df", F.round("idf", 6).alias("idf"))


def top_tfidf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return idf.top_features(records, idf.document_frequency(records)).select("entity_id", "field", "feature", "df", "feature_rank")


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return blocking.signatures(records, idf.document_frequency(records))


def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("entity_id", F.array_join("signature", ",").alias("signature"))


def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.lsh_buckets(_signed(spark, sf_dir)).drop("source_name")


def exact_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.exact_buckets(_records(spark, sf_dir)).drop("source_name")


def bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.bucket_sizes(blocking.record_buckets(_records(spark, sf_dir)))


def collision_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.collision_votes(blocking.record_buckets(_records(spark, sf_dir)))


def _pairs(records: DataFrame) -> DataFrame:
    """Candidate pairs, written once, as several steps read them."""
    return cut(blocking.generate_candidates(records))


def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.generate_candidates(_records(spark, sf_dir))


def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.ranked_candidates(collision_votes(spark, sf_dir), LIMIT)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return blocking.candidate_lists(records, blocking.generate_candidates(records))


def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("source1_entity_id", format_ids(F.col("candidate_entity_ids")).alias("candidate_entity_ids"))


def candidate_pairs_from_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded_candidates(_lists(spark, sf_dir))


def _looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return pairwise.lookup_pairs(_pairs(records), records)


def pair_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir).select("source1_entity_id", "candidate_entity_id", "candidate_source", "name_left", "name_right", "address_left", "address_right")


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes))


def _group(make: Callable[[], dict]) -> Query:
    return lambda spark, sf_dir: _rounded(pairwise.scalar_features(_looked_up(spark, sf_dir), make()))


def pair_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    n = records.count()
    weights = idf.unit_weights(records, idf.smoothed_idf(idf.document_frequency(records), n), n)
    return _rounded(pairwise.cosines(_pairs(records), weights))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return pairwise.pair_features(_pairs(records), records)


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_features(spark, sf_dir))


def ground_truth_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.truth_links(fixtures.ground_truth(spark, sf_dir))


def truth_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.truth_totals(fixtures.ground_truth(spark, sf_dir))


def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.truth_table(fixtures.ground_truth(spark, sf_dir))


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(_records(spark, sf_dir)).select("source1_entity_id", "candidate_entity_id")
    return labels.label_pairs(pairs, fixtures.ground_truth(spark, sf_dir))


def labeled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labeled(spark, sf_dir).select("source1_entity_id", "candidate_entity_id", "label", "is_validation")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_counts(_labeled(spark, sf_dir))


def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.candidate_recall(_labeled(spark, sf_dir), fixtures.ground_truth(spark, sf_dir)))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 20 training pairs of each label."""
    return labels.stratified_sample(_labeled(spark, sf_dir), 20).select("source1_entity_id", "candidate_entity_id", "label")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a score that SQL can follow: the mean of both fields' Jaccard similarities."""
    mean = (F.col("name_jaccard_similarity") + F.col("address_jaccard_similarity")) / 2
    scalars = pairwise.scalar_features(_looked_up(spark, sf_dir), pairwise.token_features())
    scored = scalars.select("source1_entity_id", "candidate_entity_id", F.round(mean, 9).alias("probability"))
    return cut(labels.label_pairs(scored, fixtures.ground_truth(spark, sf_dir)))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.truth_table(fixtures.ground_truth(spark, sf_dir))


def entity_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tuning.entity_scores(_scored(spark, sf_dir), _truth(spark, sf_dir), THRESHOLD))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tuning.threshold_sweep(_scored(spark, sf_dir), _truth(spark, sf_dir), [round(i * 0.05, 4) for i in range(21)]))


def tuned_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = cut(_truth(spark, sf_dir).where("is_validation"))
    threshold, best = tuning.tuned_threshold(_scored(spark, sf_dir).where("is_validation"), held)
    return spark.range(1).select(F.lit(threshold).alias("threshold"), F.round(F.lit(best), 6).alias("macro_f05"))


def dedup_max_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair twice, once at half its score: the greater one counts."""
    scored = _scored(spark, sf_dir).select("source1_entity_id", "candidate_entity_id", "probability")
    return results.passing_links(scored.unionByName(scored.withColumn("probability", F.col("probability") / 2)), THRESHOLD)


def matches(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    ids = fixtures.ground_truth(spark, sf_dir).select("source1_entity_id")
    return results.select_matches(ids, _scored(spark, sf_dir), THRESHOLD, limit)


def _as_text(lists: DataFrame) -> DataFrame:
    return lists.select("source1_entity_id", format_ids(F.col("matched_entity_ids")).alias("matched_entity_ids"))


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(matches(spark, sf_dir))


def capped_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(matches(spark, sf_dir, 2))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth lists that break rules: some rows are missing, strange, repeated or hold unknown and padded ids."""
    truth = fixtures.ground_truth(spark, sf_dir)
    n = F.substring_index("source1_entity_id", "-", -1).cast("long")
    odd = F.when(n % 7 == 0, F.array_append("matched_entity_ids", F.lit("S2-none"))).when(n % 11 == 0, F.array_append("matched_entity_ids", F.lit("X 1 "))).when(n % 13 == 0, F.concat("matched_entity_ids", "matched_entity_ids")).otherwise(F.col("matched_entity_ids"))
    lists = truth.where(n % 5 != 0).select("source1_entity_id", odd.alias("matched_entity_ids"))
    twice = truth.where(n % 17 == 0)
    strange = truth.where(n % 19 == 0).select(F.concat(F.lit("S1-x"), "source1_entity_id").alias("source1_entity_id"), "matched_entity_ids")
    return lists.unionByName(twice).unionByName(strange)


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.coverage_gaps(_broken(spark, sf_dir), fixtures.entities(spark, sf_dir))


def unknown_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.unknown_targets(_broken(spark, sf_dir), fixtures.entities(spark, sf_dir))


def matches_not_in_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.matches_not_in_candidates(_broken(spark, sf_dir), _lists(spark, sf_dir))


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validation_report(_broken(spark, sf_dir), fixtures.entities(spark, sf_dir))


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out pairs with the probability that boosted trees (20 rounds here) give them."""
    features = cut(_features(spark, sf_dir))
    truth = fixtures.ground_truth(spark, sf_dir)
    model, _ = train(features, truth, max_iter=20)
    held = labels.label_pairs(features, truth).where("is_validation")
    return matcher.score(model, held).select("source1_entity_id", "candidate_entity_id", "label", F.round("probability", 6).alias("probability"))


QUERIES: dict[str, Query] = {
    "source_union_counts": source_union_counts,
    "normalized_names": normalized_names,
    "normalized_addresses": normalized_addresses,
    "country_keys": country_keys,
    "id_rules": id_rules,
    "id_lists": id_lists,
    "character_ngrams": character_ngrams,
    "hashed_term_counts": hashed_term_counts,
    "binary_term_counts": binary_term_counts,
    "document_frequencies": document_frequencies,
    "inverse_document_frequencies": inverse_document_frequencies,
    "top_tfidf_features": top_tfidf_features,
    "minhash_signatures": minhash_signatures,
    "lsh_buckets": lsh_buckets,
    "exact_buckets": exact_buckets,
    "bucket_sizes": bucket_sizes,
    "collision_votes": collision_votes,
    "ranked_candidates": ranked_candidates,
    "capped_candidates": capped_candidates,
    "candidate_lists": candidate_lists,
    "candidate_pairs_from_lists": candidate_pairs_from_lists,
    "pair_lookup": pair_lookup,
    "pair_exact_features": _group(pairwise.exact_features),
    "pair_token_features": _group(pairwise.token_features),
    "pair_edit_features": _group(pairwise.edit_features),
    "pair_number_features": _group(pairwise.number_features),
    "pair_country_features": _group(pairwise.country_features),
    "pair_cosines": pair_cosines,
    "pair_features": pair_features,
    "ground_truth_links": ground_truth_links,
    "truth_totals": truth_totals,
    "validation_split": validation_split,
    "labeled_pairs": labeled_pairs,
    "label_counts": label_counts,
    "candidate_recall": candidate_recall,
    "stratified_sample": stratified_sample,
    "entity_f05": entity_f05,
    "threshold_sweep": threshold_sweep,
    "tuned_threshold": tuned_threshold,
    "dedup_max_links": dedup_max_links,
    "submission": submission,
    "capped_matches": capped_matches,
    "coverage_gaps": coverage_gaps,
    "unknown_targets": unknown_targets,
    "matches_not_in_candidates": matches_not_in_candidates,
    "validation_report": validation_report,
    "gbt_scores": gbt_scores,
}
