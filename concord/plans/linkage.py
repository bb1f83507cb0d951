"""The linkage pipeline's three entry points: candidates, training and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import blocking, labels, matcher, results, tuning, validate
from concord.operators.features import lookup_pairs, misplaced_pairs, pair_features
from concord.operators.idf import document_frequency, smoothed_idf
from concord.operators.records import check_ids, exploded_candidates, keyed_records
from concord.operators.store import cut, scratch
from concord.schema import CANDIDATE_COLUMNS, MATCH_COLUMNS, BlockingConfig
from concord.sources import tsv


def generate_candidates(spark: SparkSession, root: str, output: str, split: str = "test", config: BlockingConfig = BlockingConfig()) -> str:
    """Write the ranked candidate list of every record of source 1 of a split to ``output``."""
    records = keyed_records(check_ids(tsv.load_split(spark, root, split, normalize=False)))
    lists = blocking.candidate_lists(records, blocking.generate_candidates(records, config))
    sources = [tsv.source_path(root, split, s) for s in ("source1", "source2", "source3")]
    tsv.write_lists(lists, output, sources, tsv.file_order(spark, sources[0]))
    return output


def fit_idf(spark: SparkSession, root: str, path: str, split: str = "train", config: BlockingConfig = BlockingConfig()) -> str:
    records = keyed_records(tsv.load_split(spark, root, split, normalize=False))
    n = records.count()
    tsv.save_idf(smoothed_idf(document_frequency(records, config), n), path, split, n, config)
    return path


def generate_features(
    spark: SparkSession, root: str, candidates: str, output: str, idf: str, split: str = "test", fit_split: str = "train", config: BlockingConfig = BlockingConfig()
) -> str:
    """Write the features of all candidate pairs to ``output``; the idf table is fitted on ``fit_split`` if it is missing."""
    records = keyed_records(check_ids(tsv.load_split(spark, root, split, normalize=False)))
    if tsv.is_stale(spark, f"{idf}/table", []):
        fit_idf(spark, root, idf, fit_split, config)
    table, n = tsv.load_idf(spark, idf, config)
    with scratch():
        # both are read several times
        pairs, stored = cut(exploded_candidates(tsv.read_lists(spark, candidates))), cut(records)
        misplaced = misplaced_pairs(lookup_pairs(pairs, stored))
        if found := misplaced.limit(3).collect():
            raise ValueError(f"candidates must be records of source 2 or 3, of records of source 1: {[tuple(r) for r in found]}")
        tsv.write_features(pair_features(pairs, stored, table, n, config), output, [candidates])
    return output


def train(features: DataFrame, truth: DataFrame, path: str | None = None, per_class: int = 250_000, fraction: float = 0.2, max_iter: int = 160, seed: int = 42) -> tuple:
    """(model, TrainingSummary): fitted on a sample of the training pairs, the threshold tuned on held-out entities."""
    if per_class < 1 or max_iter < 1 or seed < 0:
        raise ValueError("per_class and max_iter must be positive, seed not negative")
    labeled = labels.check_truth(labels.label_pairs(features, truth, fraction))
    sample = labels.stratified_sample(labeled, per_class, seed).cache()
    model = matcher.fit(sample, max_iter, seed)
    sample.unpersist()
    entities = labels.truth_table(truth, fraction).where("is_validation")
    scored = matcher.score(model, labeled.where("is_validation")).select("source1_entity_id", "probability", "label").cache()
    threshold, best = tuning.tuned_threshold(scored, entities)
    scored.unpersist()
    counts, totals = labels.label_counts(labeled).first(), labels.truth_totals(truth).first()
    recall = labels.candidate_recall(labeled, truth).first().candidate_recall
    summary = matcher.TrainingSummary(
        threshold, best, recall, counts.train_pairs, counts.train_positives, counts.validation_pairs, counts.validation_positives, totals.n_entities, totals.n_links
    )
    if path is not None:
        matcher.save(model, summary, path)
    return model, summary


def infer(spark: SparkSession, root: str, candidates: str, features: str, model: str, idf: str, output: str, limit: int | None = None, config: BlockingConfig = BlockingConfig(), fresh_candidates: bool = False, fresh_features: bool = False) -> str:
    """Write the validated match list of every record of source 1 of the test split to ``output``.

    Candidates and features are made where they are missing, features also where they are older than what they came from.
    """
    fitted, threshold = matcher.load(spark, model)
    sources = [tsv.source_path(root, "test", s) for s in ("source1", "source2", "source3")]
    tsv.guard_overwrite(output, [*sources, candidates, features])
    if fresh_candidates or tsv.is_stale(spark, candidates, []):
        generate_candidates(spark, root, candidates, "test", config)
    if fresh_features or fresh_candidates or tsv.is_stale(spark, features, [candidates, *sources, f"{idf}/table"]):
        generate_features(spark, root, candidates, features, idf, "test", "train", config)
    records = check_ids(tsv.load_split(spark, root, "test", normalize=False))
    scored = matcher.score(fitted, tsv.read_features(spark, features))
    ids = records.where("source_name = 'source1'").select(F.col("entity_id").alias("source1_entity_id"))
    matches = results.select_matches(ids, scored, threshold, limit).cache()
    report = validate.validation_report(matches, records, candidates=tsv.read_lists(spark, candidates))
    # prefixes of ids are a rule of the files' acceptance, not of the matches
    validate.raise_if_any(report.where("rule <> 'id_prefix'"))
    tsv.write_lists(matches, output, order=tsv.file_order(spark, sources[0]))
    matches.unpersist()
    return output


def accept(spark: SparkSession, root: str, candidates: str, matches: str) -> DataFrame:
    """Report of all violations of the two list files of the test split."""
    records = tsv.load_split(spark, root, "test", normalize=False)
    raw = lambda p: validate.field_count_violations(spark.read.text(p))
    head = lambda p, wanted: validate.header_violations(spark, tsv.header(spark, p), wanted)
    heads = head(candidates, CANDIDATE_COLUMNS).unionByName(head(matches, MATCH_COLUMNS))
    if heads.count():
        return heads
    lists = tsv.read_lists(spark, candidates)
    found = validate.validation_report(lists, records, "candidate_entity_ids").unionByName(raw(candidates)).unionByName(raw(matches))
    return found.unionByName(validate.validation_report(tsv.read_truth(spark, matches), records, candidates=lists))
