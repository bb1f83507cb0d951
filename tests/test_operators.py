"""Blocking, labels, tuning, results and validation on small tables."""

import pytest
from pyspark.sql import functions as F

from concord.operators import blocking, labels, matcher, results, tuning, validate
from concord.operators.features import cosines, lookup_pairs, misplaced_pairs, pair_features
from concord.operators.idf import document_frequency, smoothed_idf, unit_weights
from concord.operators.records import check_ids, id_violations, keyed_records, normalize_records, parse_ids, union_sources
from concord.schema import PAIR_FEATURES, PAIR_IDS, BlockingConfig

RECORD = "entity_id string, source_name string, business_name string, business_address string, country string"


def records(spark, *rows):
    return keyed_records(spark.createDataFrame(list(rows), RECORD))


def firms(spark):
    return records(
        spark,
        ("S1-1", "source1", "Acme Tools Ltd", "12 Main St", "US"),
        ("S1-2", "source1", "Zebra Foods", "9 Oak Ave", "US"),
        ("S1-3", "source1", None, None, "US"),
        ("S2-1", "source2", "ACME Tools Limited", "12 Main Street", "US"),
        ("S2-2", "source2", "Acme Tools Ltd", "77 Elm Rd", "FR"),
        ("S3-1", "source3", "Acme Toolz Ltd", "12 Main St", "us"),
        ("S3-2", "source3", "", "", "US"),
    )


def test_candidates_stay_in_their_country(spark):
    found = {(r.source1_entity_id, r.candidate_entity_id): r for r in blocking.generate_candidates(firms(spark)).collect()}
    assert ("S1-1", "S2-2") not in found
    exact = found["S1-1", "S2-1"]
    assert exact.exact_hits == 2 and exact.lsh_votes == 16 and exact.candidate_rank == 1
    assert found["S1-1", "S3-1"].candidate_rank == 2
    assert not any("S1-3" in k or "S3-2" in k for k in found)


def test_every_record_has_a_list(spark):
    r = firms(spark)
    lists = {x.source1_entity_id: x.candidate_entity_ids for x in blocking.candidate_lists(r, blocking.generate_candidates(r)).collect()}
    assert set(lists) == {"S1-1", "S1-2", "S1-3"} and lists["S1-3"] == []


def test_ranking_ties_and_cap(spark):
    votes = spark.createDataFrame([("a", "x", 0, 9), ("a", "z", 1, 0), ("a", "y", 0, 9), ("a", "w", 0, 10)], "source1_entity_id string, candidate_entity_id string, exact_hits long, lsh_votes long")
    order = lambda limit: [r.candidate_entity_id for r in blocking.ranked_candidates(votes, limit).orderBy("candidate_rank").collect()]
    assert order(None) == ["z", "w", "x", "y"] and order(2) == ["z", "w"]


def test_cosine_of_equal_and_empty(spark):
    r = firms(spark)
    idf = smoothed_idf(document_frequency(r), r.count())
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-3", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    rows = {x.source1_entity_id: x for x in cosines(pairs, unit_weights(r, idf, r.count())).collect()}
    assert rows["S1-1"].name_tfidf_cosine_similarity == pytest.approx(1) and rows["S1-3"].name_tfidf_cosine_similarity == 0


def test_unseen_features_weigh_as_never_met(spark):
    r = firms(spark)
    weights = unit_weights(r, smoothed_idf(document_frequency(r), 7).where("df > 100"), 7)
    norms = weights.groupBy("entity_id", "field").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert norms and all(x.n == pytest.approx(1) for x in norms)


def test_feature_columns(spark):
    r = firms(spark)
    pairs = blocking.generate_candidates(r)
    frame = pair_features(pairs, r)
    assert frame.columns == [*PAIR_IDS, *PAIR_FEATURES]
    row = frame.where("source1_entity_id = 'S1-1' AND candidate_entity_id = 'S2-1'").first()
    assert row.name_exact_match == row.address_exact_match == row.country_exact_match == 1 and row.candidate_source == "source2"


def test_misplaced_pairs(spark):
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S2-1", "S1-1"), ("S1-1", "nobody")], "source1_entity_id string, candidate_entity_id string")
    assert misplaced_pairs(lookup_pairs(pairs, firms(spark))).count() == 2


@pytest.mark.parametrize("bad", [dict(num_perm=30), dict(ngrams=(3, 2)), dict(max_candidates=0), dict(n_features=0)])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        BlockingConfig(**bad)


def test_ids(spark):
    frame = spark.createDataFrame([("a",), ("a",), (" ",), ("b,c",), (None,), ("ok",)], "entity_id string")
    assert sorted((r.entity_id, r.rule) for r in id_violations(frame).where("entity_id IS NOT NULL").collect()) == [(" ", "malformed"), ("a", "repeated"), ("b,c", "malformed")]
    with pytest.raises(ValueError):
        check_ids(frame)
    assert check_ids(frame.where("entity_id = 'ok'")).count() == 1
    assert spark.range(1).select(parse_ids(F.lit("b,,a,b"))).first()[0] == ["b", "a"]


def test_normalize_keeps_columns(spark):
    frame = spark.createDataFrame([("1", "A Co", "1 St", "X", 5)], "entity_id string, business_name string, business_address string, country string, extra int")
    row = normalize_records(frame).first()
    assert (row.business_name, row.extra, row.business_name_normalized, row.business_address_normalized) == ("A Co", 5, "a company", "1 street")
    with pytest.raises(ValueError):
        normalize_records(frame.drop("country"))
    assert union_sources({"source1": frame, "source2": frame.drop("extra")}).count() == 2


@pytest.mark.parametrize("hits, predicted, truth, want", [(0, 0, 0, 1.0), (0, 1, 0, 0.0), (0, 0, 2, 0.0), (1, 1, 1, 1.0), (1, 2, 1, 1.25 / 2.25)])
def test_f05(spark, hits, predicted, truth, want):
    assert spark.range(1).select(tuning.f05(F.lit(hits), F.lit(predicted), F.lit(truth))).first()[0] == pytest.approx(want)


def test_sweep_is_the_mean_over_entities(spark):
    scored = spark.createDataFrame([("a", 0.9, 1), ("a", 0.5, 0), ("b", 0.5, 0), ("b", 0.2, 1)], "source1_entity_id string, probability double, label int")
    truth = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0)], "source1_entity_id string, truth_count int")
    grid = [0.0, 0.2, 0.5, 0.7, 1.0]
    got = {r.threshold: r.macro_f05 for r in tuning.threshold_sweep(scored, truth, grid).collect()}
    for t in grid:
        assert got[t] == pytest.approx(tuning.entity_scores(scored, truth, t).agg(F.avg("f05")).first()[0])
    # both entities with a link have it at 0.2; the greatest of equal thresholds wins
    assert tuning.tuned_threshold(scored, truth) == (0.2, pytest.approx((1 + 2 * 1.25 / 2.25) / 3))


def test_labels_and_recall(spark):
    truth = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "source1_entity_id string, matched_entity_ids array<string>")
    pairs = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "x"), ("c", "x")], "source1_entity_id string, candidate_entity_id string")
    labeled = labels.label_pairs(pairs, truth)
    assert {(r.source1_entity_id, r.candidate_entity_id): r.label for r in labeled.collect()} == {("a", "x"): 1, ("a", "z"): 0, ("b", "x"): 0, ("c", "x"): 0}
    assert labels.candidate_recall(labeled, truth).first().candidate_recall == 0.5
    with pytest.raises(ValueError):
        labels.check_truth(labeled)
    with pytest.raises(ValueError):
        labels.is_validation(F.lit("a"), 0.5)


def test_sample_is_bounded_and_repeatable(spark):
    frame = spark.range(100).select(F.col("id").cast("string").alias("source1_entity_id"), F.lit("x").alias("candidate_entity_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit(False).alias("is_validation"))
    take = lambda f: sorted(r.source1_entity_id for r in labels.stratified_sample(f, 7).collect())
    assert len(take(frame)) == 14 and take(frame) == take(frame.repartition(3).orderBy(F.rand()))


def test_selection(spark):
    scored = spark.createDataFrame([("s1", "x", 0.9), ("s1", "y", 0.5), ("s1", "x", 0.7), ("s1", "z", 0.4)], "source1_entity_id string, candidate_entity_id string, probability double")
    ids = spark.createDataFrame([("s1",), ("s2",)], "source1_entity_id string")
    got = lambda *a: {r[0]: r[1] for r in results.select_matches(ids, scored, *a).collect()}
    assert got(0.5) == {"s1": ["x", "y"], "s2": []} and got(0.5, 1) == {"s1": ["x"], "s2": []}
    with pytest.raises(ValueError):
        results.passing_links(scored, 1.5)


def test_each_rule_is_reported(spark):
    r = spark.createDataFrame([("S1-1", "source1"), ("S1-2", "source1"), ("S1-3", "source1"), ("S2-1", "source2"), ("S3-1", "source3")], "entity_id string, source_name string")
    lists = spark.createDataFrame(
        [("S1-1", ["S2-1", "S2-1", " S3-1"]), ("S1-1", []), ("S1-2", ["S1-1"]), ("S1-9", ["S2-7"]), ("a,b", None)], "source1_entity_id string, matched_entity_ids array<string>"
    )
    candidates = spark.createDataFrame([("S1-1", ["S2-1"])], "source1_entity_id string, candidate_entity_ids array<string>")
    report = validate.validation_report(lists, r, candidates=candidates)
    rules = {x.rule for x in report.collect()}
    assert rules == {"bad_source1_id", "null_list", "repeated_source1_id", "coverage", "malformed_id", "repeated_id", "id_prefix", "unknown_target", "not_a_candidate"}
    with pytest.raises(ValueError):
        validate.raise_if_any(report)
    good = spark.createDataFrame([("S1-1", ["S2-1"]), ("S1-2", []), ("S1-3", ["S3-1"])], lists.schema)
    validate.raise_if_any(validate.validation_report(good, r))
    assert validate.field_count_violations(spark.createDataFrame([("a\tb",), ("a",), ("a\tb\tc",)], "value string")).count() == 2


def test_training_needs_both_labels(spark):
    with pytest.raises(ValueError):
        matcher.balanced(spark.createDataFrame([(1,), (1,)], "label int"))


def test_cosines_in_many_cells(spark, monkeypatch):
    from itertools import product

    from concord.operators import features

    monkeypatch.setattr(features, "BLOCK", 3)
    monkeypatch.setattr(features, "PAIRS", 4)
    monkeypatch.setattr(features, "RUN", 2)
    terms = {f"S{1 + i % 2}-{i}": {(i % 3, 0): 0.5 + i, (7, 0): 0.25, (5, 1): 1.0 + i} for i in range(14)}
    weights = spark.createDataFrame([(k, field, feature, w) for k, x in terms.items() for (feature, field), w in x.items()], "entity_id string, field int, feature int, w double")
    ids = [(a, b) for a, b in product(terms, terms) if a < b and a[:2] != b[:2]]
    ids += [ids[0], ids[0], ("S1-0", "S2-none"), ("S1-none", "S2-1")]  # a pair given again has its own row and the same cosines
    pairs = spark.createDataFrame(ids, "source1_entity_id string, candidate_entity_id string")
    of = lambda a, b, field: sum(w * terms.get(b, {}).get(k, 0.0) for k, w in terms.get(a, {}).items() if k[1] == field)
    got = cosines(pairs, weights)
    want = sorted((a, b, round(of(a, b, 0), 9), round(of(a, b, 1), 9)) for a, b in ids)
    assert sorted((a, b, round(x, 9), round(y, 9)) for a, b, x, y in got.collect()) == want
