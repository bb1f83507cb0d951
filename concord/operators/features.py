"""Features of candidate pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import similarity as S
from concord.functions.normalize import country_key
from concord.operators.idf import FIELDS, document_frequency, smoothed_idf, unit_weights
from concord.schema import PAIR_FEATURES, PAIR_IDS, BlockingConfig

BLOCK, PAIRS = 1 << 13, 1 << 20  # records of one side, and pairs, of a cell in which cosines are found
RUN = 1 << 12  # pairs whose products are held at once


def lookup_pairs(pairs: DataFrame, records: DataFrame, *keep: str) -> DataFrame:
    """``pairs`` (source1_entity_id, candidate_entity_id, and what to ``keep``) with name_left, name_right, ... of both records (``keyed_records``)."""
    fields = ("name", "address", "country")
    left = records.select(F.col("entity_id").alias("source1_entity_id"), F.col("source_name").alias("source_left"), *(F.col(f).alias(f"{f}_left") for f in fields))
    right = records.select(F.col("entity_id").alias("candidate_entity_id"), F.col("source_name").alias("candidate_source"), *(F.col(f).alias(f"{f}_right") for f in fields))
    return pairs.select("source1_entity_id", "candidate_entity_id", *keep).join(left, "source1_entity_id", "left").join(right, "candidate_entity_id", "left")


def misplaced_pairs(looked_up: DataFrame) -> DataFrame:
    """Pairs whose left record isn't in source 1 or whose right one isn't in source 2 or 3."""
    fine = F.coalesce((F.col("source_left") == "source1") & F.col("candidate_source").isin("source2", "source3"), F.lit(False))
    return looked_up.where(~fine).select("source1_entity_id", "candidate_entity_id", "source_left", "candidate_source")


def _sides(field: str) -> tuple[Column, Column]:
    return F.col(f"{field}_left"), F.col(f"{field}_right")


def exact_features() -> dict[str, Column]:
    return {f"{f}_exact_match": S.exact(*_sides(f)) for f in FIELDS}


def token_features() -> dict[str, Column]:
    out = {}
    for f in FIELDS:
        a, b = map(S.token_set, _sides(f))
        out |= {
            f"{f}_jaccard_similarity": S.jaccard(a, b),
            f"{f}_exact_token_match": (S.overlap(a, b) > 0).cast("int"),
            f"{f}_token_overlap_count": S.overlap(a, b),
            f"{f}_token_containment": S.containment(a, b),
            f"{f}_token_count_source1": F.size(a),
            f"{f}_token_count_candidate": F.size(b),
        }
    return out


def edit_features() -> dict[str, Column]:
    out = {}
    for f in FIELDS:
        a, b = _sides(f)
        out |= {f"{f}_levenshtein_distance": F.levenshtein(a, b), f"{f}_levenshtein_similarity": S.edit_similarity(a, b), f"{f}_character_length_ratio": S.length_ratio(a, b)}
    return out


def number_features() -> dict[str, Column]:
    a, b = map(S.numbers, _sides("address"))
    return {"address_exact_numeric_token_match": S.shares_number(a, b), "address_exact_postal_code_match": S.shares_number(a, b, 3, 10), "address_first_number_match": S.same_first(a, b)}


def country_features() -> dict[str, Column]:
    return {"country_exact_match": S.exact(*map(country_key, _sides("country")))}


def scalar_features(looked_up: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    """The pair's ids and the features of ``groups``; all but the cosines if none is given."""
    groups = groups or (exact_features(), token_features(), edit_features(), number_features(), country_features())
    return looked_up.select(*PAIR_IDS, *(c.alias(k) for g in groups for k, c in g.items()))


def _cell_products(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
    """Both cosines of each pair of a cell, whose records' vectors are all there is to look them up in; a record without one has 0."""
    m, ids = pairs.num_rows, pairs.column(0).combine_chunks()
    out = np.zeros((m, len(FIELDS)))
    if vectors.num_rows:
        known = vectors.column("entity_id").combine_chunks()
        place = lambda x: pc.fill_null(pc.index_in(x, value_set=known, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        left, right = place(ids), place(pairs.column(1).combine_chunks())
        terms = vectors.column("terms").combine_chunks()
        first = terms.offsets.to_numpy()
        fields, weight = terms.values.field("field").to_numpy(), terms.values.field("w").to_numpy()
        code = np.unique(terms.values.field("feature").to_numpy().astype(np.int64) * len(FIELDS) + fields, return_inverse=True)[1]
        own = np.zeros(int(code.max()) + 1 if len(code) else 0)  # the left record's weights by term
        order = np.argsort(left, kind="stable")
        order = order[(left[order] >= 0) & (right[order] >= 0)]
        starts = np.flatnonzero(np.diff(left[order], prepend=-1))
        for at, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            mine = slice(first[left[order[at]]], first[left[order[at]] + 1])
            own[code[mine]] = weight[mine]
            for some in (order[i : min(i + RUN, stop)] for i in range(at, stop, RUN)):
                begin = first[right[some]]
                sizes = first[right[some] + 1] - begin
                row = np.repeat(np.arange(len(some)), sizes)
                each = np.arange(len(row)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
                sums = np.bincount(row * len(FIELDS) + fields[each], own[code[each]] * weight[each], len(some) * len(FIELDS))
                out[some] = sums.reshape(-1, len(FIELDS))
            own[code[mine]] = 0.0
    return pa.table({"source1_entity_id": ids, "candidate_entity_id": pairs.column(1).combine_chunks(), **{f"{f}_tfidf_cosine_similarity": out[:, i] for i, f in enumerate(FIELDS)}})


def cosines(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """source1_entity_id, candidate_entity_id, name_tfidf_cosine_similarity and that of addresses; 0 where a side is empty.

    One row for each of ``pairs``, which are read three times. Records of either side are dealt over blocks of about BLOCK,
    and the pairs of two blocks meet in a cell, to which a record's vector goes once, whatever number of pairs it has
    there; terms of pairs never move. A cell has about PAIRS pairs at most.
    """
    keys = ["source1_entity_id", "candidate_entity_id"]
    n, lefts, rights = pairs.agg(F.count(F.lit(1)), *(F.approx_count_distinct(k) for k in keys)).first()
    across = max(1, -(-rights // BLOCK))
    down = max(1, -(-lefts // BLOCK), -(-n // (PAIRS * across)))
    block = lambda k, count: F.pmod(F.xxhash64(k), F.lit(count))
    dealt = pairs.select(*keys, (block(keys[0], down) * across + block(keys[1], across)).alias("cell"))
    members = dealt.select(F.col("cell").alias("member_of"), F.explode(F.array(*keys)).alias("entity_id")).distinct()
    vectors = weights.groupBy("entity_id").agg(F.collect_list(F.struct("field", "feature", "w")).alias("terms"))
    met = members.join(vectors, "entity_id").select("member_of", "entity_id", "terms")
    types = dict(pairs.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{f}_tfidf_cosine_similarity double" for f in FIELDS)])
    return dealt.groupBy("cell").cogroup(met.groupBy("member_of")).applyInArrow(_cell_products, schema)


def pair_features(pairs: DataFrame, records: DataFrame, idf: DataFrame | None = None, n_records: int | None = None, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """All 29 columns, in their fixed order, of ``pairs``.

    ``idf`` (with the ``n_records`` it was fitted on) is fitted on ``records`` if it isn't given. ``pairs`` is read several
    times, so it should be a stored table.
    """
    if idf is None:
        n_records = records.count()
        idf = smoothed_idf(document_frequency(records, config), n_records)
    paired = pairs.select(F.col("source1_entity_id").alias("entity_id")).union(pairs.select("candidate_entity_id")).distinct()
    cosine = cosines(pairs, unit_weights(records.join(paired, "entity_id", "left_semi"), idf, n_records, config))
    # cosines, one row for each pair, go along into the look-up: 26 features are never dealt
    names = cosine.columns[2:]
    groups = (exact_features(), token_features(), edit_features(), number_features(), country_features(), {c: F.col(c) for c in names})
    return scalar_features(lookup_pairs(cosine, records, *names), *groups).select(*PAIR_IDS, *PAIR_FEATURES)
