"""The queries of ``catalog`` in SQL, written apart from the DataFrame code, over the same tables."""

from __future__ import annotations

from concord.functions.normalize import ADDRESS_ALIASES, NAME_ALIASES
from concord.schema import PAIR_FEATURES

FEATURES = 1 << 20


def _aliased(folded: str, aliases: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in aliases.items())
    return f"array_to_string([CASE t WHEN '' THEN '' {cases} ELSE t END for t in string_split({folded}, ' ')], ' ')"


def _fold(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(strip_accents(lower(nfc_normalize({x}))), 'ß', 'ss'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


#: Views by name; each may use those before it.
VIEWS = {
    "ent": """SELECT concat('S', page_id % 3 + 1, '-', page_id) AS entity_id, concat('source', page_id % 3 + 1) AS source_name,
  regexp_extract(html, '<title>(.*?)</title>', 1) AS business_name, url AS business_address, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS country,
  regexp_extract(html, '<article>(.*)</article>', 1, 's') AS article FROM pages""",
    "rec": f"""SELECT entity_id, source_name, {_aliased("fn", NAME_ALIASES)} AS name, {_aliased("fa", ADDRESS_ALIASES)} AS address, country
  FROM (SELECT *, {_fold("business_name")} AS fn, {_fold("business_address")} AS fa FROM ent)""",
    "tok": """SELECT entity_id, country, field, w, unnest(range(2, least(5, length(w)) + 1)) AS n FROM (
    SELECT entity_id, country, 0 AS field, ' ' || unnest(string_split(name, ' ')) || ' ' AS w FROM rec WHERE name <> ''
    UNION ALL SELECT entity_id, country, 1, ' ' || unnest(string_split(address, ' ')) || ' ' FROM rec WHERE address <> '')""",
    "grams": "SELECT entity_id, country, field, w[i:i + n - 1] AS gram FROM (SELECT *, unnest(range(1, length(w) - n + 2)) AS i FROM tok)",
    "tf": f"""SELECT entity_id, country, field, CAST(CAST(concat('0x', md5(gram)[1:8]) AS BIGINT) % {FEATURES} AS INTEGER) AS feature, count(*) AS tf
  FROM grams GROUP BY entity_id, country, field, feature""",
    "freq": "SELECT field, feature, count(*) AS df FROM tf GROUP BY field, feature",
    "total": "SELECT count(*) AS n FROM rec",
    "top": """SELECT * FROM (SELECT entity_id, country, field, feature, df,
    row_number() OVER (PARTITION BY entity_id, field ORDER BY df, feature) AS feature_rank FROM tf JOIN freq USING (field, feature)) WHERE feature_rank <= 48""",
    "perm": "SELECT k, (1103515245 * (k + 1) + 12345) % 2147483646 + 1 AS a, (69069 * (k + 7) + 1) % 2147483647 AS b FROM (SELECT unnest(range(0, 32)) AS k)",
    "sig": f"SELECT entity_id, country, k, min((a * (field * {FEATURES} + feature) + b) % 2147483647) AS h FROM top CROSS JOIN perm GROUP BY entity_id, country, k",
    "lsh": "SELECT entity_id, concat_ws('/', 'm', country, k // 2, string_agg(CAST(h AS VARCHAR), '/' ORDER BY k)) AS bucket, 0 AS exact_match FROM sig GROUP BY entity_id, country, k // 2",
    "exa": """SELECT entity_id, concat_ws('/', 'e', length(country), country, 'name', name) AS bucket, 1 AS exact_match FROM rec WHERE name <> ''
  UNION ALL SELECT entity_id, concat_ws('/', 'e', length(country), country, 'address', address), 1 FROM rec WHERE address <> ''""",
    "buck": "SELECT entity_id, source_name, bucket, exact_match FROM (SELECT * FROM lsh UNION ALL SELECT * FROM exa) JOIN rec USING (entity_id)",
    "votes": """SELECT l.entity_id AS source1_entity_id, r.entity_id AS candidate_entity_id, CAST(sum(l.exact_match) AS BIGINT) AS exact_hits, CAST(sum(1 - l.exact_match) AS BIGINT) AS lsh_votes
  FROM buck l JOIN buck r USING (bucket) WHERE l.source_name = 'source1' AND r.source_name <> 'source1' GROUP BY l.entity_id, r.entity_id""",
    "ranked": """SELECT *, CAST(row_number() OVER (PARTITION BY source1_entity_id ORDER BY exact_hits DESC, lsh_votes DESC, candidate_entity_id) AS INTEGER) AS candidate_rank FROM votes""",
    "pairs": """SELECT p.source1_entity_id, p.candidate_entity_id, r.source_name AS candidate_source, l.name AS nl, r.name AS nr, l.address AS al, r.address AS ar, l.country AS cl, r.country AS cr
  FROM (SELECT * FROM ranked WHERE candidate_rank <= 500) p JOIN rec l ON l.entity_id = p.source1_entity_id JOIN rec r ON r.entity_id = p.candidate_entity_id""",
    "sets": """SELECT *, list_distinct([t for t in string_split(nl, ' ') if t <> '']) AS tnl, list_distinct([t for t in string_split(nr, ' ') if t <> '']) AS tnr,
    list_distinct([t for t in string_split(al, ' ') if t <> '']) AS tal, list_distinct([t for t in string_split(ar, ' ') if t <> '']) AS tar,
    regexp_extract_all(' ' || replace(al, ' ', '  ') || ' ', ' ([0-9]+) ', 1) AS dl, regexp_extract_all(' ' || replace(ar, ' ', '  ') || ' ', ' ([0-9]+) ', 1) AS dr FROM pairs""",
    "wts": """SELECT entity_id, field, feature, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN freq USING (field, feature) CROSS JOIN total""",
    "unit": "SELECT entity_id, field, feature, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id, field)) AS w FROM wts",
    "cos": """SELECT source1_entity_id, candidate_entity_id, coalesce(sum(a.w * b.w) FILTER (a.field = 0), 0) AS name_tfidf_cosine_similarity, coalesce(sum(a.w * b.w) FILTER (a.field = 1), 0) AS address_tfidf_cosine_similarity
  FROM pairs LEFT JOIN unit a ON a.entity_id = source1_entity_id LEFT JOIN unit b ON b.entity_id = candidate_entity_id AND b.field = a.field AND b.feature = a.feature GROUP BY ALL""",
    "links": """SELECT l.entity_id AS source1_entity_id, r.entity_id AS candidate_entity_id FROM ent l JOIN ent r ON l.article = r.article AND l.country = r.country
  WHERE l.source_name = 'source1' AND r.source_name <> 'source1'""",
    "truth": f"""SELECT e.entity_id AS source1_entity_id, CAST(count(candidate_entity_id) AS INTEGER) AS truth_count, list_sort(list(candidate_entity_id) FILTER (candidate_entity_id IS NOT NULL)) AS ids,
    CAST(concat('0x', md5('er-val-split' || e.entity_id)[1:8]) AS BIGINT) % 10000 < 2000 AS is_validation
  FROM ent e LEFT JOIN links ON links.source1_entity_id = e.entity_id WHERE e.source_name = 'source1' GROUP BY e.entity_id""",
    "labeled": """SELECT p.source1_entity_id, p.candidate_entity_id, CASE WHEN links.source1_entity_id IS NULL THEN 0 ELSE 1 END AS label, is_validation
  FROM pairs p JOIN truth USING (source1_entity_id) LEFT JOIN links ON links.source1_entity_id = p.source1_entity_id AND links.candidate_entity_id = p.candidate_entity_id""",
    "jac": """SELECT source1_entity_id, candidate_entity_id, round((CASE WHEN len(list_distinct(tnl || tnr)) > 0 THEN len(list_intersect(tnl, tnr)) / len(list_distinct(tnl || tnr)) ELSE 0 END
    + CASE WHEN len(list_distinct(tal || tar)) > 0 THEN len(list_intersect(tal, tar)) / len(list_distinct(tal || tar)) ELSE 0 END) / 2, 9) AS probability FROM sets""",
    "scored": "SELECT jac.*, label, is_validation FROM jac JOIN labeled USING (source1_entity_id, candidate_entity_id)",
    "linked": "SELECT source1_entity_id, candidate_entity_id, probability FROM scored WHERE probability >= 0.3",
    "broken": """SELECT source1_entity_id, CASE WHEN n % 7 = 0 THEN ids || ['S2-none'] WHEN n % 11 = 0 THEN ids || ['X 1 '] WHEN n % 13 = 0 THEN ids || ids ELSE ids END AS ids
  FROM (SELECT source1_entity_id, coalesce(ids, []) AS ids, CAST(split_part(source1_entity_id, '-', 2) AS BIGINT) AS n FROM truth) WHERE n % 5 <> 0
  UNION ALL SELECT source1_entity_id, coalesce(ids, []) FROM truth WHERE CAST(split_part(source1_entity_id, '-', 2) AS BIGINT) % 17 = 0
  UNION ALL SELECT 'S1-x' || source1_entity_id, coalesce(ids, []) FROM truth WHERE CAST(split_part(source1_entity_id, '-', 2) AS BIGINT) % 19 = 0""",
    "named": "SELECT source1_entity_id, unnest(ids) AS candidate_entity_id FROM broken",
    "gaps": """SELECT entity_id, 'missing' AS gap FROM ent WHERE source_name = 'source1' AND entity_id NOT IN (SELECT source1_entity_id FROM broken)
  UNION ALL SELECT DISTINCT source1_entity_id, 'unknown' FROM broken WHERE source1_entity_id NOT IN (SELECT entity_id FROM ent WHERE source_name = 'source1')""",
}


def _with(select: str) -> str:
    """``select`` after the views that it needs, directly or through others."""
    import re

    needed: set[str] = set()
    todo = [select]
    while todo:
        words = set(re.findall(r"[a-z]+", todo.pop()))
        for name in words & set(VIEWS) - needed:
            needed.add(name)
            todo.append(VIEWS[name])
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    return f"WITH {views}\n{select}" if views else select


def _share(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0 END, 6)"


def _expressions() -> dict[str, str]:
    out = {}
    for field, l, r, tl, tr in (("name", "nl", "nr", "tnl", "tnr"), ("address", "al", "ar", "tal", "tar")):
        both, longest = f"len(list_intersect({tl}, {tr}))", f"greatest(length({l}), length({r}))"
        out |= {
            f"{field}_exact_match": f"CAST({l} <> '' AND {l} = {r} AS INTEGER)",
            f"{field}_jaccard_similarity": _share(both, f"len(list_distinct({tl} || {tr}))"),
            f"{field}_levenshtein_distance": f"CAST(levenshtein({l}, {r}) AS INTEGER)",
            f"{field}_levenshtein_similarity": f"round(CASE WHEN {longest} > 0 THEN 1 - levenshtein({l}, {r}) / {longest} ELSE 0 END, 6)",
            f"{field}_tfidf_cosine_similarity": f"round({field}_tfidf_cosine_similarity, 6)",
            f"{field}_exact_token_match": f"CAST({both} > 0 AS INTEGER)",
            f"{field}_token_overlap_count": f"CAST({both} AS INTEGER)",
            f"{field}_token_containment": _share(both, f"least(len({tl}), len({tr}))"),
            f"{field}_token_count_source1": f"CAST(len({tl}) AS INTEGER)",
            f"{field}_token_count_candidate": f"CAST(len({tr}) AS INTEGER)",
            f"{field}_character_length_ratio": _share(f"least(length({l}), length({r}))", longest),
        }
    return out | {
        "address_exact_numeric_token_match": "CAST(len(list_intersect(dl, dr)) > 0 AS INTEGER)",
        "address_exact_postal_code_match": "CAST(len([x for x in list_intersect(dl, dr) if length(x) BETWEEN 3 AND 10]) > 0 AS INTEGER)",
        "address_first_number_match": "CAST(coalesce(dl[1] = dr[1], FALSE) AS INTEGER)",
        "country_exact_match": "CAST(cl <> '' AND cl = cr AS INTEGER)",
    }


def _pair_sql(*names: str) -> str:
    known = _expressions()
    return _with(f"SELECT source1_entity_id, candidate_entity_id, candidate_source, {', '.join(f'{known[n]} AS {n}' for n in names)} FROM sets")


def _pick(*parts: str) -> list[str]:
    return [f for f in PAIR_FEATURES if any(p in f for p in parts)]


_F05 = "CASE WHEN truth_count = 0 THEN CASE WHEN predicted = 0 THEN 1.0 ELSE 0.0 END WHEN predicted = 0 THEN 0.0 ELSE 1.25 * hits / (predicted + 0.25 * truth_count) END"


def _sweep(grid: str, only: str = "") -> str:
    return f"""SELECT threshold, avg({_F05}) AS macro_f05 FROM (
    SELECT threshold, t.source1_entity_id, truth_count, coalesce(sum(label) FILTER (probability >= threshold), 0) AS hits, count(*) FILTER (probability >= threshold) AS predicted
    FROM truth t CROSS JOIN {grid} LEFT JOIN scored s ON s.source1_entity_id = t.source1_entity_id {only} GROUP BY threshold, t.source1_entity_id, truth_count) GROUP BY threshold"""


def _matches(limit: str = "") -> str:
    return f"""SELECT t.source1_entity_id, coalesce(string_agg(candidate_entity_id, ',' ORDER BY at), '') AS matched_entity_ids FROM truth t LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY probability DESC, candidate_entity_id) AS at FROM linked) m
  ON m.source1_entity_id = t.source1_entity_id {limit} GROUP BY t.source1_entity_id""".replace(" at)", " place)").replace("AS at", "AS place")


_LISTS = """SELECT e.entity_id AS source1_entity_id, coalesce(string_agg(candidate_entity_id, ',' ORDER BY candidate_rank), '') AS candidate_entity_ids
FROM ent e LEFT JOIN (SELECT * FROM ranked WHERE candidate_rank <= 500) r ON r.source1_entity_id = e.entity_id WHERE e.source_name = 'source1' GROUP BY e.entity_id"""
_BAD = "trim(entity_id) = '' OR regexp_matches(entity_id, '[,\\t\\r\\n]')"

ORACLE_SQL: dict[str, str] = {
    "source_union_counts": _with("SELECT source_name, count(*) AS n_records FROM ent GROUP BY source_name"),
    "normalized_names": _with("SELECT entity_id, name AS business_name_normalized FROM rec"),
    "normalized_addresses": _with("SELECT entity_id, address AS business_address_normalized FROM rec"),
    "country_keys": _with("SELECT country, count(*) AS n_records FROM rec GROUP BY country"),
    "id_rules": _with(
        f"""SELECT entity_id, rule, n FROM (SELECT business_name AS entity_id, count(*) AS n FROM ent GROUP BY business_name), (VALUES ('malformed'), ('repeated')) AS r(rule)
WHERE (rule = 'malformed' AND ({_BAD})) OR (rule = 'repeated' AND n > 1)"""
    ),
    "id_lists": _with(
        """SELECT entity_id, string_agg(x, ',' ORDER BY i) FILTER (x <> '') AS ids, CAST(count(*) FILTER (x <> '') AS INTEGER) AS n_ids FROM (
  SELECT entity_id, x, min(i) AS i FROM (SELECT entity_id, parts[i] AS x, i FROM (SELECT entity_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT entity_id, string_split_regex(business_address, '[/.?=,]') AS parts FROM ent))) GROUP BY entity_id, x) GROUP BY entity_id"""
    ),
    "character_ngrams": _with("SELECT gram, count(*) AS n FROM grams WHERE field = 0 GROUP BY gram"),
    "hashed_term_counts": _with("SELECT entity_id, field, feature, tf FROM tf"),
    "binary_term_counts": _with(
        """SELECT entity_id, CAST(count(feature) FILTER (field = 0) AS INTEGER) AS name_features, CAST(count(feature) FILTER (field = 1) AS INTEGER) AS address_features
FROM rec LEFT JOIN tf USING (entity_id) GROUP BY entity_id"""
    ),
    "document_frequencies": _with("SELECT field, feature, df FROM freq"),
    "inverse_document_frequencies": _with("SELECT field, feature, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM freq CROSS JOIN total"),
    "top_tfidf_features": _with("SELECT entity_id, field, feature, df, CAST(feature_rank AS INTEGER) AS feature_rank FROM top"),
    "minhash_signatures": _with("SELECT entity_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY k) AS signature FROM sig GROUP BY entity_id"),
    "lsh_buckets": _with("SELECT * FROM lsh"),
    "exact_buckets": _with("SELECT * FROM exa"),
    "bucket_sizes": _with(
        """SELECT bucket, count(*) FILTER (source_name = 'source1') AS n_source1, count(*) FILTER (source_name <> 'source1') AS n_targets FROM buck GROUP BY bucket
HAVING count(DISTINCT source_name = 'source1') = 2"""
    ),
    "collision_votes": _with("SELECT * FROM votes"),
    "ranked_candidates": _with("SELECT * FROM ranked WHERE candidate_rank <= 500"),
    "capped_candidates": _with("SELECT * FROM ranked WHERE candidate_rank <= 5"),
    "candidate_lists": _with(_LISTS),
    "candidate_pairs_from_lists": _with("SELECT source1_entity_id, candidate_entity_id, candidate_rank FROM ranked WHERE candidate_rank <= 500"),
    "pair_lookup": _with("SELECT source1_entity_id, candidate_entity_id, candidate_source, nl AS name_left, nr AS name_right, al AS address_left, ar AS address_right FROM pairs"),
    "pair_exact_features": _pair_sql("name_exact_match", "address_exact_match"),
    "pair_token_features": _pair_sql(*[f for f in _pick("jaccard", "exact_token", "overlap", "containment", "token_count")]),
    "pair_edit_features": _pair_sql(*_pick("levenshtein", "length_ratio")),
    "pair_number_features": _pair_sql(*_pick("numeric", "postal", "first_number")),
    "pair_country_features": _pair_sql("country_exact_match"),
    "pair_cosines": _with(
        "SELECT source1_entity_id, candidate_entity_id, round(name_tfidf_cosine_similarity, 6) AS name_tfidf_cosine_similarity, round(address_tfidf_cosine_similarity, 6) AS address_tfidf_cosine_similarity FROM cos"
    ),

    "ground_truth_links": _with("SELECT source1_entity_id, candidate_entity_id FROM links"),
    "truth_totals": _with("SELECT count(*) AS n_entities, CAST(sum(truth_count) AS BIGINT) AS n_links FROM truth"),
    "validation_split": _with("SELECT source1_entity_id, truth_count, is_validation FROM truth"),
    "labeled_pairs": _with("SELECT source1_entity_id, candidate_entity_id, label, is_validation FROM labeled"),
    "label_counts": _with(
        """SELECT count(*) FILTER (NOT is_validation) AS train_pairs, count(*) FILTER (NOT is_validation AND label = 1) AS train_positives,
count(*) FILTER (is_validation) AS validation_pairs, count(*) FILTER (is_validation AND label = 1) AS validation_positives FROM labeled"""
    ),
    "candidate_recall": _with(
        """SELECT found_links, n_links, round(found_links / n_links, 6) AS candidate_recall
FROM (SELECT CAST(sum(label) AS BIGINT) AS found_links FROM labeled) CROSS JOIN (SELECT count(*) AS n_links FROM links)"""
    ),
    "stratified_sample": _with(
        """SELECT source1_entity_id, candidate_entity_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || source1_entity_id || '|' || candidate_entity_id)) AS place FROM labeled WHERE NOT is_validation) WHERE place <= 20"""
    ),
    "entity_f05": _with(
        f"""SELECT *, round({_F05}, 6) AS f05 FROM (
  SELECT t.source1_entity_id, truth_count, CAST(coalesce(sum(label) FILTER (probability >= 0.3), 0) AS BIGINT) AS hits, count(*) FILTER (probability >= 0.3) AS predicted
  FROM truth t LEFT JOIN scored s ON s.source1_entity_id = t.source1_entity_id GROUP BY t.source1_entity_id, truth_count)"""
    ),
    "threshold_sweep": _with(f"SELECT threshold, round(macro_f05, 6) AS macro_f05 FROM ({_sweep('(SELECT round(unnest(range(0, 21)) * 0.05, 4)::DOUBLE AS threshold)')})"),
    "tuned_threshold": _with(
        f"""SELECT threshold, round(macro_f05, 6) AS macro_f05 FROM ({_sweep('''(SELECT DISTINCT round(least(1, greatest(0, c - 0.05 + i * 0.005)), 4)::DOUBLE AS threshold FROM (
  SELECT threshold AS c FROM (''' + _sweep("(SELECT round(unnest(range(0, 21)) * 0.05, 4)::DOUBLE AS threshold)", "WHERE t.is_validation") + ''') ORDER BY round(macro_f05, 12) DESC, threshold DESC LIMIT 1), (SELECT unnest(range(0, 21)) AS i))''', "WHERE t.is_validation")})
ORDER BY round(macro_f05, 12) DESC, threshold DESC LIMIT 1"""
    ),
    "dedup_max_links": _with("SELECT * FROM linked"),
    "submission": _with(_matches()),
    "capped_matches": _with(_matches("AND place <= 2")),
    "coverage_gaps": _with("SELECT * FROM gaps"),
    "unknown_targets": _with("SELECT * FROM named WHERE candidate_entity_id NOT IN (SELECT entity_id FROM ent WHERE source_name <> 'source1')"),
    "matches_not_in_candidates": _with(
        """SELECT DISTINCT n.source1_entity_id, n.candidate_entity_id FROM named n JOIN ent e ON e.entity_id = n.source1_entity_id AND e.source_name = 'source1'
LEFT JOIN ranked r ON r.source1_entity_id = n.source1_entity_id AND r.candidate_entity_id = n.candidate_entity_id AND r.candidate_rank <= 500 WHERE r.candidate_rank IS NULL"""
    ),
    "validation_report": _with(
        """SELECT 'repeated_source1_id' AS rule, source1_entity_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM broken GROUP BY source1_entity_id HAVING count(*) > 1
UNION ALL SELECT 'coverage', entity_id, gap FROM gaps
UNION ALL SELECT 'malformed_id', source1_entity_id, array_to_string([x for x in ids if x = '' OR x <> trim(x)], '|') FROM broken WHERE len([x for x in ids if x = '' OR x <> trim(x)]) > 0
UNION ALL SELECT 'repeated_id', source1_entity_id, CAST(len(ids) - len(list_distinct(ids)) AS VARCHAR) FROM broken WHERE len(ids) > len(list_distinct(ids))
UNION ALL SELECT 'id_prefix', source1_entity_id, array_to_string([x for x in ids if x[1:3] NOT IN ('S2-', 'S3-')], '|') FROM broken WHERE len([x for x in ids if x[1:3] NOT IN ('S2-', 'S3-')]) > 0
UNION ALL SELECT 'unknown_target', source1_entity_id, candidate_entity_id FROM named WHERE candidate_entity_id NOT IN (SELECT entity_id FROM ent WHERE source_name <> 'source1')"""
    ),
}
ORACLE_SQL["pair_features"] = _with(
    "SELECT source1_entity_id, candidate_entity_id, candidate_source, " + ", ".join(f"{e} AS {n}" for n, e in _expressions().items()) + " FROM sets JOIN cos USING (source1_entity_id, candidate_entity_id)"
)

# what ``concord.plans.files`` writes and reads; files stand in the order of their ids' MD5
_FILE = "(SELECT entity_id AS source1_entity_id, row_number() OVER (ORDER BY md5(entity_id)) AS line FROM ent WHERE source_name = 'source1')"
_TEXT = [f"coalesce({c}, '') AS {c}" for c in ("business_name", "business_address", "country")]
ORACLE_SQL |= {
    "source_files": _with(f"SELECT source_name, entity_id, {', '.join(_TEXT)} FROM ent"),
    "source_file_normalized": _with("SELECT entity_id, name AS business_name_normalized, address AS business_address_normalized FROM rec"),
    "source_file_lines": _with(f"SELECT source1_entity_id AS entity_id, line FROM {_FILE}"),
    "candidate_file": _with(f"SELECT source1_entity_id, candidate_entity_ids, line FROM ({_LISTS}) JOIN {_FILE} USING (source1_entity_id)"),
    "candidate_file_pairs": ORACLE_SQL["candidate_pairs_from_lists"],
    "match_file": _with(f"SELECT source1_entity_id, matched_entity_ids, line FROM ({_matches()}) JOIN {_FILE} USING (source1_entity_id)"),
    "truth_file": _with("SELECT source1_entity_id, coalesce(array_to_string(ids, ','), '') AS matched_entity_ids, truth_count AS n_links FROM truth"),
    "feature_file": ORACLE_SQL["pair_features"],
    "idf_file": _with("SELECT field, feature, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf, n AS n_records FROM freq CROSS JOIN total"),
}
