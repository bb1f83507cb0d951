"""Queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import bpe, chat, licenses, linededup, mixing, mtree, probminhash, quality, suffixtree, warc
from concord.llm.common import read
from concord.llm.license_rules import rules


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    saying = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), saying.alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(chat.chat_format(turns.unionByName(more)))


def op2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_metrics(read(spark, sf_dir, "documents")).drop("n_lines")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.top_k(rows, rows.where(F.col("vec_id") % mtree.EVERY == 0))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read(spark, sf_dir, "documents"), *vocabulary())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(read(spark, sf_dir, "pages"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(read(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(mixing.mix_plan(read(spark, sf_dir, "documents")))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(read(spark, sf_dir, "documents"))


QUERIES = {"op1_chat": op1_chat, "op2_score": op2_score, "op3_quality": op3_quality, "op4_neardup": op4_neardup, "op5_topk": op5_topk, "op6_bpe": op6_bpe, "op7_warc": op7_warc, "op8_license": op8_license, "op9_mix": op9_mix, "op10_lines": op10_lines}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rules_sql() -> str:
    return ",\n".join(f"({i}, {_quoted(label)}, {sure}, {_quoted(' ' + key)}, {_quoted(pattern)})" for i, label, sure, key, pattern in rules())


def _quality_sql() -> str:
    metrics, sizes = quality.METRICS, quality.SIZES
    rows = ", ".join([f"({_quoted(m)}, {f.replace('div', '//')})" for m, (f, _, _) in metrics.items()] + [f"({_quoted(c)}, {c})" for c in sizes])
    low = lambda q: f"CASE WHEN {q} < 64 THEN {q} ELSE ({q} - ({q} // 32 - 1) * 32) << CAST({q} // 32 - 1 AS INTEGER) END"

    def level(keys: str) -> str:
        by = f"{keys}, " if keys else ""
        group = f"GROUP BY {keys}" if keys else ""
        at = lambda m, q: f"(min(bucket) FILTER (metric = '{m}' AND up_to * 100 >= total * {q}))"
        fence = []
        for m, (_, (a, b), size) in metrics.items():
            x, y = low(at(m, a)), low(at(m, b))
            if size is None:
                width = f"{quality.SPREAD} * ({low(f'({at(m, b)} + 1)')} - ({x}))"
                fence += [f"{x} - {width} AS low_{m}", f"{y} + {width} AS high_{m}"]
            else:
                fence.append(f"greatest(2 * ({y}) - ({x}), {1000 * quality.EVENTS} // greatest({low(at(size, 50))}, 1)) AS high_{m}")
        return f"""(SELECT {by}max(total) AS n, {", ".join(fence)} FROM (
            SELECT {by}metric, bucket, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY {by}metric) AS total
            FROM (SELECT {by}metric, bucket, count(*) AS n FROM b GROUP BY {by}metric, bucket)) {group})"""

    inside = []
    for m, (f, _, size) in metrics.items():
        drawn = lambda t, own, parent: f"CASE WHEN {own} IS NULL THEN {parent} ELSE CAST(floor(({t}.n * {own} + {quality.PRIOR} * {parent}) / ({t}.n + {quality.PRIOR})) AS BIGINT) END"
        pick = lambda side, m=m: drawn("o", f"o.{side}_{m}", f"({drawn('l', f'l.{side}_{m}', f'a.{side}_{m}')})")
        v = f.replace("div", "//")
        inside.append(f"coalesce({v} <= {pick('high')}, TRUE)")
        if size is None:
            inside.append(f"coalesce({v} >= {pick('low')}, TRUE)")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
g AS (SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
h AS (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM g),
r AS (SELECT row, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY row),
c AS (
  SELECT w.row, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON r.row = w.row),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
v AS (SELECT lang, source, metric, value FROM f, LATERAL (VALUES {rows}) AS m(metric, value) WHERE NOT base_failed),
b AS (
  SELECT lang, source, metric, CASE WHEN value < 64 THEN value ELSE (length(bin(value)) - 6) * 32 + (value >> CAST(length(bin(value)) - 6 AS INTEGER)) END AS bucket FROM v),
own AS {level("lang, source")},
of_lang AS {level("lang")},
of_all AS {level("")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(inside)} AS kept
FROM f LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM f.lang AND o.source IS NOT DISTINCT FROM f.source
  LEFT JOIN of_lang l ON l.lang IS NOT DISTINCT FROM f.lang CROSS JOIN of_all a
"""


ORACLE_SQL = {
    "op1_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
u AS (
  SELECT *, row_number() OVER w AS i, role IS DISTINCT FROM lag(role) OVER w AS head,
    length(regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (SELECT *, CASE WHEN head THEN length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1 ELSE length('<|im_sep|>') END AS marks FROM u)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(marks + n) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
""",
    "op8_license": r"""
WITH rules(priority, label, confidence, keyword, pattern) AS (VALUES
"""
    + _rules_sql()
    + r"""),
d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_replace(' ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ', '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g') AS norm
  FROM documents),
w AS (SELECT row, doc_id, norm, [x for x in string_split(norm, '  ') if x <> ''] AS words FROM d),
places AS (
  SELECT row, i - 1 AS place, CASE words[i] WHEN 'mit' THEN 'mit' WHEN 'apache' THEN 'apache' ELSE 'gpl' END AS label
  FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE contains(norm, ' license '))
  WHERE (words[i] IN ('mit', 'apache') AND words[i + 1] = 'license') OR (words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license')),
base AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY row),
tried AS (
  SELECT row, priority, label, confidence, string_split_regex(norm, pattern) AS gaps, regexp_extract_all(norm, pattern) AS hits
  FROM w JOIN rules ON contains(norm, keyword)),
found AS (
  SELECT row, priority, label, confidence, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM tried WHERE len(hits) > 0),
spans AS (
  SELECT row, priority, label, confidence, start, start + length(hits[i]) AS stop
  FROM (SELECT *, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0) AS start FROM found)),
stay AS (
  SELECT * FROM spans a WHERE NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.row = a.row AND b.priority < a.priority AND b.start <= a.start AND b.stop >= a.stop)),
more AS (SELECT row, list(label) AS labels, max(confidence) AS score FROM stay GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (row) LEFT JOIN more USING (row)
""",
    "op3_quality": _quality_sql(),
    "op5_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN k.kept > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.kept > p.page_id THEN k.kept END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000
""",
    "op10_lines": r"""
WITH e AS (
  SELECT doc_id, i - 1 AS pos, lines[i] AS line
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
  WHERE len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) >= 1),
l AS (SELECT line, min((doc_id, pos)) AS first FROM e GROUP BY line),
v AS (
  SELECT line, first, p, hash(line[:p - 1] || line[p + 1:]) AS v
  FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS p FROM l)),
replaced AS (SELECT line, first > min(first) OVER (PARTITION BY p, v) AS late FROM v),
longer AS (SELECT v.line, v.first AS first, l.line AS shorter, l.first AS other FROM v JOIN l ON hash(l.line) = v.v AND length(l.line) + 1 = length(v.line)),
near AS (
  SELECT line FROM replaced WHERE late UNION SELECT line FROM longer WHERE other < first UNION SELECT shorter FROM longer WHERE first < other),
gone AS (
  SELECT doc_id, list_sort(list_distinct(list(CAST(pos AS INTEGER)))) AS removed
  FROM e JOIN l USING (line) WHERE (e.doc_id, e.pos) <> l.first OR line IN (SELECT line FROM near) GROUP BY doc_id)
SELECT doc_id, max(len(string_split(coalesce(text, ''), chr(10)))) AS n_lines, coalesce(any_value(len(removed)), 0) AS n_removed, coalesce(any_value(removed), []) AS removed
FROM documents LEFT JOIN gone USING (doc_id) GROUP BY doc_id
""",
}
