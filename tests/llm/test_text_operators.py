"""Chat formatting, license scan, quality rules and line dedup on small tables."""

import hashlib
import random
from re import _parser

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from concord.llm import chat, licenses, linededup, quality
from concord.llm.license_rules import rules
from concord.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL)))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


# chat formatting

TURN = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", r"<\|im_sep|>", "<\\\\s>", "<<SYS>> x <</SYS>>", "<|im_sep|>", "[/INST]", "", "\\", "a\n\nb\x00é😀"]


def test_turns_come_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\\n\ntem", "<|im_end|>"]), "".join(rng.choices(NASTY, k=rng.randint(0, 4)))) for c in range(60) for t in range(rng.randint(1, 7))]
    frame = spark.createDataFrame(rows, TURN)
    formatted = chat.chat_format(frame)
    got = {r.conv_id: r for r in formatted.select("*", chat.parse_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        want = [(r[2], r[3]) for r in sorted(rows) if r[0] == c]
        assert [tuple(t) for t in got[c].turns] == want
        assert got[c].loss == "".join(t for role, t in want if role == "assistant")
        runs = sum(i == 0 or want[i - 1][0] != want[i][0] for i in range(len(want)))
        # no text can forge a control string of the template
        assert got[c].formatted.count(chat.START) == runs and got[c].formatted.count(chat.END) == runs and got[c].formatted.count(chat.SEAM) == len(want) - runs


def test_chat_nulls_ties_and_extra_columns(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (None, None, None, "a", "x"), (1, 1, "assistant", "b", "x")]
    frame = spark.createDataFrame(rows, TURN + ", formatted string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.chat_format(frame)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\n\nuser\n\nassistant\nb\n").hexdigest()
    assert got[None].n_turns == 1 and got[None].loss_chars == 0 and got[1].loss_sha256 == hashlib.sha256(b"b").hexdigest()
    assert chat.chat_format(frame.limit(0)).count() == 0


def test_chat_is_native(spark, sf_dir):
    plan = QUERIES["op1_chat"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# license scan

TEXT = "doc_id long, text string"


def scan(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), TEXT)
    return [r for _, r in sorted((r.doc_id, r) for r in licenses.license_scan(frame).collect())]


def test_there_are_hundreds_of_rules():
    table = rules()
    assert len(table) >= 200 and [r[0] for r in table] == list(range(len(table)))


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("the permit licenses and a summit license", ""),
        ("submit license", ""),
        ("émit license", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_labels(spark, text, labels):
    (row,) = scan(spark, text)
    assert row.labels == labels and (row.score > 0) == bool(labels) and row.score <= 1


def expanded(tree):
    """Texts that a parsed pattern names: every alternative, with and without what is optional."""
    texts = [""]
    for op, of in tree:
        match str(op):
            case "LITERAL":
                each = [chr(of)]
            case "NOT_LITERAL":
                each = ["x"]
            case "IN":
                each = [chr(x if str(kind) == "LITERAL" else x[0]) for kind, x in of]
            case "SUBPATTERN":
                each = expanded(of[3])
            case "BRANCH":
                each = [x for branch in of[1] for x in expanded(branch)]
            case "MAX_REPEAT":
                least, most, inner = of
                each = [x * k for x in expanded(inner) for k in {least, min(int(most), max(least, 1))}]
        texts = [t + x for t in texts for x in each]
    return texts


def test_every_alternative_holds_its_keyword():
    for _, label, _, keyword, pattern in rules():
        for text in expanded(_parser.parse(pattern)):
            assert f" {keyword}" in text, (label, keyword, text)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("model under OpenRAIL-M", "openrail"),
        ("a Responsible AI License", "openrail"),
        ("0BSD license", "0bsd"),
        ("Open Data Commons Attribution License v1.0", "odc-by-1.0"),
        ("Common Development and Distribution License 1.1", "cddl-1.1"),
        ("European Union Public Licence 1.2", "eupl-1.2"),
        ("European Union Public License v1.1", "eupl-1.1"),
        ("grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce", "apache-2.0"),
    ],
)
def test_labels_without_another_keyword(spark, text, labels):
    (row,) = scan(spark, text)
    assert row.labels == labels


def test_places(spark):
    a, b, c = scan(spark, "MIT license mit LICENSE, mit-license", "x general public  license", "é " * 20_000 + "apache license")
    assert (a.n_words, a.n_base, a.first_word, a.last_word, a.base_labels) == (6, 3, 0, 4, "mit")
    assert (b.n_words, b.n_base, b.first_word, b.last_word) == (4, 1, 1, 1)
    assert (c.n_words, c.first_word, c.base_labels) == (20_002, 20_000, "apache")


def test_contained_detections_go(spark):
    (row,) = scan(spark, "licensed under the apache license version 2 0 and the mit license")
    assert [d.label for d in row.detections] == ["apache-2.0", "mit"]


def test_scan_keeps_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "mit license", "mine", 5)], "doc_id long, text string, labels string, other int")
    row = licenses.license_scan(frame).first()
    assert (row.labels, row.other) == ("mit", 5)
    assert licenses.license_scan(frame.limit(0)).count() == 0


# quality rules


def brute_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_counts_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice("abcdé") for _ in range(rng.randint(0, 14))]
        text = "".join(w + rng.choice([" ", "\n", "\t\r\n", "\n\n"]) for w in words)
        n, chars, symbols, lines, dups, repeats = quality.count_text(text)
        kept = [x for x in text.split("\n") if x.strip(" \t\r\n\x0b\x0c")]
        assert (n, chars, symbols, lines, dups, repeats) == (len(words), len(words), 0, len(kept), len(kept) - len(set(kept)), brute_repeats(words))
    assert quality.count_text(None) == quality.count_text("") == quality.count_text(" \n") == (0,) * 6
    assert quality.count_text("a\xa0b ##|　")[:3] == (2, 7, 3)


def test_buckets_are_ordered_and_tight(spark):
    values = [*range(300), 1000, 12345, 10**9, 10**15]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b")).select("v", "b", quality.bucket_floor(F.col("b")).alias("low")).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert all(r.low <= r.v <= r.low * 33 / 32 + 1 for r in rows)


def clean(rng, n=80):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))


def test_adaptive_verdicts(spark):
    rng = random.Random(3)
    rows = [(i, clean(rng), "en", f"s{i % 2}", 0) for i in range(500)]
    rows += [(600, " ".join(w + "***" for w in clean(rng).split()), "en", "s0", 0), (601, None, None, None, 0), (602, "few words", "en", "s0", 0), (603, "one two three " * 40, "en", "s0", 0)]
    rows += [(604, " ".join("x" * 60 for _ in range(30)) + " " + " ".join("y" * (50 + i) for i in range(40)), "en", "s1", 0), rows[0]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: r for r in quality.quality_metrics(frame).collect()}
    assert all(got[i].kept for i in range(500))
    assert not got[600].base_failed and not got[600].kept and not got[604].kept
    assert got[601].base_failed and got[602].base_failed and got[603].base_failed
    kept = quality.quality_filter(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [0, *range(500)]
    assert quality.quality_metrics(frame.limit(0)).count() == 0 and quality.quality_filter(frame.limit(0)).count() == 0


def test_fences_follow_metrics_that_are_mostly_zero(spark):
    rng = random.Random(8)

    def lines(repeated):
        return "\n".join([clean(rng, 8) for _ in range(10 - repeated)] + [clean(rng, 8)] * 1) + "\n" + "\n".join(["xy " + clean(random.Random(1), 1)] * repeated)

    rows = [(i, lines(0), "en", "rare") for i in range(300)] + [(300 + i, lines(4), "en", "rare") for i in range(5)]
    rows += [(1000 + i, lines(4 if i % 5 == 0 else 0), "en", "often") for i in range(300)]
    got = {r.doc_id: r for r in quality.quality_metrics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values()) and got[300].n_dup_lines == got[1000].n_dup_lines == 3
    assert all(got[i].kept == (i < 300) for i in range(305))  # outliers where others have no repeated lines
    assert all(got[1000 + i].kept for i in range(300))  # and not where they are usual


def test_each_metric_has_fences_of_its_group(spark):
    """Two groups of texts that differ in all tails: a text that one of them finds usual fails in the other."""
    rng = random.Random(14)

    def text(loose):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 14) if loose else 5)) for _ in range(200)]
        if loose and rng.random() < 0.5:
            words[:20] = [w + "#" for w in words[:20]]
            words[30:60] = words[60:90]
        rows = [" ".join(words[i : i + 10]) for i in range(0, 200, 10)]
        if loose and rng.random() < 0.5:
            rows[10:14] = [rows[3]] * 4
        return "\n".join(rows)

    schema = "doc_id long, text string, lang string, source string"
    rows = [(i, text(False), "en", "strict") for i in range(400)] + [(1000 + i, text(True), "en", "loose") for i in range(400)]
    docs = spark.createDataFrame([*rows, *((9000 + i, "word " * 70, "en", s) for i, s in enumerate(("strict", "loose")))], schema)
    table = {r.source: r for r in quality.fences(quality.sketches(quality.with_counts(docs))).collect()}
    for fence in ("high_word_length", "high_symbols", "high_dup_lines", "high_repeats"):
        assert table["loose"][fence] > 1.2 * table["strict"][fence], fence
    got = {r.doc_id: r for r in quality.quality_metrics(docs).collect()}
    assert sum(got[i].kept for i, *_ in rows) > 780


def test_small_groups_lean_on_their_language(spark):
    rng = random.Random(15)
    rows = [(i, clean(rng), "en", "large") for i in range(300)]
    rows += [(1000 + i, "\n".join(["same line here again and so on now"] * 3 + [clean(rng, 30), clean(rng, 30)]), "en", f"small{i % 2}") for i in range(4)]
    limits = {r.source: r for r in quality.fences(quality.sketches(quality.with_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))).collect()}
    own, of_lang = 1000 * quality.EVENTS // 5, limits["large"].high_dup_lines
    assert own < of_lang and own < limits["small0"].high_dup_lines <= of_lang + 20


# line dedup


def near(a, b):
    """Within one edit."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_lines(docs):
    lines = [(d, i, x) for d, t in docs for i, x in enumerate((t or "").split("\n")) if len(x.split()) >= linededup.MIN_WORDS]
    first = {}
    for d, i, x in sorted(lines):
        first.setdefault(x, (d, i))
    late = {x for x in first for y in first if first[y] < first[x] and near(x, y)}
    gone = {}
    for d, i, x in lines:
        if x in late or (d, i) != first[x]:
            gone.setdefault(d, set()).add(i)
    return {d: sorted(gone.get(d, [])) for d, _ in docs}


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    seeds = [" ".join("".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(rng.randint(5, 14))) for _ in range(12)]

    def edited(x):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(x))
            x = rng.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "q" + x[i + 1 :], x + "!"])
        return x

    docs = [(d, "\n".join(edited(rng.choice(seeds)) for _ in range(rng.randint(1, 6)))) for d in range(60)]
    docs += [(100, None), (101, ""), (102, "too short"), (103, seeds[0] + "\n" + seeds[0])]
    frame = spark.createDataFrame(docs, TEXT)
    want = brute_lines(docs)
    got = {r.doc_id: r for r in linededup.line_report(frame).collect()}
    assert {d: list(r.removed) for d, r in got.items()} == want and sum(map(len, want.values())) > 50
    assert got[100].n_lines == got[101].n_lines == 1
    texts = {r.doc_id: r.text for r in linededup.drop_repeated_lines(frame).collect()}
    for d, t in docs:
        assert texts[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]))


def test_long_lines_and_repeated_rows(spark):
    long = "word " * 3000
    rows = [(1, long + "end"), (2, long + "enD"), (3, long[:7000] + "X" + long[7001:] + "end"), (1, long + "end"), (4, "a b c d e f\n" + long + "and")]
    frame = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_chars long, line string")
    got = {r.doc_id: list(r.removed) for r in linededup.line_report(frame).collect()}
    assert got == {1: [], 2: [0], 3: [0], 4: [1]}
    kept = linededup.drop_repeated_lines(frame)
    assert kept.columns == frame.columns and kept.count() == 5
    assert {r.doc_id: r.n_chars for r in kept.collect()} == {1: 1, 2: 0, 3: 0, 4: 11}
    assert linededup.line_report(frame.limit(0)).count() == 0


def test_lines_with_null_ids(spark):
    line = "this very line is long enough"
    frame = spark.createDataFrame([(None, line), (7, line)], TEXT)
    assert {r.doc_id: list(r.removed) for r in linededup.line_report(frame).collect()} == {None: [0], 7: []}


def test_lines_of_few_words_go(spark):
    unsegmented = "東京都は日本の首都であり" * 10
    rows = [(1, unsegmented + "\nread more\n\n"), (2, "read more\n" + unsegmented), (3, unsegmented[:-1] + "\n\nanother one")]
    frame = spark.createDataFrame(rows, TEXT)
    assert {r.doc_id: list(r.removed) for r in linededup.line_report(frame).collect()} == {1: [], 2: [0, 1], 3: [0]}
    assert {r.doc_id: r.text for r in linededup.drop_repeated_lines(frame).collect()} == {1: rows[0][1], 2: "", 3: "\nanother one"}


def test_native_plans(spark, sf_dir):
    for name in ("op8_license", "op9_mix", "op10_lines"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_very_long_lines(spark):
    """Lines of 200,000 characters that differ in one, and one that lacks a character."""
    rng = random.Random(30)
    base = "".join(rng.choices("abcdefgh ", k=200_000))
    other = base[:170_000] + "#" + base[170_001:]
    shorter = base[:123_456] + base[123_457:]
    far = base[:10] + "##" + base[12:]
    docs = [(1, base), (2, other), (3, shorter), (4, far), (5, "".join(rng.choices("abcdefgh ", k=200_000)))]
    got = {r.doc_id: r.n_removed for r in linededup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
