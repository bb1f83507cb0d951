"""License scan by ordered signature rules, in DataFrame operations alone.

A text becomes its lower-case words with two spaces around each. Texts in which some rule's keyword stands are read by
the rules whose keywords they hold; a detection inside one of a rule of higher priority is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.license_rules import rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are always looked for, with their labels.
PHRASES = (("mit  license", "mit", 2), ("apache  license", "apache", 2), ("general  public  license", "gpl", 3))
OPEN, CLOSE = "\x01", "\x02"
DETECTION = "array<struct<priority:int,label:string,confidence:double,start:int,stop:int>>"


def spread_words(text: Column) -> Column:
    """The words of ``text`` with two spaces before, between and after them; two spaces if there are none."""
    padded = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" "))
    return F.regexp_replace(padded, BREAK, "  ")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _marked(norm: Column, i: int, key: str, pattern: str) -> Column:
    """The rule's number and the text with a sign before and after each of its matches; null without the keyword.

    The signs are none of a spread text. Keyword and pattern are constants, so a pattern is compiled once.
    """
    found = F.regexp_replace(norm, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))
    return F.when(F.contains(norm, F.lit(f" {key}")), F.struct(F.lit(i).alias("priority"), found.alias("marked")))


def _matches(x: Column, labels: Column, sure: Column) -> Column:
    """Detections of one rule: lengths of what stands between its matches give their places."""
    pieces = F.split(x["marked"], OPEN, -1)
    rule = x["priority"]

    def add(acc: Column, piece: Column) -> Column:
        hit = F.length(F.substring_index(piece, CLOSE, 1))
        stop = acc["at"] + hit
        one = F.struct(rule.alias("priority"), F.element_at(labels, rule + 1).alias("label"), F.element_at(sure, rule + 1).alias("confidence"), acc["at"].alias("start"), stop.alias("stop"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    start = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast(DETECTION).alias("found"))
    return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, add)["found"]


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, detections, labels and score.

    Null text is empty: no words, no places (first_word and last_word null), empty labels, score 0. ``detections`` are
    the rules' that stay, with start and stop in the spread words; ``score`` is the greatest confidence among them. A
    detection stays beside another of the same place and priority. Texts are read whole; time grows with a text's length,
    and with the square of its detections. Other columns pass through; columns that have one of the new names are
    replaced. Rows are independent of each other, so repeated ones stay, and an empty table gives no rows.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    own = [c for c in docs.columns if c.lower() not in new]
    table = rules()
    gate = "|".join(sorted({k for _, _, _, k, _ in table}))
    spread = docs.select(*kept, spread_words(F.col(text)).alias("__norm"))
    norm = F.col("__norm")
    tried = F.array_compact(F.array(*(_marked(norm, i, key, pattern) for i, _, _, key, pattern in table)))
    hit = F.filter(tried, lambda x: F.contains(x["marked"], F.lit(OPEN)))
    labels, sure = F.array(*(F.lit(r[1]) for r in table)), F.array(*(F.lit(r[2]) for r in table))
    found = F.when(norm.rlike(f" (?:{gate})"), F.flatten(F.transform(hit, lambda x: _matches(x, labels, sure)))).otherwise(F.array().cast(DETECTION))
    pieces = [F.when(F.contains(norm, F.lit(f" {p} ")), F.split(norm, f" {p} ", -1)) for p, _, _ in PHRASES]
    step = spread.select(*own, "__norm", F.floor(_spaces(norm) / 2 - 1).alias("n_words"), found.alias("__found"), *(p.alias(f"__p{i}") for i, p in enumerate(pieces)))
    places = [F.coalesce(F.size(f"__p{i}") - 1, F.lit(0)) for i in range(len(PHRASES))]
    firsts = [F.floor(_spaces(F.element_at(f"__p{i}", 1)) / 2) for i in range(len(PHRASES))]
    lasts = [F.col("n_words") - F.floor(_spaces(F.element_at(f"__p{i}", -1)) / 2) - size for i, (_, _, size) in enumerate(PHRASES)]
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"__p{i}").isNotNull(), F.lit(label)) for i, (_, label, _) in enumerate(PHRASES)))))
    inside = lambda d, e: (e["priority"] < d["priority"]) & (e["start"] <= d["start"]) & (e["stop"] >= d["stop"])
    stay = F.filter("__found", lambda d: ~F.exists("__found", lambda e: inside(d, e)))
    step = step.select(
        *own, "n_words", sum(places[1:], places[0]).cast("long").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), base.alias("__base"), stay.alias("detections")
    )
    labels = F.array_sort(F.array_union("__base", F.transform("detections", lambda d: d["label"])))
    score = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return step.select(*own, "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"), "detections", F.array_join(labels, ",").alias("labels"), score.alias("score"))


def license_digest(docs: DataFrame) -> DataFrame:
    """``license_scan`` of (doc_id, text) without the detections' places; its edge cases are that function's."""
    return license_scan(docs.select("doc_id", "text")).drop("text", "detections")
