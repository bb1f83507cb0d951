"""Quality rules with thresholds that follow the data.

Metrics of a text are counted once; each language and source has a quantile sketch of each metric, a table of bucket
counts (buckets of equal width below 64, of 1/32 relative width above), which merges by addition. A document fails where a
metric lies outside the fences that its own language and source set: some quartile ranges beyond the quartiles for the
length of words; for metrics that are 0 in most texts, as far beyond an upper quantile as that lies above the median.
Fences of small groups are drawn towards their language's, those of small languages towards everyone's, by a weight that
falls steadily as the group grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import cut, small_batches

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BROADCAST_ROWS = 50_000  # groups: a few hundred bytes each
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SIZES = ("n_words", "n_lines")  # whose medians say how large a group's texts are

#: Metric: (1000 times its value from the counts, two percentiles, the count that it is a rate of or None). With None
#: both sides have a fence beyond the percentiles; else the upper one, as far beyond the second as that from the first.
METRICS = {
    "word_length": ("word_chars * 1000 div n_words", (25, 75), None),
    "symbols": ("n_symbols * 1000 div n_words", (50, 90), "n_words"),
    "dup_lines": ("n_dup_lines * 1000 div n_lines", (50, 98), "n_lines"),
    "repeats": ("n_repeat_words * 1000 div n_words", (50, 98), "n_words"),
}
SPREAD = 4  # quartile ranges between a quartile and its fence
EVENTS = 2  # of them in a text of the group's median size are never too many
PRIOR = 200  # documents that a language's fences weigh as much as in its groups


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """COUNTS of a text; null has none. Lines count where they hold a word."""
    data = (text or "").encode()
    words = data.split()  # bytes split at the six ASCII white space characters
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    chars = sum(len(w) for w in words)
    chars -= len(data) - len(text)  # bytes beyond one for each code point; white space has none
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    seq = [ids.setdefault(w, len(ids)) for w in words]
    windows = list(zip(seq, seq[1:], seq[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        covered = 0  # words up to here are counted
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 3 - max(covered, i)
                covered = i + 3
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def with_counts(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with COUNTS (bigint) of its column text; columns of those names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in COUNTS])
    rest = docs.columns if keep_text else [c for c in docs.columns if c != "text"]
    schema = docs.select(*[f"`{c}`" for c in rest], *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = list(zip(*(count_text(t.as_py()) for t in batch.column("text")), strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(c, pa.int64()) for c in counted)], names=[*rest, *COUNTS])

    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _metric(name: str) -> Column:
    return F.when(F.col("n_words") > 0, F.expr(METRICS[name][0]))


def bucket(value: Column) -> Column:
    """The sketch's bucket of a whole number from 0: itself below 64, else its leading six bits and its length."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(shift * 32 + F.call_function("shiftright", value, shift))


def bucket_floor(b: Column) -> Column:
    """The least value of bucket ``b``."""
    shift = F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - shift * 32, shift))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) over documents that the base rules keep; adding n merges sketches."""
    values = {m: _metric(m) for m in METRICS} | {c: F.col(c) for c in SIZES}
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(v).alias("bucket")) for m, v in values.items()))
    each = counted.where(~base_failed()).select("lang", "source", F.explode(pairs).alias("x"))
    return each.groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _own_fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: n, and low_<metric> and high_<metric> from its own quantiles, exact to a bucket."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    up_to = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.select(*keys, "metric", "bucket", up_to.alias("up_to"), F.sum("n").over(group).alias("total"))
    wanted = {(m, q) for m, (_, percents, _) in METRICS.items() for q in percents} | {(c, 50) for c in SIZES}
    at = lambda m, q: F.min(F.when((F.col("metric") == m) & (F.col("up_to") * 100 >= F.col("total") * q), F.col("bucket")))
    found = ranked.groupBy(*keys).agg(F.max("total").alias("n"), *(at(m, q).alias(f"{m}_{q}") for m, q in sorted(wanted)))
    value = lambda m, q: bucket_floor(F.col(f"{m}_{q}"))
    limits = {}
    for m, (_, (low, high), size) in METRICS.items():
        if size is None:
            # the sketch can't tell quartiles apart that lie in one bucket
            width = SPREAD * (bucket_floor(F.col(f"{m}_{high}") + 1) - value(m, low))
            limits |= {f"low_{m}": value(m, low) - width, f"high_{m}": value(m, high) + width}
        else:
            chance = F.expr(f"{1000 * EVENTS} div greatest({_floor_sql(f'{size}_50')}, 1)")
            limits[f"high_{m}"] = F.greatest(2 * value(m, high) - value(m, low), chance)
    return found.select(*keys, "n", *(c.cast("long").alias(k) for k, c in limits.items()))


def _floor_sql(b: str) -> str:
    return f"if({b} < 64, {b}, shiftleft({b} - ({b} div 32 - 1) * 32, cast({b} div 32 - 1 as int)))"


def _shrunk(n: Column, own: Column, parent: Column) -> Column:
    """``own``, drawn towards ``parent`` by as much as PRIOR documents weigh against ``n``; ``parent`` where there is none."""
    return F.when(own.isNull(), parent).otherwise(F.floor((n * own + PRIOR * parent) / (n + PRIOR)))


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): low_<metric> and high_<metric>.

    A language's fences are drawn towards everyone's, a group's towards its language's, by a weight that falls as the
    group grows.
    """
    sketch = cut(sketch)
    limits = [f"{side}_{m}" for m, (_, _, size) in METRICS.items() for side in (("low", "high") if size is None else ("high",))]

    def level(keys: list[str], tag: str) -> DataFrame:
        x = _own_fences(sketch, keys)
        return x.select(*[F.col(k).alias(f"{k}_{tag}") for k in keys], F.struct("n", *limits).alias(tag))

    same = lambda k, tag: F.col(k).eqNullSafe(F.col(f"{k}_{tag}"))
    groups = sketch.select("lang", "source").distinct()
    own, lang = level(["lang", "source"], "own"), level(["lang"], "of_lang")
    everyone = level([], "of_all").first()["of_all"]
    joined = groups.join(own, same("lang", "own") & same("source", "own"), "left").join(lang, same("lang", "of_lang"), "left")
    of_lang = {k: _shrunk(F.col("of_lang.n"), F.col(f"of_lang.{k}"), F.lit(everyone[k]).cast("long")) for k in limits}
    return joined.select("lang", "source", *(_shrunk(F.col("own.n"), F.col(f"own.{k}"), of_lang[k]).cast("long").alias(k) for k in limits))


def verdicts(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` with base_failed and kept. Texts of groups without any fences pass them."""
    limits = cut(limits.withColumnsRenamed({"lang": "__lang", "source": "__source"}))
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    outside = F.lit(False)
    for m, (_, _, size) in METRICS.items():
        outside = outside | F.coalesce(_metric(m) > F.col(f"high_{m}"), F.lit(False))
        if size is None:
            outside = outside | F.coalesce(_metric(m) < F.col(f"low_{m}"), F.lit(False))
    return joined.select(*[f"`{c}`" for c in counted.columns], base_failed().alias("base_failed"), (~base_failed() & ~outside).alias("kept"))


def quality_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of each row of ``docs`` (doc_id, text, lang, source).

    Null and empty texts have no words and fail; a very long one is counted whole, in memory of some times its size. Null
    lang and source are groups of their own; repeated rows count each; of ties in a quantile the least value counts. An
    empty table gives no rows. Other columns are not read.
    """
    counted = cut(with_counts(docs.select("doc_id", "text", "lang", "source"), keep_text=False))
    return verdicts(counted, fences(sketches(counted))).drop("lang", "source")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns, whatever their names; edge cases as in ``quality_metrics``.

    Texts are read twice: for the fences and for the verdicts.
    """
    limits = fences(sketches(with_counts(docs.select("text", "lang", "source"), keep_text=False)))
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__doc"), "text", "lang", "source")
    return verdicts(with_counts(whole, keep_text=False), limits).where("kept").select("__doc.*")
