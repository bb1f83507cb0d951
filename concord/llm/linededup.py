"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

Two lines within one edit share a variant: the line without one of its characters (a replaced character at the same
place in both, or an inserted one that the shorter line lacks). Variants travel as hashes. So that a line needn't emit
one for each of its characters, two filters that lose nothing come first. A line with a neighbour equals it in its first
or in its last half; and it equals it but for one leaf of ``LEAF`` characters. Only leaves whose surroundings another
line shares emit their variants. The earliest line of each variant stands for the others, the distance to it is verified,
and a line goes if an earlier one, by (doc_id, line number), is equal to it or within one edit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import SPACE, WORD, Held, cut
from concord.operators.store import cut_dealt, scratch

MIN_WORDS, LEAF = 1, 32
SHORT = 2000  # characters up to which an edit distance is cheap to find
BROADCAST_ROWS = 200_000  # of 16-byte line hashes


def _at() -> Column:
    """Place of a line, by which the earliest is found; documents without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("pos").alias("pos"))


def lines_of(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, pos, line, line_hash) of each line of ``docs`` (doc_id, text) with at least ``min_words`` words."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    if min_words > 0:
        each = each.where(F.col("line").rlike(rf"^[{SPACE}]*(?:{WORD}[{SPACE}]+){{{min_words - 1}}}[^{SPACE}]"))
    return each.withColumn("line_hash", F.unhex(F.md5("line")))


def _half_keys(line: Column) -> Column:
    """Hashes of the halves that a neighbour of the same length, one longer or one shorter would share."""
    n = F.length(line)

    def keys(of: Column) -> list[Column]:
        left = F.floor(of / 2).cast("int")
        return [F.xxhash64(F.lit("l"), of, F.left(line, left)), F.xxhash64(F.lit("r"), of, F.right(line, of - left))]

    return F.array(*keys(n), *keys(n - 1))


def _leaves(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0))


def _sums(hashes: Column) -> Column:
    """0, then the sum (bit by bit, without carry) of the first, of the first two, ..."""
    return F.aggregate(hashes, F.array(F.lit(0).cast("long")), lambda acc, h: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(h))))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is found once a row, whatever the optimiser inlines."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _holes(line: Column) -> Column:
    """array<struct<hole, content, longer>>: for each leaf the hash of what surrounds it, and what it holds.

    ``longer`` is false where the line is seen beside one with one character more, of whose leaf it has all but one. A
    surrounding's hash is the sum of its leaves' hashes, so that the whole line isn't read again for each leaf.
    """
    at = lambda xs, first: F.transform(xs, lambda x, j: F.xxhash64(j + first, x))
    key = lambda n, i, around: F.xxhash64(n, i, around).alias("hole")

    def sums(c: Column) -> Column:
        # beside a longer line, what follows a leaf stands one place earlier
        hashed = F.struct(c["n"].alias("n"), c["leaves"].alias("leaves"), at(c["leaves"], F.lit(0)).alias("own"), at(c["later"], F.lit(1)).alias("moved"))
        return _let(hashed, lambda h: _let(F.struct(h["n"].alias("n"), h["leaves"].alias("leaves"), h["own"].alias("own"), _sums(h["own"]).alias("before"), _sums(h["moved"]).alias("moved")), both))

    def both(s: Column) -> Column:
        total, moved = F.element_at(s["before"], -1), F.element_at(s["moved"], -1)
        own = F.transform(s["leaves"], lambda x, i: F.struct(key(s["n"], i, total.bitwiseXOR(F.get(s["own"], i))), x.alias("content"), F.lit(True).alias("longer")))

        def beside(i: Column) -> Column:
            around = F.get(s["before"], i).bitwiseXOR(moved).bitwiseXOR(F.get(s["moved"], i))
            content = F.coalesce(F.left(F.get(s["leaves"], i), F.lit(LEAF - 1)), F.lit(""))
            return F.struct(key(s["n"] + 1, i, around), content.alias("content"), F.lit(False).alias("longer"))

        return F.concat(own, F.transform(F.sequence(F.lit(0), F.floor(s["n"] / LEAF).cast("int")), beside))

    return _let(F.struct(F.length(line).alias("n"), _leaves(line).alias("leaves"), _leaves(F.substr(line, F.lit(LEAF))).alias("later")), sums)


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether ``a`` and ``b`` are; long ones by their common start, which is found by halving."""

    def step(acc: Column, k: Column) -> Column:
        more = acc + k
        return F.when((more <= F.length(a)) & (more <= F.length(b)) & (F.left(a, more) == F.left(b, more)), more).otherwise(acc)

    start = F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), step)
    after = lambda x, longer: F.substr(x, start + F.when(longer, 2).otherwise(1))
    same = after(a, F.length(a) >= F.length(b)) == after(b, F.length(b) >= F.length(a))
    close = F.abs(F.length(a) - F.length(b)) <= 1
    return F.when(F.length(a) <= SHORT, F.levenshtein(a, b, 1) >= 0).otherwise(close & same)


def _variants() -> Column:
    """array<struct<variant, replaced>> of a row of holes."""
    c = F.col("content")
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda p: F.struct(F.concat(F.left(c, p - 1), F.substr(c, p + 1)).alias("v"), p.alias("p")))
    replaced = F.transform(without, lambda x: F.struct(F.xxhash64("hole", x["p"], x["v"]).alias("variant"), F.lit(True).alias("replaced")))
    dropped = F.transform(F.array_distinct(F.transform(without, lambda x: x["v"])), lambda v: F.struct(F.xxhash64("hole", F.lit(0), v).alias("variant"), F.lit(False).alias("replaced")))
    whole = F.array(F.struct(F.xxhash64("hole", F.lit(0), c).alias("variant"), F.lit(False).alias("replaced")))
    return F.when(F.col("longer"), F.concat(replaced, dropped)).otherwise(whole)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` (with line_hash) whose ``key`` another line has too."""
    several = rows.groupBy(key).agg(F.min("line_hash").alias("__a"), F.max("line_hash").alias("__b")).where("__a < __b").select(key)
    return rows.join(several, key, "left_semi")


def near_lines(docs: DataFrame, lines: DataFrame, held: Held, min_words: int = MIN_WORDS) -> DataFrame:
    """line_hash of the lines of ``lines`` (line_hash, first, halves) within one edit of a line whose first place is earlier."""
    halves = lines.select("line_hash", F.explode(F.array_distinct("halves")).alias("half"))
    wanted = held(_shared(halves, "half").select("line_hash").distinct())
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = lines_of(docs, min_words).join(wanted, "line_hash", "left_semi")
    texts = texts.groupBy("line_hash").agg(F.min(_at()).alias("first"), F.min("line").alias("line"))
    texts = cut_dealt(texts)
    holes = texts.select("line_hash", "first", F.explode(_holes(F.col("line"))).alias("h")).select("line_hash", "first", "h.*")
    holes = _shared(holes, "hole")
    variants = held(holes.select("line_hash", "first", "longer", F.explode(_variants()).alias("x")).select("line_hash", "first", "longer", "x.*"))
    place = F.struct(F.col("first").alias("first"), F.col("line_hash").alias("line_hash"))
    earliest = variants.groupBy("variant", "replaced").agg(F.min(F.when(F.col("longer"), place)).alias("of_longer"), F.min(F.when(~F.col("longer"), place)).alias("of_shorter"))
    other = F.when(F.col("replaced") | ~F.col("longer"), F.col("of_longer")).otherwise(F.col("of_shorter"))
    pairs = variants.join(earliest, ["variant", "replaced"]).select("line_hash", "first", other.alias("other")).where(F.col("other.first") < F.col("first"))
    pairs = pairs.select("line_hash", F.col("other.line_hash").alias("earlier")).distinct()
    a, b = texts.select("line_hash", F.col("line").alias("a")), texts.select(F.col("line_hash").alias("earlier"), F.col("line").alias("b"))
    verified = pairs.join(a, "line_hash").join(b, "earlier").where(_within_one_edit(F.col("a"), F.col("b")))
    return verified.select("line_hash").distinct()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, pos, line_hash) of the lines that go."""
    each = lines_of(docs.select("doc_id", "text"), min_words)
    seen = each.select("line_hash", _at().alias("at"), _half_keys(F.col("line")).alias("halves"))
    # lines and texts are written: each plan that reads a persisted table holds the plans of all that this was made from,
    # as often as they were read there, and the driver spells them out again after each of its stages
    with scratch() as kept, Held() as held:
        lines = cut_dealt(seen.groupBy("line_hash").agg(F.min("at").alias("first"), F.max("at").alias("final"), F.min("halves").alias("halves")))
        near = near_lines(docs.select("doc_id", "text"), lines, held, min_words).withColumn("near", F.lit(True))
        marked = cut(lines.join(near, "line_hash", "left").where("near or first < final").select("line_hash", F.when(F.col("near").isNull(), F.col("first")).alias("stays")))
        kept.append(marked)
    found = each.select("doc_id", "pos", "line_hash").join(marked, "line_hash")
    gone = F.col("stays").isNull() | ~F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) | (F.col("pos") != F.col("stays.pos"))
    return found.where(gone).select("doc_id", "pos", "line_hash")


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each doc_id of ``docs`` (doc_id, text): n_lines, n_removed and removed, the numbers of lines that go.

    Null text is one empty line, as empty text is. Lines of fewer than ``min_words`` words always stay. Rows with one
    doc_id are one document: a line that they share at one place is one line; of lines that are equal or near, the one of
    the least (doc_id, place) stays. Lines are compared whole, in time that grows with their length. An empty table gives
    no rows. Other columns are not read.
    """
    sizes = docs.groupBy("doc_id").agg(F.max(F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))).cast("long").alias("n_lines"))
    gone = repeated_lines(docs, min_words).groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    joined = sizes.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with texts without the lines that go, and n_chars, where there is one, counted anew; all rows stay.

    Null and empty texts stay as they are; rows that share an id lose the lines that they share; an empty table gives no
    rows; other columns pass through, whatever their names, but for names that start with two underscores.
    """
    gone = cut(repeated_lines(docs, min_words).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("pos", "line_hash")).alias("__gone")))
    if gone.count() <= BROADCAST_ROWS // 20:
        gone = F.broadcast(gone)
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n", -1)))
    # rows may share an id but not the text, so a line that goes is known by its hash, too
    there = F.filter("__gone", lambda g: F.unhex(F.md5(F.get("__lines", g["pos"]))) == g["line_hash"])
    joined = joined.withColumn("__at", F.array_sort(F.transform(there, lambda g: g["pos"])))
    spans = F.arrays_zip(F.concat(F.array(F.lit(-1)), "__at").alias("after"), F.concat("__at", F.array(F.size("__lines"))).alias("before"))
    kept = F.flatten(F.transform(spans, lambda x: F.slice(F.col("__lines"), x["after"] + 2, x["before"] - x["after"] - 1)))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    new = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return new.select(*[f"`{c}`" for c in docs.columns])
