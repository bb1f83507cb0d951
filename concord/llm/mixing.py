"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

A source's words come near a target, so each of its documents is due ``target / size of the source`` copies: a whole
part and a fraction. Fractions are rounded in pairs: mass (fraction times size) moves from one document to the other,
in a direction drawn so that expectations hold, until one of them is whole; the other goes on. A block of some hundred
documents is folded this way into at most one fractional document; the residuals of neighbouring blocks meet in the
next level of a reduction tree, until one is left in each source. So a source's words differ from its target by less
than one document. All draws are hashes of what they decide on, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import WORD, cut

WEIGHTS, CAP, BLOCK, SEED = (5.0, 2.0, 1.0), 3, 256, 20
BROADCAST_ROWS = 100_000  # sources: some dozen bytes each
TINY = 1e-9


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: ``share`` of all words, dealt by weight.

    Weights repeat over the sources in code point order, null last. Targets stop at ``cap`` times the source's size; the
    excess is dealt again by weight until none is above. That is min(cap, level * weight) for one level, found here from
    sums over the sources in the order in which they reach their cap. One row for each source meets in one task.
    """
    in_order, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    at = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (at + 1).cast("int"))
    reached = Window.orderBy("__full", "__at").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__sum") - F.coalesce(F.sum("__cap").over(reached), F.lit(0.0))
    weights_left = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(reached), F.lit(0.0))
    table = (
        sizes.select("source", "source_size", F.row_number().over(in_order).alias("__at"), weight.alias("__w"), (F.col("source_size") * float(cap)).alias("__cap"))
        .withColumn("__full", F.col("__cap") / F.col("__w"))
        .withColumn("__sum", F.sum("source_size").over(every) * float(share))
        .withColumn("__level", left / weights_left)
        .withColumn("__rank", F.row_number().over(Window.orderBy("__full", "__at")))
    )
    level = F.min(F.when(F.col("__level") <= F.col("__full") * (1 + 1e-12), F.struct("__rank", "__level"))).over(every)["__level"]
    return table.select("source", "source_size", F.least(F.col("__cap"), level * F.col("__w")).alias("target"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _unit() -> list[str]:
    return ["doc_id", "source", "size", "text_hash"]


def _settle(level: int) -> Callable[[Column, Column], Column]:
    """A step of the fold: mass moves between the carried unit, struct of h, p and size, and the next one."""

    def settle(acc: Column, x: Column) -> Column:
        a = acc["carry"]
        draw = F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), a["h"], x["h"]), F.lit(1 << 30)) / float(1 << 30)
        masses = F.struct(
            ((1 - a["p"]) * a["size"]).alias("a_up"), (a["p"] * a["size"]).alias("a_down"), ((1 - x["p"]) * x["size"]).alias("x_up"), (x["p"] * x["size"]).alias("x_down"), draw.alias("draw")
        )

        def move(m: Column) -> Column:
            up, down = F.least(m["a_up"], m["x_down"]), F.least(m["a_down"], m["x_up"])
            return F.struct((m["draw"] * (up + down) < down).alias("up"), up.alias("by_up"), down.alias("by_down"), *(m[k].alias(k) for k in ("a_up", "a_down", "x_up", "x_down")))

        def snap(p: Column) -> Column:
            return F.when(p < TINY, 0.0).when(p > 1 - TINY, 1.0).otherwise(p)

        def after(m: Column) -> Column:
            pa = F.when(m["up"], F.when(m["a_up"] <= m["x_down"], 1.0).otherwise(a["p"] + m["by_up"] / a["size"])).otherwise(F.when(m["a_down"] <= m["x_up"], 0.0).otherwise(a["p"] - m["by_down"] / a["size"]))
            px = F.when(m["up"], F.when(m["x_down"] <= m["a_up"], 0.0).otherwise(x["p"] - m["by_up"] / x["size"])).otherwise(F.when(m["x_up"] <= m["a_down"], 1.0).otherwise(x["p"] + m["by_down"] / x["size"]))
            return F.array(a.withField("p", snap(pa)), x.withField("p", snap(px)))

        def sort_out(both: Column) -> Column:
            open_ = F.filter(both, lambda u: (u["p"] > 0) & (u["p"] < 1))
            done = F.filter(both, lambda u: (u["p"] <= 0) | (u["p"] >= 1))
            return F.struct(F.try_element_at(open_, F.lit(1)).alias("carry"), F.concat(acc["decided"], done).alias("decided"))

        moved = _let(_let(masses, move), lambda m: _let(after(m), sort_out))
        return F.when(a.isNull(), F.struct(x.alias("carry"), acc["decided"].alias("decided"))).otherwise(moved)

    return settle


def round_copies(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """Column ``extra`` (0 or 1) for each row of ``units`` (source, h long, p in (0, 1), size > 0, n: rows of its source)."""
    names = [c for c in units.columns if c not in ("p", "n")]
    item = F.struct("h", *[c for c in names if c != "h"], "p")
    kind = units.select(item.alias("u")).schema["u"].dataType.simpleString()
    now = units.select("source", F.pmod(F.xxhash64(F.lit(SEED + 1), "h"), F.ceil(F.col("n") / block)).alias("block"), F.col("h").alias("__h"), item.alias("u"), F.ceil(F.col("n") / block).alias("blocks"))
    done, level = None, 0
    while True:
        none = F.struct(F.lit(None).cast(kind).alias("carry"), F.array().cast(f"array<{kind}>").alias("decided"))
        folded = now.groupBy("source", "block").agg(F.sort_array(F.collect_list("u")).alias("items"), F.max("blocks").alias("blocks"))
        folded = cut(folded.select("source", "block", "blocks", F.aggregate("items", none, _settle(level)).alias("x")))
        last = folded.agg(F.max("blocks")).first()[0] in (None, 1)
        more = folded.select(F.explode("x.decided").alias("u"))
        done = more if done is None else done.unionByName(more)
        carried = folded.where("x.carry is not null").select("source", "block", "blocks", F.col("x.carry").alias("u"))
        if last:
            draw = F.pmod(F.xxhash64(F.lit(SEED + 2), F.col("u.h")), F.lit(1 << 30)) / float(1 << 30)
            final = carried.select(F.col("u").withField("p", F.when(draw < F.col("u.p"), 1.0).otherwise(0.0)).alias("u"))
            return done.unionByName(final).select(*[F.col(f"u.{c}").alias(c) for c in names], F.col("u.p").cast("int").alias("extra"))
        now = carried.select("source", F.floor(F.col("block") / block).alias("block"), F.col("u.h").alias("__h"), "u", F.ceil(F.col("blocks") / block).alias("blocks"))
        level += 1


def _round_by_size(units: DataFrame, cap: float) -> DataFrame:
    """``round_copies``, the large documents first: ``whole`` and ``extra`` of each unit.

    What rounding the documents over twice the mean size leaves over moves, in equal parts, to the others, so that a
    source ends within one of the small ones from its target. It is 0 in expectation. Where the part lifts a document's
    due copies over a whole number or below one, ``whole`` follows; only none and ``cap`` for each row stop it.
    """
    large = F.col("size") * F.col("n") > 2 * F.col("source_size")
    first = cut(round_copies(units.where(large).withColumn("due", F.col("p"))))
    small = units.where(~large)
    over = first.groupBy("source").agg(F.sum(F.col("size") * (F.col("due") - F.col("extra"))).alias("over"))
    room = small.groupBy("source").agg(F.sum("size").alias("room"))
    shift = cut(room.join(over.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).select("__s", (F.col("over") / F.col("room")).alias("shift")))
    if shift.count() <= BROADCAST_ROWS:
        shift = F.broadcast(shift)
    due = F.col("whole") + F.col("p") + F.coalesce(F.col("shift"), F.lit(0.0))
    moved = small.join(shift, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("due", F.greatest(F.lit(0.0), F.least(F.col("n_rows") * float(cap), due))).drop("__s", "shift")
    whole, rest = _parts("due")
    moved = moved.withColumn("whole", whole).withColumn("p", rest).drop("due")
    settled = moved.where("p = 0").drop("p", "n").withColumn("extra", F.lit(0))
    return first.drop("due").unionByName(round_copies(moved.where("p > 0"))).unionByName(settled)


def _parts(due: str) -> tuple[Column, Column]:
    """Whole copies and the fraction of one; a fraction next to 0 or 1 is taken for it."""
    whole = F.floor(due)
    rest = F.col(due) - whole
    return F.when(rest > 1 - TINY, whole + 1).otherwise(whole), F.when((rest < TINY) | (rest > 1 - TINY), 0.0).otherwise(rest)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """Documents of ``docs`` (doc_id, text, source): doc_id, source, size, text_hash, n_rows, source_size, target, copies.

    Rows equal in doc_id, source and text are one document with ``n_rows`` rows and ``copies`` for all of them, at most
    ``cap`` for each. Size is the count of words of the whole text; null and empty ones have none, and documents without
    words get no copies. Null ids and sources are values like others; ties are drawn by hash. An empty table gives no
    rows. The sources, but never their documents, meet in one task. Other columns are not read.
    """
    units = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")).groupBy(*_unit()).agg(F.count(F.lit(1)).alias("n_rows"))
    units = cut(units)
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = cut(sources)
    targets = source_targets(sources.select("source", "source_size"), weights, cap, share).join(sources.select(F.col("source").alias("__s"), "n"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    if sources.count() <= BROADCAST_ROWS:
        targets = F.broadcast(cut(targets))
    due = F.when(F.col("size") > 0, F.col("n_rows") * (F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole, rest = _parts("due")
    joined = units.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("due", due)
    joined = joined.withColumn("whole", whole).withColumn("p", rest).drop("due")
    joined = joined.withColumn("h", F.xxhash64(F.lit(SEED + 3), *_unit()))
    out = [*_unit(), "n_rows", "source_size", "target"]
    settled = joined.where("p = 0").select(*out, F.col("whole").alias("copies"))
    rounded = _round_by_size(joined.where("p > 0").select("h", *_unit(), "n_rows", "source_size", "target", "whole", "p", "n"), cap)
    return settled.unionByName(rounded.select(*out, (F.col("whole") + F.col("extra")).alias("copies")))


def mix_rows(plan: DataFrame) -> DataFrame:
    """A row for each row that ``mix_plan`` read, with the words taken from it; copies are dealt evenly over equal rows."""
    rows = plan.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    copies = F.floor(F.col("copies") / F.col("n_rows")) + F.when(F.col("__row") <= F.col("copies") % F.col("n_rows"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"), "source")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each document as often as the mix takes it; edge cases as in ``mix_plan``.

    Rows equal in doc_id, source and text are one document; its copies carry the least of their other columns.
    """
    key = docs.select("*", word_count(F.col("text")).alias("__size"), F.xxhash64("text").alias("__text"))
    plan = mix_plan(docs, **how).select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"), F.col("text_hash").alias("__t"), "n_rows", F.col("copies").alias("__copies")).where("__copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n")) & (F.col("__text") == F.col("__t"))
    taken = key.join(plan, same)
    once = taken.where("n_rows = 1").select(*docs.columns, "__copies")
    first = taken.where("n_rows > 1").groupBy("__d", "__s", "__n", "__t").agg(F.min(F.struct(*docs.columns)).alias("x"), F.max("__copies").alias("__copies")).select("x.*", "__copies")
    every = once.unionByName(first)
    return every.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
