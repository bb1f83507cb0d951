"""Chat formatting with Spark expressions alone.

The turns of a conversation are collected as structs and sorted; a fold merges neighbours of one role into a run; the
runs become one string. A run reads ``<|im_start|>role\\n`` turn ``<|im_sep|>`` turn ``<|im_end|>\\n``. Control strings
inside roles and texts get a backslash after their first character (one more, if they have some), so that none but the
template's own stay and the texts can be read back exactly. ``loss_spans`` holds start and length, in code points, of
each turn that a model is trained to say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEAM, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What follows the first character, "<" or "[", of strings that tokenizers of chat models take for control.
BODY = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + BODY, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + BODY, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    pieces = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def chat_format(turns: DataFrame, say: str = "assistant") -> DataFrame:
    """One row for each conv_id of ``turns`` (conv_id, turn, role, text): conv_id, formatted, loss_spans.

    Turns stand in order of (turn, role, text), null turns first; null role and text are empty; repeated rows are
    repeated turns; rows of a null conv_id are one conversation; an empty table gives no rows. Other columns are not
    read. A conversation is one string, so it must fit into a row.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def merge(runs: Column, x: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        one = lambda parts: F.array(F.struct(x["role"].alias("role"), parts.alias("parts")))
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), one(F.concat(last["parts"], F.array(x["text"]))))
        return F.when(last["role"] == x["role"], joined).otherwise(F.concat(runs, one(F.array(x["text"]))))

    runs = F.aggregate("turns", F.array().cast("array<struct<role:string,parts:array<string>>>"), merge)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(run: Column) -> Column:
        own, said = F.lit(False), run["role"] == say
        head = F.array(segment(F.concat(F.lit(START), _escape_role(run["role"]), F.lit("\n")), own))
        part = lambda p, i: F.when(i == 0, F.array(segment(escape(p), said))).otherwise(F.array(segment(F.lit(SEAM), own), segment(escape(p), said)))
        return F.concat(head, F.flatten(F.transform(run["parts"], part)), F.array(segment(F.lit(END), own)))

    def place(acc: Column, s: Column) -> Column:
        n = F.length(s["text"])
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("chars")))
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))
    return (
        sorted_turns.select("conv_id", runs.alias("runs"))
        .select("conv_id", F.flatten(F.transform("runs", segments)).alias("segments"))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.aggregate("segments", nothing, place)["spans"].alias("loss_spans"))
    )


def parse_chat(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, that ``formatted`` was made from."""

    def turns(block: Column) -> Column:
        role = _unescape_role(F.substring_index(block, "\n", 1))
        rest = F.substr(block, F.length(F.substring_index(block, "\n", 1)) + 2)
        body = F.substr(rest, F.lit(1), F.length(rest) - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks) - 1), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["chars"]))), "")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what ``chat_format``'s rows say when they are read back: a row for each, none for none; long ones whole."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return formatted.select(
        "conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
