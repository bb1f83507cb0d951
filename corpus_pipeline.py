"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, mixing and encoding.

Each stage takes what the one before kept, whole. All but the last return the columns of documents; the last returns
doc_id, lang, source, n_tokens, ids (array of int) and decoded_sha256, of the bytes that the ids decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import bpe, linededup, mixing, probminhash, quality
from concord.llm.common import cut, read
from concord.llm.queries import vocabulary
from concord.operators.store import discard, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null and empty texts go; other columns stay."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has; n_chars anew. Null texts stay."""
    return linededup.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts without words stay. Other columns stay."""
    return probminhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those without words go. Other columns stay."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document's whole text and the digest of what they decode to; null text is empty."""
    path, pattern = vocabulary()
    ids = bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, digest="decoded_sha256")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]
#: Near-dedup draws registers and mixing draws copies by hashes that SQL hasn't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written is deleted once the next one's rows are.

    Null and empty texts fail the quality rules; repeated rows count as copies; an empty table gives no rows.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch() as kept:
            docs = cut(stage(spark, docs, sf_dir))
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
