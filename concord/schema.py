"""Schemas, column names and parameters of the linkage pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Names of sources, columns and files that inputs and outputs have.
SOURCES = ("source1", "source2", "source3")
SPLITS = ("train", "test")
SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
CANDIDATE_COLUMNS = ["source1_entity_id", "candidate_entity_ids"]
MATCH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]
PAIR_IDS = ["source1_entity_id", "candidate_entity_id", "candidate_source"]
PAIR_FEATURES = [
    "name_exact_match",
    "address_exact_match",
    "name_jaccard_similarity",
    "address_jaccard_similarity",
    "name_levenshtein_distance",
    "address_levenshtein_distance",
    "name_levenshtein_similarity",
    "address_levenshtein_similarity",
    "name_tfidf_cosine_similarity",
    "address_tfidf_cosine_similarity",
    "name_exact_token_match",
    "address_exact_token_match",
    "name_token_overlap_count",
    "address_token_overlap_count",
    "name_token_containment",
    "address_token_containment",
    "name_token_count_source1",
    "name_token_count_candidate",
    "address_token_count_source1",
    "address_token_count_candidate",
    "name_character_length_ratio",
    "address_character_length_ratio",
    "address_exact_numeric_token_match",
    "address_exact_postal_code_match",
    "address_first_number_match",
    "country_exact_match",
]
ID_PREFIX = {"source1": "S1-", "source2": "S2-", "source3": "S3-"}

SOURCE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in SOURCE_COLUMNS])
#: What no entity id may hold: it would break the lists and files that ids stand in.
BAD_ID = r"[,\t\r\n]"


@dataclass(frozen=True)
class BlockingConfig:
    """Parameters of candidate generation; ``max_candidates`` of None keeps all."""

    n_features: int = 1 << 20
    ngrams: tuple[int, int] = (2, 5)
    max_name_features: int = 48
    max_address_features: int = 48
    num_perm: int = 32
    bands: int = 16
    max_candidates: int | None = 500

    def __post_init__(self) -> None:
        low, high = self.ngrams
        if self.n_features < 1 or low < 1 or high < low or min(self.max_name_features, self.max_address_features) < 1:
            raise ValueError("n_features, ngrams and feature limits must be positive, ngrams in order")
        if self.bands < 1 or self.num_perm % self.bands:
            raise ValueError("num_perm must be a multiple of bands")
        if self.max_candidates is not None and self.max_candidates < 1:
            raise ValueError("max_candidates must be positive or None")


def require_columns(found: list[str], wanted: list[str]) -> None:
    if missing := [c for c in wanted if c not in found]:
        raise ValueError(f"missing columns {missing}; found {found}")
