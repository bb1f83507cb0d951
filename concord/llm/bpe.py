"""Byte-level BPE encoding and decoding by a given rank file.

Each token's bytes, read as Latin-1, go into one Aho-Corasick automaton. A piece is encoded from the left with the
longest token that matches, going back to shorter ones where two neighbours couldn't stand side by side after the
merges; a position from which no way led on is never tried again, so the work is linear in the piece. Whether two
tokens are compatible is found by undoing their merges at the seam, latest first, and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import small_batches

#: Entries of a worker's memo tables before they start afresh; they hold nothing that can't be found again.
MEMO = 200_000


class ByteBpe:
    """Encoder and decoder for ``ranks`` (token bytes to id) after splitting by ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.size = max(self.tokens) + 1
        self.split = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)
        self.length = [0] * self.size
        self.shorter = [-1] * self.size  # longest token that is a proper prefix
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        self.automaton = ahocorasick.Automaton()
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            self.length[rank] = len(token)
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
            if len(token) > 1:
                self.halves[rank] = self._last_merge(token, rank)
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}, pattern)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two earlier tokens that merges join into ``token`` at last."""
        for n in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:n], rank), self.ranks.get(token[n:], rank)
            if a < rank and b < rank and self._side_by_side(a, b, rank):
                return a, b
        raise ValueError(f"these ranks aren't those of merges: no two earlier tokens make up {token!r}")

    def _side_by_side(self, a: int, b: int, bound: int) -> bool:
        """Whether merging keeps ``a`` and ``b`` apart, where merges from ``bound`` on don't count."""
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < bound:
                return False
            of_a, of_b = self.halves[a], self.halves[b]
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and a > b):
                bound, a = a, of_a[1]
            else:  # of equal merges the left one comes first
                bound, b = b + 1, of_b[0]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self._side_by_side(a, b, self.size)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, length, shorter = len(piece), self.length, self.shorter
        longest = [-1] * (n + 1)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank  # ends rise, so the longest from each start stays
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, token = end, longest[end]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Piece to its packed ids, filled as pieces come."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        packed = np.asarray(self.bpe.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = packed
        return packed


_loaded: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each rank file in a worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe.load(path, pattern)
    return _loaded[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", digest: str = "") -> DataFrame:
    """``docs`` with column ``ids`` (array of int): the tokens of ``text``, null text as empty.

    ``path`` is the rank file's place on every machine. All other columns pass through, whatever their names; a column
    named as ``ids`` is replaced. Empty texts give an empty array; repeated rows stay repeated; a very long text is encoded
    whole, its tokens in one row; an empty table gives no rows. With ``digest`` a column
    of that name has the SHA-256, in hex, of the bytes that the ids decode to.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(ids, *[digest] * bool(digest))
    schema = docs.withColumn(ids, F.lit(None).cast("array<int>"))
    schema = (schema.withColumn(digest, F.lit("")) if digest else schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            values, offsets, digests = [], [0], []
            for t in batch.column(text):
                values.append(packed := bpe.encode(t.as_py() or ""))
                offsets.append(offsets[-1] + len(packed) // 4)
                if digest:
                    digests.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            flat = pa.array(np.frombuffer(b"".join(values), "<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            more = [pa.array(digests, pa.string())] if digest else []
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with binary column ``out``: the bytes of the tokens in ``ids`` (null: empty); an unknown id is an error."""
    small_batches(df.sparkSession)
    schema = df.drop(out).withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            decoded = [bpe.decode(array("i", x.as_py() or []).tobytes()) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, out])

    return df.drop(out).mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_tokens, digests of the ids and of the bytes they decode to.

    Encodes and decodes in one pass, so that ids needn't travel. Null text is empty; ids and digests of an empty text
    are those of no bytes. Repeated rows stay; a very long text is encoded whole; an empty table gives no rows. Extra
    columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for t in batch.column(1):
                packed = bpe.encode(t.as_py() or "")
                n.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
