"""Scoring texts by a probabilistic suffix tree over words, grown from the whole corpus.

A text is its lower-case words and an end; what stands before its first word is a sign of its own. The tree's contexts
are up to DEPTH words of training. One is retained if the distribution of what follows it differs from that of its own
suffix by more than a parameter count excuses: n times Kullback-Leibler divergence against half a logarithm of n for each
different follower, n its occurrences (Schwarz). There is no other cut, so contexts grow with the corpus. A word's distribution is that of the longest suffix
of the text so far that is in the tree, smoothed towards the next shorter one, at last towards the words' shares of all
tokens. As much mass as words were met for the first time there goes to words that training hasn't, by the spelling that
a second suffix tree, over the bytes of the distinct words, gives them (``concord.llm.spelling``). So the probabilities
of all texts add up to one.

The tree is never in one place. Texts are packed into batches of some MB. A batch asks for the total of each of its
distinct n-grams, with its own counts, and gets the totals back; each n-gram has one owner among the batches, the first
that trains on it. Longer n-grams are asked for where their contexts may be retained. Owners add up what their n-grams
tell about contexts, and every batch asks for its own contexts' verdicts. Keys travel once for each batch, sorted and
packed, dealt by range of their hashes (a context of several words that occurs once needs no verdict: it differs from its
suffix unless that has one follower); so what one task reads is bounded, whatever words are frequent. Words' keys have 63
bits; those of longer n-grams have 16 more than the corpus needs to count its tokens, so that about one in a hundred
thousand shares another's.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm import spelling
from concord.llm.common import small_batches
from concord.operators.store import cut_dealt, discard

DEPTH = 2
SMOOTH = 2  # weight of the shorter context's distribution for each different follower (Witten-Bell has 1)
FOLDS, HELD_OUT = 7, 2
CHUNK = 1 << 22  # bytes of text in a batch
PART = 1 << 20  # keys that meet in one group of a tally
WORD_BITS = 63  # of words' keys
GRAIN = 256  # divergences add up as whole numbers of 1 / GRAIN, so that no order of addition matters
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BEGIN, END = b"\n", b""  # neither can be a word
TRAIN, FIRST = 1, 2  # flags of a piece


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of murmur3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# packed arrays


def pack(arrays: list[np.ndarray], rise: bool = False) -> bytes:
    """Arrays of whole numbers from 0 as planes of bytes, compressed; with ``rise`` the first, sorted, as its steps."""
    out = []
    for i, a in enumerate(arrays):
        a = np.diff(a.astype(np.uint64), prepend=np.uint64(0)) if rise and i == 0 else a.astype(np.uint64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        out.append(np.array([len(a), width], np.uint64).tobytes())
        out.append(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, rise: bool = False) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        i = len(out)
        n, width = np.frombuffer(raw, "<u8", 2, at).astype(int)
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
        a = planes.view("<u8").reshape(-1)
        out.append(np.cumsum(a, dtype=np.uint64) if rise and i == 0 else a)
        at += 16 + n * width
    return out


# batches of text


def _slices(text: str | None) -> Iterator[tuple[list[bytes], bool]]:
    """The text's words, in runs of about CHUNK bytes, and whether a run is the last."""
    data, at = (text or "").encode().translate(LOWER), 0
    gap = re.compile(rb"[\x20\x09-\x0D]")
    while len(data) - at > CHUNK:
        found = gap.search(data, at + CHUNK)
        if not found:
            break
        yield data[at : found.start()].split(), False
        at = found.start()
    yield (data[at:] if at else data).split(), True


class _Batch:
    """Texts on their way into a batch: words by number, and of each piece the row, id, flags, size and lead.

    A lead is what stands before a piece and is only context: the begin sign, or the last words of the text's last piece.
    """

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.stream: list[np.ndarray] = []
        self.rows, self.ids, self.flags, self.sizes, self.leads, self.held = [], [], [], [], [], 0

    def add(self, row: int, id: object, flags: int, lead: list[bytes], words: list[bytes]) -> None:
        self.stream.append(np.fromiter(map(self.numbers.__getitem__, lead + words), np.uint32, len(lead) + len(words)))
        for to, x in ((self.rows, row), (self.ids, id), (self.flags, flags), (self.sizes, len(words)), (self.leads, len(lead))):
            to.append(x)
        self.held += sum(map(len, words)) + len(words)

    def done(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        stream = np.concatenate(self.stream)
        often = np.argsort(-np.bincount(stream, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        words = list(self.numbers)
        words = b" ".join([words[i] for i in often.tolist()])
        stream = pack([rank[stream]])  # small numbers for frequent words pack best
        tokens = sum(s for s, f in zip(self.sizes, self.flags, strict=True) if f & TRAIN)
        columns = [pa.array([number]), pa.array([len(words)], pa.int64()), pa.array([pa.compress(words, codec="zstd", asbytes=True)], pa.binary()), pa.array([stream], pa.binary())]
        columns += [pa.array([x], t) for x, t in ((self.rows, pa.list_(pa.int64())), (self.ids, pa.list_(kind)), (self.flags, pa.list_(pa.int32())), (self.sizes, pa.list_(pa.int32())), (self.leads, pa.list_(pa.int32())))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([tokens], pa.int64())], names=STATE)


STATE = ["batch", "words_size", "words", "stream", "rows", "ids", "flags", "sizes", "leads", "tokens"]


def pack_texts(docs: DataFrame) -> DataFrame:
    """Batches of ``docs`` (doc_id, text): columns STATE, tokens being those that train."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        row, number, held, batch = first, first, _Batch(), None
        for batch in batches:
            for id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                lead, flags = [BEGIN], (0 if out else TRAIN) | FIRST
                for words, last in _slices(text.as_py()):
                    held.add(row, id, flags, lead, [*words, END] if last else words)
                    lead, flags = (lead + words)[-DEPTH:], flags & ~FIRST
                    if held.held >= CHUNK:
                        yield held.done(number, batch.schema.field(0).type)
                        number, held = number + 1, _Batch()
                row += 1
        if held.rows:
            yield held.done(number, batch.schema.field(0).type)

    schema = f"batch long, words_size long, words binary, stream binary, rows array<long>, ids array<{kind}>, flags array<int>, sizes array<int>, leads array<int>, tokens long"
    return docs.select("doc_id", held.alias("held"), "text").mapInArrow(run, schema)


class Grams:
    """The n-grams of a batch. ``weight`` is 1 for symbols that train, ``counted`` for those that are scored."""

    def __init__(self, row: dict, bits: int):
        self.row, self.bits = row, bits
        raw = pa.decompress(row["words"], decompressed_size=row["words_size"], codec="zstd", asbytes=True)
        self.words = raw.split(b" ")
        hashes = _mix(np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words)))
        self.mask = np.uint64((1 << bits) - 1)
        keys, number = np.unique(hashes >> np.uint64(64 - WORD_BITS), return_inverse=True)
        self.number = number.astype(np.int32)  # of each word its place
        self.stream = unpack(row["stream"])[0].astype(np.int32)
        sizes, leads, flags = (np.array(row[c], np.int64) for c in ("sizes", "leads", "flags"))
        whole = sizes + leads
        self.piece = np.repeat(np.arange(len(whole), dtype=np.int32), whole)
        self.place = np.arange(len(self.stream), dtype=np.int32) - np.repeat((np.cumsum(whole) - whole).astype(np.int32), whole)
        self.counted = self.place >= leads[self.piece]
        begins = (self.place == 0) & (flags[self.piece] & FIRST > 0)
        self.weight = (self.counted | begins) & (flags[self.piece] & TRAIN > 0)
        self.hashes = self.before = hashes[self.stream]
        self.keys, self.at = [keys], [self.number[self.stream]]

    def longer(self, where: np.ndarray | None = None) -> None:
        """Add the next order of n-grams, where ``where`` holds: keys, sorted, and of each symbol the place there or -1.

        One is made from the n-gram that ended one symbol before, and its last symbol.
        """
        k = len(self.keys)
        grams = np.zeros(len(self.stream), np.uint64)
        grams[1:] = _mix(self.before[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[1:])
        self.before = grams
        there = self.place >= k if where is None else (self.place >= k) & where
        keys, at = np.unique(grams[there] & self.mask, return_inverse=True)
        full = np.full(len(self.stream), -1, np.int32)
        full[there] = at
        self.keys.append(keys)
        self.at.append(full)

    def counts(self, k: int) -> np.ndarray:
        some = self.weight & (self.at[k] >= 0)
        return np.bincount(self.at[k][some], minlength=len(self.keys[k]))


# tallies


def _ask(number: int, groups: dict[str, list[np.ndarray]], parts: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, batch, what, asked), one for each range of keys and group: sorted keys and what goes with them."""
    for what, arrays in groups.items():
        width = WORD_BITS if what == "total 1" else bits
        edges = np.array([(p << width) // parts for p in range(1, parts)], np.uint64)
        cuts = [0, *np.searchsorted(arrays[0], edges).tolist(), len(arrays[0])]
        some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        for at in range(0, len(some), 1024):
            few = some[at : at + 1024]
            asked = [pack([a[cuts[p] : cuts[p + 1]] for a in arrays], rise=True) for p in few]
            yield pa.RecordBatch.from_arrays([pa.array(few, pa.int64()), pa.array([number] * len(few), pa.int64()), pa.array([what] * len(few)), pa.array(asked, pa.binary())], names=["part", "batch", "what", "asked"])


ASKED = "part long, batch long, what string, asked binary"


def _tally(asked: DataFrame, penalty: float) -> DataFrame:
    """(batch, replies): what the rows of each part come to, given back to the batches that asked, in order of key."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        every = [unpack(x.as_py(), rise=True) for x in table.column("asked")]
        sizes = [len(x[0]) for x in every]
        keys, at = np.unique(np.concatenate([x[0] for x in every]), return_inverse=True)
        columns = [np.concatenate([x[i] for x in every]) for i in range(1, len(every[0]))]
        got = _totals(len(keys), at, *columns) if len(columns) == 1 else _verdicts(penalty, len(keys), at, *columns)
        replies = [pack([x]) for x in np.split(got, np.cumsum(sizes)[:-1])]
        return pa.table({"batch": table.column("batch"), "what": table.column("what"), "part": table.column("part"), "reply": pa.array(replies, pa.binary())})

    replies = asked.groupBy("part", "what").applyInArrow(run, "batch long, what string, part long, reply binary")
    return replies.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("what", "part", "reply"))).alias("replies"))


def _heard(replies: list[dict] | None, what: str) -> np.ndarray:
    parts = [unpack(x["reply"])[0] for x in replies or () if x["what"] == what]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _totals(n: int, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Twice each key's total, one more for its owner: the first batch that has counted it."""
    total = np.bincount(at, counts.astype(np.float64), n).astype(np.uint64)
    first = np.full(n, -1)
    some = np.flatnonzero(counts)[::-1]
    first[at[some]] = some
    return total[at] * np.uint64(2) + (first[at] == np.arange(len(at))).astype(np.uint64)


def _verdicts(penalty: float, n: int, at: np.ndarray, occurrences: np.ndarray, kinds: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Twice each context's number of different followers, one more if it is retained."""
    total = np.zeros(n)
    total[at] = occurrences
    kinds, gain = np.bincount(at, kinds.astype(np.float64), n), np.bincount(at, gain.astype(np.float64), n)
    with np.errstate(invalid="ignore"):  # an infinite penalty retains nothing
        kept = gain > GRAIN * penalty * kinds * np.log(total)
    return (2 * kinds + kept).astype(np.uint64)[at]


# the model


class _Counted(Grams):
    """A batch with the corpus's totals of its n-grams up to order ``orders``, and which of them it owns."""

    def __init__(self, row: dict, bits: int, orders: int):
        super().__init__(row, bits)
        self.replies = [x for r in row["replies"] for x in r]
        self.total, self.owned = [], []
        self._hear(1)
        for k in range(1, orders):
            self.further(k)
            self._hear(k + 1)

    def further(self, k: int) -> None:
        """Add the n-grams of order ``k`` + 1; above the second where training has their context."""
        if k == 1:
            return self.longer()
        before = np.zeros(len(self.stream), bool)
        context = self.at[k - 1][:-1]
        before[1:] = (context >= 0) & (self.total[k - 1][context] > 0)
        self.longer(before)

    def _hear(self, order: int) -> None:
        both = _heard(self.replies, f"total {order}")
        self.total.append(both >> 1)
        self.owned.append(both & 1 > 0)

    def of_words(self, values: np.ndarray) -> np.ndarray:
        return values[self.number]

    def contexts(self, order: int, tokens: int) -> list[np.ndarray]:
        """The contexts of an order that need a verdict: keys, occurrences, and the followers and divergence owned here."""
        k = order - 1
        longer, own = self.at[order], np.flatnonzero(self.owned[order])
        end = np.zeros(len(self.keys[order]), np.int64)  # a place where each n-gram ends
        there = np.flatnonzero(longer >= 0)
        end[longer[there]] = there
        end = end[own]
        n, context, suffix = self.total[order][own], self.at[k][end - 1], self.total[k][self.at[k][end]].astype(np.float64)
        wider = self.total[k - 1][self.at[k - 1][end - 1]] if k else tokens
        gain = n * np.log(n * (wider / (self.total[k][context] * suffix)))
        kinds = np.bincount(context, minlength=len(self.keys[k]))
        gain = np.rint(GRAIN * np.maximum(np.bincount(context, gain, len(self.keys[k])), 0))
        some = self.tried(order)
        return [self.keys[k][some], self.total[k][some], kinds[some], gain[some]]

    def tried(self, order: int) -> np.ndarray:
        """Which contexts of an order need a verdict."""
        return self.total[order - 1] > (order > 1)

    def spelled_words(self) -> list[bytes]:
        """The words that this batch owns."""
        own = self.of_words(self.owned[0])
        return [w for w, o in zip(self.words, own.tolist(), strict=True) if o and w not in (BEGIN, END)]


def _round(known: DataFrame, r: int, bits: int, parts: int, tokens: int, penalty: float) -> DataFrame:
    """(batch, replies) to what batches ask in round ``r``.

    At first totals of words and pairs, then of the next order, and the verdicts on contexts of order ``r``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                groups = {}
                if r == 0:
                    g = Grams(row, bits)
                    g.longer()
                    groups = {f"total {k + 1}": [g.keys[k], g.counts(k)] for k in (0, 1)}
                else:
                    c = _Counted(row, bits, r + 1)
                    groups[f"verdict {r}"] = c.contexts(r, tokens)
                    if r == 1:  # a verdict needs no more of a word's key
                        groups["verdict 1"][0] = groups["verdict 1"][0] >> np.uint64(WORD_BITS - bits)
                    if r < DEPTH:
                        c.further(r + 1)
                        groups[f"total {r + 2}"] = [c.keys[r + 1], c.counts(r + 1)]
                yield from _ask(row["batch"], groups, parts, bits)

    return _tally(known.mapInArrow(run, ASKED), penalty)


def _spellings(known: DataFrame, bits: int) -> DataFrame:
    """(key, n): byte sequences of the distinct words of training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = np.unique(spelling.sequences(_Counted(row, bits, 1).spelled_words()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return known.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _scores(row: dict, bits: int, tokens: int, kinds: int, tree: spelling.Spelling, penalty: float) -> tuple[Grams, dict[str, np.ndarray]]:
    """Of each symbol: whether training knows it, its base score, its score, how much of that is spelling, its state's depth."""
    g = _Counted(row, bits, DEPTH + 1)
    n = g.total[0][g.at[0]]
    known, new = n > 0, ~g.of_words(g.total[0] > 0)
    spelled = np.zeros(len(g.words))
    spelled[new] = tree.spell([w for w, x in zip(g.words, new.tolist(), strict=True) if x])
    spelled = np.where(known, 0.0, spelled[g.stream])
    p = np.where(known, n, max(kinds, 1)) / (tokens + max(kinds, 1))
    depth = np.zeros(len(p), np.int64)
    wider = np.zeros(0)
    for k in range(DEPTH):
        here = np.flatnonzero(g.at[k + 1] >= 0)
        context = g.at[k][here - 1]
        different, kept = np.ones(len(g.keys[k]), np.int64), np.zeros(len(g.keys[k]), bool)
        said = _heard(g.replies, f"verdict {k + 1}")
        different[g.tried(k + 1)], kept[g.tried(k + 1)] = said >> 1, said & 1 > 0
        kept = kept[context]
        if k:  # what occurs once
            kept |= (g.total[k][context] == 1) & (wider[g.at[k - 1][here - 1]] > 1) & math.isfinite(penalty)
        wider = different
        here, context = here[kept], context[kept]
        more = SMOOTH * different[context]
        p[here] = (g.total[k + 1][g.at[k + 1][here]] + more * p[here]) / (g.total[k][context] + more)
        depth[here] = k + 1
    return g, {"n_known": known, "base": np.log10(n + 1.0) - math.log10(tokens + kinds + 1), "score": np.log10(p) + spelled, "spelled": spelled, "depth": depth}


def score(docs: DataFrame, penalty: float = 0.5) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    spelling_score, mean_depth.

    Tokens are the words and one end; null text is empty, so it has the end alone. ``score`` is the model's log10
    probability of the text; ``spelling_score`` is the part of it that spells words that training hasn't. ``base_score``
    is that of add-one smoothed token counts. ``mean_depth`` is the mean length of the contexts used. Contexts are
    retained where their divergence exceeds ``penalty`` times the logarithm of n for each follower (infinite: none).
    Repeated rows train and are scored each; a text longer than CHUNK goes in pieces. A document without an id trains.
    Without training rows all words are spelled, by a uniform tree; an empty table gives no rows. Other columns are not
    read.
    """
    spark = docs.sparkSession
    tables = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = cut_dealt(pack_texts(docs.select("doc_id", "text")).repartition(tables, "batch"))
    tokens, symbols = batches.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    bits = min(63, max(symbols, 1).bit_length() + 16)
    parts = max(tables, -(-symbols // PART))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "spelled", "depth"]
    # dealt by batch once; replies come to where batches are
    known = batches.withColumn("replies", F.array().cast("array<array<struct<what:string,part:long,reply:binary>>>"))
    for r in range(DEPTH + 1):
        replies = cut_dealt(_round(known, r, bits, parts, tokens, penalty))  # what was asked goes with its shuffle files
        known = known.join(replies.select("batch", F.col("replies").alias("more")), "batch", "left").withColumn("replies", F.concat("replies", F.array_compact(F.array("more")))).drop("more")
        if r == 0:
            words = cut_dealt(_spellings(known, bits))
            kinds = (words.where(F.col("key").bitwiseAND(255) == spelling.END).agg(F.sum("n")).first()[0] or 0) + (tokens > 0)
            tree = spark.sparkContext.broadcast(spelling.grow(words))  # sparse: a count for each sequence of its contexts
            discard(words)

    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some:
            id_type = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                g, got = _scores(row, bits, tokens, kinds, tree.value, penalty)
                of_piece = lambda x: np.bincount(g.piece[g.counted], x[g.counted], len(row["rows"]))  # noqa: B023, E731
                columns = [
                    pa.array(row["rows"], pa.int64()),
                    pa.array(row["ids"], id_type),
                    pa.array([f & TRAIN == 0 for f in row["flags"]]),
                    pa.array(row["sizes"], pa.int64()),
                    *(pa.array(of_piece(got[c]).astype(t)) for c, t in (("n_known", np.int64), ("base", float), ("score", float), ("spelled", float), ("depth", float))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    pieces = known.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, spelled double, depth double")
    rows = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in names[3:]))
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", F.col("spelled").alias("spelling_score"), (F.col("depth") / F.col("n_tokens")).alias("mean_depth")
    )
