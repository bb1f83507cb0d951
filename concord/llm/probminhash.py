"""Near-duplicate detection by ProbMinHash, banding and verification.

Each distinct shingle of a text sends arrivals of a Poisson process, at the rate of its weight, to registers drawn at
random; a register keeps the shingle that arrived first. Two texts agree in a register with the probability Jaccard of
their weighted shingles. A shingle whose next arrival comes after all registers are taken by earlier ones stops. Weights
lie between 1 and a bound, so a pair whose plain Jaccard similarity is the threshold has a probability Jaccard of at
least the threshold over that bound; bands and the comparison of signatures allow for that.

Equal texts are one node. Nodes that agree in a band meet in a bucket. There each node is verified against the one that
meets most others, so a large group costs one link for each member. Buckets that then still hold several components are
compared in blocks of bounded size, and only links that join components leave those. Pairs are verified where their whole
signatures agree as often as those of similar texts do. A link is an exact Jaccard
similarity of the distinct shingles of at least the threshold; linked nodes form classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import cut, small_batches
from concord.operators.store import cut_dealt, cut_freed, discard, scratch

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 4  # a pair shares no band with probability 7e-10 at 0.8, 6e-4 at 0.64, the least that weights make of it
HEAVIEST = 1.25  # weight of a shingle, at most; the least is 1
SEGMENT = 1 << 22  # bytes that are hashed at once
CHUNK = 1 << 21  # bytes of text that are worked on at once
BLOCK = 1000  # nodes of a bucket that meet those of another block in one task
SIGMAS = 5  # how far below the threshold a signature's estimate may lie
BROADCAST_ROWS = 200_000  # of 16-byte nodes

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWER = np.uint64(0xD6E8FEB86659FD93)
_LETTER = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
_LETTER[_SPACE] = 0


def _word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text."""
    text = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    space = _SPACE[text]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.cumsum([len(x) + 1 for x in data])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    out = np.zeros(len(starts), np.uint64)
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(text), SEGMENT)), len(starts)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        low, high = starts[a], starts[b] if b < len(starts) else len(text)
        if high - starts[b - 1] > SEGMENT:  # the last word may be longer than a segment
            out[b - 1] = _long_hash(text[starts[b - 1] : high])
            high, b = starts[b - 1], b - 1
        if b > a:
            place = np.arange(high - low) - np.repeat(starts[a:b] - low, np.diff(starts[a:b], append=high))
            powers = np.cumprod(np.full(int(place.max()) + 1, _POWER, np.uint64))
            out[a:b] = np.add.reduceat(_LETTER[text[low:high]] * powers[place], starts[a:b] - low)
    return _mix(out), counts


def _long_hash(word: np.ndarray) -> np.uint64:
    powers, total = np.cumprod(np.full(SEGMENT, _POWER, np.uint64)), 0
    for at in range(0, len(word), SEGMENT):
        part = _LETTER[word[at : at + SEGMENT]]
        total += int((part * powers[: len(part)]).sum()) * pow(int(_POWER), at, 1 << 64)
    return np.uint64(total % (1 << 64))


def shingle_sets(data: list[bytes], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted hashes of its distinct shingles and their counts.

    A text of fewer words than ``size`` has one shingle, all its words; one without words has none.
    """
    words, counts = _word_hashes(data)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(size):
        rolled[: len(words) - k] = rolled[: len(words) - k] * np.uint64(0xA0761D6478BD642F) + words[k:]
    rolled = _mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1], return_counts=True))
        elif n:
            one = np.array([n], np.uint64)
            for w in words[at : at + n]:
                one = _mix(one * _GOLD ^ w)
            out.append((one, np.array([1])))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        at += n
    return out


#: Weight of a shingle by its count in the text, from 1 to HEAVIEST: a passage that is said again counts for more.
WEIGHTS = {"log": lambda counts: 1 + np.minimum(np.log(counts) / 8, HEAVIEST - 1), "one": lambda counts: np.ones(len(counts))}


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``m`` registers for each text (shingles, weights); zeros where there are no shingles."""
    sizes = [len(e) for e, _ in texts]
    e = np.concatenate([x for x, _ in texts]) if texts else np.zeros(0, np.uint64)
    w = np.concatenate([x for _, x in texts]) if texts else np.zeros(0)
    d = np.repeat(np.arange(len(texts)), sizes)
    time = np.zeros(len(e))
    taken = np.full((len(texts), m), np.inf)
    held = np.zeros((len(texts), m), np.uint64)
    flat, kept = taken.reshape(-1), held.reshape(-1)
    turn = 0
    while len(e):
        x = _mix(e + np.uint64(turn * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((x >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / w
        at = d * m + (_mix(x ^ _GOLD) % np.uint64(m)).astype(np.int64)
        ahead = time < flat[at]
        at, t = at[ahead], time[ahead]
        np.minimum.at(flat, at, t)
        won = flat[at] == t
        kept[at[won]] = e[ahead][won]
        on = time < taken.max(axis=1)[d]
        e, w, d, time = e[on], w[on], d[on], time[on]
        turn += 1
    return held


def band_keys(held: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, m = held.shape
    parts = held.reshape(n, bands, m // bands)
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], n, axis=0) * _GOLD
    for k in range(m // bands):
        key = _mix(key ^ parts[:, :, k]) * np.uint64(0xA0761D6478BD642F)
    return key


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Offset and texts (null: empty) of runs of rows with about CHUNK bytes."""
    start, held, size = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        held.append((x.as_py() or "").encode())
        size += len(held[-1])
        if size >= CHUNK:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def sign(docs: DataFrame, weights: str = "log") -> DataFrame:
    """(doc_id, node, keys, sketch) of ``docs`` (doc_id, text): node is the MD5 of the text, null if it has no words."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "node", "keys", "sketch"]
    weigh = WEIGHTS[weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in _chunks(batch, 1):
                sets = shingle_sets(data)
                held = signatures([(e, weigh(n)) for e, n in sets])
                keys = band_keys(held)
                some = [len(e) > 0 for e, _ in sets]
                node = [hashlib.md5(x).digest() if s else None for x, s in zip(data, some, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(data) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                sketch = pa.array([x.tobytes() for x in _mix(held).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(data)), pa.array(node, pa.binary()), lists, sketch], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node binary, keys array<long>, sketch binary")


def _shingles(texts: DataFrame) -> DataFrame:
    """(node, shingles) of ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in _chunks(batch, 1):
                sets = [e.view(np.int64) for e, _ in shingle_sets(data)]
                offsets = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(data)), lists], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node binary, shingles array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted`` (node; stored), from one row of each text: the one of its least doc_id."""
    rows = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"))
    firsts = wanted.join(nodes.select("node", "first"), "node")
    if wanted.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    texts = rows.join(firsts.withColumnRenamed("node", "__node"), (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("first")))
    return _shingles(texts).groupBy("node").agg(F.max("shingles").alias("shingles"))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` (stored) whose texts' shingles have at least the threshold in common; stored."""
    with scratch() as kept:
        wanted = cut_freed(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        sets = cut_freed(_sets(docs, nodes, wanted))
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        joined = pairs.join(a, "a").join(b, "b")
        kept.append(cut_freed(joined.where(both >= threshold * (F.size("of_a") + F.size("of_b") - both) - 1e-9).select("a", "b")))
    return kept[0]


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``links`` (a, b): the least node that each is connected to; stored.

    Each round gives a node the least label around it and then that label's own label; chains halve, and labels are
    written to the checkpoint folder between rounds.
    """
    with scratch() as kept:
        both = cut_freed(links.select("a", "b").union(links.select("b", "a")).distinct())
        now = cut_freed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
        while True:
            labels = now.select("node", "label")
            around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("around"))
            near = cut_freed(labels.join(around, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "around").alias("near")))
            up = near.select(F.col("node").alias("__up"), F.col("near").alias("__label"))
            new = cut_freed(near.join(up, F.col("near") == F.col("__up"), "left").select("node", F.coalesce("__label", "near").alias("label"), "old"))
            discard(now)
            discard(near)
            if new.where("label != old").isEmpty():
                kept.append(new)
                return new.select("node", "label")
            now = new


def _least_alike(threshold: float) -> float:
    """Registers in which signatures of a pair at the threshold agree at least, but for one pair in some millions.

    Each shared shingle's share of arrivals is at least 1 / (HEAVIEST * shingles of both), whatever the weights.
    """
    m, p = BANDS * ROWS, threshold / HEAVIEST
    return p * m - SIGMAS * (m * p * (1 - p)) ** 0.5


def _alike(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose signatures agree as often as those of similar texts do."""
    sketch = nodes.select("node", "sketch")
    a, b = sketch.withColumnsRenamed({"node": "a", "sketch": "of_a"}), sketch.withColumnsRenamed({"node": "b", "sketch": "of_b"})
    least = _least_alike(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("of_a", "of_b"))
            some = pa.array(np.flatnonzero((x == y).sum(axis=1) >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(some), batch.column("b").take(some)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node of ``buckets`` (key, node, n) with its bucket's center: the node that meets most others.

    The text that a group's copies were made from agrees with each of them more than they do with one another; it is
    in the large buckets of all bands.
    """
    met = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    center = buckets.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("center"))
    pairs = buckets.select("key", "node").join(center, "key").where("node != center")
    return pairs.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` (key, node, ...) with i and j: a bucket's nodes are dealt over blocks, and each pair of blocks meets once."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "own", "other")


def _groups(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Nodes, and a number for each one's component."""
    labels: dict[bytes, int] = {}
    return table.column("node").to_pylist(), np.array([labels.setdefault(x, len(labels)) for x in table.column("label").to_pylist()])


def _unresolved(nodes: DataFrame, buckets: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(key, node, label) of nodes whose signature is like that of a node of another component in their bucket."""
    member = cut_freed(buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    # the one pair of a bucket of two was a star's
    several = member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("n > 2 and x < y").select("key")
    dealt = _blocks(cut_freed(member.join(several, "key", "left_semi").join(nodes.select("node", "sketch"), "node")))
    least = _least_alike(threshold)

    def alike(table: pa.Table) -> pa.Table:
        node, group = _groups(table)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        some = [x for x in range(len(node)) if (((sketch == sketch[x]).sum(axis=1) >= least) & (group != group[x])).any()]
        return table.select(["key", "node", "label"]).take(pa.array(some, pa.int64()))

    return dealt.groupBy("key", "i", "j").applyInArrow(alike, "key long, node binary, label binary").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of ``sets`` share: frequent ones by matrix products, others by their lists."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    frequent = np.flatnonzero(times >= 32)
    for start in range(0, len(frequent), 2048):
        column = np.full(len(times), -1)
        part = frequent[start : start + 2048]
        column[part] = np.arange(len(part))
        there = column[at] >= 0
        x = np.zeros((n, len(part)), np.float32)
        x[row[there], column[at][there]] = 1
        out += x @ x.T
    rare = (times[at] > 1) & (times[at] < 32)
    order = np.argsort(at[rare], kind="stable")
    rows, ends = row[rare][order], np.cumsum(times[(times > 1) & (times < 32)])
    for k in range(1, 32):  # pairs of the same element that stand k apart
        same = np.searchsorted(ends, np.arange(len(rows) - k), side="right") == np.searchsorted(ends, np.arange(k, len(rows)), side="right") if len(rows) > k else np.zeros(0, bool)
        a, b = rows[: max(0, len(rows) - k)][same], rows[k:][same]
        np.add.at(out, (a, b), 1)
        np.add.at(out, (b, a), 1)
    return out


def _joining(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components of ``members`` (key, node, label): in each block as few as join all that can be."""

    def links(table: pa.Table) -> pa.Table:
        node, group = _groups(table)
        sets = [x.values.to_numpy() for x in table.column("shingles").combine_chunks()]
        sizes = np.array([len(s) for s in sets], np.float32)
        both = _common(sets)
        near = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-4
        found = []
        for x in range(len(node)):
            for y in np.flatnonzero(near[x] & (group != group[x])).tolist():
                if group[x] != group[y]:
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
                    group[group == group[y]] = group[x]
        return pa.table({"a": pa.array([p[0] for p in found], pa.binary()), "b": pa.array([p[1] for p in found], pa.binary())})

    return _blocks(cut_freed(members.join(sets, "node"))).groupBy("key", "i", "j").applyInArrow(links, "a binary, b binary").distinct()


def _links(docs: DataFrame, nodes: DataFrame, buckets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Verified links that join all that can be joined, and the components' labels.

    After the stars come the buckets that still hold several components: their nodes that are like one of another
    component meet in blocks, where sets are compared and only the links that join components leave.
    """
    links = _verified(docs, nodes, cut_freed(_alike(nodes, _stars(buckets), threshold)), threshold)
    labels = components(links)
    with scratch() as kept:
        rest = cut_freed(_unresolved(nodes, buckets.select("key", "node"), labels, threshold))
        if rest.isEmpty():
            return links, labels
        more = cut_freed(_joining(rest, _sets(docs, nodes, cut_freed(rest.select("node").distinct())), threshold))
        kept.append(more)
    if more.isEmpty():
        return links, labels
    links = links.union(more)
    return links, components(links)


def classes(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "log") -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row, and (node, class_id, keeper, n_links, n_rows) of each node.

    class_id is the least doc_id of the class, ``keeper`` the least node that has it; ``n_links`` counts the links to other
    texts that hold the class together, ``n_rows`` the rows of the text.
    """
    docs = docs.select("doc_id", "text")
    signed = sign(docs, weights)
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows"), F.max("keys").alias("keys"), F.max("sketch").alias("sketch"))
    # tables that are read again are written, not persisted: plans that read a written one don't hold its own plan, and a
    # persisted table made from a dealt one isn't known again where a plan reads it twice, so it was made anew each time
    with scratch() as kept:
        nodes = cut_dealt(nodes)
        each = nodes.select(F.explode("keys").alias("key"), "node")
        shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        buckets = cut_freed(each.join(shared, "key"))
        links, labels = _links(docs, nodes, buckets, threshold)
        degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
        linked = labels.join(degree, "node")
        grouped = cut_freed(nodes.select("node", "first", "n_rows").join(linked, "node", "left").withColumn("label", F.coalesce("label", "node")))
        of_class = grouped.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("no"), F.col("first").alias("first"), F.col("node").alias("node"))).alias("x"))
        of_class = of_class.select("label", F.col("x.first").alias("class_id"), F.col("x.node").alias("keeper"))
        table = cut(grouped.join(of_class, "label").select("node", "class_id", "keeper", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_rows"))
        kept.append(table)
    rows = docs.select("doc_id", F.when(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5("text"))).alias("node"))
    return rows, table


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "log") -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_rows.

    Whole texts are compared, however long, in memory of some times their size. Of ties the least doc_id gives the class
    its id. Repeated rows are of one class; an empty table gives no rows. Texts without words (null or empty ones, too) are never duplicates: class_id is their own doc_id, n_links 0, n_rows 1.
    Rows without an id have their class's id, null if none in it has one. Other columns are not read.
    """
    rows, table = classes(docs, threshold, weights)
    joined = rows.join(table, "node", "left")
    return joined.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_rows", F.lit(1)).cast("long").alias("n_rows"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "log") -> DataFrame:
    """``docs`` without near duplicates: of each class the row with the least doc_id stays, as do texts without words.

    Of rows equal in doc_id and text the one with the least other columns stays.
    """
    _, table = classes(docs, threshold, weights)
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__doc"), F.when(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5("text"))).alias("__node"))
    keepers = table.where("node = keeper").select(F.col("node").alias("__keeper"), "class_id", "n_rows")
    kept = whole.where("__node is not null").join(keepers, F.col("__node") == F.col("__keeper")).where(F.col("__doc.doc_id").eqNullSafe(F.col("class_id")))
    once = kept.where("n_rows = 1").select("__doc")
    first = kept.where("n_rows > 1").groupBy("__node").agg(F.min("__doc").alias("__doc")).select("__doc")
    return once.union(first).union(whole.where("__node is null").select("__doc")).select("__doc.*")
