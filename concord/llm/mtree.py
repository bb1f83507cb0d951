"""Exact top-k search by inner product in M-trees.

With one more component, the root of the greatest squared norm minus its own, vectors are equally long, and the greatest
inner product with a query is the least Euclidean distance to it. Vectors are dealt over trees of bounded size. A tree is
paged: leaf pages hold vectors around a routing object, directory pages hold leaves around theirs; every entry has its
distance to the page's routing object, every page a covering radius. A query visits pages by the least distance that
their radius allows and stops when the next lies beyond its k-th best; inside a page, entries whose stored distance to
the routing object differs from the query's by more than the k-th best distance are ruled out.
Queries meet trees in blocks, and pages in rounds, so that one product of matrices serves all queries of a block that need
a page; an entry is left out of it if no query needs it. The best of all trees are merged. No tree starts without a bound: the k-th best score among
SEED vectors, which are as good as any, is one that the answer can't be below. Scores are exact integers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import cut, small_batches

SCALE, K, EVERY = 64, 20, 20
LEAF, FAN = 128, 16  # entries of a leaf page and of a directory page
TREE, BLOCK = 16384, 256  # vectors of a tree, queries of a block
FRESH = 8  # hits for each query of a block after which bounds are drawn anew
HELD = 4  # trees that a task holds at once
SEED = 4096  # vectors, any of them, that every block of queries is first held against
SLACK = 1e-6  # relative, for distances in floating point
SAFE = 1 << 20  # components up to here have exact products in a double; others are multiplied as whole numbers


def _near(points: np.ndarray, size: int, start: int) -> list[np.ndarray]:
    """Split rows into groups of at most ``size`` that lie close: halves by which of two far points is nearer."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        some = points[rows]
        far = lambda x: ((some - points[x]) ** 2).sum(axis=1)
        a = rows[int(np.argmax(far(rows[start % len(rows)])))]
        to_a = far(a)
        b = rows[int(np.argmax(to_a))]
        order = np.argsort(to_a - far(b), kind="stable")
        half = len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def _distance(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(axis=1))


def _middle(points: np.ndarray, rows: np.ndarray) -> int:
    """The row nearest to the mean: the routing object."""
    return int(rows[int(np.argmin(_distance(points[rows], points[rows].mean(axis=0))))])


@dataclass
class Page:
    """Its routing object and covering radius; the numbers of its entries, (first, last) or pages, their distances to the
    routing object and, of pages, their radii."""

    route: np.ndarray
    radius: float
    entries: np.ndarray | tuple[int, int]
    stored: np.ndarray
    radii: np.ndarray | None
    routes: np.ndarray | None


class MTree:
    """Pages over integer vectors: leaves, and directories over them, up to one root."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        """``ids`` and the rows of ``vectors`` (int64) are put into page order."""
        points = vectors.astype(np.float64)
        self.exact = bool(len(points)) and float(np.abs(points).max(initial=0)) <= SAFE
        norms = (points**2).sum(axis=1)
        self.top = norms.max() if len(norms) else 0.0
        lifted = np.hstack([points, np.sqrt(np.maximum(self.top - norms, 0))[:, None]])
        self.pages: list[Page] = []
        order, level, at = [], [], 0
        for rows in _near(lifted, LEAF, 0) if len(lifted) else []:
            route = lifted[_middle(lifted, rows)]
            stored = _distance(lifted[rows], route)
            level.append(len(self.pages))
            self.pages.append(Page(route, float(stored.max()), (at, at + len(rows)), stored, None, None))
            order.append(rows)
            at += len(rows)
        while len(level) > 1:
            routes, numbers, above = np.array([self.pages[i].route for i in level]), np.array(level), []
            for some in _near(routes, FAN, 0):
                route, under = routes[_middle(routes, some)], numbers[some]
                stored, radii = _distance(routes[some], route), np.array([self.pages[i].radius for i in under])
                above.append(len(self.pages))
                self.pages.append(Page(route, float((stored + radii).max()), under, stored, radii, routes[some]))
            level = above
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.computed = self.products = 0  # scores, and the products of matrices that gave them

    def search(self, query: np.ndarray, own: int | None, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The ``k`` greatest (score, vec_id) of at least ``floor``, ties to the smaller id, without the rows of id ``own``."""
        _, ids, scores = self.search_block(query[None, :], None if own is None else np.array([own]), k, np.array([floor]))
        return list(zip(scores.tolist(), ids.tolist(), strict=True))

    def search_block(self, queries: np.ndarray, own: np.ndarray | None, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``search`` for each row of ``queries``: (row, vec_id, score), in order of row and rank.

        Each query has its own bounds and visits leaves by the least distance that they allow. They go in rounds, the nearest
        one first, then the next few, then more, so that the queries that need a page in a round meet it in one product.
        """
        empty = np.zeros(0, np.int64)
        if not len(self.ids) or not len(queries):
            return empty, empty, empty
        n = self.vectors.shape[1]
        q = np.zeros((len(queries), n), np.int64)
        q[:, : min(n, queries.shape[1])] = queries[:, :n]
        exact = self.exact and not (q.size and np.abs(q).max() > SAFE)
        flat = q.astype(np.float64)
        points = np.hstack([flat, np.zeros((len(q), 1))])
        shift = (flat**2).sum(axis=1) + self.top
        slack = SLACK * (1 + np.sqrt(shift))
        # a distance is the root of shift - 2 * score, widened by what rounding may cost
        reach = lambda scores: np.where(scores == -np.inf, np.inf, np.sqrt(np.maximum(shift - 2.0 * scores, 0.0)) + slack)
        least = np.asarray(floors, np.float64).copy()  # scores below it are no answers
        limit = reach(least)
        to_route, low = self._leaves(points, limit)
        order = np.argsort(low, axis=1, kind="stable")
        hits: list[tuple[np.ndarray, ...]] = [(empty, empty, empty)]
        fresh, at, many = 0, 0, 1
        while at < order.shape[1]:
            rows, places = np.repeat(np.arange(len(q)), min(many, order.shape[1] - at)), order[:, at : at + many].ravel()
            near = low[rows, places] <= limit[rows]
            rows, places = rows[near], places[near]
            if not len(rows):
                break  # further ones are farther away
            for place, some in _by_page(rows, places, low):
                some = some[low[some, place] <= limit[some]]
                if not len(some):
                    continue
                page = self.pages[place]
                start, stop = page.entries
                # the distance to the routing object alone rules out some entries
                open_ = np.abs(to_route[some, place][:, None] - page.stored) <= limit[some, None]
                some = some[open_.any(axis=1)]
                entries = np.flatnonzero(open_.any(axis=0))
                if not len(some):
                    continue
                where = slice(start, stop) if len(entries) == stop - start else entries + start
                self.computed += len(some) * len(entries)
                self.products += 1
                # whole numbers below 2**53, or whole numbers from the start
                scores = flat[some] @ self.points[where].T if exact else q[some] @ self.vectors[where].T
                ids = self.ids[where]
                i, j = np.nonzero(scores >= least[some, None])
                if own is not None:
                    other = ids[j] != own[some[i]]
                    i, j = i[other], j[other]
                if len(i):
                    hits.append((some[i], ids[j], scores[i, j].astype(np.int64)))
                    fresh += len(i)
                if fresh > FRESH * len(q):
                    hits, fresh = [_first(hits, k)], 0
                    self._tighten(hits[0], k, least)
                    limit = np.minimum(limit, reach(least))
            hits, fresh = [_first(hits, k)], 0
            self._tighten(hits[0], k, least)
            limit = np.minimum(limit, reach(least))
            at, many = at + many, many * 4
        return hits[0]

    @staticmethod
    def _tighten(best: tuple[np.ndarray, ...], k: int, least: np.ndarray) -> None:
        """No answer to a query with ``k`` of them is less than its last."""
        rows, _, scores = best
        last = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == k - 1)
        least[rows[last]] = np.maximum(least[rows[last]], scores[last])

    def _leaves(self, points: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query and leaf page, which come first among pages: the distance to its routing object, and the least one
        to its entries; infinite where a directory or the page's own bound rules it out."""
        leaves = next((i for i, p in enumerate(self.pages) if p.radii is not None), len(self.pages))
        to_route, low = (np.full((len(points), leaves), np.inf) for _ in range(2))
        root = self.pages[-1]
        every = np.arange(len(points))
        to_root = _distance(points, root.route)
        todo = [(len(self.pages) - 1, every, to_root, np.maximum(to_root - root.radius, 0.0))]
        while todo:
            number, rows, distance, least = todo.pop()
            some = least <= limit[rows]
            rows, distance, least = rows[some], distance[some], least[some]
            if not len(rows):
                continue
            page = self.pages[number]
            if page.radii is None:
                to_route[rows, number], low[rows, number] = distance, least
                continue
            # the parent's distance alone rules out some pages
            open_ = np.abs(distance[:, None] - page.stored) - page.radii <= limit[rows, None]
            for i, child in enumerate(page.entries.tolist()):
                few = rows[open_[:, i]]
                if len(few):
                    to_child = _distance(points[few], page.routes[i])
                    todo.append((child, few, to_child, np.maximum(to_child - page.radii[i], 0.0)))
        return to_route, low


def _by_page(rows: np.ndarray, places: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Pages and the queries that visit them, nearest pages first."""
    order = np.argsort(places, kind="stable")
    rows, places = rows[order], places[order]
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    nearest = np.minimum.reduceat(low[rows, places], starts)
    groups = np.split(rows, starts[1:])
    for g in np.argsort(nearest, kind="stable").tolist():
        yield int(places[starts[g]]), groups[g]


def _first(hits: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of each row's hits (row, vec_id, score) the ``k`` greatest, ties to the smaller id, in order."""
    rows, ids, scores = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    some = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[some], ids[some], scores[some]


def _floors(ids: np.ndarray, queries: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k-th greatest score among the seeds, its own id aside; -inf where there are fewer."""
    width = max(queries.shape[1], seeds.shape[1])
    wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    scores = (wide(queries).astype(np.float64) @ wide(seeds).astype(np.float64).T)  # rounded, so a little is taken off
    scores[ids[:, None] == seed_ids[None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(ids), -np.inf)
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.where(np.isfinite(kth), kth - 1e-9 * np.abs(kth) - 1, -np.inf)


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v the scaled whole components; vectors null or with null or non-finite components don't take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where("vec_id is not null").select("vec_id", x.alias("x")).where(F.col("x").isNotNull() & fine).select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))


def _table(column: pa.ListArray) -> np.ndarray:
    """Lists as rows, shorter ones filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    table = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    table[np.arange(table.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return table


def _stack(tables: list[np.ndarray]) -> np.ndarray:
    width = max(x.shape[1] for x in tables)
    return np.vstack([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in tables])


def _pack(ids: np.ndarray, table: np.ndarray) -> bytes:
    small = table.astype(np.int16)
    out = io.BytesIO()
    np.savez_compressed(out, ids=ids, v=small if (small == table).all() else table)
    return out.getvalue()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(data)) as x:
        return x["ids"], x["v"].astype(np.int64)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block) of packed rows, at most ``size`` in each."""

    row = lambda ids, table: pa.RecordBatch.from_arrays([pa.array([_pack(ids, table)], pa.binary())], names=["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tables, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            tables.append(_table(batch.column(1)))
            held += batch.num_rows
            if held >= size:
                every, table = np.concatenate(ids), _stack(tables)
                at = held - held % size
                for i in range(0, at, size):
                    yield row(every[i : i + size], table[i : i + size])
                ids, tables, held = [every[at:]], [table[at:]], held - at
        if held:
            yield row(np.concatenate(ids), _stack(tables))

    return rows.mapInArrow(run, "block binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` the ``k`` rows of ``vectors`` that score most.

    Both have vec_id and embedding. A query's own vec_id is no candidate. Components are scaled by SCALE and floored;
    shorter vectors count as filled up with zeros, empty ones as zeros; a vector, however long, is held whole. Rows without an id or with invalid vectors take
    no part; of a vec_id that has several rows, all are candidates and, as queries, one stands for equal ones. Ties go to
    the smaller vec_id. Without vectors or queries there are no rows. Scores are 64-bit numbers.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    trees = cut(_blocks(_valid(vectors), TREE).withColumn("part", F.monotonically_increasing_id()))
    first = trees.limit(1).collect()  # at most TREE vectors, of which SEED are used
    seeds = spark.sparkContext.broadcast(tuple(x[:SEED] for x in _unpack(bytes(first[0].block)))) if first else None

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with their floors, which hold for every tree."""
        for batch in batches:
            for block in batch.column(0):
                floors = _floors(*_unpack(block.as_py()), *seeds.value, k) if seeds else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.binary()), pa.array([floors.astype("<f8").tobytes()], pa.binary())], names=["queries", "floors"])

    asked = cut(_blocks(_valid(queries).distinct(), BLOCK).mapInArrow(bounded, "queries binary, floors binary"))
    parts = max(1, min(spark.sparkContext.defaultParallelism * 4, trees.count()))
    # every block of queries goes once to each of the parts into which the trees are dealt
    left = trees.select(F.pmod(F.xxhash64("part"), F.lit(parts)).alias("part"), F.col("part").alias("tree"), "block")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "queries", "floors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[int, MTree] = {}
        for batch in batches:
            for number, block, ask, low in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                if number not in built:
                    if len(built) == HELD:
                        built.pop(next(iter(built)))
                    built[number] = MTree(*_unpack(block.as_py()))
                tree = built[number]
                ids, vectors = _unpack(ask.as_py())
                rows, found, scores = tree.search_block(vectors, ids, k, np.frombuffer(low.as_py(), "<f8"))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    # a merge join gives each tree its blocks of queries one after another; another order would only cost time
    met = left.hint("merge").join(right, "part").select("tree", "block", "queries", "floors")
    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
