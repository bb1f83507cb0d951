"""How words are spelled: a probabilistic suffix tree over bytes.

The tree holds contexts of up to DEPTH bytes whose next-byte distribution differs from that of their own suffix by more
than a parameter count excuses (number of symbols times Kullback-Leibler divergence against a Schwarz penalty), with the
suffixes and prefixes of those. Distributions are smoothed towards that of the suffix. ``Spelling`` holds what was
counted in the tree's contexts as sorted keys and finds the longest one of each place by looking it up, so it has no more
cells than training has different sequences, and no limit; ``SuffixTree`` is the same tree as an automaton with a cell for
each context and byte, whose state is the longest suffix of what has been read. A word is its bytes and an end sign.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

DEPTH = 4
SMOOTH = 2  # weight of the shorter context's distribution for each different byte seen (Witten-Bell has 1)
LONG = 1 << 20  # bytes of a word that is spelled by itself
END, LANES = 10, 2048


def tape(texts: list[bytes]) -> np.ndarray:
    """All texts with DEPTH end signs before, between and after them, so that none has another's symbols as context."""
    gap = bytes([END]) * DEPTH
    return np.frombuffer(gap + gap.join(texts) + gap, np.uint8)


def _packed(symbols: np.ndarray) -> np.ndarray:
    """For each symbol but the first DEPTH, the DEPTH symbols before it and itself, in one number."""
    packed = symbols[: len(symbols) - DEPTH].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        packed <<= np.uint64(8)
        packed |= symbols[k : len(symbols) - DEPTH + k]
    return packed


def sequences(texts: list[bytes]) -> np.ndarray:
    """For each symbol of the texts, ends too, DEPTH symbols of context and the symbol, in one number."""
    some = [t for t in texts if t]
    out = np.full(len(texts) - len(some), int.from_bytes(bytes([END]) * (DEPTH + 1), "big"), np.uint64)
    if not some:
        return out
    symbols = tape(some)
    packed = _packed(symbols)
    return np.concatenate([out, packed[(symbols[DEPTH:] != END) | (symbols[DEPTH - 1 : -1] != END)]])


def _parts(n: int, size: int = 4096) -> list[slice]:
    return [slice(at, at + size) for at in range(0, n, size)]


@dataclass
class SuffixTree:
    """symbol: column of each byte; log10: state by column, the log10 probability; follow: state by column, the next."""

    symbol: np.ndarray
    log10: np.ndarray
    follow: np.ndarray
    depths: np.ndarray

    @classmethod
    def build(cls, depth: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> SuffixTree:
        """From counts of ``symbol`` after ``context`` (its last ``depth`` symbols)."""
        seen = np.unique(symbol)
        column = np.full(256, len(seen), np.int64)  # bytes that training hasn't share the last column
        column[seen] = np.arange(len(seen))
        unseen = 256 - len(seen)
        levels = []  # (contexts, counts by column)
        for d in range(DEPTH + 1):
            at = depth == d
            contexts, row = np.unique(context[at], return_inverse=True)
            counts = np.zeros((len(contexts), len(seen) + 1), np.float32)
            np.add.at(counts, (row, column[symbol[at]]), n[at])
            levels.append((contexts, counts))
        if not len(levels[0][0]):
            levels[0] = (np.zeros(1, np.uint64), np.zeros((1, len(seen) + 1), np.float32))

        def place(d: int, contexts: np.ndarray) -> np.ndarray:
            return np.searchsorted(levels[d][0], contexts)

        shorter = [None, *(place(d - 1, levels[d][0] & np.uint64((1 << 8 * (d - 1)) - 1)) for d in range(1, DEPTH + 1))]
        before = [None, *(place(d - 1, levels[d][0] >> np.uint64(8)) for d in range(1, DEPTH + 1))]
        kept = [np.ones(len(levels[0][0]), bool)]
        for d in range(1, DEPTH + 1):
            passed = []
            for part in _parts(len(levels[d][0])):
                counts, wider = levels[d][1][part].astype(np.float64), levels[d - 1][1][shorter[d][part]].astype(np.float64)
                total = counts.sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.log(counts / total[:, None]) - np.log(wider / wider.sum(axis=1)[:, None])
                divergence = (counts * np.where(counts > 0, ratio, 0)).sum(axis=1)
                passed.append(divergence > 0.5 * ((counts > 0).sum(axis=1)) * np.log(total))
            kept.append(np.concatenate(passed) if passed else np.zeros(0, bool))
        for d in range(DEPTH, 1, -1):  # with a context, its suffix and its prefix
            kept[d - 1][shorter[d][kept[d]]] = True
            kept[d - 1][before[d][kept[d]]] = True

        number, first = [], 0
        for k in kept:
            number.append(np.where(k, np.cumsum(k) - 1 + first, -1))
            first += int(k.sum())
        log10 = np.zeros((first, len(seen) + 1), np.float32)
        follow = np.zeros((first, len(seen) + 1), np.int32)
        for d in range(DEPTH + 1):
            rows = np.flatnonzero(kept[d])
            for part in _parts(len(rows)):
                own = number[d][rows[part]]
                counts = levels[d][1][rows[part]].astype(np.float64)
                if d == 0:
                    counts[:, -1] += unseen
                    counts[:, :-1] += 1
                    now = counts / counts.sum(axis=1, keepdims=True)
                else:
                    back = number[d - 1][shorter[d][rows[part]]]
                    wider = 10.0 ** log10[back].astype(np.float64)
                    wider[:, -1] *= unseen
                    kinds = SMOOTH * (counts > 0).sum(axis=1, keepdims=True)
                    now = (counts + kinds * wider) / (counts.sum(axis=1, keepdims=True) + kinds)
                    follow[own] = follow[back]
                if unseen:
                    now[:, -1] /= unseen
                with np.errstate(divide="ignore"):
                    log10[own] = np.log10(now)
            if d < DEPTH:
                more = kept[d + 1]
                follow[number[d][before[d + 1][more]], column[(levels[d + 1][0][more] & np.uint64(255)).astype(np.int64)]] = number[d + 1][more]
        return cls(column.astype(np.int32), log10, follow, np.repeat(np.arange(DEPTH + 1), [int(k.sum()) for k in kept]))

    def spell(self, words: list[bytes]) -> np.ndarray:
        """The log10 probability of each word's spelling, its end too."""
        out = np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        out[short] = self._lockstep([words[i] for i in short])
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._one(w)
        return out

    def _one(self, word: bytes) -> float:
        """A word's spelling symbol by symbol, in memory that doesn't grow with it."""
        end = bytes([END])
        state, total, symbol = 0, 0.0, self.symbol.tolist()
        for b in end * DEPTH:
            state = self.follow[state, symbol[b]]
        for piece in (word[at : at + LONG] for at in range(0, len(word), LONG)):
            for b in piece:
                total += float(self.log10[state, symbol[b]])
                state = self.follow[state, symbol[b]]
        return total + float(self.log10[state, symbol[END]])

    def _lockstep(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        symbols = self.symbol[tape(words)]
        size, width = len(symbols), self.log10.shape[1]
        lanes = min(LANES, max(1, size // 64))
        run = -(-size // lanes)
        padded = np.concatenate([np.full(DEPTH, self.symbol[END], np.int32), symbols, np.zeros(run * lanes - size, np.int32)])
        lane = np.arange(lanes) * run
        state = np.zeros(lanes, np.int64)
        flat, follow = self.log10.reshape(-1), self.follow.reshape(-1)
        got = np.empty((run, lanes), np.float32)
        for t in range(run + DEPTH):
            at = state * width + padded[lane + t]
            if t >= DEPTH:
                got[t - DEPTH] = flat[at]
            state = follow[at].astype(np.int64)
        values = got.T.reshape(-1)[:size].astype(np.float64)
        ends = np.cumsum([len(w) + DEPTH for w in words])  # a word's own end; DEPTH - 1 more are only context
        sums = np.concatenate([[0.0], np.cumsum(values)])
        return sums[ends + 1] - sums[ends - [len(w) for w in words]]


def _find(among: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``x`` in a sorted array, and which of them are there."""
    if not len(among):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return at, among[at] == x


def _last(keys: np.ndarray, symbols: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * symbols) - 1)


@dataclass
class Spelling:
    """For each depth: sorted keys (context and symbol) and their counts, sorted contexts, their totals and kinds of symbols."""

    levels: list[tuple[np.ndarray, ...]]

    @classmethod
    def build(cls, keys: np.ndarray, n: np.ndarray) -> Spelling:
        """From distinct ``sequences`` and their counts."""
        levels, kept = [], []
        for d in range(DEPTH + 1):
            some, at = np.unique(_last(keys, d + 1), return_inverse=True)
            count = np.bincount(at, n, len(some))
            contexts, row = np.unique(some >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(row, count, len(contexts)), np.bincount(row, minlength=len(contexts))
            passed = np.ones(len(contexts), bool)
            if d:
                wider = levels[d - 1]
                share = wider[1][_find(wider[0], _last(some, d))[0]] / wider[3][_find(wider[2], _last(some >> np.uint64(8), d - 1))[0]]
                divergence = np.bincount(row, count * (np.log(count / total[row]) - np.log(share)), len(contexts))
                passed = divergence > 0.5 * kinds * np.log(total)
            levels.append((some, count, contexts, total, kinds))
            kept.append(passed)
        for d in range(DEPTH, 1, -1):  # with a context, its suffix and its prefix
            own = levels[d][2][kept[d]]
            for other in (_last(own, d - 1), own >> np.uint64(8)):
                kept[d - 1][_find(levels[d - 1][2], other)[0]] = True
        out = []
        for (some, count, contexts, total, kinds), k in zip(levels, kept, strict=True):
            rows = k[_find(contexts, some >> np.uint64(8))[0]] if len(some) else np.zeros(0, bool)
            out.append((some[rows], count[rows], contexts[k], total[k], kinds[k]))
        return cls(out)

    def _log10(self, sequences: np.ndarray) -> np.ndarray:
        each, back = np.unique(sequences, return_inverse=True)
        keys, count, _, total, _ = self.levels[0]
        at, there = _find(keys, _last(each, 1))
        p = 1.0 + (np.where(there, count[at], 0.0) if len(keys) else 0.0)
        p = np.broadcast_to(p / (256 + total.sum()), len(each)).copy()
        live = np.arange(len(each))
        for d in range(1, DEPTH + 1):
            keys, count, contexts, total, kinds = self.levels[d]
            context, known = _find(contexts, _last(each[live] >> np.uint64(8), d))
            live, context = live[known], context[known]
            if not len(live):
                break
            at, there = _find(keys, _last(each[live], d + 1))
            more = SMOOTH * kinds[context]
            p[live] = (np.where(there, count[at], 0.0) + more * p[live]) / (total[context] + more)
        return np.log10(p)[back]

    def spell(self, words: list[bytes]) -> np.ndarray:
        """The log10 probability of each word's spelling, its end too."""
        out, some, held = np.zeros(len(words)), [], 0
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._one(w)
                continue
            some.append(i)
            held += len(w) + DEPTH
            if held > LONG:
                out[some] = self._together([words[j] for j in some])
                some, held = [], 0
        if some:
            out[some] = self._together([words[j] for j in some])
        return out

    def _together(self, words: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + DEPTH) - (sizes + DEPTH)
        sums = np.concatenate([[0.0], np.cumsum(self._log10(_packed(tape(words))))])
        return sums[starts + sizes + 1] - sums[starts]  # an end sign after each is its own, the others are only context

    def _one(self, word: bytes) -> float:
        """A word's spelling piece by piece, in memory that doesn't grow with it."""
        total, lead, end = 0.0, bytes([END]) * DEPTH, bytes([END])
        for at in range(0, len(word), LONG):
            piece = word[at : at + LONG] + (end if at + LONG >= len(word) else b"")
            total += float(self._log10(_packed(np.frombuffer(lead + piece, np.uint8))).sum())
            lead = (lead + piece)[-DEPTH:]
        return total


def grow(counts: DataFrame) -> Spelling:
    """The tree of all sequences in ``counts`` (key, n). It is as large as training's words have different sequences."""
    table = counts.select("key", "n").toArrow()
    return Spelling.build(table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(np.float64))
