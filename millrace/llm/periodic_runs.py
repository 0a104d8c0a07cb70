"""Periodic runs of words: Lempel-Ziv blocks from the longest-previous-factor array, Main's boundary extensions, bucketed copying."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLICE_BYTES = 4 << 20  # of texts taken together
_GROUP_WORDS = 1 << 18  # of texts whose suffixes are sorted together
_PAIRS = 1 << 20  # of boundary and period looked at together


class Settings(NamedTuple):
    """A run has at least min_words words and min_periods times its period (2 or more)."""

    min_words: int = 24
    min_periods: int = 3

    def least_repeat(self) -> int:
        """A run of period q repeats at least this many words at distance q, whatever q is."""
        return min(max(self.min_words - q, (self.min_periods - 1) * q) for q in range(1, self.min_words + 1))


class _Ranks:
    """Names of the words' windows of 1, 2, 4, ... words by prefix doubling, until every suffix has its own; the last is the
    inverse suffix array. Two windows are equal if their names are."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        sorted_ = symbols[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        rank = np.empty(n, "i8")
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        self.levels, h = [rank.astype("i4")], 1
        active = order[~(new & np.concatenate([new[1:], [True]]))]
        while len(active):
            following = active + h
            key = rank[active] * (n + 1) + np.where(following < n, rank[np.minimum(following, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            major = rank[active]
            at = np.arange(len(active))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            old = np.concatenate([[True], major[1:] != major[:-1]])
            rank = rank.copy()
            rank[active] = major + np.flatnonzero(new)[np.cumsum(new) - 1] - np.flatnonzero(old)[np.cumsum(old) - 1]
            self.levels.append(rank.astype("i4"))
            active, h = active[~(new & np.concatenate([new[1:], [True]]))], 2 * h
        self.n = n

    def suffixes(self) -> np.ndarray:
        out = np.empty(self.n, "i8")
        out[self.levels[-1]] = np.arange(self.n)
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i and j differ)."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), "i8")
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype("i8") << k
            i, j, out = i + step, j + step, out + step
        return out

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), "i8")
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            step = ((a >= 0) & (b >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype("i8") << k
            i, j, out = i - step, j - step, out + step
        return out

    def alike(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the 2^k words from i and j on are the same; False where they would begin before the first word."""
        return (i >= 0) & (j >= 0) & (self.levels[k][np.clip(i, 0, self.n - 1)] == self.levels[k][np.clip(j, 0, self.n - 1)])


def _longest_previous(ranks: _Ranks) -> tuple[list[int], list[int]]:
    """For each position the length of its longest factor that begins earlier, and where. Suffixes leave the suffix array's
    list from the last position to the first, so a suffix's neighbours are those that begin before it."""
    suffixes, n = ranks.suffixes(), ranks.n
    common = np.zeros(n + 1, "i8")
    common[suffixes[1:]] = ranks.ahead(suffixes[:-1], suffixes[1:])  # with the suffix before it
    lcp = common.tolist()
    left, right = np.full(n + 1, n), np.full(n + 1, n)
    left[suffixes[1:]], right[suffixes[:-1]] = suffixes[:-1], suffixes[1:]
    left, right = left.tolist(), right.tolist()
    length, source = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        p, q = left[i], right[i]
        a, b = lcp[i], lcp[q]
        if a >= b:
            length[i], source[i], lcp[q] = a, p, b
        else:
            length[i], source[i], lcp[q] = b, q, a
        left[q], right[p] = p, q
        lcp[n] = 0
    return length, source


def _extended(ranks: _Ranks, edges: np.ndarray, first: np.ndarray, before: np.ndarray, after: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Runs (start, end, period) that touch a boundary between blocks: for each period up to the two blocks' length the words
    on both sides of the boundary are compared with those a period further right or left, and extended as far as they go."""
    near = max(0, (-(-s.least_repeat() // 2)).bit_length() - 1)  # one of the two extensions has this many doublings at least
    found = [np.empty((3, 0), "i8")]
    if len(ranks.levels) <= near:
        return tuple(found[0])
    for right in (True, False):
        counts = after if right else np.minimum(before + after, edges - first)
        ends = np.cumsum(counts)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS):
            flat = np.arange(lo, min(lo + _PAIRS, int(ends[-1])))
            at = np.searchsorted(ends, flat, side="right")
            period, edge = flat - (ends[at] - counts[at]) + 1, edges[at]
            i, j = (edge, edge + period) if right else (edge - period, edge)
            hopeful = (j < ranks.n) & (ranks.alike(near, i, j) | ranks.alike(near, i - (1 << near), j - (1 << near)))
            i, j, period = i[hopeful], j[hopeful], period[hopeful]
            start, end = i - ranks.before(i, j), j + ranks.ahead(i, j)
            good = end - start >= np.maximum(s.min_words, s.min_periods * period)
            found.append(np.stack([start, end, period])[:, good])
    return tuple(np.concatenate(found, axis=1))


def _runs(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, s: Settings) -> list[list[tuple[int, int, int]]]:
    """The runs (start, end, smallest period) of each text in a group: text t has the symbols from starts[t] to ends[t], after
    which stands a symbol of its own. No text shares a symbol with another."""
    ranks = _Ranks(symbols)
    length, source = _longest_previous(ranks)
    blocks: list[list[tuple[int, int, int]]] = []
    edges, first, before, after = [], [], [], []
    for a, b in zip(starts.tolist(), ends.tolist()):
        own, at, previous = [], a, 0
        while at < b:
            size = max(1, length[at])
            own.append((at, size, source[at]))
            edges.append(at), first.append(a), before.append(previous), after.append(size)
            at, previous = at + size, size
        edges.append(b), first.append(a), before.append(previous), after.append(0)
        blocks.append(own)
    start, end, period = _extended(ranks, *(np.array(v, "i8") for v in (edges, first, before, after)), s)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    text = np.searchsorted(starts, start[smallest], side="right") - 1
    buckets: list[list] = [[] for _ in starts]
    for t, run in zip(text.tolist(), zip(start[smallest].tolist(), end[smallest].tolist(), period[smallest].tolist())):
        buckets[t].append(run)
    for t, found in enumerate(buckets):
        if found:
            _copied(found, blocks[t])
            shift = int(starts[t])
            buckets[t] = [(a - shift, b - shift, q) for a, b, q in found]
    return buckets


def _copied(found: list[tuple[int, int, int]], blocks: list[tuple[int, int, int]]) -> None:
    """Adds, in order of start, the runs that lie strictly inside a block: those strictly inside the block's earlier occurrence."""
    known = set(found)
    for at, size, source in blocks:
        k = bisect_right(found, (source, float("inf"), 0))
        while k < len(found) and found[k][0] < source + size:
            a, b, q = found[k]
            copy = (a + at - source, b + at - source, q)
            if b < source + size and copy not in known:
                known.add(copy)
                insort(found, copy)
            k += 1


def _repeating(codes: np.ndarray, text: np.ndarray, texts: int, window: int) -> np.ndarray:
    """Texts that hold some window of so many words twice, by a hash (another text may be named too, none is left out)."""
    rng = np.random.default_rng(1)
    word = rng.integers(1, 1 << 63, int(codes.max(initial=0)) + 1, "u8")
    own = rng.integers(1, 1 << 63, texts, "u8")
    key, size = word[codes], 1
    while size * 2 <= window:
        key = key[:-size] * rng.integers(1, 1 << 62, 1, "u8") * np.uint64(2) + key[:-size] + key[size:] if len(key) > size else key[:0]
        size *= 2
    inside = text[: len(key)] == text[size - 1 : size - 1 + len(key)]
    at = text[: len(key)][inside]
    key = key[inside] ^ own[at]
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    return np.unique(at[order][1:][again])


def _groups(texts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in groups of about _GROUP_WORDS words; a longer one stands alone."""
    held, n = [], 0
    for t in texts:
        if held and n + sizes[t] > _GROUP_WORDS:
            yield np.array(held)
            held, n = [], 0
        held.append(t)
        n += sizes[t]
    if held:
        yield np.array(held)


def _found(words: list[list[bytes]], s: Settings) -> list[list[tuple[int, int, int]]]:
    """Runs of each text. A run repeats least_repeat() words, so a text without a repeated window of that size (its longest
    previous factor is shorter) has none, and its suffixes needn't be sorted."""
    sizes = np.array([len(w) for w in words], "i8")
    out: list[list] = [[] for _ in words]
    if not sizes.sum():
        return out
    codes = pa.array([w for own in words for w in own], pa.large_binary()).dictionary_encode().indices.to_numpy().astype("i8")
    firsts = np.cumsum(sizes) - sizes
    hopeful = _repeating(codes, np.repeat(np.arange(len(words)), sizes), len(words), s.least_repeat())
    for group in _groups(hopeful, sizes):
        most, parts = int(codes.max()) + 1, []
        for k, t in enumerate(group):
            parts += [codes[firsts[t] : firsts[t] + sizes[t]] + (k + 1) * most + len(group), np.array([k])]
        ends = np.cumsum(sizes[group] + 1) - 1
        for t, runs in zip(group, _runs(np.concatenate(parts), ends - sizes[group], ends, s)):
            out[t] = runs
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, "i8")
    for a, b, q in runs:
        change[a + q] += 1
        change[b] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0))


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > _SLICE_BYTES:
            yield at, k
            at, held = k, 0
        held += n + 1
    if at < len(sizes):
        yield at, len(sizes)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The runs of every text and the text without their repetitions: (key, n_words, runs, collapsed).

    Words are what stands between ASCII white space; runs are stretches with smallest period q, as long as the settings ask,
    that no neighbouring word extends, by start, then period. collapsed holds the words that lie in no run after its first q
    words, joined by one space. A null text has no words (collapsed is empty); null keys and repeated rows are kept, each
    with its own row; an empty table gives no rows; other columns, whatever their names, are ignored. A task holds about 4 MB of texts or
    one longer text, and for texts that repeat some 4 bytes a word for each doubling of their longest repeat.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist()
            for a, b in _slices(sizes):
                words = [(t or b"").split() for t in texts.slice(a, b - a).to_pylist()]
                runs = _found(words, settings)
                made = pa.array([[(x, y - x, q) for x, y, q in own] for own in runs], pa.list_(_RUN))
                joined = pa.array([_collapsed(w, own) for w, own in zip(words, runs)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(w) for w in words], pa.int64()), made, joined.cast(pa.string())], ["key", "n_words", "runs", "collapsed"])

    given = docs.select(F.col(key).alias("key"), F.encode(F.col(text).cast("string"), "UTF-8").alias("text"))
    shape = f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return given.mapInArrow(run, shape).withColumnRenamed("key", key)


def greatest(runs: str = "runs") -> F.Column:
    """Of an array of runs that with the greatest length / period, exactly; of equal ones the first (runs are by start, then period)."""
    return F.reduce(F.col(runs), F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
