"""Benchmark decontamination: a BM25 index of test items with block-max WAND, queried by every training passage."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import staged

_TERM = re.compile(r"\w+")
_END = re.compile(r"(?<=[.?!])\s+|\n+")


@dataclass(frozen=True)
class Settings:
    """stride: words between passages, each two strides long. share: part of an item's own score that a passage must reach
    to be retrieved. k1, b: of BM25. block: items that share one bound. rest: part of the
    threshold that a passage's weakest terms may bring before a block is looked at for the others. gram, overlap: share of the question's and of the
    answer's word n-grams that a retrieved passage must hold. whole: share of the n-grams of question
    and answer together that is enough if the answer is no longer than one n-gram. index_chars: of the items that are
    indexed and broadcast at once; more items take more passes."""

    stride: int = 64
    share: float = 0.4
    k1: float = 1.2
    b: float = 0.75
    block: int = 4
    rest: float = 0.2
    gram: int = 3
    overlap: float = 0.5
    whole: float = 0.75
    index_chars: int = 16_000_000


def split_item(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer: the answer is the last sentence or line, if there are several."""
    parts = [w for w in (_TERM.findall(p.lower()) for p in _END.split(text)) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def _grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def _runs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs start, start + 1, ...: which run each place belongs to, and the places."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    before = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - before[owner] + starts[owner]


class Index:
    """Postings (item, impact) sorted by term, then item, cut into blocks of items; for each term and block that it occurs in,
    the place of its postings and their largest impact; for each term the largest of all. Impacts are divided by the item's
    threshold, so that an item is retrieved from a sum of 1. Size follows the postings, not terms times blocks."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], total: int, mean: float, settings: Settings) -> None:
        s = self.settings = settings
        self.ids = [i for i, _ in items]
        self.parts = [split_item(t) for _, t in items]
        self.longest = max((len(q) + len(a) for q, a in self.parts), default=0)
        self.n_blocks = max(1, -(-len(items) // s.block))
        self.terms: dict[str, int] = {}
        rows: list[tuple[int, int, float]] = []
        for k, (q, a) in enumerate(self.parts):
            n, tf = len(q) + len(a), Counter(q + a)
            impact = {t: math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * c * (s.k1 + 1) / (c + s.k1 * (1 - s.b + s.b * n / mean)) for t, c in tf.items()}
            need = s.share * sum(impact.values()) * min(1.0, s.stride / max(n, 1))
            rows += [(self.terms.setdefault(t, len(self.terms)), k, x / need) for t, x in impact.items()]
        rows.sort()
        self.items = np.array([k for _, k, _ in rows], np.int64)
        self.impacts = np.array([x for _, _, x in rows], float)
        term = np.array([t for t, _, _ in rows], np.int64)
        cell = term * self.n_blocks + self.items // s.block
        self.post = np.flatnonzero(np.diff(cell, prepend=-1))  # where the postings of a term in a block begin
        self.cells = cell[self.post]  # term * blocks + block, sorted
        self.post_length = np.diff(np.append(self.post, len(cell)))
        self.bounds = np.maximum.reduceat(self.impacts, self.post) if len(cell) else np.zeros(0)
        first = np.searchsorted(self.cells // self.n_blocks, np.arange(len(self.terms) + 1))
        self.term_cell, self.term_cells = first[:-1], np.diff(first)
        self.term_bound = np.maximum.reduceat(self.bounds, first[:-1]) if len(cell) else np.zeros(0)
        self.read = 0  # postings read so far

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all items whose impacts sum to 1 or more over a passage's distinct terms; passage is
        sorted, its numbers begin at 0.

        The terms of a passage go by their largest impact. Those whose impacts together stay below settings.rest leave the
        others, the pivots, to bring what lacks to 1; most passages have none. Blocks in which the pivots' bounds bring that
        are the candidates; only those in which the bounds of all the passage's terms reach 1 are read, and of them only the
        postings of its terms. All passages are taken at once.
        """
        s, none = self.settings, np.zeros(0, np.int64)
        if not len(term):
            return none, none, np.zeros(0)
        order = np.lexsort((self.term_bound[term], passage))
        passage, term = passage[order], term[order]
        running = np.cumsum(self.term_bound[term])
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        sizes = np.diff(np.append(starts, len(passage)))
        before = np.repeat(np.where(starts > 0, running[starts - 1], 0.0), sizes)
        pivot = running - before >= s.rest - 1e-6  # the running sum is long, its last digits are not exact
        owner, place = _runs(self.term_cell[term[pivot]], self.term_cells[term[pivot]])
        blocks, back = np.unique(passage[pivot][owner] * self.n_blocks + self.cells[place] % self.n_blocks, return_inverse=True)
        blocks = blocks[np.bincount(back, weights=self.bounds[place], minlength=len(blocks)) >= 1 - s.rest - 1e-6]
        # All terms of a candidate's passage, each with its postings in the block, if there are any.
        at = np.searchsorted(passage[starts], blocks // self.n_blocks)
        candidate, row = _runs(starts[at], sizes[at])
        wanted = term[row] * self.n_blocks + blocks[candidate] % self.n_blocks
        cell = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
        there = self.cells[cell] == wanted
        candidate, cell = candidate[there], cell[there]
        live = np.bincount(candidate, weights=self.bounds[cell], minlength=len(blocks)) >= 1 - 1e-9
        cell, candidate = cell[live[candidate]], candidate[live[candidate]]
        owner, place = _runs(self.post[cell], self.post_length[cell])
        self.read += len(place)
        pair, back = np.unique(blocks[candidate[owner]] // self.n_blocks * len(self.ids) + self.items[place], return_inverse=True)
        score = np.bincount(back, weights=self.impacts[place], minlength=len(pair))
        found = score >= 1 - 1e-9
        return pair[found] // len(self.ids), pair[found] % len(self.ids), score[found]

    def overlaps(self, item: int, words: list[str]) -> tuple[float, float]:
        """Shares of the question's and of the answer's n-grams that words hold; an answer that isn't there counts as held."""
        n = self.settings.gram
        q, a = self.parts[item]
        there = _grams(words, n)
        return tuple(len(g & (there if len(next(iter(g))) == n else _grams(words, len(next(iter(g)))))) / len(g) if (g := _grams(p, n)) else 1.0 for p in (q, a))

    def held(self, item: int, words: list[str], q: float, answer: float) -> bool:
        """Whether words hold the item. A short answer is one gram, which a changed word or a cut breaks: there the share of
        the whole item's grams is enough."""
        s, own = self.settings, self.parts[item]
        if q < s.overlap or answer >= s.overlap:
            return q >= s.overlap
        if len(own[1]) > s.gram:
            return False
        grams = _grams(own[0] + own[1], s.gram)
        return len(grams & _grams(words, s.gram)) >= s.whole * len(grams)

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text's place, item's id, best score, question and answer overlap) of every verified pair."""
        s, get = self.settings, self.terms.get
        words = [_TERM.findall(t.lower()) for t in texts]
        own = np.concatenate([np.fromiter((get(w, -1) for w in ws), np.int64, len(ws)) for ws in words] or [np.zeros(0, np.int64)])
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        strides = np.maximum(1, -(-sizes // s.stride))
        base = np.concatenate([[0], np.cumsum(strides)])
        text = np.repeat(np.arange(len(texts)), sizes)
        half = base[text] + (np.arange(len(own)) - first[text]) // s.stride
        # A passage is two strides; each word thus stands in the passage that begins at its stride and in the one before.
        known = own >= 0
        here, term = half[known], own[known]
        again = here > base[text[known]]
        pairs = np.unique(np.concatenate([here, here[again] - 1]) * max(1, len(self.terms)) + np.concatenate([term, term[again]]))
        passage, term = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
        cuts = np.append(np.flatnonzero(np.diff(passage, prepend=-1))[::4096], len(passage))  # so many passages at once
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            names, number = np.unique(passage[a:b], return_inverse=True)
            for k, item, score in zip(*(x.tolist() for x in self.retrieve(number, term[a:b]))):
                p = int(names[k])
                t = int(np.searchsorted(base, p, side="right")) - 1
                if score <= found.get((t, item), (0.0,))[0]:
                    continue
                first_word = (p - int(base[t])) * s.stride
                near = words[t][max(0, first_word - self.longest) : first_word + 2 * s.stride + self.longest]
                q, answer = self.overlaps(item, near)
                if self.held(item, near, q, answer):
                    found[t, item] = (score, q, answer)
        for (t, item), (score, q, answer) in found.items():
            yield t, self.ids[item], score, q, answer


def _indexes(items: DataFrame, settings: Settings) -> Iterator[Index]:
    """An index for each block of items. Document frequencies, sizes and the mean length are of all items."""
    terms = "item_id long, text string, terms array<string>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words as search() sees them: Java's word characters are others."""
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([_TERM.findall(t.lower()) for t in texts], pa.list_(pa.string()))], ["item_id", "text", "terms"])

    bare = staged(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(split, terms).filter(F.size("terms") > 0), "decontam-items")
    total, chars, mean = bare.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0)), F.avg(F.size("terms"))).first()
    if not total:
        return
    blocks = -(-chars // settings.index_chars)
    spread = bare.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    df = staged(bare.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "decontam-terms")
    for k in range(blocks):
        here = spread.filter(F.col("block") == k)
        part = [(r["item_id"], r["text"]) for r in here.select("item_id", "text").sort("item_id", "text").collect()]
        own = here.select(F.explode("terms").alias("term")).distinct()
        counts = {r["term"]: r["n"] for r in df.join(own, "term", "left_semi").collect()}  # at most index_chars of terms
        yield Index(part, counts, total, mean, settings)


def contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap): one row for each row of docs and item that it holds.

    Every text is cut into overlapping passages; each is a query on the index and gets all items above the threshold;
    question and answer must then be there (a null item text counts as empty). The index is broadcast in blocks of about settings.index_chars characters of
    items, one pass over docs for each, so its size doesn't follow the number of items or documents; docs are never
    shuffled. Null and empty texts hold nothing; null keys stay null; repeated rows are searched each; items without a
    word and empty tables give no rows; equal items are found each; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string"))
    schema = pa.schema([("key", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    ddl = "key long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in _indexes(items, settings):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for part in _parts(batch):
                    keys = part.column(0).to_pylist()
                    rows = [(keys[t], *rest) for t, *rest in index.search([x or "" for x in part.column(1).to_pylist()])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        own = source.mapInArrow(run, ddl)
        out = own if out is None else out.unionByName(own)
    return (spark.createDataFrame([], ddl) if out is None else out).withColumnRenamed("key", key)


def _parts(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about most bytes of text, so that word lists stay small."""
    start = size = 0
    for k, n in enumerate(pa.compute.binary_length(batch.column(1)).to_pylist()):
        size += n or 0
        if size > most:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
