"""Bounded-space online packing of token sequences into fixed windows."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import staged

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "level_group")])
_FLUSH_BYTES = 8 << 20

# The pre-tokenisation pattern of the vocabulary file word_bpe_49k.json, and a line end between words.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
_BREAK = "a1"  # between words: no part has a letter before a digit, so no word has these two ids in a row
_SLICE_BYTES = 4 << 20
_SPACES = b" \t\n\x0b\x0c\r"


class _Known:
    """Words and their ids, as one array of ids with a start and a length for each word. At most size words: where there
    would be more, those met in one slice only go first, then all."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.met = np.zeros(0, np.uint8)

    def add(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.starts)
        self.place.update(zip(words, range(first, first + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.uint8)])

    def shrink(self) -> None:
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > self.size // 2:
            return self.clear()
        words = list(self.place)
        lengths, starts, ids = self.lengths[keep], self.starts[keep], self.ids
        own = [words[k] for k in keep.tolist()]
        self.clear()
        self.add(own, lengths, ids[_ragged(starts, lengths)])


_SHARED: dict[tuple[str, int], tuple[_Known, _Known]] = {}  # a worker's tasks follow each other and share what is known: words and their parts


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class WordEncoder:
    """Texts to little-endian uint32 ids with a word-level BPE file, each distinct word encoded once.

    Words are what ASCII white space separates; the file's normaliser (NFC, lower case) and its pre-tokeniser never
    reach across it, so a text's ids are its words' ids in order. Words are told apart by Arrow, a slice of texts at a time;
    of words that a worker doesn't know yet, only the parts (by the pre-tokeniser) that it doesn't know either reach the model,
    all of a slice in one call, and ids are gathered as arrays. Memory is bounded: a slice has about 4 MB of text (a longer text
    is cut at white space), and a worker knows at most cache_size words and as many parts.
    """

    def __init__(self, path: str, eos: int, cache_size: int = 600_000) -> None:
        self.path, self.eos, self.cache_size = path, eos.to_bytes(4, "little"), cache_size
        self._ready = False

    def __getstate__(self) -> dict:
        return {"path": self.path, "eos": self.eos, "cache_size": self.cache_size, "_ready": False}

    def _load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; a thread pool would only add overhead
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self._whole = Tokenizer.from_file(self.path)
        self._model = Tokenizer(self._whole.model)
        self._model.pre_tokenizer = WhitespaceSplit()
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._break = self._model.encode(_BREAK).ids
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self._bytes = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)} | {10: _BREAK, 32: 32}
        self._known, self._parts = _SHARED.setdefault((self.path, self.cache_size), (_Known(self.cache_size), _Known(self.cache_size)))
        self._ready = True

    def _learn(self, words: list[str]) -> None:
        """Adds words to what is known. Lower-casing is by character, so a final sigma is no exception."""
        text = "\n".join(words)
        if any(s in text for s in self._special):
            odd = [w for w in words if any(s in w for s in self._special)]
            for w in odd:
                own = np.array(self._whole.encode(w, add_special_tokens=False).ids, np.uint32)
                self._known.add([w], np.array([len(own)]), own)
            words = [w for w in words if w not in self._known.place]
            text = "\n".join(words)
        if not words:
            return
        parts = _WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower() + "\n")
        at, distinct = self._parts.place, dict.fromkeys(parts)
        at["\n"] = -1  # the line end between words is no part
        new = [p for p in distinct if p not in at]
        if len(at) + len(new) > self.cache_size:
            self._parts.clear()
            at = self._parts.place
            at["\n"] = -1
            new = [p for p in distinct if p != "\n"]
        if new:
            shown = "\n".join([*new, ""]).replace("\n", " \n ").encode().decode("latin-1").translate(self._bytes)
            ids = np.array(self._model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint32)
            breaks = np.flatnonzero((ids[:-1] == self._break[0]) & (ids[1:] == self._break[1]))
            self._parts.add(new, np.diff(breaks, prepend=-2) - 2, np.delete(ids, np.concatenate([breaks, breaks + 1])))
        place = np.fromiter(map(at.__getitem__, parts), np.int64, len(parts))
        ends = np.flatnonzero(place < 0)
        own = place[place >= 0]
        lengths = self._parts.lengths[own]
        total = np.concatenate([[0], np.cumsum(lengths)])
        self._known.add(words, np.diff(total[ends - np.arange(len(ends))], prepend=0), self._parts.ids[_ragged(self._parts.starts[own], lengths)])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, and where each text's begin and end."""
        lists = pa.compute.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._known
        if len(known.place) + len(words) > self.cache_size:
            known.shrink()
        if missing := [w for w in words if w not in known.place]:
            self._learn(missing)
        place = np.fromiter(map(known.place.__getitem__, words), np.int64, len(words))
        known.met[place] += known.met[place] < 2
        own = place[coded.indices.to_numpy()]
        lengths = known.lengths[own]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return known.ids[_ragged(known.starts[own], lengths)], ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def __call__(self, texts: pa.Array | Iterable[str | None]) -> Iterator[bytes]:
        """One string of ids for each text, in order; null counts as empty."""
        if not self._ready:
            self._load()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
        for part in _slices(texts):
            if len(part) == 1 and len(whole := part[0].as_buffer().to_pybytes()) > 2 * _SLICE_BYTES:
                yield b"".join(self._slice(pa.array([piece], pa.large_string()))[0].astype("<u4").tobytes() for piece in _pieces(whole)) + self.eos
                continue
            ids, ends = self._slice(part)
            packed, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            for a, b in zip(ends, ends[1:]):
                yield packed[a:b] + self.eos


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about _SLICE_BYTES; a text that is longer stands alone."""
    start = size = 0
    for k, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if size and size + n > _SLICE_BYTES:
            yield texts.slice(start, k - start)
            start, size = k, 0
        size += n + 1
    if start < len(texts):
        yield texts.slice(start)


def _pieces(text: bytes) -> Iterator[str]:
    """A long text in pieces that end at white space."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _SLICE_BYTES)
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        yield text[at:end].decode()
        at = end


class _Windows:
    """A fixed number of open windows. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, slots: int, slack: int, first_id: int) -> None:
        self.size, self.slots, self.slack, self.next_id = size, slots, slack, first_id
        self.open: list[tuple[int, list]] = []

    def _sealed(self, pieces: list) -> Iterator[tuple]:
        at, own = 0, self.next_id
        self.next_id += 1
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, own, at
            at += len(ids) // 4

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        """Best fit; where nothing fits, the fullest window is emitted, topped up with the head of the piece only if more
        than slack would be padded."""
        full = 4 * self.size
        while len(ids) >= full:
            yield from self._sealed([(doc, start, ids[:full], total)])
            start, ids = start + self.size, ids[full:]
        if not ids:
            return
        need = len(ids) // 4
        fits = [k for k, (used, _) in enumerate(self.open) if used + need <= self.size]
        if fits:
            k = max(fits, key=lambda i: self.open[i][0])
            used, pieces = self.open[k]
            pieces.append((doc, start, ids, total))
            self.open[k] = (used + need, pieces)
            if used + need == self.size:
                yield from self._sealed(self.open.pop(k)[1])
        elif len(self.open) < self.slots:
            self.open.append((need, [(doc, start, ids, total)]))
        else:
            used, pieces = self.open.pop(max(range(len(self.open)), key=lambda i: self.open[i][0]))
            head = self.size - used if self.size - used > self.slack else 0
            if head:
                pieces.append((doc, start, ids[: 4 * head], total))
            yield from self._sealed(pieces)
            yield from self.add(doc, start + head, ids[4 * head :], total)

    def leftovers(self) -> Iterator[tuple]:
        for _, pieces in self.open:
            yield from self._sealed(pieces)


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded size."""
    schema = _ARROW
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 64
        if size > _FLUSH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def pack(docs: DataFrame, encode: Callable[[pa.Array], Iterator[bytes]], window: int = 4096, open_windows: int = 32, fan_in: int = 32, slack: float = 0.01) -> DataFrame:
    """Packs the texts of docs (doc_id, text) into sequences of at most window tokens.

    Each partition keeps open_windows windows, places a document best-fit, and where none fits emits the fullest. Of an
    emitted window at most the share slack is padding: one with more room is topped up with the document's head first, and
    only then, or where it is longer than a window, a document is cut. Open windows left at the end of partitions are merged
    fan_in partitions at a time until one group is left, so no task ever holds more than fan_in * open_windows windows. Only
    the very last sequence can have more padding. Returns PIECES: one row per piece with its ids (little-endian uint32); a document's pieces partition
    its ids. Null text counts as empty (its one id is the closing one); a null doc_id stays null; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows = _Windows(window, open_windows, int(slack * window), part << 32)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, tokens in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                    for row in windows.add(doc, 0, tokens, len(tokens) // 4):
                        yield *row, None
            for row in windows.leftovers():
                yield *row, part

        yield from _batches(rows())

    schema = PIECES + ", level_group long"
    level = staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(first, schema), "packing")
    sealed = [level.filter("level_group is null")]
    groups = (level.agg(F.max("level_group")).first()[0] or 0) + 1
    depth = 0
    while True:
        depth += 1
        groups, last = -(-groups // fan_in), -(-groups // fan_in) == 1
        level = staged(level.filter("level_group is not null").withColumn("level_group", F.expr(f"level_group div {fan_in}")).groupBy("level_group").applyInArrow(_merger(window, int(slack * window), depth, last), schema), "packing")
        sealed.append(level.filter("level_group is null"))
        if last:
            break
    out = sealed[0]
    for more in sealed[1:]:
        out = out.unionByName(more)
    return out.drop("level_group")


def _merger(window: int, slack: int, depth: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Joins partly filled windows of a group, longest first, each topped up by the next."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        group, fill = rows[0]["level_group"], {}
        for r in rows:
            fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
        rows.sort(key=lambda r: (-fill[r["sequence_id"]], r["sequence_id"], r["offset"]))
        windows, out = _Windows(window, 1, slack, depth << 56 | group << 32), []
        for r in rows:
            out += [(*x, None) for x in windows.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])]
        out += [(*x, None if last else group) for x in windows.leftovers()]
        return pa.Table.from_batches(list(_batches(out)), schema=_ARROW)

    return merge
