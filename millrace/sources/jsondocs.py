"""JSON documents of any size, item by item: a list of rows is never held whole, and one file is read by many tasks.

Spark's text reader cuts a file at commas, which no escape straddles. What a comma means depends on what stands before: whether it lies in a
string, and how deep. A first pass therefore tells for each block of a file how it changes both, a fold over the blocks (one
record each) what each begins with, and the last pass cuts the items. An item that crosses blocks is put together from its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = b" \t\r\n\xef\xbb\xbf"  # white space and a byte order mark
_WHOLE, _BEGUN, _ENDED, _THROUGH = range(4)  # how an item's text lies in a block


class _State(NamedTuple):
    """What a block begins with: its file's root, whether it is in a string, how many brackets are open, whether it is in the list of rows."""

    root: str
    in_string: bool
    depth: int
    inside: bool


class _Marks:
    """Brackets outside strings and commas of a stretch of text, with the depth behind each bracket and at each comma outside strings."""

    def __init__(self, text: bytes, in_string: bool, depth: int) -> None:
        data = np.frombuffer(text, np.uint8)
        quotes = np.flatnonzero(data == 34)
        slashes = np.flatnonzero(data == 92)
        if len(slashes):
            first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
            length = np.diff(np.append(first, len(slashes)))
            quotes = np.setdiff1d(quotes, (slashes[first] + length)[length % 2 == 1], assume_unique=True)
        outside = lambda at: (np.searchsorted(quotes, at) + in_string) % 2 == 0
        lower = data | 0x20  # '[' and '{', ']' and '}' differ in this bit
        brackets = np.flatnonzero((lower == 0x7B) | (lower == 0x7D))
        own = outside(brackets)
        self.inner = int(np.where(lower[brackets[~own]] == 0x7B, 1, -1).sum())  # change of depth if strings were the rest
        self.at = brackets[own]
        self.sign = np.where(lower[self.at] == 0x7B, 1, -1)
        self.depth = depth + np.cumsum(self.sign)
        commas = np.flatnonzero(data == 44)
        self.commas = commas[outside(commas)]
        behind = np.concatenate([[depth], self.depth])
        self.comma_depth = behind[np.searchsorted(self.at, self.commas)]
        self.change, self.odd = int(self.sign.sum()), len(quotes) % 2 == 1


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(file, block, text) of consecutive pieces of a block, each with the comma that ended it."""
    for batch in batches:
        files, blocks = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = np.flatnonzero((np.diff(files, prepend=files[0] - 1 if len(files) else 0) != 0) | (np.diff(blocks, prepend=-1) != 0)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(files)]):
            yield int(files[a]), int(blocks[a]), b"".join(x + b"," for x in batch.column(2).slice(a, b - a).to_pylist())


_SUMMARY = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("odd", pa.bool_()), ("outer", pa.int64()), ("inner", pa.int64()), ("root", pa.string())])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: whether it ends in another state (string or not) than it begins with, and its change of depth for both."""
    found: dict[tuple[int, int], list] = {}
    for file, block, text in _stretches(batches):
        odd, outer, inner, root = found.get((file, block), (False, 0, 0, ""))
        m = _Marks(text, odd, 0)  # odd: in a string if the block began outside one
        found[file, block] = [odd ^ m.odd, outer + m.change, inner + m.inner, root or text.lstrip(_BLANK)[:1].decode("latin-1")]
    if found:
        rows = [(*place, *own) for place, own in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMMARY)], schema=_SUMMARY)


class _Cutter:
    """Cuts the items out of a block's text."""

    def __init__(self, state: _State, key: str) -> None:
        self.state, self.parts, self.begun, self.changed = state, [], False, False
        self.key = re.compile(rb'"' + re.escape(key.encode()) + rb'"\s*:\s*\Z')

    def items(self, text: bytes) -> Iterator[tuple[bytes, int]]:
        s = self.state
        m, top = _Marks(text, s.in_string, s.depth), 1 if s.root == "[" else 2
        opened = m.at[(m.sign > 0) & (m.depth == top)]
        if top == 2:
            opened = [p for p in opened.tolist() if text[p] == 0x5B and self.key.search(text, text.rfind(b",", 0, p) + 1, p)]
        ends = m.at[(m.sign < 0) & (m.depth == top - 1)]
        cuts = m.commas[m.comma_depth == top]
        inside, begin = s.inside, 0
        for p, what in sorted([(int(p), 0) for p in opened] + [(int(p), 1) for p in cuts] + [(int(p), 2) for p in ends]):
            if what == 0:
                inside, begin, self.parts, self.begun, self.changed = True, p + 1, [], True, True
            elif inside:
                yield b"".join([*self.parts, text[begin:p]]), _WHOLE if self.begun else _ENDED
                inside, begin, self.parts, self.begun, self.changed = what == 1, p + 1, [], True, True
            else:
                self.changed |= what == 2  # also in a block that wasn't known to begin inside the list
        if inside:
            self.parts.append(text[begin:])
        self.state = s._replace(in_string=s.in_string ^ m.odd, depth=s.depth + m.change, inside=inside)

    def rest(self) -> Iterator[tuple[bytes, int]]:
        """What the block leaves of an item that goes on."""
        if self.state.inside:
            yield b"".join(self.parts), _BEGUN if self.begun else _THROUGH


def _cutters(batches: Iterator[pa.RecordBatch], states: dict[tuple[int, int], _State], key: str) -> Iterator[tuple[int, int, _Cutter, bytes | None]]:
    """Each block's cutter with each stretch of its text, and once more with None at its end."""
    place, cutter = None, None
    for file, block, text in _stretches(batches):
        if (file, block) != place:
            if place:
                yield *place, cutter, None
            place, cutter = (file, block), _Cutter(states[file, block], key)
        yield file, block, cutter, text
    if place:
        yield *place, cutter, None


def _states(pieces: DataFrame, key: str, path: str) -> dict[tuple[int, int], _State]:
    """What each block begins with. A record a block reaches the driver."""
    blocks: dict[int, list] = {}
    for r in sorted(pieces.mapInArrow(_summaries, "file long, block long, odd boolean, outer long, inner long, root string").collect()):
        blocks.setdefault(r["file"], []).append(r)
    states = {}
    for own in blocks.values():
        root, in_string, depth = next((r["root"] for r in own if r["root"]), ""), False, 0
        if root not in ("[", "{"):
            raise ValueError(f"{path} holds a file that is no JSON list or object")
        for r in own:
            states[r["file"], r["block"]] = _State(root, in_string, depth, False)
            depth += r["inner"] if in_string else r["outer"]
            in_string ^= r["odd"]
        if in_string or depth:
            raise ValueError(f"{path} holds a JSON document that doesn't end")
    states = {p: s._replace(inside=s.root == "[" and s.depth > 0) for p, s in states.items()}
    if large := [f for f, own in blocks.items() if len(own) > 1 and states[f, own[0]["block"]].root == "{"]:
        sent = pieces.sparkSession.sparkContext.broadcast(states)

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for file, block, cutter, text in _cutters(batches, sent.value, key):
                if text is None:
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([cutter.state.inside if cutter.changed else None], pa.bool_())], ["file", "block", "inside"])
                else:
                    for _ in cutter.items(text):
                        pass

        told = {(r["file"], r["block"]): r["inside"] for r in pieces.mapInArrow(ends, "file long, block long, inside boolean").collect()}
        for f in large:
            inside = False
            for r in blocks[f]:
                place = r["file"], r["block"]
                states[place] = states[place]._replace(inside=inside)
                inside = inside if told[place] is None else told[place]
    return states


def json_items(spark: SparkSession, path: str, key: str = "data") -> DataFrame:
    """(file, block, place, raw): the JSON text of each row of the documents at path. A document's rows are the items of its
    top-level list; else, its root being an object, those of the list under key; else there are none. Order by file, block, place is
    that of the documents. A file that is no list or object, or doesn't end, is an error; blank files too. Memory is that of an
    item, or of the longest text between two commas."""
    if "," in key or '"' in key:
        raise ValueError(f"{key!r} has a comma or a quote")
    text = spark.read.option("lineSep", ",").text(path)
    pieces = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.encode("value", "UTF-8").alias("value"))
    sent = spark.sparkContext.broadcast(_states(pieces, key, path))
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("raw", pa.binary()), ("kind", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = 0, None
        for file, block, cutter, stretch in _cutters(batches, sent.value, key):
            place, last = (place if (file, block) == last else 0), (file, block)
            made = list(cutter.rest() if stretch is None else cutter.items(stretch))
            if made:
                raw, kind = zip(*made)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(raw)), pa.array([block] * len(raw)), pa.array(range(place, place + len(raw))), pa.array(raw, pa.binary()), pa.array(kind, pa.int32())], schema=schema)
                place += len(raw)

    found = pieces.mapInArrow(cut, "file long, block long, place long, raw binary, kind int")
    several = any(block for _, block in sent.value)
    items = found.filter(F.col("kind") == _WHOLE).select("file", "block", "place", "raw")
    if several:  # texts that cross blocks: two a block at most
        item = F.sum((F.col("kind") == _BEGUN).cast("long")).over(Window.partitionBy("file").orderBy("block", "place"))
        crossing = found.filter(F.col("kind") != _WHOLE).withColumn("item", item)
        parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "raw"))), lambda x: x["raw"])
        joined = F.aggregate(parts, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))
        first = F.min(F.struct("block", "place"))
        items = items.unionByName(crossing.groupBy("file", "item").agg(first.alias("p"), joined.alias("raw")).select("file", "p.block", "p.place", "raw"))
    return items.withColumn("raw", F.decode("raw", "UTF-8")).filter(~F.col("raw").rlike(r"\A\s*\z"))


def read_items(items: DataFrame, schema: str | None = None) -> DataFrame:
    """Items (raw) as rows: an object's members are columns, any other item is a column row; _file, _block and _place order them.
    Without a schema of the rows (as DDL) it is found in a pass of its own; malformed items fail the read."""
    spark = items.sparkSession
    text = F.concat(F.lit('{"row":'), "raw", F.lit("}"))
    if schema is None:
        strings = getattr(items.select(text.alias("value"))._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        found = DataFrame(spark._jsparkSession.read().option("mode", "FAILFAST").json(strings), spark).schema
        kind = found["row"].dataType if "row" in found.names else T.StringType()
    else:
        kind = T.StructType.fromDDL(schema)
    parsed = F.from_json(text, T.StructType([T.StructField("row", kind)]), {"mode": "FAILFAST"})["row"]
    rows = items.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("place").alias("_place"), parsed.alias("row"))
    return rows.select("_file", "_block", "_place", "row.*") if isinstance(kind, T.StructType) else rows
