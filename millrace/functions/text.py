"""Text functions: observation lists, normalisation for scoring, tokens and alignment."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.jsontext import number_text
from millrace.functions.labels import strip

# Latin letters that look like Cyrillic ones (M, H, B and T only as capitals).
HOMOGLYPHS = ("aAeEoOcCpPxXyYkKMHBT", "аАеЕоОсСрРхХуУкКМНВТ")
# Line boundaries of Unicode, which observation texts are split at.
LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def tail(items: Column, limit: int) -> Column:
    """The last limit items in order; a short list whole, and all of it for limit 0."""
    if limit == 0:
        return items
    return F.slice(items, F.greatest(F.size(items) - limit, F.lit(0)) + 1, F.lit(limit))


def observation_lines(text: Column, limit: int = 12) -> Column:
    """The last lines with text of a multi-line string."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINES, -1), strip), lambda x: x != "")
    return tail(lines, limit)


def timed_observations(raw: Column, limit: int = 12) -> Column:
    """'[time] event' of (time, event) structs, both stripped, without blank events; a blank time is left out. Null lists are empty."""
    said = lambda x, name: F.coalesce(strip(x[name].cast("string")), F.lit(""))
    known = F.transform(F.filter(raw, lambda x: x.isNotNull()), lambda x: F.struct(said(x, "time").alias("time"), said(x, "event").alias("event")))
    shown = F.transform(F.filter(known, lambda x: x["event"] != ""), lambda x: F.when(x["time"] == "", x["event"]).otherwise(F.concat(F.lit("["), x["time"], F.lit("] "), x["event"])))
    return tail(F.coalesce(shown, F.array().cast("array<string>")), limit)


def plain_text(value: Column, kind: T.DataType, separator: str = "\n") -> Column:
    """A value of any type as text: strings stripped; items of lists, and 'key: value' of maps and structs in their own order,
    joined by the separator and stripped, nulls left out; other values as JSON spells them, booleans as True and False. Null is empty."""
    inner = lambda x, k: plain_text(x, k, separator)
    if isinstance(kind, T.StringType):
        out = strip(value)
    elif isinstance(kind, T.ArrayType):
        out = strip(F.array_join(F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: inner(x, kind.elementType)), separator))
    elif isinstance(kind, T.MapType):
        entries = F.filter(F.map_entries(value), lambda e: e["value"].isNotNull())
        out = strip(F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(": "), inner(e["value"], kind.valueType))), separator))
    elif isinstance(kind, T.StructType):
        lines = [F.when(value[f.name].isNotNull(), F.concat(F.lit(f"{f.name}: "), inner(value[f.name], f.dataType))) for f in kind]
        out = F.when(value.isNotNull(), strip(F.concat_ws(separator, *lines)))
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, F.lit("True")).when(~value, F.lit("False"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number_text(value)
    elif isinstance(kind, T.VariantType):
        return as_text(F.to_json(value))
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit(""))


@F.pandas_udf(T.StringType())
def as_text(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """plain_text() of JSON texts, whose types only each value tells; members of objects come in their own order. For columns
    with a type plain_text() needs no Python."""
    import json

    def plain(v) -> str:
        if v is None:
            return ""
        if isinstance(v, list):
            return "\n".join(plain(x) for x in v if x is not None).strip()
        if isinstance(v, dict):
            return "\n".join(f"{k}: {plain(x)}" for k, x in v.items() if x is not None).strip()
        return str(v).strip()

    for column in values:
        yield column.map(lambda raw: "" if raw is None else plain(json.loads(raw)))


#: Characters that composition never changes, alone or beside each other: Latin to U+02FF, Greek but its signs, Cyrillic and Armenian but
#: their marks, punctuation and signs, kana, ideographs and Hangul syllables. A text of these is as it was.
SETTLED = r"\x00-\u02ff\u0370-\u0373\u0375-\u037d\u037f-\u0386\u0388-\u0482\u048a-\u0590\u2002-\u20cf\u2190-\u2328\u232b-\u2adb\u3001-\u3029\u3030-\u3098\u309b-\u9fff\uac00-\ud7a3"
# Pairs of letter and mark that decomposed Kazakh and Russian texts hold, and their letters.
COMPOSED = {"и\u0306": "й", "И\u0306": "Й", "е\u0308": "ё", "Е\u0308": "Ё", "у\u0306": "ў", "У\u0306": "Ў", "і\u0308": "ї", "І\u0308": "Ї"}


@F.arrow_udf(T.StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Canonical composition. Texts of settled characters are as they were, the pairs of Kazakh and Russian are replaced; only
    texts with other marks or signs go to Python."""
    # The first class is a quick one, of few ranges, that most characters fail.
    unsettled = lambda t: t.rlike(rf"[\u0300-\u036f\u0374\u037e\u0387\u0483-\u0489\u0591-\x{{10ffff}}](?<=[^{SETTLED}])")
    paired = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), COMPOSED.items(), text)
    odd = unsettled(text) & unsettled(paired)
    return F.when(~unsettled(text), text).when(~unsettled(paired), paired).otherwise(_composed(F.when(odd, text)))


def normalize(text: Column, compose: bool = True) -> Column:
    """A transcript as error rates compare it: composed, look-alike letters in Cyrillic, lower case, punctuation and
    hyphens at word edges as spaces, spaces collapsed. Null is empty."""
    given = F.coalesce(text, F.lit(""))
    low = F.lower(F.translate(nfc(given) if compose else given, *HOMOGLYPHS))
    letter = r"\p{L}\p{N}_"
    return F.btrim(F.regexp_replace(low, rf"(?:[^{letter}\-Ѐ-ӿ]|-(?<![{letter}]-)|-(?![{letter}]))+", " "))


def words(normalized: Column) -> Column:
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " ", -1))


def joined(normalized: Column) -> Column:
    """What is compared by characters: a text without its spaces."""
    return F.replace(normalized, F.lit(" "))


def characters(normalized: Column) -> Column:
    return F.filter(F.split(joined(normalized), "", -1), lambda c: c != "")


def align_expression(reference: Column, hypothesis: Column) -> Column:
    """(substitutions, deletions, insertions) of the cheapest alignment, as one fold over the reference that keeps a single
    row of the distance table. Equal tokens go diagonally; ties prefer a substitution, then a deletion. For short lists."""
    cell = "struct<c:int,s:int,d:int,i:int>"
    make = lambda c, s, d, i: F.struct(c.cast("int").alias("c"), s.cast("int").alias("s"), d.cast("int").alias("d"), i.cast("int").alias("i"))
    zero = F.lit(0)
    count = F.size(hypothesis)
    first = F.transform(F.sequence(zero, count), lambda j: make(j, zero, zero, j))
    one_more = lambda x, s, d, i: make(x["c"] + 1, x["s"] + s, x["d"] + d, x["i"] + i)

    def row(above: Column, token: Column) -> Column:
        start = F.array(one_more(F.get(above, zero), 0, 1, 0))

        def step(done: Column, j: Column) -> Column:
            diagonal, up, left = F.get(above, j - 1), F.get(above, j), F.get(done, j - 1)
            best = F.when((diagonal["c"] <= up["c"]) & (diagonal["c"] <= left["c"]), one_more(diagonal, 1, 0, 0)).when(up["c"] <= left["c"], one_more(up, 0, 1, 0)).otherwise(one_more(left, 0, 0, 1))
            return F.concat(done, F.array(F.when(F.get(hypothesis, j - 1) == token, diagonal).otherwise(best)))

        columns = F.when(count == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(count, F.lit(1))))
        return F.aggregate(columns, start.cast(f"array<{cell}>"), step)

    last = F.element_at(F.aggregate(reference, first.cast(f"array<{cell}>"), row), -1)
    return F.struct(last["s"].alias("substitutions"), last["d"].alias("deletions"), last["i"].alias("insertions"))


_BITS = 1 << 28  # of the distance table that are kept at once


class _Columns:
    """The distance table of a reference against growing heads of a hypothesis, a column at a time, as bits over the reference:
    where a cell costs as much as that before it on the diagonal, and where one more than that above it."""

    def __init__(self, reference: list) -> None:
        self.all = (1 << len(reference)) - 1
        self.up, self.down = self.all, 0  # where a cell costs one more, or one less, than that above it
        self.where: dict = {}
        for k, token in enumerate(reference):
            self.where[token] = self.where.get(token, 0) | 1 << k

    def step(self, token) -> tuple[int, int]:
        equal = self.where.get(token, 0) | self.down
        diagonal = ((((equal & self.up) + self.up) ^ self.up) | equal) & self.all
        right = ((self.down | (self.all & ~(diagonal | self.up))) << 1 | 1) & self.all
        self.up, self.down = ((diagonal & self.up) << 1 & self.all) | (self.all & ~(diagonal | right)), diagonal & right
        return diagonal, self.up


def alignment(reference: Sequence, hypothesis: Sequence) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of two token lists. Equal tokens go diagonally; ties prefer a substitution, then a
    deletion. Common ends are cut; a column of the table is a few operations on whole numbers; of a table beyond 2^28
    bits every so many columns are kept, and those between are made again on the way back."""
    n, m = len(reference), len(hypothesis)
    while n and m and reference[n - 1] == hypothesis[m - 1]:
        n, m = n - 1, m - 1
    head = 0
    while head < n and head < m and reference[head] == hypothesis[head]:
        head += 1
    r, h = list(reference[head:n]), list(hypothesis[head:m])
    n, m = len(r), len(h)
    if not n or not m:
        return 0, n, m
    columns = _Columns(r)
    block = m if 2 * n * m <= _BITS else max(1, math.isqrt(m))
    starts = []
    for k in range(0, m, block):
        starts.append((columns.up, columns.down))
        if k + block < m:
            for token in h[k : k + block]:
                columns.step(token)
    substitutions = deletions = insertions = 0
    i, j = n, m
    for k in range(len(starts) - 1, -1, -1):
        first = k * block
        columns.up, columns.down = starts[k]
        kept = [columns.step(token) for token in h[first : min(m, first + block)]]
        while i and j > first:
            if r[i - 1] == h[j - 1]:
                i, j = i - 1, j - 1
                continue
            diagonal, up = kept[j - 1 - first]
            if not diagonal >> (i - 1) & 1:
                i, j, substitutions = i - 1, j - 1, substitutions + 1
            elif up >> (i - 1) & 1:
                i, deletions = i - 1, deletions + 1
            else:
                j, insertions = j - 1, insertions + 1
    return substitutions, deletions + i, insertions + j


_COUNTS = ("substitutions", "deletions", "insertions")


_TOKENS = 1 << 18  # of the pairs of a batch that are held as lists at once; a longer pair stands alone


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in _COUNTS]))
def align(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """align_expression() for lists of any length, or for texts as lists of their characters, a bounded part of a batch at a time;
    a null list or text is empty."""
    texts = pa.types.is_string(reference.type) or pa.types.is_large_string(reference.type)
    length = pa.compute.utf8_length if texts else pa.compute.list_value_length
    sizes = [length(a).fill_null(0).cast(pa.int64()) for a in (reference, hypothesis)]
    ends = pa.compute.cumulative_sum(pa.compute.add(*sizes)).to_numpy()
    found, start, n = [], 0, len(ends)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(before + _TOKENS, "right")))
        own = [a.slice(start, stop - start) for a in (reference, hypothesis)]
        found += [alignment(r, h) if r != h else (0, 0, 0) for r, h in zip(*((t or "" for t in a.to_pylist()) for a in own) if texts else _coded(own))]
        start = stop
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (zip(*found) if found else ((), (), ()))], list(_COUNTS))


def _coded(lists: list[pa.Array]) -> list[list[list[int]]]:
    """Arrays of lists as lists of numbers, the same for equal tokens of all."""
    both = pa.concat_arrays([a.cast(pa.large_list(pa.large_string())).flatten() for a in lists])
    codes = both.dictionary_encode().indices.to_pylist()
    out, at = [], 0
    for a in lists:
        ends = [at, *(at + n for n in accumulate(pa.compute.list_value_length(a).fill_null(0).to_pylist()))]
        out.append([codes[x:y] for x, y in zip(ends, ends[1:])])
        at = ends[-1]
    return out
