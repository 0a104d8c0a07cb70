"""Train and evaluation texts that coincide."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PROBE, _STEP = 32, 16  # characters of an item that are looked for at first, and between the candidates for them


def exact_overlap(train: DataFrame, held_out: DataFrame, text: str = "text") -> DataFrame:
    """Rows of held_out whose text is in train, by digest."""
    digest = lambda d: F.sha2(F.trim(d[text]), 256)
    return held_out.join(train.select(digest(train).alias("_digest")).distinct(), digest(held_out) == F.col("_digest"), "left_semi")


def _probes(texts: list[str]) -> dict[str, list[int]]:
    """A piece of each text, that which the fewest texts have at a step, and the texts (by number) that chose it."""
    pieces = lambda t: {t[k : k + _PROBE] for k in range(0, max(1, len(t) - _PROBE + 1), _STEP)}
    often = Counter(p for t in texts for p in pieces(t))
    chosen: dict[str, list[int]] = {}
    for k, t in enumerate(texts):
        chosen.setdefault(min(pieces(t), key=lambda p: (often[p], -len(p), p)), []).append(k)
    return chosen


@lru_cache(maxsize=1)
def _automaton(block: int, sent):
    """The automaton of a broadcast block of texts, made once a worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for piece, owners in sent.value[1].items():
        found.add_word(piece, owners)
    found.make_automaton()
    return found


def contained(train: DataFrame, held_out: DataFrame, key: str, item: str, text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(key, item): the items whose whole text occurs in a row's, each pair once.

    Items are taken in blocks of about block_bytes of text, one pass over the rows for each block: a piece of every item goes into one automaton
    a task, which looks for all of them at once in a text; where a piece is found the whole item is compared. Rows are
    neither split into words nor shuffled. Null and blank items occur nowhere; null texts hold nothing; equal items are found each.
    """
    spark = train.sparkSession
    kinds = dict(train.dtypes)[key], dict(held_out.dtypes)[item]
    ddl = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}"
    items = held_out.filter(F.trim(text) != "").select(F.col(item).alias("_item"), F.col(text).cast("string").alias("_text"))
    size = items.agg(F.sum(F.octet_length("_text") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    spread = items.withColumn("_block", F.pmod(F.xxhash64("_text"), F.lit(max(1, blocks))))
    source = train.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).filter("_text is not null")
    out = spark.createDataFrame([], ddl)
    for block in range(blocks):
        own = spread.filter(F.col("_block") == block).select("_item", "_text").toArrow()
        texts, names = own.column("_text").to_pylist(), own.column("_item").combine_chunks()
        sent = spark.sparkContext.broadcast((texts, _probes(texts)))

        def look(batches: Iterator[pa.RecordBatch], sent=sent, names=names, block=block) -> Iterator[pa.RecordBatch]:
            machine, texts = _automaton(block, sent), sent.value[0]
            for batch in batches:
                rows, met = [], []
                for k, said in enumerate(batch.column(1).to_pylist()):
                    near = {id(owners): owners for _, owners in machine.iter(said)}
                    held = [i for owners in near.values() for i in owners if texts[i] in said]
                    rows += [k] * len(held)
                    met += held
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), names.take(pa.array(met, pa.int64()))], [key, item])

        if texts:
            out = out.unionByName(source.mapInArrow(look, ddl))
    return out.distinct()
