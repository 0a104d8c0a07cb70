"""Placement of rows on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the production table; a prime, and far more than shards, so that shares differ by at most a few per mille.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index in shards that owns each slot. Shards take turns; each claims the first free slot of its own permutation
    (offset + k * skip, modulo the prime number of slots). Adding or removing a shard moves few slots beside its own."""
    if not _is_prime(slots):
        raise ValueError(f"{slots} is not a prime number of slots")
    if not shards or len(shards) > slots:
        raise ValueError(f"{len(shards)} shards for {slots} slots")
    if len(set(shards)) < len(shards):
        raise ValueError("two shards have the same name")
    digests = [int.from_bytes(hashlib.md5(s.encode()).digest(), "big") for s in shards]
    steps = [(d % slots, (d >> 64) % (slots - 1) + 1) for d in digests]
    at, owner, left = [0] * len(shards), [-1] * slots, slots
    while left:
        for k, (offset, skip) in enumerate(steps):
            while owner[slot := (offset + at[k] * skip) % slots] >= 0:
                at[k] += 1
            owner[slot] = k
            at[k] += 1
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: 60 bits of its MD5, modulo the number of slots. A null key counts as the empty string."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots))


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard); their number is the parameter slots, whatever the data's size."""
    owner = fill_table(shards, slots)
    return spark.createDataFrame([(k, shards[o]) for k, o in enumerate(owner)], "slot long, shard string")


def assign(rows: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Adds the columns slot and shard to rows (replacing columns of these names).

    The table is broadcast: it has slots rows whatever rows holds, so placement costs one hash and one lookup a row and
    no shuffle; repeated keys, however many, stay where they are. Equal keys get equal shards; null keys share one.
    """
    own = [F.col(f"`{c}`") for c in rows.columns if c not in ("slot", "shard")]
    placed = rows.select(*own, slot_of(key, slots).alias("slot"))
    return placed.join(F.broadcast(lookup(rows.sparkSession, shards, slots)), "slot", "left").select(*own, "slot", "shard")
