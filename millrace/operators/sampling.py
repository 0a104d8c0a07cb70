"""Class balancing, proportional mixing and splitting. Rows are never repeated; a mix shrinks instead.

Order is that of salted MD5 digests of a stable id, so a seed gives the same rows whatever the partitioning. Each stage has
a salt of its own: with one salt, rows that survived a small sample would all come first in a later split.

A sample's size is exact. Its cut is found by refining a histogram: one pass counts digests by their first 16 bits, a second
the digests of the bucket that holds the cut. What is taken is then one filter on a literal cut a group, so the returned
plan reads its source once. Only where rows of one key straddle the cut are they told apart by a digest of the whole row.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = 4  # hexadecimal digits; at most 65,536 buckets and one of null keys
_NONE, _ALL = "", "~"  # before and behind every digest
_AT_ONCE = 1 << 20


def shuffle_key(seed: int, stage: str, key: Column) -> Column:
    """The salted digest of a key. Null keys come last, behind all hexadecimal digits, as in SQL."""
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}:{stage}:"), key.cast("string"))), F.lit("null"))


def _row_digest(rows: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])), 256)


class _Cut(NamedTuple):
    """Where a group's sample ends: behind all rows of smaller digests, of this digest those up to a row digest (None: all),
    and of equal rows with that digest so many copies (None: all); over are the copies that are left out."""

    digest: str
    row: str | None = None
    copies: int | None = None
    over: int = 0


_CUTS = "_group {}, _cut string, _cut_row string, _copies long"


def _histogram(rows: DataFrame, group: Column, digest: Column) -> dict[Any, list[tuple[str, int]]]:
    """(bucket, rows) by group, in order; at most 65,537 a group reach the driver."""
    counts = rows.groupBy(group.alias("g"), F.substring(digest, 1, _BUCKET).alias("b")).agg(F.count("*").alias("c"))
    found: dict[Any, list] = {}
    for r in counts.toArrow().to_pylist():
        found.setdefault(r["g"], []).append((r["b"], r["c"]))
    return {g: sorted(b) for g, b in found.items()}


def _holding(buckets: list[tuple[str, int]], quota: int) -> tuple[str, int, int]:
    """The bucket in which the first quota rows end, how many of its rows they take, and how many it has."""
    before = 0
    for bucket, n in buckets:
        if before + n >= quota:
            return bucket, quota - before, n
        before += n
    raise AssertionError("a quota beyond the group")


def _refined(rows: DataFrame, group: Column, order: Column, inside: dict[Any, tuple[str, int]], kind: str) -> dict[Any, tuple[str, int, int]]:
    """For each group the value of order at which the first so many rows, of those whose order begins with a prefix, end; how many of its
    rows they take, and how many it has."""
    own = rows.sparkSession.createDataFrame([(g, p, n) for g, (p, n) in inside.items()], f"_g {kind}, _prefix string, _left long")
    here = rows.select(group.alias("_group"), order.alias("_order")).join(F.broadcast(own), F.col("_group").eqNullSafe(F.col("_g"))).filter(F.startswith("_order", "_prefix"))
    counts = here.groupBy("_group", "_order").agg(F.count("*").alias("c"), F.first("_left").alias("left"))
    upto = Window.partitionBy("_group").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    found = counts.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0))).filter("before < left and before + c >= left")
    return {r["_group"]: (r["_order"], r["left"] - r["before"], r["c"]) for r in found.collect()}


def _cuts(rows: DataFrame, group: Column, kind: str, digest: Column, buckets: dict[Any, list[tuple[str, int]]], quotas: dict[Any, int]) -> dict[Any, _Cut]:
    """The cut of each group's first quota rows; a row a group reaches the driver."""
    cuts, split = {}, {}
    for g, quota in quotas.items():
        whole = sum(n for _, n in buckets.get(g, []))
        if quota <= 0 or quota >= whole:
            cuts[g] = _Cut(_NONE if quota <= 0 else _ALL)
            continue
        bucket, left, n = _holding(buckets[g], quota)
        if left == n:
            cuts[g] = _Cut(bucket + _ALL)
        else:
            split[g] = (bucket, left)
    tied = {}
    for g, (value, left, n) in (_refined(rows, group, digest, split, kind) if split else {}).items():
        if left == n:
            cuts[g] = _Cut(value)
        else:
            tied[g] = (value, left)
    if tied:  # rows of one key: by their own digests, first by its bucket
        own = rows.sparkSession.createDataFrame([(g, d) for g, (d, _) in tied.items()], f"_g {kind}, _d string")
        alike = rows.join(F.broadcast(own), group.eqNullSafe(F.col("_g")) & (digest == F.col("_d")))
        order = _row_digest(rows)
        of_rows = _histogram(alike, group, order)
        inside = {g: _holding(of_rows[g], left)[:2] for g, (_, left) in tied.items()}
        for g, (value, left, n) in _refined(alike, group, order, inside, kind).items():
            cuts[g] = _Cut(tied[g][0], value, None if left == n else left, n - left)
    return cuts


def _told(rows: DataFrame, group: Column, kind: str, digest: Column, cuts: dict[Any, _Cut]) -> DataFrame:
    """rows of the groups with a cut and _taken: whether they lie before it; null for the equal rows of which only some copies do."""
    own = rows.sparkSession.createDataFrame([(g, c.digest, c.row, c.copies) for g, c in cuts.items()], _CUTS.format(kind))
    met = rows.withColumn("_digest", digest).join(F.broadcast(own), group.eqNullSafe(F.col("_group")))
    by_row = _row_digest(rows)
    tie = F.when(F.col("_cut_row").isNull() | (by_row < F.col("_cut_row")), True).when(by_row > F.col("_cut_row"), False).when(F.col("_copies").isNull(), True)
    return met.withColumn("_taken", F.when(F.col("_digest") == F.col("_cut"), tie).otherwise(F.col("_digest") < F.col("_cut"))).drop("_digest", "_group", "_cut", "_cut_row", "_copies")


def _copies(row: DataFrame, n: int) -> DataFrame:
    """A table's one row n times, made by many tasks."""
    parts = -(-n // _AT_ONCE)
    sizes = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.least(F.lit(_AT_ONCE), F.lit(n) - k * _AT_ONCE).cast("int"))
    spread = row.withColumn("_n", F.explode(sizes))
    spread = spread.repartition(min(parts, 1000)) if parts > 1 else spread
    return spread.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).drop("_n")


def _straddling(rows: DataFrame, group: Column, digest: Column, cuts: dict[Any, _Cut]):
    """(one of the equal rows, copies taken, copies left out) of each group in which only some of equal rows are taken."""
    for g, c in cuts.items():
        if c.copies is not None:
            yield rows.filter(group.eqNullSafe(F.lit(g)) & (digest == c.digest)).filter(_row_digest(rows) == c.row).limit(1), c.copies, c.over


def _exact_top(rows: DataFrame, group: str, digest: Column, buckets: dict[Any, list[tuple[str, int]]], quotas: dict[Any, int]) -> DataFrame:
    """For each group with a quota its first rows in shuffled order, exactly, whatever the keys: repeated ones or null."""
    by, kind = F.col(group), dict(rows.dtypes)[group]
    cuts = _cuts(rows, by, kind, digest, buckets, quotas)
    out = _told(rows, by, kind, digest, cuts).filter("_taken").drop("_taken")
    for row, taken, _ in _straddling(rows, by, digest, cuts):
        out = out.unionByName(_copies(row, taken))
    return out


def downsample_to_balance(rows: DataFrame, group: str, key: Column, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest has; all rows if there are fewer than two classes."""
    digest = shuffle_key(seed, "balance", key)
    buckets = _histogram(rows, F.col(group), digest)
    sizes = {g: sum(n for _, n in b) for g, b in buckets.items()}
    if len(sizes) < 2:
        return rows
    return _exact_top(rows, group, digest, buckets, dict.fromkeys(sizes, min(sizes.values())))


def balanced_count(counts: DataFrame, class_column: str, count_column: str) -> DataFrame:
    """How many rows balancing would leave: the smallest class times their number; with one class, all. Unknown is left out."""
    known = counts.filter(F.col(class_column) != "UNKNOWN")
    return known.agg(F.coalesce(F.when(F.count("*") > 1, F.min(count_column) * F.count("*")).otherwise(F.sum(count_column)), F.lit(0)).cast("long").alias("balanced"))


def renormalize(sources: DataFrame) -> DataFrame:
    """Sources (ord, name, proportion, n) without the empty ones, shares divided by what is left of them. Shares stay as they
    are if none is empty; all empty is an error."""
    whole = Window.partitionBy()
    alive = F.sum(F.when(F.col("n") > 0, F.col("proportion")).otherwise(F.lit(0.0))).over(whole)
    dead = F.sum(F.when(F.col("n") > 0, 0).otherwise(1)).over(whole)
    rescaled = sources.withColumn("_alive", alive).withColumn("_dead", dead)
    living = F.when(F.col("_alive") > 0, F.col("n") > 0).otherwise(F.raise_error(F.lit("every source is empty; fetch the data first")).cast("boolean"))
    return rescaled.filter(living).withColumn("proportion", F.when(F.col("_dead") > 0, F.col("proportion") / F.col("_alive")).otherwise(F.col("proportion"))).drop("_alive", "_dead")


def mix_ceiling(sources: DataFrame) -> DataFrame:
    """(max_total, limiting): the largest mix that repeats no row, and the source (the first listed of equals) that limits it."""
    room = F.floor(F.col("n") / F.col("proportion"))
    found = sources.filter("proportion > 0").agg(F.min(F.struct(room.alias("room"), "ord", "name")).alias("m"))
    return found.select(F.coalesce("m.room", F.lit(0)).cast("long").alias("max_total"), F.coalesce("m.name", F.lit("")).alias("limiting"))


def mix_plan(sources: DataFrame, target: int | None) -> DataFrame:
    """Sources with wanted (half to even) and taken rows, and the mix's totals on every row. Shares must sum to 1."""
    total = sources.agg(F.sum("proportion").alias("_sum"))
    ceiling = mix_ceiling(sources)
    whole = F.least(F.lit(target).cast("long"), F.col("max_total")) if target is not None else F.col("max_total")
    joined = sources.join(F.broadcast(ceiling.join(total, F.lit(True))), F.lit(True)).withColumn("total", F.when(F.abs(F.col("_sum") - 1) <= 1e-6, whole).otherwise(F.raise_error(F.concat(F.lit("shares sum to "), F.col("_sum").cast("string")))))
    planned = joined.withColumn("wanted", F.bround(F.col("total") * F.col("proportion")).cast("long"))
    return planned.withColumn("taken", F.least("wanted", "n")).withColumn("shortfall", F.col("wanted") - F.col("taken")).drop("_sum")


def build_mix(rows: DataFrame, shares: dict[str, float], key: Column, target: int | None = None, seed: int = 42, source: str = "source") -> DataFrame:
    """The largest mix of rows (tagged by source) in the given shares, at most target rows, no row twice."""
    digest = shuffle_key(seed, "mix", key)
    buckets = _histogram(rows, F.col(source), digest)
    sizes = [(k, name, float(p), sum(n for _, n in buckets.get(name, []))) for k, (name, p) in enumerate(shares.items())]
    listed = rows.sparkSession.createDataFrame(sizes, "ord int, name string, proportion double, n long")
    quotas = {r["name"]: r["taken"] for r in mix_plan(renormalize(listed), target).select("name", "taken").collect()}
    return _exact_top(rows, source, digest, buckets, quotas)


def train_val_split(rows: DataFrame, ratio: float, key: Column, seed: int = 42) -> DataFrame:
    """rows with a column part: the first max(1, int(n * ratio)) rows in shuffled order are val, the others train; so the
    parts are disjoint and exhaustive."""
    if not 0 < ratio < 1:
        raise ValueError(f"val ratio {ratio} is not between 0 and 1")
    own = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "part"])
    digest, whole = shuffle_key(seed, "split", key), F.lit("")
    buckets = _histogram(own, whole, digest)
    n = sum(n for _, n in buckets.get("", []))
    cuts = _cuts(own, whole, "string", digest, buckets, {"": max(1, int(n * ratio))} if n > 1 else {"": n})
    part = lambda taken: F.when(taken, "val").otherwise("train").alias("part")
    out = _told(own, whole, "string", digest, cuts)
    if any(c.copies is not None for c in cuts.values()):
        out = out.filter("_taken is not null")
    out = out.select(*own.columns, part(F.col("_taken")))
    for row, taken, left in _straddling(own, whole, digest, cuts):
        for copies, name in ((taken, "val"), (left, "train")):
            out = out.unionByName(_copies(row, copies).withColumn("part", F.lit(name)))
    return out
