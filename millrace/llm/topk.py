"""Exact top-k search by inner product: a three-phase uniform threshold over blocks of dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.staging import discard, staged
from millrace.llm.vectors import integer_vectors, matrices

_LEAST = -(1 << 62)  # below every score; exact as a double
_CHUNK = 1 << 21  # scores held at a time, by block


class _Queries(NamedTuple):
    """Queries of one length that are searched together; numbers are their places among all queries of the round."""

    numbers: np.ndarray
    ids: np.ndarray
    x: np.ndarray


def _scores(q: np.ndarray, x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Local scores: inner products of all pairs within each of so many blocks of dimensions, exact as doubles or longs."""
    d = q.shape[1]
    largest = max(1, d) * max(1, *(abs(int(f(initial=0))) for f in (q.min, q.max))) * max(1, *(abs(int(f(initial=0))) for f in (x.min, x.max)))
    if largest >= 1 << 62:
        raise ValueError("inner products beyond a 64-bit integer")
    if largest < 1 << 53:
        q, x = q.astype("f8"), x.astype("f8")
    cuts = [d * b // parts for b in range(parts + 1)]
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts, cuts[1:])]


class _Best:
    """The best entries of each query, by falling score, then smaller id (a null id last)."""

    def __init__(self, queries: int, keep: int) -> None:
        self.keep = keep
        self.entries = [np.empty(0, "i8") for _ in range(5)]  # query, score, id, whether it is null, more
        self.floor = np.full(queries, _LEAST, "i8")

    def add(self, *entries: np.ndarray) -> None:
        entries = [np.concatenate([a, np.asarray(b, "i8")]) for a, b in zip(self.entries, entries)]
        q, score, own, null, _ = entries
        order = np.lexsort((own, null, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        stay = place < self.keep
        self.entries = [e[order[stay]] for e in entries]
        full = self.entries[0][place[stay] == self.keep - 1]
        self.floor[full] = self.entries[1][place[stay] == self.keep - 1]


def _ids(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("id").take(pa.array(rows))
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)


def _chunks(queries: _Queries, rows: int) -> Iterator[slice]:
    step = max(1, _CHUNK // max(1, rows))
    return (slice(a, a + step) for a in range(0, len(queries.numbers), step))


def _local_lists(queries: dict[int, _Queries], total: int, keep: int, parts: int):
    """Phase one: for each query and block of dimensions the best local scores among a task's rows, with the rows' whole scores."""
    schema = pa.schema([("query", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("score", pa.int64()), ("whole", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(total, keep) for _ in range(parts)]
        for batch in batches:
            for rows, x in matrices(batch):
                if not (own := queries.get(x.shape[1])):
                    continue
                ids, null = _ids(batch, rows)
                for cut in _chunks(own, len(x)):
                    local, numbers = _scores(own.x[cut], x, parts), own.numbers[cut]
                    for b, score in enumerate(local):
                        least = best[b].floor[numbers]
                        if len(x) > keep:
                            least = np.maximum(least, np.partition(score, len(x) - keep, axis=1)[:, -keep].astype("i8")) if (least == _LEAST).any() else least
                        i, j = np.nonzero(score >= least[:, None])
                        best[b].add(numbers[i], score[i, j], ids[j], null[j], sum(s[i, j] for s in local))
        for b, found in enumerate(best):
            q, score, own, null, whole = found.entries
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(np.full(len(q), b), pa.int32()), pa.array(own, mask=null.astype(bool)), pa.array(score), pa.array(whole)], schema=schema)

    return run


def _sufficient(queries: dict[int, _Queries], cutoffs: np.ndarray, keep: int, parts: int):
    """Phases two and three: of a task's rows those with a local score of at least the uniform share of the query's cutoff in
    some block, less those whose bound (the share in place of smaller local scores) is under the cutoff; the rest get
    their whole scores, and the best of them stay."""
    schema = pa.schema([("query", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_())])
    shares = -(-cutoffs // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, names = _Best(len(cutoffs), keep), np.empty(len(cutoffs), "i8")
        for own in queries.values():
            names[own.numbers] = own.ids
        for batch in batches:
            for rows, x in matrices(batch):
                if not (own := queries.get(x.shape[1])):
                    continue
                ids, null = _ids(batch, rows)
                for cut in _chunks(own, len(x)):
                    local, numbers = _scores(own.x[cut], x, parts), own.numbers[cut]
                    share, least = shares[numbers][:, None], np.maximum(cutoffs, best.floor)[numbers]
                    enough = local[0] >= share
                    for score in local[1:]:
                        enough |= score >= share
                    i, j = np.nonzero(enough)
                    entries = [score[i, j] for score in local]
                    near = shares[numbers][i]
                    may = sum(np.maximum(e, near - 1) for e in entries) >= least[i]
                    i, j, whole = i[may], j[may], sum(e[may] for e in entries)
                    stay = whole >= least[i]
                    i, j, whole = i[stay], j[stay], whole[stay]
                    same = (own.ids[cut][i] == ids[j]) & ~null[j]
                    same[same] = (own.x[cut][i[same]] == x[j[same]]).all(1)
                    best.add(numbers[i], whole, ids[j], null[j], same)
        q, score, found, null, same = best.entries
        for a in range(0, len(q), 1 << 16):
            s = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(q[s], pa.int32()), pa.array(names[q[s]]), pa.array(found[s], mask=null[s].astype(bool)), pa.array(score[s]), pa.array(same[s].astype(bool))], schema=schema)

    return run


def _gathered(queries: DataFrame) -> tuple[dict[int, _Queries], int]:
    table = queries.select("id", "x").toArrow().combine_chunks()
    found = {}
    for batch in table.to_batches():
        ids, _ = _ids(batch, np.arange(len(batch)))
        found |= {x.shape[1]: _Queries(rows, ids[rows], x) for rows, x in matrices(batch)}
    return found, table.num_rows


def search(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, parts: int = 4, round_bytes: int = 32 << 20) -> DataFrame:
    """The k best rows of every query row, itself left out, by the inner product of integer vectors (floor(scale * entry)).

    The dimensions are cut into parts; a part's inner products are one score list. Phase one gathers each list's best entries
    from all tasks; the whole scores of these rows give each query's cutoff, which k other rows are sure to reach. Phase two
    collects what has at least the cutoff's uniform share in some list (a row without is under the cutoff), phase three
    resolves the whole scores of what is left, and Spark merges the tasks' best. Queries are staged, and searched in rounds
    of at most round_bytes, the size of a broadcast; a row meets a query in the task that reads it, so rows aren't shuffled.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id, a null id last. Vectors that are null or hold
    null or non-finite entries take no part, nor do rows of another length than the query's; a query with fewer others has fewer
    rows. Repeated rows count each: one of them is the query itself. Null ids are never queries unless is_query says so.
    An empty table gives no rows; other columns are ignored. Scores beyond a long raise an error.
    """
    vectors = integer_vectors(rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")), "id", "x", scale)
    asked = integer_vectors(rows.filter(is_query).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")), "id", "x", scale)
    size = asked.agg(F.sum(8.0 * F.size("x") + 16)).first()[0] or 0.0
    rounds = int(-(-size // round_bytes)) or 1
    asked = staged(asked.repartition(rounds).withColumn("round", F.spark_partition_id()), "topk-queries")
    shape = "query_id long, rank int, vec_id long, score long"
    found = [_round(vectors, asked.filter(F.col("round") == r), k, parts) for r in range(rounds)]
    discard(asked)
    out = rows.sparkSession.createDataFrame([], shape)
    for part in found:
        out = out.unionByName(part)
    return out


def _round(vectors: DataFrame, asked: DataFrame, k: int, parts: int) -> DataFrame:
    spark = vectors.sparkSession
    queries, total = _gathered(asked)
    sent = spark.sparkContext.broadcast(queries)
    keep = k + 1  # the query's own row may be among the best
    lists = vectors.mapInArrow(lambda b: _local_lists(sent.value, total, keep, parts)(b), "query int, part int, id long, score long, whole long")
    place = F.row_number().over(Window.partitionBy("query", "part").orderBy(F.desc("score")))
    seen = lists.withColumn("place", place).filter(F.col("place") <= keep).select("query", "id", "whole").distinct()
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("whole")))
    cutoffs = np.full(total, _LEAST, "i8")
    for r in seen.withColumn("place", place).filter(F.col("place") == keep).select("query", "whole").collect():
        cutoffs[r["query"]] = r["whole"]
    held = spark.sparkContext.broadcast(cutoffs)
    best = vectors.mapInArrow(lambda b: _sufficient(sent.value, held.value, keep, parts)(b), "query int, query_id long, vec_id long, score long, own boolean")
    order = (F.desc("score"), F.asc_nulls_last("vec_id"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= keep)
    other = best.withColumn("mine", F.row_number().over(Window.partitionBy("query", "own").orderBy("place"))).filter("not own or mine > 1")
    ranked = other.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("place"))).filter(F.col("rank") <= k)
    return staged(ranked.select("query_id", "rank", "vec_id", "score"), "topk")
