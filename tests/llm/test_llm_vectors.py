"""Whitening and exact top-k search against plain Python, and their edge cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, topk, vectors, whitening

SHAPE = "vec_id long, embedding array<float>, label int"


def whole(v, scale=256):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(scale * c) for c in v]


def single(v):
    return None if v is None else [None if c is None else float(np.float32(c)) for c in v]


def table(spark, rows, tmp_path=None):
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], SHAPE)
    for c in ("id", "x", "d", "i", "query", "rank", "score", "own", "n", "component"):
        df = df.withColumn(c, F.lit("clash"))
    if tmp_path is None:
        return df
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def odd(rng, n, d=6, spread=1.0):
    rows = [(k, single([rng.gauss(0.3, spread * (1 + j)) for j in range(d)])) for k in range(n)]
    rows += [(n, None), (n + 1, [1.0, None, *[0.0] * (d - 2)]), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] + [0.0] * (d - 1)), (None, single([0.1] * d)), (0, rows[0][1]), (50, rows[0][1]), (n + 7, rows[1][1]), (n + 8, rows[1][1])]
    return rows


def plain_covariance(xs):
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    return sums, np.array([[float(Fraction(n * sum(x[i] * x[j] for x in xs) - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)])


def test_whitening_equals_its_contract(spark, tmp_path):
    rng = random.Random(1)
    rows = odd(rng, 300)
    got = queries.op11_whitening(spark, table(spark, rows, tmp_path)).collect()
    kept = [(k, x) for k, v in rows if (x := whole(v)) is not None]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    sums, v = plain_covariance(fit)
    values, comps = np.linalg.eigh(v)
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], set()).add(r["whitened"])
        assert r["deviation_text"] == str(r["deviation"]) and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], values[-r["component"]] / np.trace(v), rel_tol=1e-9)
    signs = None
    for k, x in kept:
        own = by[k, sum((n * a - s) ** 2 for a, s in zip(x, sums))]
        exact = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        w = np.array([exact @ comps[:, -c] / math.sqrt(values[-c]) for c in (1, 2, 3, 4)])
        mine = np.array([next(iter(own[c])) for c in (1, 2, 3, 4)])
        signs = np.sign(w * mine) if signs is None else signs
        assert all(len(own[c]) == 1 for c in own) and np.allclose(mine, signs * w, rtol=0, atol=1e-9)


def test_scatter_is_exact_beyond_longs(spark):
    rng = random.Random(2)
    xs = [[rng.randrange(-(1 << 63), 1 << 63), (1 << 63) - 1 - rng.randrange(3), -(1 << 63), rng.randrange(-5, 5)] for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "x array<bigint>").repartition(5)
    n, sums, cross, shift = whitening._scatter(df)[4]
    assert n == 200 and [s + n * t for s, t in zip(sums, shift)] == [sum(c) for c in zip(*xs)]
    for i in range(4):
        for j in range(i, 4):
            assert n * cross[i][j] - sums[i] * sums[j] == n * sum(x[i] * x[j] for x in xs) - sum(x[i] for x in xs) * sum(x[j] for x in xs)


def test_a_large_offset_costs_no_digits(spark):
    """Entries of about 10^15 that differ by a few units: a covariance in doubles would be noise."""
    rng = random.Random(3)
    xs = [[10**15 + rng.randrange(8), 10**15 + rng.randrange(3)] for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x array<bigint>").distinct()
    m = whitening.fit(df)[2]
    _, v = plain_covariance(sorted({tuple(x) for x in xs}))
    assert np.allclose(m.eigenvalues, np.linalg.eigvalsh(v)[::-1], rtol=1e-12) and m.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    few = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.5]), (4, []), (5, [1.5])]
    got = whitening.whiten(table(spark, few)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["whitened"]) for r in got if r["vec_id"] < 3) == [(1, 1, 1, None)] * 2 + [(1, 2, 1, None)] * 2 + [(2, 1, 1, None), (2, 2, 1, None)]
    assert sorted((r["vec_id"], r["n"], abs(r["whitened"])) for r in got if r["vec_id"] > 2) == [(3, 2, 1.0), (5, 2, 1.0)]
    assert whitening.whiten(table(spark, few).limit(0)).collect() == []
    huge = whitening.whiten(table(spark, [(1, [3e38]), (2, [-3e38])])).collect()
    assert {r["deviation"] for r in huge} == {None} and {r["deviation_text"] for r in huge} == {str(((1 << 64) - 1) ** 2)}


def plain_search(rows, k=5, every=50):
    out = []
    kept = [(own, x) for own, v in rows if (x := whole(v)) is not None]
    for a, (q, x) in enumerate(kept):
        if q is not None and q % every == 0:
            scored = sorted((-sum(s * t for s, t in zip(x, y)), own is None, own or 0) for b, (own, y) in enumerate(kept) if b != a and len(y) == len(x))
            out += [(q, i + 1, None if null else own, -s) for i, (s, null, own) in enumerate(scored[:k])]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((c is None, c or 0) for c in r))


@pytest.mark.parametrize("n, d", [(400, 6), (60, 3), (120, 1)])
def test_search_equals_its_contract(spark, tmp_path, n, d):
    rows = odd(random.Random(n), n, d, 0.05)
    got = queries.op13_topk(spark, table(spark, rows, tmp_path))
    assert ordered(got.select("query_id", "rank", "vec_id", "score").collect()) == ordered(plain_search(rows))


def test_search_by_rounds_ties_and_lengths(spark, tmp_path):
    rng = random.Random(5)
    same = [(k, [0.5, 0.25, -0.5]) for k in range(700)]
    other = [(1000 + k, single([rng.uniform(-1, 1) for _ in range(3)])) for k in range(200)]
    short = [(2000 + 50 * k, single([rng.uniform(-1, 1)] * 2)) for k in range(3)]
    rows = same + other + short + [(2500, [])]
    df = table(spark, rows).repartition(4)
    got = topk.search(df, F.col("vec_id") % 50 == 0, round_bytes=200)
    assert ordered(got.collect()) == ordered(plain_search(rows))
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_cutoffs_leave_most_rows_unresolved(spark):
    """The cutoff is safe (it is never above the k-th best) and the uniform share rules most rows out."""
    rng = np.random.default_rng(7)
    x = rng.integers(-40, 40, (3000, 8)) + 120 * (np.arange(3000)[:, None] % 9 == np.arange(8))
    q = topk._Queries(np.arange(20), np.arange(20), x[:20])
    scores = sum(topk._scores(q.x, x, 4)).astype("i8")
    assert (scores == x[:20] @ x.T).all()
    best = topk._Best(20, 6)
    i, j = np.nonzero(scores >= -(1 << 60))
    best.add(i, scores[i, j], j, 0 * j, 0 * j)
    assert (best.floor == np.sort(scores, axis=1)[:, -6]).all()
    share = -(-best.floor // 4)
    enough = np.logical_or.reduce([s >= share[:, None] for s in topk._scores(q.x, x, 4)])
    assert all(enough[k, np.argsort(-scores[k])[:6]].all() for k in range(20)) and enough.mean() < 0.5


def test_scores_beyond_longs_raise(spark):
    with pytest.raises(ValueError):
        topk._scores(np.array([[1 << 40]]), np.array([[1 << 40]]), 1)


def test_integer_vectors(spark):
    rows = [(k, v) for k, v in odd(random.Random(1), 3)]
    got = {r["id"]: r["x"] for r in vectors.integer_vectors(table(spark, rows), "vec_id", "embedding").collect()}
    assert all(got[k] == whole(v) for k, v in rows if k is not None and k < 3 and k != 0) and 4 not in got and 5 not in got
