"""Periodic runs against plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import periodic_runs, queries


def plain_runs(words, min_words=24, min_periods=3):
    """Every stretch with some period that no neighbour extends, by trying each period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // min_periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_periods * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b, q) for (a, b), q in found.items())


def looped(rng, n, alphabet):
    """Words with stretches repeated inside stretches that are repeated."""
    words = [str(rng.randrange(alphabet)) for _ in range(n)]
    for _ in range(rng.randrange(6)):
        if not words:
            break
        a = rng.randrange(len(words))
        b = min(len(words), a + rng.randint(1, 30))
        words[b:b] = (words[a:b] * rng.randint(2, 9))[: rng.randint(1, 200)]
    return words


@pytest.mark.parametrize("min_words, min_periods", [(24, 3), (6, 2), (10, 4), (2, 2)])
def test_runs_equal_brute_force(min_words, min_periods):
    rng = random.Random(min_words)
    texts = [looped(rng, rng.randrange(90), rng.choice([1, 2, 2, 3, 5, 40])) for _ in range(400)] + [[], ["a"], ["a"] * 24, ["a"] * 23, list("ab") * 40, list("abaab") * 30 + list("ab") * 30 + list("abaab") * 30]
    s = periodic_runs.Settings(min_words, min_periods)
    got = periodic_runs._found([[w.encode() for w in t] for t in texts], s)
    assert sum(map(len, got)) > 100
    for t, own in zip(texts, got):
        assert own == plain_runs(t, min_words, min_periods), t


def test_fibonacci_words_have_all_their_runs():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    got = periodic_runs._found([[c.encode() for c in b]], periodic_runs.Settings(6, 2))
    assert got[0] == plain_runs(list(b), 6, 2) and len(got[0]) > 500


def test_long_texts_are_not_quadratic():
    rng = random.Random(1)
    block = [str(rng.randrange(1000)) for _ in range(700)]
    words = [w.encode() for w in block * 400 + ["x"] + ["y"] * 50_000]
    got = periodic_runs._found([words], periodic_runs.Settings())[0]
    assert got == [(0, 280_000, 700), (280_001, 330_001, 1)]


def test_previous_factors():
    rng = random.Random(3)
    for _ in range(60):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        length, source = periodic_runs._longest_previous(periodic_runs._Ranks(np.array([*w, 99])))
        for i in range(len(w)):
            best = max([next((k for k in range(len(w) - i + 1) if i + k == len(w) or w[i + k] != w[j + k]), 0) for j in range(i)], default=0)
            assert length[i] == best and (not best or w[source[i] : source[i] + best] == w[i : i + best] and source[i] < i)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(doc_id, text):
    """The contract of the op12 query, read literally."""
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = [(a, b - a, q) for a, b, q in plain_runs(words)]
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_its_contract(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, " ".join(looped(rng, rng.randrange(200), rng.choice([2, 30, 500])))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (None, "a b " * 30), (None, None), (5, "again " * 40), (5, "again " * 40), (406, "é\x1c \x85   x\x0b" * 50), (407, "w " * 20_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("key", "runs", "words", "n_words", "collapsed", "start", "best"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).select(COLUMNS).collect()
    order = lambda r: (r[0] is None, r[0] or 0, tuple(map(str, r)))
    assert sorted(map(tuple, got), key=order) == sorted((expected(*r) for r in rows), key=order)
    assert sum(r["n_runs"] > 0 for r in got) > 60 and any(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 and r["n_runs"] for r in got if r["doc_id"] is not None)


def test_collapse_gives_texts(spark):
    docs = spark.createDataFrame([(1, "say it " + "again and " * 20 + "stop"), (2, "a  b\n c")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.collapse(docs).collect()}
    assert got[1]["collapsed"] == "say it again and stop" and [tuple(r) for r in got[1]["runs"]] == [(2, 40, 2)]
    assert got[2]["collapsed"] == "a b c" and got[2]["n_words"] == 3 and got[2]["runs"] == []
    assert periodic_runs.collapse(docs.limit(0)).collect() == []
