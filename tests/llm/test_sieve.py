"""What the steps on pairs shuffle and write, and the joins behind a bitmap."""

import glob
import random

from pyspark.sql import functions as F

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from millrace.llm import ngram_join, sieve, staging  # noqa: E402


def shuffled(spark, job):
    """Bytes that the job's stages write to shuffles, and its result."""
    def total():
        stages = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in stages}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = total()
    out = job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in total().items() if k not in before), out


@pytest.fixture
def merged(spark):
    """No side of a join is small enough to be sent out, as with many documents."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def texts(n, chars):
    rng = random.Random(n)
    return [(k, " ".join(f"{rng.getrandbits(4 * chars):0{chars}x}" for _ in range(20))) for k in range(n)]


def test_only_texts_that_may_match_are_shuffled(merged):
    docs = texts(300, 1000)
    docs += [(1000 + k, docs[k][1]) for k in range(10)]
    df = merged.createDataFrame(docs, "doc_id long, text string").repartition(4).localCheckpoint()
    n, kept = shuffled(merged, lambda: [r[0] for r in corpus_pipeline.deduplicate(merged, df, "").select("doc_id", "text").collect()])
    assert sorted(kept) == list(range(300))
    assert n < 0.5 * sum(len(t) for _, t in docs)


def test_without_is_a_left_anti_join(merged):
    rows = merged.createDataFrame([(k if k % 7 else None, f"t{k}") for k in range(500)] + [(3, "again")], "key long, text string")
    for gone in (rows.select("key").limit(0), rows.filter("key % 3 = 0").select("key"), merged.range(1 << 17).select((F.col("id") + 400).alias("key"))):
        want = sorted(map(tuple, rows.join(gone, "key", "left_anti").collect()), key=str)
        assert sorted(map(tuple, sieve.without(rows, "key", gone).collect()), key=str) == want
        assert {tuple(r) for r in rows.join(gone, "key", "left_semi").collect()} <= {tuple(r) for r in sieve.sifted(rows, "key", gone).collect()}


def test_small_tables_are_few_files(merged, monkeypatch):
    """Before, each of 60 partitions wrote a file of each table: labels, edges, pairs and so on."""
    files, real = {}, staging.staged
    def counted(df, label, *tasks):
        out = real(df, label, *tasks)
        files[label] = max(files.get(label, 0), len(glob.glob(f"{out.staged_at.removeprefix('file:')}/*.parquet")))
        return out
    old = merged.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr("millrace.llm.components.staged", counted)
    monkeypatch.setattr("millrace.llm.ngram_join.staged", counted)
    monkeypatch.setattr("millrace.llm.staging.staged", counted)
    merged.conf.set("spark.sql.shuffle.partitions", "60")
    merged.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = texts(300, 8)
        docs += [(1000 + k, f"{t[:-40]} other words {k}") for k, t in docs]
        got = ngram_join.cluster(merged.createDataFrame(docs, "doc_id long, text string"), ngram_join.Settings(words=2, percent=60)).collect()
    finally:
        merged.conf.set("spark.sql.shuffle.partitions", old)
        merged.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["component_id"] != r["doc_id"] for r in got) == 300
    assert max(n for k, n in files.items() if k not in ("ngram-shared", "ngram-sets")) <= 20 and len(files) >= 9
