"""The pipeline's stages on a small corpus whose right outcome is known."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from millrace.llm.queries import encoder  # noqa: E402


def said(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    root = tmp_path_factory.mktemp("corpus")
    items = [f"{said(rng, 30)}. {said(rng, 5)}." for _ in range(10)]
    clean = [f"{said(rng, 90)}.\n{said(rng, 40)}." for _ in range(20)]
    words = clean[1].split(" ")
    words[50] = "changed"
    docs = dict(enumerate(clean))
    docs |= {20: clean[0], 21: " ".join(words), 22: f"{clean[2]}\n{items[3]}\n{said(rng, 60)}.", 23: f"{said(rng, 80)} me.7@mail7.example.com {said(rng, 20)}.", 24: "too short.", 25: "\n".join(f"A{k} | B{k} | C{k} |" for k in range(40)), 26: None, 27: f"{said(rng, 90)}.\nAll rights reserved."}
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), docs


def test_each_stage_decides_and_keeps_clean_documents(spark, folder):
    root, texts = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stay = [set(texts) - {24, 25, 26}, set(range(20)) | {22, 23, 27}, set(range(20)) | {23, 27}, set(range(20)) | {23, 27}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, stay):
        before, docs = docs, stage(spark, docs, root)
        assert docs.columns == before.columns, name
        assert {r["doc_id"] for r in docs.collect()} == ids, name
    got = {r["doc_id"]: r for r in docs.collect()}
    assert "<EMAIL>" in got[23]["text"] and "@" not in got[23]["text"] and got[23]["n_chars"] == len(got[23]["text"])
    assert "All rights" not in got[27]["text"] and all(got[k]["text"] == texts[k] for k in range(20))


def test_run_packs_what_the_stages_keep(spark, folder):
    root, _ = folder
    rows = corpus_pipeline.run(spark, root).collect()
    assert {r["doc_id"] for r in rows} == set(range(20)) | {23, 27}
    for doc in range(20):
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        expected = next(encoder()([spark.read.parquet(f"{root}/documents.parquet").filter(f"doc_id = {doc}").first()["text"]]))
        assert b"".join(r["ids"] for r in own) == expected and len(expected) == 4 * own[0]["doc_tokens"]


def test_repeated_ids_with_other_texts_stay(spark):
    said = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, said(1)), (1, said(2)), (1, said(2)), (2, said(1) + " end"), (3, said(3)), (3, said(3) + " end"), (None, said(4)), (None, said(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.deduplicate(spark, docs, "").collect())
    assert got == [(0, said(4)), (1, said(1)), (1, said(2)), (3, said(3))]  # a null id is no reason to keep a copy


def test_rows_are_decontaminated_each(spark, folder):
    """Of rows with one id, and of rows without any, those that hold an item go and the others stay."""
    root, _ = folder
    rng = random.Random(12)
    item = spark.read.parquet(f"{root}/benchmark.parquet").filter("item_id = 4").first()["text"]
    clean = [f"{said(rng, 70)}." for _ in range(4)]
    leaks = f"{said(rng, 50)}.\n{item}\n{said(rng, 50)}."
    rows = [(1, leaks), (1, clean[0]), (1, clean[0]), (None, leaks), (None, clean[1]), (2, clean[2]), (3, leaks), (4, None), (None, None)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, _row string")
    got = corpus_pipeline.decontaminate(spark, docs, root)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in got.collect())) == sorted((k or 0, t or "") for k, t in rows if t != leaks)
    unique = docs.filter("doc_id > 1")
    assert {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, unique, root).collect()} == {2, 4}


def test_empty_tables(spark, folder, tmp_path):
    root, _ = folder
    spark.read.parquet(f"{root}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{root}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_take_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, blank and very long texts, clashing columns, empty tables: no stage fails, none loses a
    document that it has no reason to drop."""
    rng = random.Random(3)
    text = lambda n: "\n".join(" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(12)) + "." for _ in range(n))
    one, two, long = text(8), text(8), text(4000)
    rows = [(None, one), (1, two), (1, two), (1, text(9)), (2, None), (3, " \n"), (4, long), (None, None)]
    spark.createDataFrame([(1, "a question that nobody asked here at all. An answer that is long enough.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("key", "node", "n", "tokens", "quality", "spans", "component_id", "_row", "item_id", "level"):
        docs = docs.withColumn(c, F.lit("x"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").distinct().collect()) if name == "packing" else docs.count())
    assert sizes[:4] == [5, 4, 4, 4] and sizes[4] == [(False, 1), (False, 4), (True, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0
