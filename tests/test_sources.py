"""JSON documents cut by many tasks, exact slices and passes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import build
from millrace.sources import configs, files, jsondocs


def odd_row(rng, k):
    text = "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "\n", "a", " ", '",', "\\,", '"data": [']) for _ in range(rng.randrange(40)))
    return {"k": k, "text": text, "data": [rng.randrange(9)] * rng.randrange(4), "deep": {"a, [b": [{"x": text[:5]}], "none": None}}


@pytest.fixture
def small_blocks(spark):
    had = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for c, v in had.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("layout", ["list", "indented", "object", "late"])
def test_documents_of_many_blocks(spark, tmp_path, small_blocks, layout):
    rng = random.Random(layout)
    rows = [odd_row(rng, k) for k in range(120)]
    whole = {"list": lambda: json.dumps(rows), "indented": lambda: "﻿ \n" + json.dumps(rows, indent=3, ensure_ascii=False), "object": lambda: json.dumps({"data": rows, "more": [1, 2]}), "late": lambda: json.dumps({"info": rows[:9], "a": {"data": [7]}, "data": rows, "z": rows[:9]}, indent=1)}[layout]()
    path = tmp_path / "x.json"
    path.write_text(whole)
    assert len(whole) > 7000
    items = jsondocs.json_items(spark, str(path))
    assert items.select("block").distinct().count() > 3
    got = [json.loads(r["raw"]) for r in items.orderBy("file", "block", "place").collect()]
    assert got == rows
    read = files.read_json_document(spark, str(path))
    assert {(r["k"], r["text"], tuple(r["data"])) for r in read.collect()} == {(r["k"], r["text"], tuple(r["data"])) for r in rows}
    part = build.load_rows(spark, configs.DatasetSpec(path=str(path), split="train[10:60]", limit=20))
    assert [r["k"] for r in part.orderBy("k").collect()] == list(range(10, 30))


def test_roots_of_files_may_differ(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"k": 3}], "k": [4]}))
    (tmp_path / "c.json").write_text(json.dumps({"rows": [{"k": 5}]}))
    (tmp_path / "d.json").write_text("[ ]")
    assert {r["k"] for r in files.read_json_document(spark, str(tmp_path)).collect()} == {1, 2, 3}
    assert {r["k"] for r in files.read_json_document(spark, str(tmp_path), schema="k string").collect()} == {"1", "2", "3"}
    assert files.read_json_document(spark, str(tmp_path / "d.json")).count() == 0
    (tmp_path / "e.json").write_text('{"data": [1, 2, 3]}')
    assert [r["row"] for r in files.read_json_document(spark, str(tmp_path / "e.json")).collect()] == [1, 2, 3]
    for name, text in (("f.json", "[1, 2"), ("g.json", '"text"'), ("h.json", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError) if text else pytest.raises(Exception):
            assert files.read_json_document(spark, str(tmp_path / name)).count() or text
            raise ValueError("blank")


def test_slices_are_exact_without_a_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "AT_ONCE", 5)
    rng = random.Random(2)
    keys = [(rng.randrange(40), k) for k in range(300)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(keys, "a long, b long").repartition(6).write.parquet(path)
    rows = spark.read.parquet(path)
    for start, stop in ((0, 100), (7, 250), (120, None), (0, 3), (290, 400), (400, 500), (20, 20)):
        got = files.sliced(rows, start, stop, ["a", "b"])
        assert sorted(map(tuple, got.collect())) == sorted(keys)[start:stop]
        if stop is None or stop > 5:
            assert "Limit" not in got._jdf.queryExecution().toString()
    cuts = [files.sliced(rows, a, b) for a, b in ((0, 130), (130, 131), (131, None))]
    assert [c.count() for c in cuts] == [130, 1, 169]
    assert sorted(tuple(r) for c in cuts for r in c.collect()) == sorted(keys)
    assert [tuple(r) for r in files.sliced(rows, 0, 4).collect()] == [tuple(r) for r in rows.limit(4).collect()]


@pytest.mark.parametrize("budget, sizes", [(None, [50, 50, 50]), (125, [50, 50, 25]), (20, [20]), (100, [50, 50]), (999, [50, 50, 50]), (0, [])])
def test_passes_end_where_the_budget_does(spark, monkeypatch, budget, sizes):
    monkeypatch.setattr(files, "AT_ONCE", 5)
    got = files.repeat_passes(spark.range(50).toDF("k"), 3, ["k"], budget).collect()
    assert sorted((r["pass"], r["k"]) for r in got) == [(p, k) for p, n in enumerate(sizes) for k in range(n)]
    with pytest.raises(RuntimeError):
        files.repeat_passes(spark.range(0), 2, ["id"])


def test_split_slice_of_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"k": k}) + "\n" for k in range(40)))
    load = lambda **spec: [r["k"] for r in build.load_rows(spark, configs.DatasetSpec(path=str(tmp_path / "x.jsonl"), **spec)).collect()]
    assert load() == list(range(40)) and load(split="train[5:9]") == [5, 6, 7, 8] and load(split="train[:3]", limit=9) == [0, 1, 2] and sorted(load(split="train[30:]")) == list(range(30, 40))


def test_one_scan_of_each_source(spark, tmp_path):
    """Balance, mix and split read their source once in the plan that they return."""
    from millrace.operators import sampling

    path = str(tmp_path / "rows")
    spark.range(3000).select(F.when(F.col("id") % 7 == 0, "a").otherwise("b").alias("source"), "id").write.parquet(path)
    rows = spark.read.parquet(path)
    plans = [sampling.downsample_to_balance(rows, "source", F.col("id")), sampling.build_mix(rows, {"a": 0.4, "b": 0.6}, F.col("id")), sampling.train_val_split(rows, 0.1, F.col("id"))]
    for df in plans:
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [df.count() for df in plans] == [858, 1072, 3000]


def test_equal_rows_straddle_a_cut(spark):
    from millrace.operators import sampling

    rows = spark.createDataFrame([("a", "k", "x")] * 700 + [("a", "k", "y")] * 300 + [("b", "l", "z")] * 400 + [(None, "m", "z")] * 900, "source string, id string, t string")
    got = {(r["source"], r["t"]): r["count"] for r in sampling.downsample_to_balance(rows, "source", F.col("id")).groupBy("source", "t").count().collect()}
    assert got[None, "z"] == 400 and got["b", "z"] == 400 and sum(n for (s, _), n in got.items() if s == "a") == 400
    split = {(r["part"], r["t"]): r["count"] for r in sampling.train_val_split(rows, 0.37, F.col("id")).groupBy("part", "t").count().collect()}
    assert sum(n for (p, _), n in split.items() if p == "val") == 851 and sum(split.values()) == 2300
    assert split.get(("val", "x"), 0) + split.get(("train", "x"), 0) == 700


def test_shelf_slices_and_streams(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from millrace.sources import rowstream

    shelf = tmp_path / "kk" / "data"
    shelf.mkdir(parents=True)
    at = 0
    for name, n in (("train-0", 70), ("train-1", 1), ("train-2", 49)):
        pq.write_table(pa.table({"k": range(at, at + n), "t": [f"t{k}" for k in range(at, at + n)]}), shelf / f"{name}.parquet", row_group_size=16)
        at += n
    pq.write_table(pa.table({"k": [999], "t": ["x"]}), shelf / "test-0.parquet")
    rows = lambda split, **more: [r["k"] for r in rowstream.shelf_rows(spark, str(tmp_path), split, **more).orderBy("k").collect()]
    assert rows("train") == list(range(120)) and rows("test") == [999]
    assert rows("train[65:75]", task_rows=3) == list(range(65, 75)) and rows("train[118:400]") == [118, 119] and rows("train[300:]") == [] and rows("train[:5]") == [0, 1, 2, 3, 4]
    assert rowstream.shelf_rows(spark, str(tmp_path), "train", task_rows=30).rdd.getNumPartitions() == 6
    assert [tuple(r) for r in rowstream.shelf_rows(spark, str(tmp_path), "train[3:5]").select("t", "k").orderBy("k").collect()] == [("t3", 3), ("t4", 4)]
    with pytest.raises(Exception, match="no Parquet file"):
        rowstream.shelf_rows(spark, str(tmp_path), "validation").collect()
    seen = []

    def run(until):
        stream = rowstream.shelf_rows(spark, str(tmp_path), "train[10:200]", streaming=True, task_rows=25)
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: seen.append(sorted(r["k"] for r in df.collect()))).start()
        try:
            q.processAllAvailable()
            if until:
                until()
                q.processAllAvailable()
        finally:
            q.stop()

    more = lambda name, a, b: pq.write_table(pa.table({"k": range(a, b), "t": ["n"] * (b - a)}), shelf / name)
    run(lambda: more("train-3.parquet", 120, 150))
    more("train-4.parquet", 150, 230)
    run(None)  # from the checkpoint on
    assert [k for made in seen for k in made] == list(range(10, 200))


def test_shelves_of_tables_in_folders(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from millrace.sources import rowstream

    for table, first in (("talks", 0), ("part", 1000)):
        (tmp_path / "own" / f"{table}.parquet").mkdir(parents=True)
        for k in range(3):
            pq.write_table(pa.table({"k": range(first + 10 * k, first + 10 * k + 10)}), tmp_path / "own" / f"{table}.parquet" / f"part-{k:04d}.parquet")
        (tmp_path / "own" / f"{table}.parquet" / "_SUCCESS").touch()
    pq.write_table(pa.table({"k": [7]}), tmp_path / "own" / "other.parquet")
    rows = lambda split, **more: sorted(r["k"] for r in rowstream.shelf_rows(spark, f"{tmp_path}/", split, **more).collect())
    assert rows("talks[8:22]", task_rows=4) == list(range(8, 22)) and rows("talks", config="own") == list(range(30))
    assert rows("part[:12]") == list(range(1000, 1012)) and rows("other") == [7]
    with pytest.raises(Exception, match="no Parquet file"):
        rows("part-0001")


def test_json_documents_by_partition(spark, tmp_path):
    import glob

    from millrace.plans import catalogue
    from millrace.sources import files

    items = spark.createDataFrame([(k,) for k in range(9)], "k long").repartition(4, "k").select(F.to_json(F.struct("k", F.lit('a,"]}').alias("t"))).alias("value"))
    empty = items.rdd.glom().map(len).collect().count(0)
    for head, tail in (("[", "]"), ('{"more": [1], "data": [', "]}")):
        path = str(tmp_path / f"d{len(head)}")
        files.write_json_documents(items, path, head, tail)
        assert sorted(tuple(r) for r in files.read_json_document(spark, path).collect()) == [(k, 'a,"]}') for k in range(9)]
        assert len(glob.glob(f"{path}/part-*")) == 4 and empty < 4
    # The query's files follow the table's partitions, not its dialogues.
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/scratch/json-*/part-*"
    for n, text in ((300, "x"), (2, None), (0, "x")):
        talks = spark.createDataFrame([(k, 0, "user", text) for k in range(n)], "conv_id long, turn long, role string, text string")
        talks.coalesce(1).write.parquet(str(tmp_path / f"t{n}" / "conversations.parquet"))
        before = len(glob.glob(folder))
        got = [tuple(r) for r in catalogue.queries()["json_document"](spark, str(tmp_path / f"t{n}")).collect()]
        assert len(got) == 2 * n and len(glob.glob(folder)) - before <= 8 and {r[2] for r in got} <= {0, 1 if text else None}
