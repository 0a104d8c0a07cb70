"""Sampling, rewards, metrics, converters, sources and streams on literal rows."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.decisions import SYSTEM_PROMPT
from millrace.operators import convert, evaluate, leakage, reward, sampling
from millrace.sources import configs, files, interactions
from millrace.streaming import memory, reactions


def rows_of(spark, **groups):
    return spark.createDataFrame([(name, f"{name}{k}") for name, n in groups.items() for k in range(n)], "source string, id string")


def sizes(df, by="source"):
    return {r[by]: r["count"] for r in df.groupBy(by).count().collect()}


def test_mix_of_the_published_run(spark):
    mix = sampling.build_mix(rows_of(spark, a=1008, b=60000, c=20000), {"a": 0.55, "b": 0.20, "c": 0.25}, F.col("id"))
    assert sizes(mix) == {"a": 1008, "b": 366, "c": 458}
    assert mix.select("id").distinct().count() == 1832
    assert sizes(sampling.train_val_split(mix, 0.05, F.col("id")), "part") == {"train": 1741, "val": 91}


def test_mix_never_repeats_and_obeys_a_target(spark):
    rows = rows_of(spark, a=100, b=10000)
    assert sizes(sampling.build_mix(rows, {"a": 0.5, "b": 0.5}, F.col("id"), target=100_000)) == {"a": 100, "b": 100}
    assert sizes(sampling.build_mix(rows, {"a": 0.5, "b": 0.5}, F.col("id"), target=50)) == {"a": 25, "b": 25}


def test_same_seed_same_rows_whatever_the_partitions(spark):
    rows = rows_of(spark, a=300, b=700)
    pick = lambda r, seed: sorted(x["id"] for x in sampling.build_mix(r, {"a": 0.5, "b": 0.5}, F.col("id"), 200, seed).collect())
    assert pick(rows, 1) == pick(rows.repartition(7), 1) != pick(rows, 2)


def test_shares_must_sum_to_one(spark):
    with pytest.raises(Exception, match="shares sum"):
        sampling.build_mix(rows_of(spark, a=10, b=10), {"a": 0.5, "b": 0.6}, F.col("id")).collect()


def test_renormalize(spark):
    s = spark.createDataFrame([(0, "a", 0.55, 1000), (1, "b", 0.20, 0), (2, "c", 0.25, 1000)], "ord int, name string, proportion double, n long")
    assert {r["name"]: r["proportion"] for r in sampling.renormalize(s).collect()} == pytest.approx({"a": 0.6875, "c": 0.3125})
    whole = s.withColumn("n", F.lit(5))
    assert [r["proportion"] for r in sampling.renormalize(whole).orderBy("ord").collect()] == [0.55, 0.20, 0.25]
    with pytest.raises(Exception, match="every source is empty"):
        sampling.renormalize(s.withColumn("n", F.col("ord") * 0)).collect()


def test_repeated_and_null_keys_are_counted(spark):
    often = max((f"b{k}" for k in range(50)), key=lambda x: hashlib.md5(f"42:mix:{x}".encode()).hexdigest())
    rows = rows_of(spark, a=6000, b=8000).unionByName(spark.createDataFrame([("b", often)] * 4000, "source string, id string"))
    assert sizes(sampling.build_mix(rows, {"a": 0.5, "b": 0.5}, F.col("id"), target=20_000)) == {"a": 6000, "b": 6000}
    most = rows.filter("source = 'b'").withColumn("source", F.lit("a")).unionByName(rows.filter("source = 'b'"))
    assert sizes(sampling.build_mix(most, {"a": 0.5, "b": 0.5}, F.col("id"), target=20_000)) == {"a": 10_000, "b": 10_000}
    null = rows_of(spark, a=10).unionByName(spark.range(30).select(F.lit("b").alias("source"), F.lit(None).cast("string").alias("id")))
    assert sizes(sampling.build_mix(null, {"a": 0.25, "b": 0.75}, F.col("id"))) == {"a": 10, "b": 30}
    assert sizes(sampling.downsample_to_balance(null, "source", F.col("id"))) == {"a": 10, "b": 10}
    assert sizes(sampling.train_val_split(null, 0.5, F.col("id")), "part") == {"train": 20, "val": 20}


def test_balance(spark):
    rows = spark.createDataFrame([("WAIT" if k < 100 else "ACT", k) for k in range(120)], "c string, id long")
    assert sizes(sampling.downsample_to_balance(rows, "c", F.col("id")), "c") == {"WAIT": 20, "ACT": 20}
    one = rows.filter("c = 'ACT'")
    assert sampling.downsample_to_balance(one, "c", F.col("id")).count() == 20


@pytest.mark.parametrize("n, ratio, val", [(100, 0.1, 10), (1, 0.5, 1), (7, 0.01, 1)])
def test_split(spark, n, ratio, val):
    split = sampling.train_val_split(spark.range(n).withColumn("part", F.lit("old")), ratio, F.col("id"))
    assert split.filter("part = 'val'").count() == val and split.select("id").distinct().count() == n
    with pytest.raises(ValueError):
        sampling.train_val_split(split, 1.0, F.col("id"))


def log(spark, *entries):
    return spark.createDataFrame([(key, pos, r, f"a{pos}") for pos, (key, r) in enumerate(entries)], "situation_key string, pos int, reward double, action string")


def test_pairs_keep_the_earliest_best_and_the_latest_worst(spark):
    got = reward.preference_pairs(log(spark, ("k", 1.0), ("k", 0.0), ("k", 1.0), ("k", 0.0))).collect()
    assert [(r["chosen"], r["rejected"], r["margin"]) for r in got] == [("a0", "a3", 1.0)]


def test_pairs_stay_inside_a_situation_and_above_the_margin(spark):
    assert reward.preference_pairs(log(spark, ("k", 1.0), ("l", 0.0))).isEmpty()
    assert reward.preference_pairs(log(spark, ("k", 1.0), ("k", 0.9))).isEmpty()


def test_reward(spark):
    r = spark.sql("select named_struct('emotion_before', 'neutral', 'emotion_after', 'happy', 'continued_dialogue', true, 'turned_away', false, 'left_frame', false, 'interrupted_robot', cast(null as boolean), 'repeated_question', true, 'engagement_seconds', 10.0D) as r")
    assert r.select(reward.score(F.col("r"))).first()[0] == pytest.approx(1.5)


def test_always_act(spark):
    p = spark.createDataFrame([("ACT", "ACT", False, 60.0), ("WAIT", "ACT", True, 60.0)], "gold string, predicted string, addressed_to_robot boolean, duration_sec double")
    m = evaluate.agency_metrics(p).first()
    assert (m["timeliness"], m["false_intervention_rate"], m["decision_accuracy"], m["intrusiveness"]) == (1, 1, 0.5, 1)
    assert evaluate.decision_distribution(p).first()["degenerate"]
    with pytest.raises(Exception, match="no predictions"):
        evaluate.agency_metrics(p.limit(0)).collect()


def test_calibration(spark):
    s = spark.createDataFrame([(0.9, True), (0.8, True), (0.2, False), (0.1, False)], "score double, is_act boolean")
    pick = evaluate.calibration_pick(evaluate.calibration_curve(s), 0.0).first()
    assert pick["timeliness"] == 1 and pick["threshold"] == pytest.approx(0.21) and pick["satisfied"] and not pick["degenerate"]
    same = spark.createDataFrame([(0.5, True), (0.5, False)] * 3, "score double, is_act boolean")
    pick = evaluate.calibration_pick(evaluate.calibration_curve(same, 11), 0.2).first()
    assert pick["degenerate"] and pick["satisfied"] and pick["threshold"] == pytest.approx(0.6)
    curve = evaluate.calibration_curve(s, 11).orderBy("threshold").collect()
    for p in curve:
        assert p["timeliness"] == sum(x >= p["threshold"] for x in (0.9, 0.8)) / 2


def test_error_rate_is_micro_averaged(spark):
    a = spark.createDataFrame([(1, 0, 0, 1), (0, 0, 3, 1)], "substitutions int, deletions int, insertions int, reference_length long")
    assert evaluate.error_rate(a).first()["rate"] == 2.0


def test_unpaired_transcripts_are_an_error(spark):
    r, h = spark.createDataFrame([(1, "a"), (2, "b")], "k int, reference string"), spark.createDataFrame([(1, "a")], "k int, hypothesis string")
    with pytest.raises(Exception, match="pair up"):
        evaluate.paired(r, h, "k").collect()


def test_sweep(spark):
    m = "named_struct('timeliness', 1.0D, 'false_intervention_rate', {}, 'precision_act', 1.0D, 'f1_act', 1.0D, 'decision_accuracy', 1.0D)"
    results = spark.sql(" union all ".join(f"select '{label}' label, {d} degenerate, {m.format(fir)} metrics" for label, d, fir in (("checkpoint-50", "true", "1.0D"), ("checkpoint-100", "false", ".3D"), ("checkpoint-150", "false", ".3D"), ("final", "false", ".5D"))))
    table = evaluate.sweep_table(results)
    assert [r["step"] for r in table.collect()] == [50, 100, 150, 1_000_000_000]
    assert evaluate.best_checkpoint(table).first()["step"] == 100
    points = evaluate.sweep_points(results)
    assert tuple(evaluate.degenerate_span(points).first()) == (50, 50)
    assert evaluate.best_checkpoint(table.filter("degenerate")).isEmpty()
    assert sorted(r["step"] for r in evaluate.sweep_points(results, ticks=True).collect()) == [50, 100]


def test_retention(spark):
    got = evaluate.retention(spark.createDataFrame([(2.0, 1.0), (4.0, 2.0)], "base double, adapter double")).first()
    assert (got["delta"], got["relative_degradation"], got["examples"]) == (-1.5, -0.5, 2)


def test_proactive_conversion(spark):
    obs = [("10:00", "opened"), ("", "typed"), (None, " ")]
    data = [(obs, "help", True, "Correct-Detection (CD)"), (obs, "leak", True, "False-Alarm (FA)"), (obs, "x", True, "Missed-Need (MN)"), ([], "x", True, None), (obs, " ", True, None)]
    got = convert.proactive(spark.createDataFrame(data, "obs array<struct<time:string,event:string>>, pred_task string, help_needed boolean, category string")).collect()
    assert [r["status"] for r in got] == ["kept", "kept", "no_label", "no_observations", "no_text"]
    assert json.loads(got[0]["messages"][1]["content"])["observations"] == ["[10:00] opened", "typed"]
    assert "leak" not in got[1]["messages"][2]["content"] and got[1]["decision"] == "WAIT"
    assert got[0]["messages"][0]["content"] == SYSTEM_PROMPT


def test_generic_conversion_drops_what_it_does_not_know(spark):
    data = [("saw", "do it", "accepted"), ("saw", "leak", "rejected"), ("saw", "x", "maybe"), (" ", "x", "accepted"), ("saw", " ", "yes")]
    got = convert.generic(spark.createDataFrame(data, "events string, task string, label string")).collect()
    assert [r["status"] for r in got] == ["kept", "kept", "no_label", "no_observations", "no_text"]
    assert "leak" not in got[1]["messages"][2]["content"]


def test_mono_and_padding(spark):
    assert list(spark.sql("select array(array(1.0D, 3.0D), array(3.0D, 5.0D)) s").select(convert.mono(F.col("s"))).first()[0]) == [2.0, 4.0]
    rows = spark.createDataFrame([(1, 0, [9, 1, 2]), (1, 1, [9, 3]), (2, 2, [8, 1]), (2, 3, [9])], "b int, k int, ids array<int>")
    assert [r["padded"] for r in convert.pad_labels(rows, "b", "ids", 9).orderBy("k").collect()] == [[1, 2], [3, -100], [8, 1], [9, -100]]


def test_leakage(spark):
    texts = ["before one two three four five six after", "one two three four five six", "nothing here", None, "x" * 50_000 + " tiny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(0, "one two three four five six"), (1, "tiny"), (2, "absent words that nobody ever wrote"), (3, "")], "item_id long, text string")
    got = {tuple(r) for r in leakage.contained(docs, items, "doc_id", "item_id").collect()}
    assert got == {(0, 0), (1, 0), (4, 1)}
    assert [r["item_id"] for r in leakage.exact_overlap(docs, items).collect()] == [0]


def test_jsonl_round_trip_and_errors(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    files.write_jsonl(spark.createDataFrame([(1, "é\n"), (2, None)], "a int, b string"), path)
    assert {tuple(r) for r in files.read_jsonl(spark, path, "a int, b string").collect()} == {(1, "é\n"), (2, None)}
    with pytest.raises(FileNotFoundError, match="fetch"):
        files.read_jsonl(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n{broken\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"data": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "e.json").write_text('[{"a": 3}]')
    assert sorted(r["a"] for r in files.read_json_document(spark, str(tmp_path / "d.json")).collect()) == [1, 2]
    assert files.read_json_document(spark, str(tmp_path / "e.json")).first()["a"] == 3
    (tmp_path / "e.json").write_text('[\n {"a":\n 3}\n]')  # over several lines
    (tmp_path / "f.json").write_text("{broken")
    assert files.tolerant_documents(spark, str(tmp_path)).count() == 3


def test_parquet_files():
    have = ["data/kk/validation-0.parquet", "data/kk/train-0.parquet", "data/ru/validation-0.parquet", "x.txt"]
    assert files.parquet_files(have, "validation", "kk") == ["data/kk/validation-0.parquet"]
    assert files.parquet_files(have, "validation", "xx") == ["data/kk/validation-0.parquet", "data/ru/validation-0.parquet"]
    with pytest.raises(FileNotFoundError):
        files.parquet_files(have, "test", "kk")


def test_repeat(spark):
    assert files.repeat_passes(spark.range(3), 3, ["id"], 7).count() == 7
    with pytest.raises(RuntimeError):
        files.repeat_passes(spark.range(0), 3, ["id"])
    with pytest.raises(ValueError):
        files.first_row(spark.range(0))
    with pytest.raises(ValueError):
        files.dpo_input(spark.createDataFrame([], "prompt string, margin double"))


def test_interaction_log(spark, tmp_path):
    good = {"situation_key": "k", "messages": [], "decision_json": "{}", "reaction": {"emotion_after": "happy", "engagement_seconds": 2}}
    (tmp_path / "good").write_text(json.dumps(good) + "\n\n")
    r = interactions.read_log(spark, str(tmp_path / "good")).first()["reaction"]
    assert (r["emotion_before"], r["emotion_after"], r["turned_away"], r["engagement_seconds"]) == ("unknown", "happy", False, 2.0)
    for name, reaction in (("emotion", {"emotion_after": "bored"}), ("field", {"smiled": True})):
        (tmp_path / name).write_text(json.dumps(good | {"reaction": reaction}))
        with pytest.raises(Exception, match="unknown"):
            interactions.read_log(spark, str(tmp_path / name)).collect()


def test_configs():
    assert configs.load(configs.DatasetSpec, {"path": "p"}).split == "train"
    with pytest.raises(TypeError):
        configs.load(configs.DatasetSpec, {"path": "p", "typo": 1})


def test_reaction_stream_equals_the_table(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    a = spark.createDataFrame([(1, 10, at(0)), (1, 11, at(100)), (2, 12, at(0))], "user_id long, action_id long, action_ts timestamp")
    o = spark.createDataFrame([(1, 20, at(3)), (1, 21, at(6)), (1, 22, at(105)), (2, 23, at(0))], "user_id long, obs_id long, obs_ts timestamp")
    table = {(r["action_id"], r["obs_id"]) for r in reactions.reaction_windows(a, o).collect()}
    assert table == {(10, 20), (11, 22)}
    for name, df in (("a", a), ("o", o)):
        df.coalesce(1).write.parquet(str(tmp_path / name))  # in one batch, so that no row comes behind the watermark
    stream = reactions.reaction_windows(*[reactions.record_stream(spark, str(tmp_path / n), d.schema) for n, d in (("a", a), ("o", o))])
    q = stream.writeStream.format("memory").queryName("reactions").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["action_id"], r["obs_id"]) for r in spark.table("reactions").collect()} == table


def test_memories_end(spark, tmp_path):
    """A stream's memories are those of the table: the last notes, late ones in their place, old ones forgotten by timers."""
    day = lambda d, minute=0: dt.datetime(2024, 1, 1 + d, 0, minute)
    batches = [
        [(1, day(0, k), f"n{k}") for k in range(5)] + [(2, day(0), "b0"), (None, day(0), "x")],
        [(1, day(1), "late"), (2, day(2), "b2"), (1, day(2, 1), "m0"), (3, None, "never")],
        [(1, day(1, 30), "later"), (4, day(4), "d")],
        [(4, day(9), "end")],
    ]
    schema = "user_id long, ts timestamp, note string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "all" / f"{k}"))
    seen = []
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream = memory.memory_stream(source, keep=3, forget="3 days", late="1 day")
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).foreachBatch(lambda df, _: seen.append({r["user_id"]: r["memories"] for r in df.collect()}))
    q = q.start()
    try:
        for k in range(len(batches)):
            (tmp_path / "all" / str(k)).rename(tmp_path / "in" / str(k))
            q.processAllAvailable()
    finally:
        q.stop()
    last = {}
    for made in seen:
        last |= made
    assert seen[0] == {1: ["n2", "n3", "n4"], 2: ["b0"], None: ["x"]}
    assert any(made.get(1) == ["late", "later", "m0"] for made in seen)  # "later" came after "m0"
    table = spark.read.parquet(*[str(tmp_path / "in" / str(k)) for k in range(len(batches))])
    held = {r["user_id"]: r["memories"] for r in memory.memories(table, F.lit(day(8)), keep=3, forget="3 days").collect()}
    assert {k: v for k, v in last.items() if v} == {4: ["end"]} and held == {} and set(last) == {1, 2, 4, None}
    then = {r["user_id"]: r["memories"] for r in memory.memories(table, F.lit(day(2, 2)), keep=3, forget="3 days").collect()}
    assert then == {1: ["late", "later", "m0"], 2: ["b0", "b2"], None: ["x"]}
