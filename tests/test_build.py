"""JSON spelling, the corpus build, reports and the command line."""

import io
import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import cli, reports, schemas
from millrace.functions import decisions, dialogue, jsontext
from millrace.operators import build, convert, leakage, sampling
from millrace.sources import audio, configs, files


def test_json_is_spelled_like_the_standard_library(spark):
    values = [{"a": "x, y: \"z\" \\ é\n\t\x01\x1b\x7f", "b": [1, 2, {"c": None, "d": True}], "e": {}}, ["\\u001B", "a:b,c"], "s", None, 1.5, {"z": 1, "a": 2}]
    rows = spark.createDataFrame([(k, json.dumps(v, separators=(",", ":"))) for k, v in enumerate(values)], "k int, raw string")
    got = [r["t"] for r in rows.select("k", dialogue.content_text(F.col("raw")).alias("t")).orderBy("k").collect()]
    assert got == [v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values]
    assert spark.range(1).select(dialogue.content_text(F.lit(None).cast("string"))).first()[0] == "null"
    texts = ["x, y: \"z\" \\ é\n\t\x01\x0b\x1b\x1f\x7f", "\\u001B,", ""]
    kept = spark.createDataFrame([(texts,)], "t array<string>").select(jsontext.spaced(F.to_json("t"))).first()[0]
    assert kept == json.dumps(texts, ensure_ascii=False)


def test_numbers_are_spelled_like_the_standard_library(spark):
    numbers = [0.0, 1.5, -2.0, 0.1, 0.001, 0.00012, 1e-5, 1.25e-7, 12345678.0, 1e7, 1234567890123456.0, 1e16, 1.5e22, 0.85, -0.0004, 3e-10]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(jsontext.number_text(F.col("x"))).collect()]
    assert got == [json.dumps(x) for x in numbers]


def test_whole_situations(spark):
    empty = json.loads(spark.range(1).select(decisions.full_situation_json(F.from_json(F.lit("{}"), schemas.SITUATION))).first()[0])
    assert empty == {"memory": [], "observations": [], "silence_sec": 0.0}
    given = {"time": "10:00", "person": {"name": "A"}, "visual": {"distance": "near"}, "audio": {}, "memory": ["m, n"], "silence_sec": 2.5}
    text = spark.range(1).select(decisions.full_situation_json(F.from_json(F.lit(json.dumps(given)), schemas.SITUATION))).first()[0]
    whole = {"audio": {}, "memory": ["m, n"], "observations": [], "person": {"known": False, "name": "A"}, "silence_sec": 2.5, "time": "10:00", "visual": {"distance": "near", "emotion": "unknown", "faces": 0, "looking_at_robot": False}}
    assert text == json.dumps(whole, ensure_ascii=False, sort_keys=True)


def test_json_documents_by_their_root(spark, tmp_path):
    for name, content, expected in (
        ("list", [{"data": 1, "b": 2}, {"data": 3, "b": 4}], [(2, 1), (4, 3)]),
        ("lists", [{"data": [1]}], [([1],)]),
        ("object", {"data": [{"a": 1}]}, [(1,)]),
        ("without", {"rows": [{"a": 1}]}, []),
        ("scalar", {"data": 5}, []),
    ):
        (tmp_path / f"{name}.json").write_text("\n " + json.dumps(content, indent=1))
        assert [tuple(r) for r in files.read_json_document(spark, str(tmp_path / f"{name}.json")).collect()] == expected, name


def test_balancing_keeps_a_class_of_one_key(spark):
    rows = spark.createDataFrame([("A", 7)] * 10_000 + [("B", k) for k in range(100)], "g string, id long").repartition(7)
    counts = {r["g"]: r["n"] for r in sampling.downsample_to_balance(rows, "g", F.col("id")).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert counts == {"A": 100, "B": 100}


def proactive_row(k, category):
    return {"obs": [{"time": f"10:{k % 60:02d}", "event": f"event {k}"}], "pred_task": f"help {k}", "help_needed": True, "category": category}


@pytest.fixture
def sources(tmp_path):
    rows = [proactive_row(k, "(CD)") for k in range(56)] + [proactive_row(100 + k, "(FA)") for k in range(80)] + [proactive_row(300, "(MN)")]
    (tmp_path / "p.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    said = [{"messages": [{"role": "user", "content": f"q{k}"}, {"role": "assistant", "content": f"a{k}"}]} for k in range(300)]
    (tmp_path / "d.json").write_text(json.dumps({"data": said}))
    return tmp_path


def test_preflight_and_calibration(spark, tmp_path, capsys):
    (tmp_path / "n.jsonl").write_text("a\n\n b\n")
    (tmp_path / "c.yaml").write_text(json.dumps({"base_model": "org/some-4B", "load_in_4bit": True, "per_device_batch_size": 1, "max_length": 2000}))
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("preflight", tmp_path / "n.jsonl", "--config", tmp_path / "c.yaml", "--memory-gb", "16") == 0
    out = capsys.readouterr().out
    assert "examples: 2" in out and "about 4.0 billion" in out and "weights: 2.40 GB" in out and "activations: 0.25 GB" in out and "about 4.47 GB" in out
    assert run("preflight", tmp_path / "n.jsonl", "--model", "org/some-70B", "--memory-gb", "16") == 1 and "too much" in capsys.readouterr().out
    assert run("preflight-speech") == 0 and "809 million parameters, 170 of them trained" in capsys.readouterr().out
    (tmp_path / "s.yaml").write_text(json.dumps({"model": "openai/whisper-small", "optim": "adamw", "dataset": {"path": "x"}}))
    assert run("preflight-speech", "--config", tmp_path / "s.yaml", "--memory-gb", "3.0") == 1
    assert "244 million parameters, 149 of them trained" in capsys.readouterr().out and run("preflight-speech", "--model", "org/unknown") == 1
    with pytest.raises(ValueError, match="max_steps"):
        configs.load(configs.SpeechRunSpec, {"max_steps": 0})
    with pytest.raises(TypeError):
        configs.load(configs.SpeechRunSpec, {"steps": 3})
    rows = [{"probability": p, "gold": g} for p, g in ((0.9, "ACT"), (0.8, "ACT"), (0.2, "WAIT"), (0.1, "OBSERVE"), (None, "ACT"))]
    (tmp_path / "p.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    assert run("calibrate", tmp_path / "p.jsonl", "--max-false-interventions", "0", "--output", tmp_path / "k.json") == 0
    out = capsys.readouterr().out
    assert "threshold: 0.210" in out and "points of the curve: 101" in out and "kept" in out
    told = json.loads((tmp_path / "k.json").read_text())
    assert told["satisfied"] and len(told["curve"]) == 101 and told["timeliness"] == 1.0
    (tmp_path / "none.jsonl").write_text('{"probability": null, "gold": "ACT"}\n')
    with pytest.raises(ValueError, match="no probabilities"):
        run("calibrate", tmp_path / "none.jsonl")


def test_a_build_reads_each_source_once(spark, sources, caplog):
    """Conversion, counts by status and decision, and the converted rows come from one job; train and val from one write."""
    spec = configs.load(configs.BuildSpec, {"proportions": {"proactivity": 0.55, "function_calling": 0.2, "replay": 0.25}, "proactivity": [{"path": str(sources / "p.jsonl")}], "function_calling": [{"path": str(sources / "d.json")}], "replay": [{"path": str(sources / "d.json")}]})
    with caplog.at_level("INFO", logger="millrace.operators.build"):
        rows, counts = build._examples(spark, spec)
    assert counts["proactivity"] == {"ACT": 56, "WAIT": 80, "OBSERVE": 0, "UNKNOWN": 0} and counts["replay"] == {None: 300} and rows.count() == 736
    assert any("136 examples, left out: {'no_label': 1}" in r.getMessage() for r in caplog.records)
    report = build.write_corpus(spark, spec, str(sources / "out"))
    assert sorted(p.name for p in (sources / "out").iterdir() if p.name[0] != ".") == ["mix_report.txt", "train.jsonl", "val.jsonl"]
    sizes = [spark.read.text(str(sources / "out" / f"{p}.jsonl")).count() for p in ("train", "val")]
    assert sizes == [report.train, report.val] and sum(sizes) == report.total == 204
    again = build.write_corpus(spark, spec, str(sources / "out"))
    assert again == report and spark.read.text(str(sources / "out" / "val.jsonl")).count() == report.val


def test_build_from_settings(spark, sources):
    spec = {"seed": 42, "val_ratio": 0.05, "proportions": {"proactivity": 0.55, "function_calling": 0.2, "replay": 0.25}}
    spec |= {"proactivity": [{"path": str(sources / "p.jsonl")}], "function_calling": [{"path": str(sources / "d.json")}, {"path": str(sources / "gone.jsonl")}], "replay": [{"path": str(sources / "d.json"), "split": "train[:90]"}]}
    (sources / "mix.yaml").write_text(json.dumps(spec))  # JSON is YAML
    assert cli.main(["build-data", "--config", str(sources / "mix.yaml"), "--output", str(sources / "out")], spark) == 0
    train, val = (spark.read.json(str(sources / "out" / f"{part}.jsonl")) for part in ("train", "val"))
    assert (train.count(), val.count()) == (194, 10)  # 112 balanced / 0.55 = 203 and a bit, rounded up by source
    every = train.unionByName(val)
    assert {r["source"]: r["n"] for r in every.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"proactivity": 112, "function_calling": 41, "replay": 51}
    assert every.select("source", F.to_json("messages")).distinct().count() == 204
    report = (sources / "out" / "mix_report.txt").read_text()
    assert "mix: 204 examples" in report and "limited by proactivity (at most 203)" in report and "proactivity: 112 (54.9%)" in report
    again, _ = build.build_corpus(spark, configs.load_build(str(sources / "mix.yaml")))
    said = lambda df: {(r["source"], r["messages"][1]["content"], r["messages"][-1]["content"]) for r in df.collect()}
    assert said(again.filter("part = 'val'")) == said(val)


def test_a_dead_source_shrinks_the_mix_unless_it_is_proactivity(spark, sources):
    spec = configs.load(configs.BuildSpec, {"proportions": {"proactivity": 0.55, "function_calling": 0.2, "replay": 0.25}, "proactivity": [{"path": str(sources / "p.jsonl")}], "function_calling": [{"path": str(sources / "gone.json")}], "replay": [{"path": str(sources / "d.json")}]})
    parts, report = build.build_corpus(spark, spec)
    assert report.by_source == {"proactivity": 111, "replay": 51} and parts.count() == 162  # .6875 and .3125
    with pytest.raises(FileNotFoundError):
        build.build_corpus(spark, configs.load(configs.BuildSpec, {"proportions": spec.proportions, "proactivity": [{"path": str(sources / "gone.jsonl")}]}))


def test_fetching_usable_files(spark, tmp_path, capsys):
    crawl = tmp_path / "crawl"
    (crawl / "deep").mkdir(parents=True)
    (crawl / "deep" / "good.jsonl").write_text("".join(json.dumps(proactive_row(k, "(CD)")) + "\n" for k in range(60)))
    (crawl / "good.json").write_text(json.dumps({"examples": [proactive_row(k, "(FA)") for k in range(50)]}))
    (crawl / "few.jsonl").write_text(json.dumps(proactive_row(1, "(CD)")) + "\n")
    (crawl / "broken.jsonl").write_text("".join(json.dumps(proactive_row(k, "(CD)")) + "\n" for k in range(60)) + "{")
    assert cli.main(["fetch-data", "--source", str(crawl), "--output", str(tmp_path / "all.jsonl")], spark) == 0
    assert files.read_jsonl(spark, str(tmp_path / "all.jsonl"), schemas.PROACTIVE).count() == 110
    assert "110 rows" in capsys.readouterr().out
    assert cli.main(["fetch-data", "--source", str(crawl), "--min-examples", "1000"], spark) == 1


def test_fetching_generic_files(spark, tmp_path):
    crawl = tmp_path / "crawl"
    crawl.mkdir()
    generic = lambda k: {"id": k, "History": [" saw ", f"it {k}"], "proposed_action": {"say": f"hi {k}"}, "verdict": "accepted" if k % 3 else 0}
    lines = lambda rows: "".join(json.dumps(r) + "\n" for r in rows)
    (crawl / "generic.jsonl").write_text(lines(generic(k) for k in range(60)))
    (crawl / "document.json").write_text(json.dumps({"instances": [generic(k) for k in range(55)]}))
    (crawl / "proactive.jsonl").write_text(lines(proactive_row(k, "(FA)") for k in range(52)))
    (crawl / "unjudged.jsonl").write_text(lines({k: v for k, v in generic(j).items() if k != "verdict"} for j in range(60)))
    (crawl / "mixed.jsonl").write_text(lines(generic(k) for k in range(60)) + "[1]\n")
    (crawl / "numbers.jsonl").write_text("1\n" * 60)
    (crawl / "later.jsonl").write_text(lines([{"id": 0}, *(generic(k) for k in range(60))]))
    (crawl / "maybe.jsonl").write_text(lines({**generic(k), "verdict": ["yes"] if k < 20 else True, "History": " " if k > 65 else "x"} for k in range(80)))
    rows, usable = build.fetched(spark, str(crawl), 40)
    assert {r["file"].rsplit("/", 1)[1]: r["examples"] for r in usable.collect()} == {"generic.jsonl": 60, "document.json": 55, "proactive.jsonl": 52, "maybe.jsonl": 46}
    assert rows.count() == 60 + 55 + 52 + 80


def test_generic_rows_of_any_type(spark, tmp_path):
    rows = [{"observations": ["a", None, " b\nc "], "task": ["do", " it "], "label": True}, {"observations": [], "task": ["x"], "label": True}, {"observations": ["s"], "task": [" ", None], "label": True}, {"observations": ["s"], "task": None, "label": False}, {"observations": ["s"], "task": None, "label": None}]
    (tmp_path / "g.json").write_text(json.dumps(rows))
    got = convert.generic(files.read_json_document(spark, str(tmp_path / "g.json"))).collect()
    assert sorted(r["status"] for r in got) == ["kept", "kept", "no_label", "no_observations", "no_text"]
    kept = next(r for r in got if r["decision"] == "ACT")
    assert json.loads(kept["messages"][1]["content"])["observations"] == ["a", "b", "c"] and json.loads(kept["messages"][2]["content"])["speech"]["text"] == "do\nit"
    labelled = spark.sql("select 'x' as events, 'y' as task, array('yes') as label")
    assert convert.generic(labelled).first()["status"] == "no_label"


def test_pairs_and_inspection(spark, tmp_path, capsys):
    log = [{"situation_key": "k", "messages": [{"role": "user", "content": "hi"}], "decision_json": f"d{k}", "reaction": {"emotion_after": e}} for k, e in enumerate(["happy", "angry", "happy"])]
    (tmp_path / "log.jsonl").write_text("".join(json.dumps(r) + "\n" for r in log))
    assert cli.main(["build-pairs", "--input", str(tmp_path / "log.jsonl"), "--output", str(tmp_path / "pairs.jsonl")], spark) == 0
    pair = spark.read.json(str(tmp_path / "pairs.jsonl")).first()
    assert (pair["chosen"][0]["content"], pair["rejected"][0]["content"], pair["margin"]) == ("d0", "d1", 2.0)
    assert "3 records, 1 pairs" in capsys.readouterr().out
    assert cli.main(["inspect-dataset", str(tmp_path / "log.jsonl"), "--samples", "1"], spark) == 0
    assert "columns: decision_json, messages, reaction, situation_key" in capsys.readouterr().out
    (tmp_path / "empty.json").write_text("[]")
    assert cli.main(["inspect-dataset", str(tmp_path / "empty.json")], spark) == 1
    assert cli.main(["schema"]) == 0 and "RobotDecision" in capsys.readouterr().out


def test_evaluation_commands(spark, tmp_path, capsys):
    (tmp_path / "losses.jsonl").write_text('{"base": 2.0, "adapter": 1.5}\n\n{"base": 4.0, "adapter": 2.5}\n')
    assert cli.main(["retention", "--eval-file", str(tmp_path / "losses.jsonl")], spark) == 0
    assert "difference: -1.0000 (better)" in capsys.readouterr().out
    rows = [{"gold": "ACT", "answer": '{"decision":"ACT","confidence":1,"speech":{"text":"x"}}'}, {"gold": "WAIT", "answer": '{"decision":"WAIT","confidence":1}'}, {"gold": "WAIT", "answer": "broken"}]
    (tmp_path / "answers.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    assert cli.main(["eval-decisions", str(tmp_path / "answers.jsonl"), "--output", str(tmp_path / "m.json")], spark) == 0
    told = json.loads((tmp_path / "m.json").read_text())
    assert told["invalid"] == 1 and not told["degenerate"] and told["metrics"]["support"] == 2 and told["metrics"]["timeliness"] == 1.0
    (tmp_path / "asr.jsonl").write_text(json.dumps({"reference": "бір екі үш төрт", "hypothesis": "бір өзге үш төрт бес"}) + "\n")
    assert cli.main(["transcripts", str(tmp_path / "asr.jsonl"), "--output", str(tmp_path / "a.json")], spark) == 0
    assert {k: json.loads((tmp_path / "a.json").read_text())["wer_detail"][k] for k in ("substitutions", "deletions", "insertions")} == {"substitutions": 1, "deletions": 0, "insertions": 1}
    result = [{"label": f"checkpoint-{s}", "degenerate": s == 50, "metrics": {"timeliness": 1.0, "false_intervention_rate": f, "precision_act": 1.0, "f1_act": 1.0, "decision_accuracy": 1.0}} for s, f in ((50, 0.0), (100, 0.3), (150, 0.2))]
    (tmp_path / "sweep.json").write_text(json.dumps(result))
    assert cli.main(["sweep", str(tmp_path / "sweep.json")], spark) == 0
    out = capsys.readouterr().out
    assert "best healthy checkpoint: step 150" in out and "| step |" in out
    (tmp_path / "n.jsonl").write_text("a\n\n b\n")
    assert cli.main(["preflight", str(tmp_path / "n.jsonl"), "--model", "org/some-4B"], spark) == 0
    assert "examples: 2" in (out := capsys.readouterr().out) and "hub model of about 4.0" in out
    assert "NOT kept" in reports.calibration({"threshold": 1.0, "satisfied": False, "degenerate": True}, 1.0, 101)


def test_settings_of_training():
    spec = configs.load(configs.TuningSpec, {"lora": {"r": 8}, "num_epochs": 4.0})
    assert spec.lora.r == 8 and spec.lora.alpha == 64 and spec.per_device_batch_size == 4 and configs.PreferenceSpec().beta == 0.1
    with pytest.raises(TypeError):
        configs.load(configs.TuningSpec, {"lora": {"rank": 8}})
    with pytest.raises(ValueError):
        configs.PreferenceSpec(engine="other")
    assert configs.is_hub_id("org/model") and not configs.is_hub_id("/models/x") and not configs.is_hub_id("x")


def test_prepare_callback_and_small_readers(spark, tmp_path):
    made = files.prepared(spark.range(5), lambda r: {"twice": 2 * r["id"], "extra": 1}, "twice long")
    assert sorted(r["twice"] for r in made.collect()) == [0, 2, 4, 6, 8]
    rows = spark.createDataFrame([(2, None), (1, "a")], "k int, text string")
    assert [r["text"] for r in files.reference_texts(rows, "text", ["k"], 2).collect()] == ["a", ""]


def test_leakage_of_many_items_in_blocks(spark):
    rng = __import__("random").Random(6)
    said = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ü,", "the", "of"]) for _ in range(n))
    items = [said(rng.randint(1, 14)) for _ in range(150)] + ["Question: what is the capital of " + x for x in ("France", "Spain", "France and Spain")] + [" ", "", None, "\n"]
    docs = [said(rng.randint(0, 80)) for _ in range(60)] + ["Question: what is the capital of France and Spain?", None, ""]
    a, b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    expected = {(j, k) for j, d in enumerate(docs) if d for k, i in enumerate(items) if i and i.strip(" ") and i in d}
    for size in (4 << 20, 900):
        got = leakage.contained(a.repartition(3), b, "doc_id", "item_id", block_bytes=size)
        assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 100
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Cartesian" not in plan


def test_leakage_of_short_items(spark):
    texts = ["say yes we can do", "no way", "a", None, "xx yes yy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(0, "yes we can"), (1, "no way"), (2, "a"), (3, "yes you can"), (4, " ")], "item_id long, text string")
    got = {tuple(r) for r in leakage.contained(docs, items, "doc_id", "item_id").collect()}
    assert got == {(k, i) for k, t in enumerate(texts) for i, x in ((0, "yes we can"), (1, "no way"), (2, "a"), (3, "yes you can")) if t and x in t}


def wav(samples, rate, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(len(samples[0]))
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(b"".join(x.to_bytes(width, "little", signed=True) for row in samples for x in row))
    return out.getvalue()


def riff(kind, bits, channels, rate, data, extra=b""):
    frame = channels * bits // 8
    head = struct.pack("<HHIIHH", kind, channels, rate, rate * frame, frame, bits) + extra
    chunks = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_wav_formats():
    values = np.array([0.0, 0.5, -0.25, 1.0], "f4")
    for width in (4, 8):
        got, rate = audio.decode(riff(3, 8 * width, 2, 8000, np.repeat(values, 2).astype(f"<f{width}").tobytes()))
        assert rate == 8000 and got.tolist() == values.tolist()
    wide = struct.pack("<HHIH14s", 22, 16, 0, 1, bytes(14))
    assert audio.decode(riff(0xFFFE, 16, 1, 16000, np.array([1 << 14, -(1 << 14)], "<i2").tobytes(), wide))[0].tolist() == [0.5, -0.5]
    mu = audio.decode(riff(7, 8, 1, 8000, bytes(range(256))))[0] * 32768  # by the recommendation's table of 16-bit values
    assert [int(x) for x in mu[[0, 1, 127, 128, 255, 0x70]]] == [-32124, -31100, 0, 32124, 0, -120 - 0]
    law = audio.decode(riff(6, 8, 1, 8000, bytes(range(256))))[0] * 32768
    assert [int(x) for x in law[[0x55, 0xD5, 0xAA, 0x2A]]] == [-8, 8, 32256, -32256]
    assert all(sorted(set(x[128:].tolist()), reverse=rev) or True for x, rev in ((mu, True), (law, True)))
    for bad in (b"fLaC....", riff(2, 4, 1, 8000, b"xx"), riff(1, 16, 0, 8000, b""), riff(1, 16, 1, 8000, b"")[:30]):
        with pytest.raises(ValueError):
            audio.decode(bad)


@pytest.mark.parametrize("rate, target", [(8000, 16000), (44100, 16000), (48000, 16000), (22050, 16000), (16000, 8000), (11025, 16000)])
def test_resampled_sines_keep_their_shape(rate, target):
    seconds, tone = 0.5, 0.2 * min(rate, target)
    t = np.arange(int(rate * seconds)) / rate
    got = audio.resample(np.sin(2 * np.pi * tone * t) + 0.25, rate, target)
    expected = np.sin(2 * np.pi * tone * np.arange(len(got)) / target) + 0.25
    inner = slice(len(got) // 10, -len(got) // 10)
    assert len(got) == -(-len(t) * target // rate) and np.abs(got - expected)[inner].max() < 2e-3
    if target < rate:  # what the new rate can't hold is gone
        high = audio.resample(np.sin(2 * np.pi * 0.6 * target * t), rate, target)
        assert np.abs(high[inner]).max() < 5e-3
    assert audio.resample(np.zeros(0), rate, target).tolist() == []


def test_bad_audio_names_its_row(spark):
    df = spark.createDataFrame([(7, "clip", b"ID3 mp3 bytes here")], "id long, name string, audio binary")
    with pytest.raises(Exception, match=r"'id': 7, 'name': 'clip'"):
        audio.examples(df).collect()


def test_audio_examples(spark):
    assert audio.decode({"array": [0.5], "sampling_rate": None})[1] == 16_000
    with pytest.raises(ValueError, match="neither"):
        audio.decode({"path": "x"})
    for width in (2, 3, 4):
        got, rate = audio.decode(wav([[1 << (8 * width - 2)], [-(1 << (8 * width - 1))]], 8000, width))
        assert rate == 8000 and got.tolist() == [0.5, -1.0]
    rows = [(k, {"bytes": wav([[16384, 0], [0, -16384]], 8000), "path": None}) for k in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "id long, audio struct<bytes:binary,path:string>")
    got = audio.examples(df, resample=lambda x, a, b: x.repeat(b // a)).orderBy("id").collect()
    assert len(got) == 41 and got[40]["audio"] is None and got[3]["audio"].asDict() == {"array": [0.25, 0.25, -0.25, -0.25], "sampling_rate": 16_000}
    assert audio.examples(df, limit=7).count() == 7


def test_other_templates(spark):
    rows = spark.createDataFrame([([("user", "hi"), ("assistant", "yes")],)], "m array<struct<role:string,content:string>>")
    own = dialogue.Template("[", ": ", "]", "[assistant: ")
    assert rows.select(dialogue.render(F.col("m"), True, own)).first()[0] == "[user: hi][assistant: yes][assistant: "
