"""The commands: python -m millrace COMMAND. Training and inference are others' work; their results come in as tables."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import reports, schemas
from millrace.functions import sizes, text
from millrace.operators import build, evaluate, reward
from millrace.sources import configs, files, interactions


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="millrace", description="Decision and dialogue corpora on Spark")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *options: tuple) -> None:
        own = commands.add_parser(name, help=about)
        for flag, settings in options:
            own.add_argument(flag, **settings)

    limit = ("--limit", {"type": int, "default": None})
    command("inspect-dataset", "columns and first rows of a source", ("path", {}), ("--split", {"default": "train"}), ("--samples", {"type": int, "default": 2}))
    command("build-data", "a mixed corpus by a settings file", ("--config", {"default": "configs/data_mix.yaml"}), ("--output", {"default": "data/processed"}))
    command("build-pairs", "preference pairs of an interaction log", ("--input", {"required": True}), ("--output", {"default": "data/processed/preference_pairs.jsonl"}), ("--min-margin", {"type": float, "default": 0.5}))
    command("retention", "mean losses with and without the adapter, of JSON lines with base and adapter", ("--eval-file", {"required": True}), ("--limit", {"type": int, "default": 300}))
    command("schema", "the JSON Schema of a decision")
    command("fetch-data", "usable files of a crawl as one corpus", ("--source", {"required": True}), ("--output", {"default": "data/raw/proactive_bench.jsonl"}), ("--min-examples", {"type": int, "default": 50}))
    command("eval-set", "a held-out slice as dialogues", ("path", {}), ("--split", {"default": "train"}), ("--output", {"required": True}), ("--limit", {"type": int, "default": 300}))
    command("eval-decisions", "metrics of gold and predicted decisions (JSON lines: gold, answer, addressed_to_robot, duration_sec)", ("path", {}), ("--label", {"default": "model"}), ("--output", {"default": None}), limit)
    command("sweep", "a table of checkpoints' results, and the best healthy one", ("path", {}), ("--output", {"default": None}))
    command("transcripts", "error rates of JSON lines with reference and hypothesis", ("path", {}), ("--title", {"default": "model"}), ("--output", {"default": None}), ("--samples", {"type": int, "default": 5}))
    command("peek", "rows and empty transcripts of a speech table", ("path", {}), ("--text-column", {"default": None}), ("--limit", {"type": int, "default": 50}))
    command("calibrate", "the threshold at which to act, of JSON lines with probability and gold", ("path", {}), ("--max-false-interventions", {"type": float, "default": 0.1}), ("--temperature", {"type": float, "default": 1.0}), ("--steps", {"type": int, "default": 101}), ("--output", {"default": None}))
    command("preflight", "examples of a corpus and the memory that tuning needs", ("path", {}), ("--config", {"default": None}), ("--model", {"default": None}), ("--memory-gb", {"type": float, "default": None}))
    command("preflight-speech", "parameters and memory of a speech model's tuning", ("--config", {"default": None}), ("--model", {"default": None}), ("--memory-gb", {"type": float, "default": None}))
    return parser


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command and returns its exit code."""
    args = _arguments().parse_args(arguments)
    if args.command == "schema":
        print(json.dumps(schemas.decision_json_schema(), ensure_ascii=False, indent=2))
        return 0
    if spark is None:
        from millrace.session import session

        spark = session("millrace")
    return _COMMANDS[args.command](spark, args)


def _inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = build.load_rows(spark, configs.DatasetSpec(path=args.path, split=args.split, limit=args.samples)).limit(args.samples)
    found = rows.select(F.substring(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])), 1, 2000)).collect() if rows.columns else []
    if not found:
        print("the source has no rows")
        return 1
    print("columns:", ", ".join(sorted(rows.columns)))
    for k, r in enumerate(found):
        print(f"--- row {k + 1} ---\n{r[0]}")
    return 0


def _build_data(spark: SparkSession, args: argparse.Namespace) -> int:
    report = build.write_corpus(spark, configs.load_build(args.config), args.output)
    print(report.describe())
    print(f"train {report.train}, val {report.val} in {args.output}")
    return 0


def _build_pairs(spark: SparkSession, args: argparse.Namespace) -> int:
    log = interactions.read_log(spark, files.require(spark, args.input, "log interactions first")).withColumn("pos", F.monotonically_increasing_id())  # lines of one file in order
    pairs = reward.dpo_pairs(log, args.min_margin).drop("situation_key")
    files.write_jsonl(pairs, args.output)
    print(f"{log.count()} records, {spark.read.text(args.output).count()} pairs in {args.output}")
    return 0


def _retention(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = files.first_rows(spark, args.eval_file, args.limit, "base double, adapter double")
    report = evaluate.retention(rows).first().asDict()
    if not report["examples"]:
        raise ValueError(f"no examples in {args.eval_file}")
    print(reports.retention(report))
    return 0


def _fetch(spark: SparkSession, args: argparse.Namespace) -> int:
    rows, usable = build.fetched(spark, args.source, args.min_examples)
    found = usable.orderBy("file").collect()  # one row a usable file
    if not found:
        print(f"no file under {args.source} gives {args.min_examples} examples; look at its structure and give a field map")
        return 1
    rows.select("raw").write.mode("overwrite").text(args.output)
    for r in found:
        print(f"+ {r['file']}: {r['examples']} examples")
    print(f"{spark.read.text(args.output).count()} rows in {args.output}, about {sum(r['examples'] for r in found)} examples")
    return 0


def _eval_set(spark: SparkSession, args: argparse.Namespace) -> int:
    made = build.dialogue_examples(spark, [configs.DatasetSpec(path=args.path, split=args.split)]).limit(args.limit)
    files.write_jsonl(made, args.output)
    print(f"{spark.read.text(args.output).count()} dialogues in {args.output}")
    return 0


def _eval_decisions(spark: SparkSession, args: argparse.Namespace) -> int:
    from millrace.functions.decisions import decision_valid

    rows = files.first_rows(spark, args.path, args.limit, "gold string, answer string, addressed_to_robot boolean, duration_sec double")
    told = rows.withColumn("predicted", F.when(decision_valid(F.col("answer")), F.get_json_object("answer", "$.decision")))
    seen = evaluate.decision_distribution(told).first().asDict()
    metrics = evaluate.agency_metrics(told.filter("predicted is not null")).first().asDict()
    result = {"label": args.label, **seen, "metrics": metrics}
    if args.output:
        files.write_text(spark, args.output, reports.as_json(result))
    print(reports.agency(metrics))
    if seen["degenerate"]:
        print("degenerate: every valid answer is one decision; accuracy and F1 say nothing here")
    return 0


def _sweep(spark: SparkSession, args: argparse.Namespace) -> int:
    results = files.read_metrics(spark, args.path, schemas.SWEEP_RESULT)
    table = [r.asDict() for r in evaluate.sweep_table(results).collect()]  # one row a checkpoint
    shown = reports.as_markdown(table)
    if args.output:
        files.write_text(spark, args.output, shown)
    best = evaluate.best_checkpoint(evaluate.sweep_points(results)).first()
    print(shown)
    print(f"best healthy checkpoint: step {best['step']}" if best else "no healthy checkpoint")
    return 0


def _transcripts(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = files.read_jsonl(spark, args.path, "reference string, hypothesis string")
    told = {}
    for name, cut, size in (("wer", text.words, F.size), ("cer", text.joined, F.length)):
        pairs = rows.select(*[cut(text.normalize(F.col(c))).alias(c) for c in ("reference", "hypothesis")])
        aligned = pairs.select(size("reference").cast("long").alias("reference_length"), text.align("reference", "hypothesis").alias("a")).select("reference_length", "a.*")
        told[name] = evaluate.error_rate(aligned).first().asDict()
        print(reports.error_rate(told[name], name.upper()))
    if args.output:
        files.write_text(spark, args.output, reports.as_json({"title": args.title, "examples": rows.count(), "wer": told["wer"]["rate"], "cer": told["cer"]["rate"], "wer_detail": told["wer"]}))
    for r in rows.limit(args.samples).collect():
        print(f"  = {r['reference']}\n  ? {r['hypothesis']}")
    return 0


def _peek(spark: SparkSession, args: argparse.Namespace) -> int:
    from millrace.operators.fields import text_column

    rows = files.read_rows(spark, args.path).limit(args.limit)
    name = text_column(rows.columns, args.text_column)
    stats = files.split_stats(rows, name).first()
    print(f"columns: {', '.join(rows.columns)}\ntranscripts: {name}\nrows: {stats['examples']}, without text: {stats['empty_text']}")
    return 0


def _calibrate(spark: SparkSession, args: argparse.Namespace) -> int:
    from millrace.functions.decisions import apply_temperature

    rows = files.read_jsonl(spark, args.path, "probability double, gold string").filter("probability is not null and gold is not null")
    curve = evaluate.calibration_curve(rows.select(apply_temperature(F.col("probability"), args.temperature).alias("score"), (F.col("gold") == "ACT").alias("is_act")), args.steps)
    if rows.isEmpty():
        raise ValueError(f"no probabilities in {args.path}")
    pick = evaluate.calibration_pick(curve, args.max_false_interventions).first()
    points = [p.asDict() for p in curve.orderBy("threshold").collect()]  # as many as steps
    if args.output:
        files.write_text(spark, args.output, reports.as_json({"temperature": args.temperature, **pick.asDict(), "curve": points}))
    print(reports.calibration(pick.asDict(), args.temperature, len(points)))
    return 0


def _settings(kind: type, config: str | None, **given):
    spec = configs.load_yaml(kind, config) if config else kind()
    return replace(spec, **{k: v for k, v in given.items() if v is not None})


def _fits(needed: float, there: float | None) -> int:
    """What to say of an estimate where the memory is known; 1 if it doesn't fit."""
    if there is None:
        return 0
    print(f"{needed:.2f} of {there:.1f} GB" + (": too much; take shorter texts, smaller batches or four-bit weights" if needed > there else ": tight" if needed > 0.9 * there else ""))
    return int(needed > there)


def _preflight(spark: SparkSession, args: argparse.Namespace) -> int:
    print(f"examples: {files.line_count(spark, args.path).first()['examples']}")
    spec = _settings(configs.TuningSpec, args.config, base_model=args.model)
    billions = sizes.billions(F.lit(spec.base_model))
    parts = sizes.tuning_memory_parts(billions, spec.load_in_4bit, spec.per_device_batch_size, spec.max_length, spec.gradient_checkpointing)
    found = spark.range(1).select(billions.alias("billions"), *[gb.alias(name) for name, gb in parts.items()]).first().asDict()
    print(f"{spec.base_model}: {'hub' if configs.is_hub_id(spec.base_model) else 'local'} model of about {found.pop('billions')} billion parameters")
    for name, gb in found.items():
        print(f"  {name}: {gb:.2f} GB")
    needed = sum(found.values())
    print(f"memory for tuning: about {needed:.2f} GB")
    return _fits(needed, args.memory_gb)


def _preflight_speech(spark: SparkSession, args: argparse.Namespace) -> int:
    spec = _settings(configs.SpeechRunSpec, args.config, model=args.model)
    name = F.lit(spec.model)
    told = sizes.speech_millions(name), sizes.trainable_millions(name, spec.freeze_encoder), sizes.speech_memory_gb(name, spec.freeze_encoder, spec.eight_bit, spec.gradient_checkpointing, spec.per_device_batch_size)
    total, trained, needed = spark.range(1).select(*told).first()
    if total is None:
        print(f"{spec.model}: a model of unknown size")
        return 1
    print(f"{spec.model}: {total} million parameters, {trained} of them trained, batches of {spec.effective_batch}\nmemory for tuning: about {needed:.2f} GB")
    return _fits(needed, args.memory_gb)


_COMMANDS = {
    "inspect-dataset": _inspect, "build-data": _build_data, "build-pairs": _build_pairs, "retention": _retention, "fetch-data": _fetch, "eval-set": _eval_set, "eval-decisions": _eval_decisions,
    "sweep": _sweep, "transcripts": _transcripts, "peek": _peek, "calibrate": _calibrate, "preflight": _preflight, "preflight-speech": _preflight_speech,
}
