"""From a build's settings to a training corpus: read, convert, balance, mix, split and write."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace import reports
from millrace.functions import labels
from millrace.operators import convert, evaluate, fields, sampling
from millrace.schemas import DECISIONS, PROACTIVE
from millrace.sources import files
from millrace.sources.configs import BuildSpec, DatasetSpec, split_bounds
from millrace.sources.scratch import scratch

log = logging.getLogger(__name__)
UNREADABLE = (FileNotFoundError, ValueError, KeyError, PySparkException, Py4JJavaError)

#: The role of each source in a build; the first is required, a dead one of the others only shrinks the mix.
ROLES = ("proactivity", "function_calling", "replay")
PARTS = ("train", "val")


@dataclass(frozen=True)
class Report:
    """What a build took: rows in all and by source, the source that limits it, the largest mix without repeats, rows that
    a source lacked, and the sizes of both parts."""

    total: int
    by_source: dict[str, int]
    limiting: str
    max_total: int
    shortfall: dict[str, int]
    train: int = 0
    val: int = 0

    def describe(self) -> str:
        return reports.mix(self.total, self.by_source, self.limiting, self.max_total, self.shortfall)


def load_rows(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """The rows of a source: a file of JSON lines, a JSON document or a Parquet folder; a slice of its split, then its limit.
    Rows come in the order in which the source is read."""
    start, stop = split_bounds(spec.split)
    last = stop if spec.limit is None else min(start + spec.limit, stop if stop is not None else start + spec.limit)
    return files.read_slice(spark, spec.path, start, last)


@dataclass(frozen=True)
class Converted:
    """A source's rows with status, messages and decision, and what a write of them counts on its way: rows by status."""

    path: str
    rows: DataFrame
    counts: Observation

    @property
    def skipped(self) -> dict[str, int]:
        return {status: n for status, n in self.counts.get.items() if n and status != "kept"}


STATUSES = ("kept", "no_observations", "no_label", "no_text", "unparsed", "short", "no_assistant")


def _converted(path: str, made: DataFrame) -> Converted:
    counts = Observation()
    told = made.observe(counts, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return Converted(path, told.filter("status = 'kept'").select("messages"), counts)


def proactive_sources(spark: SparkSession, specs: list[DatasetSpec]) -> list[Converted]:
    """The sources of proactivity. One that can't be read fails the build."""
    parts = []
    for spec in specs:
        rows = load_rows(spark, spec)
        kind = fields.corpus_format(rows.columns, spec.format)
        made = convert.proactive(rows) if kind in ("proactive", "proactive_agent") else convert.generic(rows, **{k: v for k, v in (spec.field_map or {}).items() if v is not None})
        parts.append(_converted(spec.path, made))
    return parts


def dialogue_sources(spark: SparkSession, specs: list[DatasetSpec]) -> list[Converted]:
    """The dialogue sources. One that can't be read is left out, with a warning."""
    parts = []
    for spec in specs:
        try:
            parts.append(_converted(spec.path, convert.dialogues(load_rows(spark, spec))))
        except UNREADABLE as e:
            log.warning("source %s is left out: %s", spec.path, str(e).splitlines()[0])
    return parts


def proactive_examples(spark: SparkSession, specs: list[DatasetSpec]) -> DataFrame:
    """(messages, decision) of all sources of proactivity, appended."""
    return _appended(spark, [p.rows for p in proactive_sources(spark, specs)]).withColumn("decision", labels.decision_of(F.col("messages")))


def dialogue_examples(spark: SparkSession, specs: list[DatasetSpec]) -> DataFrame:
    """(messages) of all dialogue sources, appended."""
    return _appended(spark, [p.rows for p in dialogue_sources(spark, specs)])


def _appended(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "messages array<struct<role:string,content:string>>")
    for part in parts:
        out = out.unionByName(part)
    return out


def example_key(messages: str = "messages"):
    """A stable key of an example, the same whatever the partitions; equal examples share it."""
    return F.md5(F.to_json(F.col(messages)))


def _examples(spark: SparkSession, spec: BuildSpec) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """(source, messages, decision) of all sources, and how many rows of each decision each source has. One job reads each source, converts
    and writes it once to the shared folder; counts by status, source and decision are taken on the way."""
    made = {ROLES[0]: proactive_sources(spark, spec.proactivity), ROLES[1]: dialogue_sources(spark, spec.function_calling), ROLES[2]: dialogue_sources(spark, spec.replay)}
    rows = spark.createDataFrame([], "source string, messages array<struct<role:string,content:string>>")
    for role, parts in made.items():
        rows = rows.unionByName(_appended(spark, [p.rows for p in parts]).select(F.lit(role).alias("source"), "messages"))
    of = F.when(F.col("source") == ROLES[0], labels.decision_of(F.col("messages")))
    sizes = Observation()
    told = {(role, d): F.count_if((F.col("source") == role) & F.col("decision").eqNullSafe(F.lit(d))) for role in ROLES for d in ((*DECISIONS, "UNKNOWN") if role == ROLES[0] else (None,))}
    path = scratch(spark, "examples")
    rows.withColumn("decision", of).observe(sizes, *[n.alias(f"{role}:{d}") for (role, d), n in told.items()]).write.parquet(path)
    for part in (p for parts in made.values() for p in parts):
        log.info("%s: %d examples, left out: %s", part.path, part.counts.get["kept"], part.skipped or "none")
    counts = {role: {d: sizes.get[f"{role}:{d}"] for r, d in told if r == role} for role in ROLES}
    return _kept_at(spark, path), counts


def _kept_at(spark: SparkSession, path: str) -> DataFrame:
    """A table in the shared folder, and where it is, for who removes it."""
    out = spark.read.parquet(path)
    out.kept_at = path
    return out


def build_corpus(spark: SparkSession, spec: BuildSpec) -> tuple[DataFrame, Report]:
    """(source, messages, part) of the whole build, part being train or val, and its report.

    Converted examples are written once to the shared folder, so that counts, cuts and rows are of the same rows; the parts too.
    """
    examples, counts = _examples(spark, spec)
    rows = examples
    decided = {d: n for d, n in counts[ROLES[0]].items() if n}
    if spec.proactivity_balance:
        own = sampling.downsample_to_balance(rows.filter(F.col("source") == ROLES[0]), "decision", example_key(), spec.seed)
        rows = own.unionByName(rows.filter(F.col("source") != ROLES[0]))
        decided = dict.fromkeys(decided, min(decided.values(), default=0)) if len(decided) > 1 else decided
    share = decided.get("ACT", 0) / max(1, sum(n for d, n in decided.items() if d != "UNKNOWN"))
    if not evaluate.ACT_SHARE[0] <= share <= evaluate.ACT_SHARE[1]:
        log.warning("the share of ACT is %.1f %%; about half is wanted", 100 * share)
    counts = {role: sum((decided if role == ROLES[0] else counts[role]).values()) for role in ROLES}
    listed = spark.createDataFrame([(k, name, float(spec.proportions[name]), counts[name]) for k, name in enumerate(ROLES)], "ord int, name string, proportion double, n long")
    alive = sampling.renormalize(listed)
    plan = sampling.mix_plan(alive, spec.target_size).orderBy("ord").collect()
    mixed = sampling.build_mix(rows.select("source", "messages"), spec.proportions, example_key(), spec.target_size, spec.seed)
    parts = sampling.train_val_split(mixed, spec.val_ratio, F.concat("source", example_key()), spec.seed)
    sizes, path = Observation(), scratch(spark, "mixed")
    parts.observe(sizes, *[F.count_if(F.col("part") == p).alias(p) for p in PARTS]).write.parquet(path)
    files.remove(spark, examples.kept_at)
    taken = {r["name"]: r["taken"] for r in plan}
    ceiling = sampling.mix_ceiling(alive).first()
    report = Report(sum(taken.values()), taken, ceiling["limiting"], ceiling["max_total"], {r["name"]: r["shortfall"] for r in plan if r["shortfall"] > 0}, **sizes.get)
    return _kept_at(spark, path), report


def write_corpus(spark: SparkSession, spec: BuildSpec, output: str) -> Report:
    """The build's three outputs under output: train.jsonl and val.jsonl (folders of JSON lines, shuffled; written together and
    then put in place) and mix_report.txt."""
    parts, report = build_corpus(spark, spec)
    output = output.rstrip("/")
    shuffled = parts.orderBy("part", sampling.shuffle_key(spec.seed, "order", example_key()))
    line = files.json_line(F.struct("messages", "source"))
    shuffled.select("part", line.alias("value")).write.mode("overwrite").partitionBy("part").text(f"{output}/_parts")
    for part in PARTS:
        files.replace(spark, f"{output}/_parts/part={part}", f"{output}/{part}.jsonl")
    files.remove(spark, f"{output}/_parts")
    files.remove(spark, parts.kept_at)
    files.write_text(spark, f"{output}/mix_report.txt", report.describe())
    return report


def fetched(spark: SparkSession, folder: str, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(file, raw) of all rows of a crawl's usable files, and (file, examples) of those: files of JSON lines or documents
    from which a converter makes at least so many examples. A file's first row tells its layout, and with it the converter: that
    of proactive rows, or the generic one with the roles of the first row's names. A generic file without a name for each role, or with a row
    that is no object, gives none. The table of layouts has a row a file."""
    parts = [files.tolerant_rows(spark, folder, "*.jsonl"), files.tolerant_documents(spark, folder, "*.json")]
    path = scratch(spark, "crawl")
    parts[0].unionByName(parts[1]).withColumn("names", F.json_object_keys("raw")).write.parquet(path)
    lines = spark.read.parquet(path)
    names = F.min_by(F.coalesce("names", F.array().cast("array<string>")), "place")
    layout = lines.groupBy("file").agg(names.alias("names"), F.bool_and(F.col("names").isNotNull()).alias("objects"))
    roles = {"seen": fields.OBSERVATION, "said": fields.ACTION, "judged": fields.LABEL}
    layout = layout.select("file", "objects", F.forall(F.array(*map(F.lit, fields.PROACTIVE)), lambda k: F.array_contains("names", k)).alias("proactive"), *[fields.field_of(F.col("names"), c).alias(role) for role, c in roles.items()])
    told = lines.select("file", "raw").join(layout, "file")
    proactive = told.filter("proactive").select("file", F.from_json("raw", PROACTIVE).alias("r")).select("file", "r.*")
    value = lambda role: F.element_at(F.from_json("raw", "map<string,variant>"), F.col(role))
    other = told.filter("not proactive and objects and seen is not null and said is not null and judged is not null")
    generic = other.select("file", value("seen").alias("observation"), value("said").alias("action"), value("judged").alias("label"))
    made = convert.proactive(proactive).select("file", "status").unionByName(convert.generic(generic).select("file", "status"))
    usable = files.usable_files(made, F.col("status") == "kept", least)
    return lines.select("file", "raw").join(usable, "file", "left_semi"), usable
