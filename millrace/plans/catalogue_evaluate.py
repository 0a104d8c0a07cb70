"""Registered queries: decision metrics, calibration, retention, checkpoints, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import decisions, text
from millrace.operators import evaluate
from millrace.plans.catalogue import register, table
from millrace.sources import files

# --- decisions ---------------------------------------------------------------------------------------------------------


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    joined = table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id")
    n = F.col("n_chars")
    said = F.when(n % 11 == 0, "MAYBE").when(n % 3 == 0, "WAIT").when(n % 7 == 0, "OBSERVE").otherwise("ACT")
    return joined.select("doc_id", "lang", F.when(F.col("quality") == 1, "ACT").otherwise("WAIT").alias("gold"), said.alias("predicted"), (n % 2 == 0).alias("addressed_to_robot"), (n / 100).alias("duration_sec"))


_P = "(select doc_id, lang, case when quality = 1 then 'ACT' else 'WAIT' end as gold, case when n_chars % 11 = 0 then 'MAYBE' when n_chars % 3 = 0 then 'WAIT' when n_chars % 7 = 0 then 'OBSERVE' else 'ACT' end as predicted, n_chars % 2 = 0 as addressed, n_chars / 100::double as sec from labels join documents using (doc_id))"


@register("agency_metrics", f"""
with s as (select count(*) as support, count(*) filter (gold = 'ACT' and predicted = 'ACT') as tp, count(*) filter (gold = 'ACT' and predicted <> 'ACT') as fn, count(*) filter (gold <> 'ACT' and predicted = 'ACT') as fp,
  count(*) filter (gold <> 'ACT') as neg, count(*) filter (gold = predicted) as ok, count(*) filter (not addressed and predicted = 'ACT') as rude, coalesce(sum(sec) filter (not addressed), 0) as alone from {_P} where predicted <> 'MAYBE'),
m as (select *, tp / nullif(tp + fn, 0)::double as r, tp / nullif(tp + fp, 0)::double as p from s)
select round(coalesce(r, 0), 9) as timeliness, round(coalesce(fp / nullif(neg, 0)::double, 0), 9) as false_intervention_rate, round(coalesce(p, 0), 9) as precision_act, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) as f1_act,
  round(ok / support::double, 9) as decision_accuracy, round(coalesce(rude / nullif(alone / 60, 0), 0), 9) as intrusiveness, support from m""")
def agency_metrics(spark: SparkSession, sf: str) -> DataFrame:
    got = evaluate.agency_metrics(_predictions(spark, sf).filter("predicted <> 'MAYBE'"))
    return got.select(*[F.round(c, 9).alias(c) if c != "support" else c for c in got.columns])


@register("decision_distribution", f"select lang, count(*) filter (gold = 'ACT') as gold_act, count(*) filter (gold = 'WAIT') as gold_wait, count(*) filter (gold = 'OBSERVE') as gold_observe, count(*) filter (predicted = 'ACT') as predicted_act, count(*) filter (predicted = 'WAIT') as predicted_wait, count(*) filter (predicted = 'OBSERVE') as predicted_observe, count(*) filter (predicted = 'MAYBE') as invalid, count(distinct predicted) filter (predicted <> 'MAYBE') <= 1 as degenerate from {_P} group by lang")
def decision_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.decision_distribution(_predictions(spark, sf), ["lang"])


# --- calibration -------------------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("is_act")).join(docs, "doc_id")


_SCORED = "(select doc_id, (n_chars % 1000) / 1000.0::double as score, quality = 1 as is_act from labels join documents using (doc_id))"
_CURVE = f"""(select t as threshold, coalesce(tp / nullif(pos, 0)::double, 0) as timeliness, coalesce(fp / nullif(neg, 0)::double, 0) as false_intervention_rate, coalesce(2 * tp / nullif(tp + fp + pos, 0)::double, 0) as f1 from
  (select k / 100::double as t, count(*) filter (is_act and score >= k / 100::double) as tp, count(*) filter (not is_act and score >= k / 100::double) as fp, count(*) filter (is_act) as pos, count(*) filter (not is_act) as neg from range(101) g(k), {_SCORED} group by k))"""


@register("temperature_scale", "select doc_id, round(1 / (1 + exp(-(ln(p / (1 - p)) / 1.7::double))), 9) as probability from (select doc_id, least(greatest((n_chars % 1000) / 1000.0::double, 1e-6::double), 1 - 1e-6::double) as p from documents)")
def temperature_scale(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(decisions.apply_temperature((F.col("n_chars") % 1000) / 1000.0, 1.7), 9).alias("probability"))


@register("calibration_curve", f"select round(threshold, 9) as threshold, round(timeliness, 9) as timeliness, round(false_intervention_rate, 9) as false_intervention_rate, round(f1, 9) as f1 from {_CURVE}")
def calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    got = evaluate.calibration_curve(_scored(spark, sf).select("score", "is_act"))
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns])


@register("calibration_pick", f"""with c as (select * from {_CURVE}), p as (select * from c where false_intervention_rate <= 0.2::double order by timeliness desc, threshold limit 1), q as (select * from c order by false_intervention_rate, threshold limit 1),
  u as (select *, true as satisfied from p union all select *, false from q where not exists (select 1 from p))
  select round(threshold, 9) as threshold, round(timeliness, 9) as timeliness, round(false_intervention_rate, 9) as false_intervention_rate, round(f1, 9) as f1, satisfied, timeliness = 0 as degenerate from u""")
def calibration_pick(spark: SparkSession, sf: str) -> DataFrame:
    got = evaluate.calibration_pick(evaluate.calibration_curve(_scored(spark, sf).select("score", "is_act")), 0.2)
    return got.select(*[F.round(c, 9).alias(c) for c in ("threshold", "timeliness", "false_intervention_rate", "f1")], "satisfied", "degenerate")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("ACT", " act", "WAIT", "OBSERVE")))
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 4).alias("e"))
    made = F.transform("e", lambda x, k: F.struct(F.when(F.col("label") % 3 == 2, F.lit("WAIT")).otherwise(F.get(names, k)).alias("token"), (-F.abs(x.cast("double"))).alias("logprob")))
    return rows.select("vec_id", F.when(F.col("label") % 2 == 0, "ACT").otherwise("WAIT").alias("chosen"), made.alias("entries"))


_PROB = "(select vec_id, case when label % 2 = 0 then 'ACT' else 'WAIT' end as chosen, case when label % 3 = 2 then (case when label % 2 = 0 then 1.0::double else 0.0::double end) else exp(-abs(embedding[2]::double)) / (exp(-abs(embedding[1]::double)) + exp(-abs(embedding[2]::double)) + exp(-abs(embedding[3]::double)) + exp(-abs(embedding[4]::double))) end as p from embeddings)"


@register("act_probability", f"select vec_id, chosen, round(p, 9) as probability from {_PROB}")
def act_probability(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("vec_id", "chosen", F.round(decisions.act_probability(F.col("entries"), F.col("chosen")), 9).alias("probability"))


@register("decision_gate", f"select vec_id, case when chosen = 'ACT' and p >= 0.3::double then 'ACT' else 'WAIT' end as decision from {_PROB}")
def decision_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entries(spark, sf).withColumn("p", decisions.act_probability(F.col("entries"), F.col("chosen")))
    return rows.select("vec_id", decisions.gated_decision(F.col("p"), F.col("chosen"), 0.3).alias("decision"))


# --- retention and checkpoints -----------------------------------------------------------------------------------------


@register("retention_delta", "select round(avg(l_discount), 9) as base_nll, round(avg(l_tax), 9) as adapter_nll, count(*) as examples, round(avg(l_tax) - avg(l_discount), 9) as delta, round((avg(l_tax) - avg(l_discount)) / avg(l_discount), 9) as relative_degradation from lineitem")
def retention_delta(spark: SparkSession, sf: str) -> DataFrame:
    got = evaluate.retention(table(spark, sf, "lineitem").select(F.col("l_discount").alias("base"), F.col("l_tax").alias("adapter")))
    return got.select(*[F.round(c, 9).alias(c) if c != "examples" else c for c in got.columns])


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    """events by hour as a sweep: an hour is a checkpoint of 50 steps a piece, the last one the final adapter."""
    step = (F.hour("ts") + 1) * 50
    label = F.when(F.hour("ts") == 23, F.lit("final")).otherwise(F.concat(F.lit("checkpoint-"), step.cast("string")))
    rows = table(spark, sf, "events").select(label.alias("label"), F.when(F.col("event_type").isin("click", "purchase"), "ACT").otherwise("WAIT").alias("gold"), F.when((F.col("value") > 50) | (F.hour("ts") % 6 == 5), "ACT").otherwise("WAIT").alias("predicted"), F.lit(True).alias("addressed_to_robot"), F.lit(0.0).alias("duration_sec"))
    metrics = evaluate.agency_metrics(rows, ["label"]).select("label", F.struct("timeliness", "false_intervention_rate", "precision_act", "f1_act", "decision_accuracy").alias("metrics"))
    return metrics.join(evaluate.decision_distribution(rows, ["label"]).select("label", "degenerate"), "label")


_SWEEP = """(select label, degenerate, step, round(r, 9) as timeliness, round(fp / neg::double, 9) as false_intervention_rate, round(p, 9) as precision_act, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) as f1_act, round(acc, 9) as decision_accuracy from (
  select label, step, count(distinct said) <= 1 as degenerate, coalesce(count(*) filter (gold and said) / nullif(count(*) filter (gold), 0)::double, 0) as r, count(*) filter (not gold and said) as fp, count(*) filter (not gold) as neg,
    coalesce(count(*) filter (gold and said) / nullif(count(*) filter (said), 0)::double, 0) as p, count(*) filter (gold = said) / count(*)::double as acc
  from (select case when hour(ts) = 23 then 'final' else 'checkpoint-' || ((hour(ts) + 1) * 50) end as label, case when hour(ts) = 23 then 1000000000 else (hour(ts) + 1) * 50 end::bigint as step, event_type in ('click', 'purchase') as gold, value > 50 or hour(ts) % 6 = 5 as said from events) group by label, step))"""


def _rounded(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 9).alias(c) if kinds[c] == "double" else c for c in df.columns])


@register("sweep_table", f"select * from {_SWEEP}")
def sweep_table(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.sweep_table(_sweep(spark, sf)))


@register("sweep_points", f"select * exclude (label) from {_SWEEP} where label <> 'final' and (step % 100 = 0 or (step % 50 = 0 and step <> 1150))")
def sweep_points(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.sweep_points(_sweep(spark, sf), ticks=True))


@register("best_checkpoint", f"select step, label, timeliness, false_intervention_rate, precision_act, f1_act, decision_accuracy from {_SWEEP} where not degenerate order by false_intervention_rate, step limit 1")
def best_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.best_checkpoint(_rounded(evaluate.sweep_table(_sweep(spark, sf))))


@register("degenerate_span", f"select min(step) filter (degenerate) as first_step, max(step) filter (degenerate) as last_step from {_SWEEP} where label <> 'final'")
def degenerate_span(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.degenerate_span(evaluate.sweep_points(_sweep(spark, sf)))


# --- transcripts -------------------------------------------------------------------------------------------------------

_LITERALS = ("ҚАЗА-ҚАЗАН,  сөз!", "Test", "MHBT mhbt", "a - b-", "бір, екі; үш", "й-й", "")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    literal = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(_LITERALS)], "id long, text string")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(literal)


_NORMAL = r"""trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(lower(translate(nfc_normalize(text), 'aAeEoOcCpPxXyYkKMHBT', 'аАеЕоОсСрРхХуУкКМНВТ')), '[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}\-\x{400}-\x{4ff}]', ' ', 'g'),
  '([\p{L}\p{N}_])-([\p{L}\p{N}_])', '\1' || chr(1) || '\2', 'g'), '([\p{L}\p{N}_])-([\p{L}\p{N}_])', '\1' || chr(1) || '\2', 'g'), '-', ' ', 'g'), chr(1), '-'), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))"""
_LIT_SQL = " union all ".join(f"select {-k - 1}, '{t}'" for k, t in enumerate(_LITERALS))
_ALL = f"(select id, {_NORMAL} as n from (select doc_id as id, text from documents union all {_LIT_SQL}))"


@register("text_normalize", f"select id, n as normalized from {_ALL}")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("id", text.normalize(F.col("text")).alias("normalized"))


@register("tokenize", f"select id, case when n = '' then 0 else len(string_split(n, ' ')) end::bigint as words, length(replace(n, ' ', ''))::bigint as characters from {_ALL}")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    made = _texts(spark, sf).select("id", text.normalize(F.col("text")).alias("n"))
    return made.select("id", F.size(text.words(F.col("n"))).cast("long").alias("words"), F.size(text.characters(F.col("n"))).cast("long").alias("characters"))


def _utterances(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    """Consecutive turns of a dialogue as reference and hypothesis, as whole lists of words or texts of characters."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", text.normalize(F.col("text")).alias("n"))
    after = F.lead("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("h", after).filter("h is not null")
    split = text.words if unit == "words" else text.joined
    return pairs.select("conv_id", "turn", "role", split(F.col("n")).alias("reference"), split(F.col("h")).alias("hypothesis"))


def _aligned(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    rows = _utterances(spark, sf, unit)
    size = F.size if unit == "words" else F.length
    return rows.select("conv_id", "turn", "role", size("reference").cast("long").alias("reference_length"), text.align("reference", "hypothesis").alias("a")).select("*", "a.*")


def _alignment_sql(unit: str) -> str:
    """Every pair's (reference_length, substitutions, deletions, insertions) by a recursion over the diagonals of its distance
    table. A cell is one number: cost * 2**42 + order of equal costs * 2**40 + substitutions * 2**20 + deletions."""
    units = "case when {0} = '' then [] else string_split({0}, ' ') end" if unit == "words" else "list_filter(string_split(replace({0}, ' ', ''), ''), lambda c: c <> '')"
    cost, order, substitution, deletion = 2**42, 2**40, 2**20, 1
    zeros = "list_transform(range(len(r) + 1), lambda i: 0::bigint)"
    return f"""with recursive t as (select conv_id, turn, role, {_NORMAL} as n from conversations),
u as (select *, lead(n) over (partition by conv_id order by turn) as m from t),
p as (select conv_id, turn, role, {units.format("n")} as r, {units.format("m")} as h from u where m is not null),
a as (select conv_id, turn, 0 as k, {zeros} as before, {zeros} as last from p
  union all
  select conv_id, turn, k + 1, last, list_transform(range(len(r) + 1), lambda i: case when i > k + 1 or k + 1 - i > len(h) then 0
    when i = 0 then (k + 1) * {cost} when i = k + 1 then (k + 1) * {cost + deletion}
    when r[i] = h[k + 1 - i] then before[i]
    else least(before[i] + {cost + substitution}, last[i] + {cost + order + deletion}, last[i + 1] + {cost + 2 * order}) & ~{3 * order} end)
  from a join p using (conv_id, turn) where len(r) > 0 and len(h) > 0 and k < len(r) + len(h)),
c as (select p.*, case when len(r) = 0 or len(h) = 0 then (len(r) + len(h)) * {cost} + len(r) else last[len(r) + 1] end as cell
  from a join p using (conv_id, turn) where k = case when len(r) = 0 or len(h) = 0 then 0 else len(r) + len(h) end)
select conv_id, turn, role, len(r)::bigint as reference_length, ((cell >> 20) & {2**20 - 1})::bigint as substitutions, (cell & {2**20 - 1})::bigint as deletions,
  ((cell >> 42) - ((cell >> 20) & {2**20 - 1}) - (cell & {2**20 - 1}))::bigint as insertions from c"""


def _rates_sql(unit: str) -> str:
    return f"select role, sum(substitutions + deletions + insertions)::bigint as errors, sum(reference_length)::bigint as reference_length, round(coalesce(sum(substitutions + deletions + insertions) / nullif(sum(reference_length), 0)::double, 0), 9) as rate from ({_alignment_sql(unit)}) group by role"


@register("align_counts", f"select conv_id, turn, reference_length, substitutions, deletions, insertions from ({_alignment_sql('words')})")
def align_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Substitutions, deletions and insertions of each pair."""
    return _aligned(spark, sf, "words").select("conv_id", "turn", "reference_length", *[F.col(c).cast("long").alias(c) for c in ("substitutions", "deletions", "insertions")])


def _rates(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    got = evaluate.error_rate(_aligned(spark, sf, unit), ["role"])
    return got.select("role", "errors", "reference_length", F.round("rate", 9).alias("rate"))


@register("corpus_wer", _rates_sql("words"))
def corpus_wer(spark: SparkSession, sf: str) -> DataFrame:
    return _rates(spark, sf, "words")


@register("corpus_cer", _rates_sql("characters"))
def corpus_cer(spark: SparkSession, sf: str) -> DataFrame:
    return _rates(spark, sf, "characters")


@register("asr_leaderboard", f"select role as name, rate as wer from ({_rates_sql('words')}) order by wer, name")
def asr_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Roles as models, by their word error rate."""
    return _rates(spark, sf, "words").select(F.col("role").alias("name"), F.col("rate").alias("wer")).orderBy("wer", "name")


@register("show_samples", "select conv_id, turn, text from conversations order by conv_id, turn limit 10")
def show_samples(spark: SparkSession, sf: str) -> DataFrame:
    return files.ordered_slice(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", 0, None).orderBy("conv_id", "turn").limit(10)
