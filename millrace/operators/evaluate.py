"""Metrics of decisions, thresholds, retention, transcripts and checkpoints. Each is one aggregate over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def agency_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Timeliness, false interventions, precision, F1, accuracy, intrusiveness (ACTs a minute while nobody addresses the
    robot) and support, for each group of by. No rows give no row, or, without groups, an error."""
    act, said = F.col("gold") == "ACT", F.col("predicted") == "ACT"
    alone = ~F.coalesce(F.col("addressed_to_robot"), F.lit(False))
    sums = [
        F.count("*").alias("support"), F.count_if(act & said).alias("tp"), F.count_if(act & ~said).alias("fn"), F.count_if(~act & said).alias("fp"), F.count_if(~act).alias("negatives"),
        F.count_if(F.col("gold") == F.col("predicted")).alias("right"), F.count_if(alone & said).alias("intrusions"), F.coalesce(F.sum(F.when(alone, F.coalesce("duration_sec", F.lit(0.0)))), F.lit(0.0)).alias("alone_sec"),
    ]
    got = predictions.groupBy(*(by or [])).agg(*sums)
    timeliness, precision = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    support = F.col("support") if by else F.when(F.col("support") > 0, F.col("support")).otherwise(F.raise_error(F.lit("no predictions to evaluate")).cast("long"))
    return got.select(
        *(by or []),
        timeliness.alias("timeliness"),
        ratio(F.col("fp"), F.col("negatives")).alias("false_intervention_rate"),
        precision.alias("precision_act"),
        ratio(2 * precision * timeliness, precision + timeliness).alias("f1_act"),
        ratio(F.col("right"), F.col("support")).alias("decision_accuracy"),
        ratio(F.col("intrusions"), F.col("alone_sec") / 60).alias("intrusiveness"),
        support.alias("support"),
    )


def decision_distribution(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of gold and predicted decisions, invalid answers among them, and whether all valid answers are one decision
    (which accuracy and F1 don't show)."""
    names = ("ACT", "WAIT", "OBSERVE")
    counts = [F.count_if(F.col(side) == name).alias(f"{side}_{name.lower()}") for side in ("gold", "predicted") for name in names]
    invalid = F.col("predicted").isNull() | ~F.col("predicted").isin(*names)
    return predictions.groupBy(*(by or [])).agg(*counts, F.count_if(invalid).alias("invalid"), (F.count_distinct(F.when(~invalid, F.col("predicted"))) <= 1).alias("degenerate"))


def calibration_curve(scored: DataFrame, steps: int = 101) -> DataFrame:
    """(threshold, timeliness, false_intervention_rate, f1) at i / (steps - 1), where score >= threshold means ACT.

    Rows (score, is_act) are counted by the last threshold they reach; cumulative sums over those steps buckets then give
    every point, so the work is one pass whatever the number of thresholds."""
    spark, top = scored.sparkSession, steps - 1
    reached = F.floor(F.col("score") * top).cast("int")
    at = lambda k: k / F.lit(float(top))
    exact = F.when(at(reached + 1) <= F.col("score"), reached + 1).when(at(reached) > F.col("score"), reached - 1).otherwise(reached)
    counts = scored.filter("score is not null and is_act is not null").groupBy(F.least(exact, F.lit(top)).alias("i")).agg(F.count_if("is_act").alias("pos"), F.count_if(~F.col("is_act")).alias("neg"))
    grid = spark.range(steps).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left")
    whole = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("all_neg"))
    above = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    summed = grid.select("i", F.sum(F.coalesce("pos", F.lit(0))).over(above).alias("tp"), F.sum(F.coalesce("neg", F.lit(0))).over(above).alias("fp")).join(F.broadcast(whole), F.lit(True))
    recall, precision = ratio(F.col("tp"), F.col("all_pos")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return summed.select(at(F.col("i")).alias("threshold"), recall.alias("timeliness"), ratio(F.col("fp"), F.col("all_neg")).alias("false_intervention_rate"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def calibration_pick(curve: DataFrame, max_false_rate: float) -> DataFrame:
    """The point of the highest timeliness within the bound, the lowest threshold of equals; if none is, the one of the
    lowest false rate, not satisfied. degenerate: the pick never acts."""
    ok = F.col("false_intervention_rate") <= max_false_rate
    point = F.struct("threshold", "timeliness", "false_intervention_rate", "f1")
    got = curve.agg(F.max_by(F.when(ok, point), F.when(ok, F.struct("timeliness", (-F.col("threshold")).alias("t")))).alias("best"), F.min_by(point, F.struct("false_intervention_rate", "threshold")).alias("least"), F.max(ok).alias("satisfied"))
    return got.select(F.when(F.col("satisfied"), F.col("best")).otherwise(F.col("least")).alias("p"), "satisfied").select("p.*", "satisfied", (F.col("p.timeliness") == 0).alias("degenerate"))


def retention(losses: DataFrame) -> DataFrame:
    """Mean losses of rows (base, adapter), their difference and its share of the base; NaN without rows."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(float("nan")))
    got = losses.agg(mean("base").alias("base_nll"), mean("adapter").alias("adapter_nll"), F.count("*").alias("examples"))
    delta = F.col("adapter_nll") - F.col("base_nll")
    return got.select("base_nll", "adapter_nll", "examples", delta.alias("delta"), ratio(delta, F.col("base_nll")).alias("relative_degradation"))


def error_rate(aligned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro-averaged error rate of rows (substitutions, deletions, insertions, reference_length); may exceed 1."""
    got = aligned.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("substitutions", "deletions", "insertions", "reference_length")])
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return got.withColumn("errors", errors).withColumn("rate", ratio(errors, F.col("reference_length")))


def paired(references: DataFrame, hypotheses: DataFrame, key: str) -> DataFrame:
    """References and hypotheses by utterance; one without the other is an error."""
    both = references.join(hypotheses, key, "full")
    lone = F.col("reference").isNull() | F.col("hypothesis").isNull()
    return both.withColumn("reference", F.when(lone, F.raise_error(F.lit("references and hypotheses don't pair up")).cast("string")).otherwise(F.col("reference")))


def checkpoint_step(path: Column) -> Column:
    """The number after checkpoint- at a path's end; a final adapter sorts last."""
    return F.coalesce(F.regexp_extract(path, r"checkpoint-(\d+)\z", 1).try_cast("long"), F.lit(1_000_000_000))


def sweep_table(results: DataFrame) -> DataFrame:
    """Results by step, metrics spread to columns."""
    return results.select(checkpoint_step(F.col("label")).alias("step"), "label", "degenerate", "metrics.*").orderBy("step", "label")


def sweep_points(results: DataFrame, ticks: bool = False) -> DataFrame:
    """The checkpoints of a sweep; with ticks, only steps that label an axis: multiples of 100, and of 50 but for the last."""
    named = results.filter(F.col("label").startswith("checkpoint-")).withColumn("step", F.split_part("label", F.lit("-"), F.lit(2)).try_cast("long"))
    if ticks:
        last = F.max("step").over(Window.partitionBy())
        named = named.withColumn("_last", last).filter((F.col("step") % 100 == 0) | ((F.col("step") % 50 == 0) & (F.col("step") != F.col("_last")))).drop("_last")
    return named.select("step", "degenerate", "metrics.*")


def degenerate_span(points: DataFrame) -> DataFrame:
    """First and last degenerate step, null without one."""
    return points.agg(F.min(F.when(F.col("degenerate"), F.col("step"))).alias("first_step"), F.max(F.when(F.col("degenerate"), F.col("step"))).alias("last_step"))


def best_checkpoint(points: DataFrame) -> DataFrame:
    """The healthy checkpoint of the fewest false interventions, the earliest of equals; no row if none is healthy."""
    kept = [c for c in points.columns if c != "degenerate"]
    healthy = points.filter(~F.col("degenerate"))
    return healthy.agg(F.min_by(F.struct(*kept), F.struct("false_intervention_rate", "step")).alias("b")).filter("b is not null").select("b.*")


def label_balance(examples: DataFrame, decision: Column) -> DataFrame:
    """Share of each decision; unknown ones are no part of the whole."""
    counts = examples.select(decision.alias("decision")).filter(F.col("decision") != "UNKNOWN").groupBy("decision").agg(F.count("*").alias("n"))
    return counts.select("decision", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


# Bounds of ACT's share.
ACT_SHARE = (0.35, 0.65)


def act_share_warning(balance: DataFrame, low: float = ACT_SHARE[0], high: float = ACT_SHARE[1]) -> DataFrame:
    """(act_share, skewed): whether ACT's share leaves the bounds."""
    got = balance.agg(F.coalesce(F.max(F.when(F.col("decision") == "ACT", F.col("share"))), F.lit(0.0)).alias("act_share"))
    return got.withColumn("skewed", ~F.col("act_share").between(low, high))
