"""Scalar rewards of logged reactions and preference pairs inside a situation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dialogue import prompt_of

# The valence of emotions; what isn't listed counts 0.
VALENCE = {"happy": 1.0, "surprise": 0.2, "neutral": 0.0, "unknown": 0.0, "sad": -0.6, "fear": -0.8, "disgust": -0.9, "angry": -1.0}


@dataclass(frozen=True)
class Weights:
    """The default weight of each sign in a reaction."""

    emotion_shift: float = 1.0
    continued_dialogue: float = 1.0
    turned_away: float = -0.8
    left_frame: float = -1.2
    interrupted: float = -1.0
    repeated_question: float = -1.0
    engagement_seconds: float = 0.05


def valence(emotion: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in VALENCE.items() for x in pair])
    return F.coalesce(F.element_at(table, emotion), F.lit(0.0))


def score(reaction: Column, weights: Weights = Weights()) -> Column:
    """The reward. Terms are added in a fixed order, so doubles are the same everywhere; null signs count as absent."""
    total = F.lit(weights.emotion_shift) * (valence(reaction["emotion_after"]) - valence(reaction["emotion_before"]))
    total = total + F.lit(weights.engagement_seconds) * F.coalesce(reaction["engagement_seconds"], F.lit(0.0))
    for sign, weight in (("continued_dialogue", weights.continued_dialogue), ("turned_away", weights.turned_away), ("left_frame", weights.left_frame), ("interrupted_robot", weights.interrupted), ("repeated_question", weights.repeated_question)):
        total = F.when(F.coalesce(reaction[sign], F.lit(False)), total + F.lit(weight)).otherwise(total)
    return total


def preference_pairs(scored: DataFrame, min_margin: float = 0.5, group: str = "situation_key", position: str = "pos", payload: str = "action") -> DataFrame:
    """(group, chosen, rejected, margin) of groups of two rows or more whose best and worst reward (column reward) differ by
    min_margin: the earliest of the best, the latest of the worst. Rewards never meet across groups.

    One hash aggregate with partial states: a group of a third of all rows sends one row a task.
    """
    order = F.struct("reward", (-F.col(position)).alias("p"))
    best = scored.groupBy(group).agg(F.count("*").alias("n"), F.max_by(F.struct("reward", payload), order).alias("best"), F.min_by(F.struct("reward", payload), order).alias("worst"))
    margin = F.col("best.reward") - F.col("worst.reward")
    return best.filter((F.col("n") >= 2) & (margin >= min_margin)).select(group, F.col(f"best.{payload}").alias("chosen"), F.col(f"worst.{payload}").alias("rejected"), margin.alias("margin"))


def dpo_pairs(log: DataFrame, min_margin: float = 0.5, weights: Weights = Weights()) -> DataFrame:
    """prompt, chosen, rejected (as messages) and margin of an interaction log with a position."""
    scored = log.withColumn("reward", score(F.col("reaction"), weights)).withColumn("action", F.struct("messages", "decision_json"))
    answer = lambda d: F.array(F.struct(F.lit("assistant").alias("role"), d.alias("content")))
    pairs = preference_pairs(scored, min_margin)
    return pairs.select("situation_key", prompt_of(F.col("chosen.messages")).alias("prompt"), answer(F.col("chosen.decision_json")).alias("chosen"), answer(F.col("rejected.decision_json")).alias("rejected"), "margin")
