"""The interaction log, with closed domains and defaults, and evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.decisions import SYSTEM_PROMPT, decision_valid
from millrace.schemas import EMOTIONS, INTERACTION

SIGNS = ("continued_dialogue", "turned_away", "left_frame", "interrupted_robot", "repeated_question")


def with_defaults(log: DataFrame) -> DataFrame:
    """Missing signs are false, missing seconds 0, missing emotions unknown; an emotion outside the domain is an error."""
    emotion = lambda c: F.when(c.isNull(), F.lit("unknown")).when(c.isin(*EMOTIONS), c).otherwise(F.raise_error(F.concat(F.lit("unknown emotion "), c)))
    r = F.col("reaction")
    filled = [emotion(r[e]).alias(e) for e in ("emotion_before", "emotion_after")] + [F.coalesce(r[s], F.lit(False)).alias(s) for s in SIGNS] + [F.coalesce(r["engagement_seconds"], F.lit(0.0)).alias("engagement_seconds")]
    return log.withColumn("reaction", F.struct(*filled))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An interaction log of JSON lines; a malformed line, or a reaction with a member that isn't known, is an error."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    known = F.array(*[F.lit(x) for x in ("emotion_before", "emotion_after", *SIGNS, "engagement_seconds")])
    extra = F.array_except(F.json_object_keys(F.get_json_object("value", "$.reaction")), known)
    checked = raw.withColumn("value", F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown reaction fields "), F.array_join(extra, ", "))).cast("string")).otherwise(F.col("value")))
    return with_defaults(checked.select(F.from_json("value", INTERACTION, {"mode": "FAILFAST"}).alias("r")).select("r.*"))


def decision_rows(rows: DataFrame) -> DataFrame:
    """Rows of at least three messages that open with the system prompt and end in a valid decision."""
    m = F.col("messages")
    return rows.filter((F.size(m) >= 3) & (F.try_element_at(m, F.lit(1))["content"] == SYSTEM_PROMPT) & decision_valid(F.try_element_at(m, F.lit(-1))["content"]))
