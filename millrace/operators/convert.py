"""Converters of foreign corpora to examples. Each adds a status column that says why a row is no example."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import decisions, dialogue, labels, text
from millrace.operators import fields


def proactive(rows: DataFrame, limit: int = 12, confidence: float = 0.85, lang: str = "ru") -> DataFrame:
    """rows (obs, pred_task, help_needed, category) with status (kept, no_observations, no_label, no_text), decision and messages.

    Observations are looked at before the label; an ACT needs a text, a WAIT never carries the rejected one."""
    out = rows.withColumn("_obs", text.timed_observations(F.col("obs"), limit)).withColumn("_decision", labels.target_decision(F.col("category"), F.col("help_needed"))).withColumn("_text", F.nullif(labels.strip(F.col("pred_task")), F.lit("")))
    status = F.when(F.size("_obs") == 0, "no_observations").when(F.col("_decision").isNull(), "no_label").when((F.col("_decision") == "ACT") & F.col("_text").isNull(), "no_text").otherwise("kept")
    return _finished(out.withColumn("status", status), confidence, lang)


def generic(rows: DataFrame, observation: str | None = None, action: str | None = None, label: str | None = None, limit: int = 12, confidence: float = 0.85, reject: str = "WAIT", lang: str = "ru") -> DataFrame:
    """rows of any columns, found by name or given, with status (kept, no_label, no_observations, no_text), decision, messages.

    Observation and action may be of any type: lists and objects are spelt out as text. A label that is a list or an object is unknown."""
    names = [fields.find_field(rows.columns, *role) for role in ((fields.OBSERVATION, "observation", observation), (fields.ACTION, "action", action), (fields.LABEL, "label", label))]
    seen, said = (text.plain_text(F.col(f"`{name}`"), rows.schema[name].dataType) for name in names[:2])
    known = labels.label_of(F.col(f"`{names[2]}`"), rows.schema[names[2]].dataType)
    out = rows.withColumn("_obs", text.observation_lines(seen, limit)).withColumn("_text", F.nullif(said, F.lit(""))).withColumn("_decision", F.when(known, F.lit("ACT")).when(~known, F.lit(reject)))
    status = F.when(F.col("_decision").isNull(), "no_label").when(F.size("_obs") == 0, "no_observations").when((F.col("_decision") == "ACT") & F.col("_text").isNull(), "no_text").otherwise("kept")
    return _finished(out.withColumn("status", status), confidence, lang)


def _finished(rows: DataFrame, confidence: float, lang: str) -> DataFrame:
    messages = decisions.example_messages(decisions.situation_json(F.col("_obs"), F.lit(0.0)), decisions.decision_json(F.col("_decision"), F.lit(confidence), F.col("_text"), lang))
    kept = F.col("status") == "kept"
    return rows.withColumn("decision", F.when(kept, F.col("_decision"))).withColumn("messages", F.when(kept, messages)).drop("_obs", "_decision", "_text")


def dialogues(rows: DataFrame) -> DataFrame:
    """rows of any dialogue layout with messages and status (kept, unparsed, short)."""
    out = rows.withColumn("_messages", dialogue.to_messages(dict(rows.dtypes)))
    status = F.when(F.col("_messages").isNull(), "unparsed").when(F.size("_messages") < 2, "short").otherwise("kept")
    return out.drop("messages").withColumn("status", status).withColumn("messages", F.when(status == "kept", F.col("_messages"))).drop("_messages")


def transcripts(rows: DataFrame) -> DataFrame:
    """rows (system, chat) with messages and status (kept, no_assistant, short)."""
    turns = dialogue.parse_transcript(F.coalesce("chat", F.lit("")))
    head = dialogue.clean(F.coalesce("system", F.lit("")))
    whole = F.when(head != "", F.concat(F.array(dialogue.message(F.lit("system"), head)), turns)).otherwise(turns)
    out = rows.withColumn("_messages", whole)
    status = F.when(~F.exists("_messages", lambda m: m["role"] == "assistant"), "no_assistant").when(F.size("_messages") < 2, "short").otherwise("kept")
    return out.withColumn("status", status).withColumn("messages", F.when(status == "kept", F.col("_messages"))).drop("_messages")


def stats(converted: DataFrame) -> DataFrame:
    """How many rows were kept, and skipped by reason."""
    return converted.groupBy("status").agg(F.count("*").alias("n"))


def assembled(turns: DataFrame, key: str, order: str, role: str = "role", content: str = "text") -> DataFrame:
    """(key, messages) of rows of single turns; memory is that of one dialogue."""
    one = F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))
    return turns.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def mono(samples: Column) -> Column:
    """The mean of channels, sample by sample; one channel as it is."""
    return F.when(F.size(samples) == 1, F.element_at(samples, 1)).otherwise(F.transform(F.element_at(samples, 1), lambda x, k: F.aggregate(samples, F.lit(0.0), lambda a, c: a + F.get(c, k).cast("double")) / F.size(samples)))


def pad_labels(rows: DataFrame, batch: str, ids: str, start_token: int, pad: int = -100) -> DataFrame:
    """Label lists of a batch padded to its longest; their first column goes if all begin with the start token."""
    from pyspark.sql import Window

    own = Window.partitionBy(batch)
    marked = rows.withColumn("_most", F.max(F.size(ids)).over(own)).withColumn("_all", F.min((F.get(ids, F.lit(0)) == start_token).cast("int")).over(own))
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(pad), F.col("_most") - F.size(ids)))
    return marked.withColumn("padded", F.when(F.col("_all") == 1, F.slice(padded, 2, F.greatest(F.col("_most") - 1, F.lit(0)))).otherwise(padded)).drop("_most", "_all")
