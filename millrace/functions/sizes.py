"""Model sizes and memory estimates out of names and settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Millions of parameters by speech model, and the encoder's share of them.
SPEECH_MILLIONS = {"openai/whisper-tiny": 39, "openai/whisper-base": 74, "openai/whisper-small": 244, "openai/whisper-medium": 769, "openai/whisper-large-v3-turbo": 809, "openai/whisper-large-v3": 1550}
ENCODER_SHARE = {"openai/whisper-large-v3-turbo": 0.79, "openai/whisper-large-v3": 0.41, "openai/whisper-medium": 0.40, "openai/whisper-small": 0.39}


def billions(name: Column) -> Column:
    """The first number before a B that ends a word; 8 if there is none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, r"(\d+(?:\.\d+)?)\s*[Bb](?:\b|-)", 1), F.lit("")), F.lit("999999D99999")).cast("double"), F.lit(8.0))


def tuning_memory_parts(params: Column, four_bit: bool, batch: int, length: int, checkpointing: bool) -> dict[str, Column]:
    """Peak memory of adapter training in GB, by what takes it."""
    return {
        "weights": params * (0.6 if four_bit else 2.0),
        "adapter and optimiser": params * 0.08,
        "activations": (batch * length / 1000) * (params / 8) * (0.25 if checkpointing else 1.0),
        "overhead": F.lit(1.5),
    }


def tuning_memory_gb(params: Column, four_bit: bool, batch: int, length: int, checkpointing: bool) -> Column:
    """Peak memory of adapter training: weights, adapter with optimiser, activations, overhead."""
    return reduce(lambda a, b: a + b, tuning_memory_parts(params, four_bit, batch, length, checkpointing).values())


def _by_name(name: Column, table: dict[str, float]) -> Column:
    """An exact name's value, else that of the longest known architecture inside the lower-cased name."""
    found = F.lit(None).cast("double")
    for key in sorted(table, key=len):
        found = F.when(F.contains(F.lower(name), F.lit(key.split("/")[-1])), F.lit(float(table[key]))).otherwise(found)
    for key, value in table.items():
        found = F.when(name == key, F.lit(float(value))).otherwise(found)
    return found


def speech_millions(name: Column) -> Column:
    return _by_name(name, SPEECH_MILLIONS).cast("long")


def trainable_millions(name: Column, frozen_encoder: bool) -> Column:
    """Parameters that are trained; half a million rounds to even."""
    total = speech_millions(name)
    if not frozen_encoder:
        return total
    return F.coalesce(F.bround(total * (1 - _by_name(name, ENCODER_SHARE))), total.cast("double")).cast("long")


def speech_memory_gb(name: Column, frozen_encoder: bool, eight_bit: bool, checkpointing: bool, batch: int) -> Column:
    """Peak memory of speech training, to two decimals."""
    total, trained = speech_millions(name), trainable_millions(name, frozen_encoder)
    states = trained * (2 if eight_bit else 12) / 1024
    return F.round(total * 2 / 1024 + trained * 2 / 1024 + states + (total / 1000) * (0.35 if checkpointing else 1.5) * batch + 1.2, 2)
