"""Which column of a foreign corpus plays which role; decided on names, before any job where a table has the same for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Candidate column names by role, and those of a transcript's text, in the order in which they are tried; the names that tell a proactive corpus.
OBSERVATION = ("events", "event", "observations", "observation", "context", "history", "activity", "user_activity", "scenario", "state", "input", "conversation")
ACTION = ("task", "prediction", "proposed_task", "candidate_task", "task_description", "action", "response", "assistant", "output", "target")
LABEL = ("label", "accepted", "is_accepted", "judgement", "judgment", "human_label", "annotation", "verdict", "preference")
PROACTIVE = ("obs", "help_needed")
TEXT = ("transcription", "sentence", "text", "raw_transcription", "normalized_text")


class FieldNotFound(KeyError):
    pass


def find_field(columns: Sequence[str], candidates: Sequence[str], role: str, override: str | None = None, required: bool = True) -> str | None:
    """The override if it is there; else the first candidate that some column equals, else that some column contains,
    letter case aside; else an error that lists the columns, or None."""
    if override is not None:
        if override in columns:
            return override
        raise FieldNotFound(f"{role}: no column {override!r} among {list(columns)}")
    for fits in (lambda c, name: c == name, lambda c, name: c in name):
        for candidate in candidates:
            for column in columns:
                if fits(candidate.lower(), column.lower()):
                    return column
    if required:
        raise FieldNotFound(f"{role}: none of {list(candidates)} among {list(columns)}")
    return None


def field_of(names: Column, candidates: Sequence[str]) -> Column:
    """find_field() where each row has names of its own (an array): the name, or null."""
    first = lambda fits, c: F.get(F.filter(names, lambda n: fits(F.lower(n), F.lit(c))), 0)
    return F.coalesce(*[first(fits, c) for fits in (lambda n, c: n == c, F.contains) for c in candidates])


def text_column(columns: Sequence[str], override: str | None = None) -> str:
    """The transcript's column; names are taken to the letter."""
    for name in (override,) if override else TEXT:
        if name in columns:
            return name
    raise KeyError(f"no transcript column among {list(columns)}")


def corpus_format(columns: Sequence[str], declared: str = "auto") -> str:
    """proactive, transcript or generic, by the columns, unless declared."""
    if declared != "auto":
        return declared
    return "proactive" if set(PROACTIVE) <= set(columns) else "transcript" if {"system", "chat"} <= set(columns) else "generic"
