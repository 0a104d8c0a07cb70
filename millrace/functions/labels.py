"""Labels, categories and roles of foreign corpora as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as accepted and as rejected.
TRUE_TOKENS = ("accept", "accepted", "yes", "true", "1", "positive", "good", "act", "call")
FALSE_TOKENS = ("reject", "rejected", "no", "false", "0", "negative", "bad", "wait", "none")
# Category codes in the order in which they are looked for, and their decisions (None: no training example).
CATEGORY_DECISIONS = {"CD": "ACT", "CR": "WAIT", "FA": "WAIT", "MN": None}
# Role names of chat formats.
ROLE_ALIASES = {
    "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "chatgpt": "assistant",
    "bot": "assistant", "system": "system", "tool": "tool", "function": "tool", "observation": "tool",
}
# White space as the data's tokens are stripped of it.
UNICODE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(text, rf"^{UNICODE_SPACE}+|{UNICODE_SPACE}+\z", "")


def _lookup(key: Column, table: dict[str, str | None]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def label_from_text(value: Column) -> Column:
    """True, false, or null for a token that isn't known (such rows are dropped later, never guessed)."""
    token = F.lower(strip(value))
    return F.when(token.isin(*TRUE_TOKENS), F.lit(True)).when(token.isin(*FALSE_TOKENS), F.lit(False))


def label_from_number(value: Column) -> Column:
    return F.when(value == 1, F.lit(True)).when(value == 0, F.lit(False))


def label_from_variant(value: Column) -> Column:
    """A label of any JSON type: booleans as they are, numbers only if 0 or 1, strings by token, null and nested values null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", label_from_text(F.try_variant_get(value, "$", "string")))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID"), F.lit(None).cast("boolean"))
        .otherwise(label_from_number(F.try_variant_get(value, "$", "double")))
    )


def label_of(value: Column, kind: T.DataType) -> Column:
    """A label by its column's type; dates, lists, maps and structs are no labels."""
    if isinstance(kind, T.BooleanType):
        return value
    if isinstance(kind, T.StringType):
        return label_from_text(value)
    if isinstance(kind, T.VariantType):
        return label_from_variant(value)
    return label_from_number(value) if isinstance(kind, T.NumericType) else F.lit(None).cast("boolean")


def category_code(category: Column) -> Column:
    """The first code, in the table's order, that stands in brackets in a category's text."""
    found = F.lit(None).cast("string")
    for code in reversed(CATEGORY_DECISIONS):
        found = F.when(F.contains(category, F.lit(f"({code})")), F.lit(code)).otherwise(found)
    return found


def target_decision(category: Column, help_needed: Column) -> Column:
    """The gold decision: by category if it has a code (MN has none and is no fallback), else by the help flag."""
    code = category_code(category)
    by_flag = F.when(help_needed, F.lit("ACT")).when(~help_needed, F.lit("WAIT"))
    return F.when(code.isNull(), by_flag).otherwise(F.when(code == "CD", F.lit("ACT")).when(code.isin("CR", "FA"), F.lit("WAIT")))


def role(name: Column) -> Column:
    """A chat role; names that aren't known, and null, are the user."""
    return F.coalesce(_lookup(F.lower(strip(name)), ROLE_ALIASES), F.lit("user"))


def decision_of(messages: Column) -> Column:
    """The decision that the last message quotes: the first of ACT, WAIT, OBSERVE that is there, else UNKNOWN."""
    last = F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], F.lit(""))
    found = F.lit("UNKNOWN")
    for name in ("OBSERVE", "WAIT", "ACT"):
        found = F.when(F.contains(last, F.lit(f'"{name}"')), F.lit(name)).otherwise(found)
    return found
