"""JSON text in one fixed spelling: ", " and ": " between members, control characters in lower-case hexadecimal, numbers in
their shortest form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SEPARATOR = r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:])*+)([,:])'  # up to the next comma or colon that isn't in a string


def spaced(compact: Column) -> Column:
    """Compact JSON text with a space behind every comma and colon outside strings."""
    out = F.regexp_replace(compact, _SEPARATOR, "$1$2 ")
    lower = out
    for high in "01":
        for low in "ABCDEF":
            code = f"00{high}{low}"
            lower = F.regexp_replace(lower, rf"\G((?:[^\\]|\\[^u]|\\u(?!{code}))*+)\\u{code}", rf"$1\\u{code.lower()}")
    return F.when(out.rlike(r"\\u00[01][A-F]"), lower).otherwise(out)


def number_text(number: Column) -> Column:
    """A double as JSON text: plain digits from 1e-4 to below 1e16, else one digit before the point and a two-digit exponent."""
    x = number.cast("double")
    plain = x.cast("string")
    mantissa, power = F.split_part(plain, F.lit("E"), F.lit(1)), F.split_part(plain, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(plain.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    short = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    return F.when(~F.contains(plain, F.lit("E")), plain).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), digits).otherwise(short)


def json_object(members: dict[str, Column]) -> Column:
    """An object of members (name: JSON text) in the order given; null texts are left out."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), value) for name, value in members.items()]), F.lit("}"))


@F.pandas_udf(StringType())
def _respelt(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False), na_action="ignore")


def respelt(text: Column) -> Column:
    """Any JSON text in this spelling, members in their order. A variant would sort them, so it is read in Python; texts that
    can't differ (words and whole numbers) are passed by."""
    bare = F.btrim(text, F.lit(" \t\n\r"))
    simple = bare.rlike(r"^(null|true|false|-?(0|[1-9][0-9]{0,17}))$")
    return F.when(simple, bare).otherwise(_respelt(F.when(~simple, text)))
