"""Text expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(text: Column) -> Column:
    """Trim white space of every kind, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """True when the lower-cased text has one of the words as a substring."""
    return F.lower(text).rlike("|".join(re.escape(word) for word in words))


def fill(template: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` places of a template; a null shows as ``None``."""
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def plain_number(value: Column) -> Column:
    """A double as plain decimal text with at least one decimal, such as ``15309876.0``, without an exponent."""
    digits = F.regexp_replace(value.cast("string").cast("decimal(38,17)").cast("string"), r"0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    size = F.abs(value)
    return F.when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain).otherwise(value.cast("string"))


def number_text(df: DataFrame, name: str) -> Column:
    """A value of any type as text, fractions without an exponent."""
    value = F.col(name)
    fraction = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return plain_number(value.cast("double")) if fraction else value.cast("string")


def fixed_sql(value: str, places: int) -> str:
    """SQL for a number with a fixed count of decimals, halves rounded to even."""
    return f"format_string('%.{places}f', bround(double({value}), {places}))"


def percent_sql(value: str) -> str:
    """SQL for a ratio as a percentage with one decimal."""
    return f"concat({fixed_sql(f'100.0D * {value}', 1)}, '%')"


def clean_name(name: str) -> str:
    """A table name: letters, digits and single underscores, lower case, not starting with a digit."""
    words = "_".join(re.findall(r"[A-Za-z0-9]+", name)).lower() or "dataset"
    return f"t_{words}" if words[0].isdigit() else words


def clean_name_column(name: Column) -> Column:
    """``clean_name`` for a column of names."""
    words = F.lower(F.array_join(F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), F.lit(0)), "_"))
    filled = F.when(words == "", F.lit("dataset")).otherwise(words)
    return F.when(filled.rlike(r"^[0-9]"), F.concat(F.lit("t_"), filled)).otherwise(filled)
