"""Text helpers: lenient numbers, number formatting, labels, escapes, unique names."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgecast.functions.geo import as_col

NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def leading_number(value: Column | str) -> Column:
    """Number at the start of a text, NULL when there is none; never fails the job."""
    text = F.regexp_extract(as_col(value), NUMBER_PREFIX, 1)
    return F.when(text != "", text).try_cast("double")


def number_text(value: Column | str) -> Column:
    """Shortest decimal form without a trailing ``.0``."""
    x = as_col(value).cast("double")
    small = F.abs(x) < 1e-3
    plain = F.regexp_replace(x.cast("string"), r"\.0$", "")
    fixed = F.regexp_replace(x.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    return F.when(x == 0, F.lit("0")).when(small | (F.abs(x) >= 1e7), fixed).otherwise(plain)


def fixed_text(value: Column | str, digits: int) -> Column:
    """Number with a fixed count of decimals, rounded on its exact binary value, ties upwards."""
    x = as_col(value).cast("double")
    pattern = "0." + "0" * digits if digits else "0"
    tie = F.pmod(x * float(2 ** (digits + 1)), F.lit(2.0)) == 1.0
    return F.when(tie, F.format_string(f"%.{digits}f", x)).otherwise(F.call_function("format_number", x, F.lit(pattern)))


def title_from_snake(value: Column | str) -> Column:
    """snake_case to Title Case: every underscore-separated word is capitalised."""
    words = F.split(as_col(value), "_")
    capital = F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))
    )
    return F.array_join(capital, " ")


def xml_escape(value: Column | str) -> Column:
    out = as_col(value)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def with_unique_names(df: DataFrame, name: str, scope: list[str], position: str, suffix: str | None = None) -> DataFrame:
    """Repeats of an earlier name get `` (suffix)``; the first keeps its name.

    First positions come from a partial aggregate joined back, not from a window
    by name, so a name that fills a third of the table is never sorted in one task.
    A null name stays null.
    """
    suffix = suffix or position
    first = df.groupBy(*scope, name).agg(F.min(position).alias("_first"))
    renamed = F.when(
        F.col(position) > F.col("_first"), F.concat(F.col(name), F.lit(" ("), F.col(suffix).cast("string"), F.lit(")"))
    ).otherwise(F.col(name))
    same = reduce(and_, [F.col(f"_n.{c}").eqNullSafe(F.col(f"_f.{c}")) for c in [*scope, name]])
    joined = df.alias("_n").join(first.alias("_f"), same).select("_n.*", "_f._first")
    return joined.withColumn(name, renamed).drop("_first")
