"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# Typographic characters and what stands for them in normalised text.
TYPOGRAPHIC = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", " ": " "}


def rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ordered(by: list[str], on: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(on)


def lagged(value: Column, n: int, w: WindowSpec) -> Column:
    return F.lag(value, n).over(w)


def change(value: Column, n: int, w: WindowSpec) -> Column:
    return value - lagged(value, n, w)


def pct_change(value: Column, n: int, w: WindowSpec, scale: float = 100.0) -> Column:
    """(value / value n rows before - 1) * scale; null where that is null or zero."""
    return (ratio(value, lagged(value, n, w)) - 1) * scale


def month_of(date: Column) -> Column:
    return F.trunc(date, "MM")


def month_offset(month: Column, n: int | Column) -> Column:
    """YYYY-MM moved by n months."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), n), "yyyy-MM")


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def within_tolerance(expected: Column, actual: Column, rel: float = 0.05, abs_: float = 0.5) -> Column:
    """Near enough: within abs_, or (unless nothing is expected) within the share rel of what is expected."""
    near = F.abs(actual - expected) <= abs_
    return F.when(expected == 0, F.abs(actual) <= abs_).otherwise(near | (F.abs(actual - expected) <= rel * F.abs(expected)))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_marks(text: Column) -> Column:
    for mark, plain in TYPOGRAPHIC.items():
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def capped(text: Column, limit: int) -> Column:
    """At most limit characters, cut at the last blank if that lies in the second half."""
    head = F.substring(text, 1, limit)
    blank = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last blank
    cut = F.when((F.instr(head, " ") > 0) & (blank >= limit / 2), F.substring(head, F.lit(1), blank.cast("int"))).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.rtrim(cut))


def normalize_text(text: Column, limit: int, compose=None) -> Column:
    """Compatibility-composed (by compose, a column function; see functions.unicode), plain marks, single blanks, capped."""
    text = compose(text) if compose else text
    return capped(collapsed(plain_marks(F.coalesce(text, F.lit("")))), limit)


def three_way(value: Column) -> Column:
    return F.when(value < 0, "RED").when(value > 0, "GREEN").otherwise("NEUTRAL")
