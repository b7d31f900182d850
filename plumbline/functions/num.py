"""Number parsing and formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Banker's rounding; ties follow the shortest decimal form of the double."""
    return F.bround(x, digits)


def fmt_g(x: Column) -> Column:
    """Six significant digits as C's %g writes them: 5563, 0.25, 1.23457e+06.

    Ties of the shortest decimal form go to the even digit.  Whole numbers of up to
    six digits are written straight.
    """
    x = x.cast("double")
    exponent = F.substring_index(F.format_string("%.5e", x), "e", -1)
    e = exponent.try_cast("int")
    one = F.lit(10.0)
    scaled = F.when(e < 0, F.abs(x) * F.pow(one, -e)).otherwise(F.abs(x) / F.pow(one, e))
    digits = F.regexp_replace(F.replace(F.format_string("%.5f", F.bround(scaled, 5)), F.lit("."), F.lit("")), "0+$", "")
    size = F.length(digits)
    large = F.when(size <= e + 1, F.rpad(digits, e + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, 1, e + 1), F.lit("."), F.substring(digits, e + 2, size)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    power = F.concat(F.substring(digits, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(F.lit("")), F.lit("e"), exponent)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when((F.abs(x) < 1e6) & (x == F.floor(x)), x.cast("bigint").cast("string"))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .otherwise(F.concat(sign, F.when(e.between(0, 5), large).when(e.between(-4, -1), small).otherwise(power)))
    )


def as_number(text: Column) -> Column:
    """A double from text with a decimal comma or point; null where it is none."""
    return F.trim(F.replace(text, F.lit(","), F.lit("."))).try_cast("double")


def number_value(label: Column) -> Column:
    """The value of a drawn number: signs of comparison go, the comma is a point."""
    return as_number(F.regexp_replace(F.trim(label), "^[<>]+", ""))


def is_number_label(text: Column) -> Column:
    """Drawn numbers: optional comparison sign, digits, optional decimals."""
    return text.rlike("(?U)^[<>]?\\s*\\d+(?:[.,]\\d+)?$")


def written_forms(x: Column) -> Column:
    """How a value may be written on a sheet: general, integer, spaced thousands, one decimal."""
    whole = x == F.floor(x)
    integer = F.floor(x).cast("bigint").cast("string")
    spaced = F.replace(F.format_number(F.floor(x).cast("bigint"), 0), F.lit(","), F.lit(" "))
    forms = F.when(whole, F.array(fmt_g(x), spaced, integer)).otherwise(F.array(fmt_g(x), F.format_string("%.1f", F.bround(x, 1))))
    return F.array_distinct(forms)


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted array; null of an empty one."""
    return F.try_element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def safe_share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))
