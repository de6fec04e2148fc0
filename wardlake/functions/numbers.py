"""Number to text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(value: Column) -> Column:
    """The shortest text of a double: ``3.0``, ``0.0001``, ``12345678.5``, ``1e-05``, ``1e+16``.

    Spark's cast switches to ``1.0E-4`` below 0.001 and to ``1.0E7`` from ten million on,
    and on older Java may print more digits than needed. Here plain digits are
    kept from 0.0001 up to below 1e16, and the shorter text wins if it reads back equal.
    """
    return let(value.cast("double"), lambda x: let(_digits(x), lambda text: _layout(x, text)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once and written once into the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(value: Column) -> Column:
    cast = value.cast("string")
    text = F.when(F.length(cast) < 18, cast)
    for pattern in ("%.13e", "%.14e", "%.15e", "%.16e"):
        shorter = F.format_string(pattern, value)
        text = text.when(shorter.try_cast("double") == value, F.upper(shorter))
    return text.otherwise(cast)


def _layout(value: Column, text: Column) -> Column:
    size = F.abs(value)
    power = F.substring_index(text, "E", -1).try_cast("int")
    exponent = F.concat(
        _trim_zeros(F.substring_index(text, "E", 1), keep_one=False),
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""),
        F.abs(power).cast("string"),
    )
    fine = _trim_zeros(text.try_cast("decimal(38,22)").cast("string"))
    coarse = _trim_zeros(text.try_cast("decimal(38,12)").cast("string"))
    return (
        F.when(~text.contains("E"), text)
        .when((size < 1e-4) | (size >= 1e16), exponent)
        .when(size < 1e7, fine)
        .otherwise(coarse)
    )


def _trim_zeros(text: Column, keep_one: bool = True) -> Column:
    """Drops zeros at the end of the fraction; ``keep_one`` leaves ``3.0`` rather than ``3``."""
    cut = F.regexp_replace(text, r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(cut, r"\.$", ".0" if keep_one else "")
