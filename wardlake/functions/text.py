"""Rows to text: ``name : value`` pairs, segments, and the growing text of an episode.

A row's values are put into an array of cells (name, number, text), and one lambda turns
a cell into its pair, so the expression stays small however many columns there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import float_text

FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


def _cell(df: DataFrame, column: str, name: str, skip_empty: bool) -> Column:
    """(name, number, text); with ``skip_empty`` a missing value or a zero has neither.

    Any text counts, also an empty one, but not the word ``nan``.
    """
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, FRACTIONAL):
        number = value.cast("double")
        if skip_empty:
            number = F.when(number != 0, number)
    elif isinstance(kind, T.StringType):
        text = F.when(value != "nan", value) if skip_empty else value
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "True") if skip_empty else F.when(value, "True").when(~value, "False")
    else:
        text = F.when(value != 0, value.cast("string")) if skip_empty else value.cast("string")
    return F.struct(F.lit(name).alias("name"), number.alias("number"), text.alias("text"))


def _cells(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None, skip_empty: bool) -> Column:
    return F.array(*[_cell(df, c, n, skip_empty) for c, n in zip(columns, names or columns)])


def _joined(cells: Column) -> Column:
    shown = lambda c: F.coalesce(c["text"], float_text(c["number"]), F.lit("nan"))
    return F.array_join(F.transform(cells, lambda c: F.concat(c["name"], F.lit(" : "), shown(c))), " | ")


def record_text(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None) -> Column:
    """The record segment: pairs joined by `` | ``; missing values and zeros are left out."""
    cells = _cells(df, columns, names, skip_empty=True)
    return _joined(F.filter(cells, lambda c: c["number"].isNotNull() | c["text"].isNotNull()))


def full_text(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None) -> Column:
    """A lab segment: every pair, zeros too; a missing value is written ``nan``."""
    return _joined(_cells(df, columns, names, skip_empty=False))


def flat_row_text(df: DataFrame, columns: Sequence[str], end_mark: str) -> Column:
    return F.concat(record_text(df, columns), F.lit(end_mark))


def segments(df: DataFrame, record: Sequence[str], panels: Sequence[Sequence[str]], groups: str) -> Column:
    """Array of segments: the record, then each done panel in the row's own order."""
    panel_cells = F.array(*[_cells(df, panel, None, skip_empty=False) for panel in panels])
    done = F.transform(F.col(groups), lambda g: _joined(F.get(panel_cells, g.cast("int"))))
    return F.concat(F.array(record_text(df, record)), done)


def segmented_row_text(parts: Column, end_mark: str) -> Column:
    return F.concat(F.array_join(parts, end_mark), F.lit(end_mark))


def growing_text(df: DataFrame, parts: str, end_mark: str) -> DataFrame:
    """One row per step: step 0 is the record alone, each further step adds a segment."""
    steps = F.sequence(F.lit(1), F.size(parts))
    upto = F.transform(
        steps,
        lambda k: F.struct(
            (k - 1).alias("step"),
            F.concat(F.array_join(F.slice(F.col(parts), F.lit(1), k), end_mark), F.lit(end_mark)).alias("text"),
        ),
    )
    others = [c for c in df.columns if c != parts]
    return df.select(*others, F.explode(upto).alias("x")).select(*others, "x.*")
