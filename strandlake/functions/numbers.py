"""Numbers as the reports need them: 32-bit floats, hundredths, their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def hundredths(weight: Column) -> Column:
    """Truncated 32-bit weight times 100: a third counts 33."""
    return (f32(weight) * f32(100)).cast("int")


def depth(w100: Column) -> Column:
    """Hundredths as a 32-bit depth."""
    return (w100.cast("float") / f32(100)).cast("float")


def number_text(x: Column) -> Column:
    """Without a point where it is whole, else the shortest text of the 32-bit float."""
    x = f32(x)
    return F.when(x == x.cast("long").cast("float"), x.cast("long").cast("string")).otherwise(x.cast("string"))


def fraction(part: Column, whole: Column) -> Column:
    """32-bit quotient; null where the whole is nothing."""
    return F.when(whole != 0, f32(part / whole))


def text_or_dot(x: Column) -> Column:
    return F.when((x == "") | x.isNull(), F.lit(".")).otherwise(x)
