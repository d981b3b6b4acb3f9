"""Vector functions as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def quantize(v: Column) -> Column:
    """int8 by round(x * 127), halves away from zero, clamped."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") * 127))).cast("tinyint"))


def row_scale(v: Column) -> Column:
    """Greatest magnitude / 127, or a tiny value for a zero row."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(most > 0, most / 127).otherwise(F.lit(1e-8))


def quantize_row(v: Column, scale: Column) -> Column:
    """int8 by floor(x / scale + 1/2): halves go up."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.floor(x.cast("double") / scale + 0.5).cast("double"))).cast("tinyint"))


def quantized_cosine(q: Column, stored: Column) -> Column:
    """Cosine of a unit float query with a stored int8 vector."""
    return dot(q, stored) / 127


def f16_value(bits: Column) -> Column:
    """Value of 16 bits as a half-precision float."""
    sign = F.when(bits.bitwiseAND(F.lit(0x8000)) != 0, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 10).bitwiseAND(F.lit(0x1F))
    fraction = bits.bitwiseAND(F.lit(0x3FF))
    return (
        F.when(exponent == 0, sign * fraction * F.lit(2.0**-24))
        .when((exponent == 31) & (fraction != 0), F.lit(float("nan")))
        .when(exponent == 31, sign * F.lit(float("inf")))
        .otherwise(sign * (1 + fraction / 1024.0) * F.pow(F.lit(2.0), exponent - 15))
    )
