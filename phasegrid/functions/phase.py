"""Phase, complex and numeric column functions. Complex values are two columns, re and im."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
#: Radians to centimetres for a wavelength of 5.5465763 cm, two-way path.
PHASE_TO_CM = 5.5465763 / (4 * math.pi)


def rewrap(phase: Column) -> Column:
    """Into [-π, π)."""
    return F.pmod(phase + math.pi, F.lit(TWO_PI)) - math.pi


def wrap(phase: Column) -> Column:
    """Minus the nearest multiple of 2π, halves to even: +π stays +π."""
    return phase - F.rint(phase / TWO_PI) * TWO_PI


def angle(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def power(re: Column, im: Column) -> Column:
    return re * re + im * im


def times_conjugate(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """a · conj(b) as (re, im)."""
    return a[0] * b[0] + a[1] * b[1], a[1] * b[0] - a[0] * b[1]


def missing_to_zero(x: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def ambiguity(phase: Column) -> Column:
    """How many whole turns the phase is away from its rewrapped value."""
    return F.rint((phase - rewrap(phase)) / TWO_PI)


def decibel(amplitude: Column) -> Column:
    return 20 * F.log10(amplitude)


def add_keeping_zero(x: Column, c: Column) -> Column:
    """x + c, where an exact zero means no data and stays."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x + c)


def r6(x: Column) -> Column:
    """Six decimals and no negative zero: the form in which results are compared."""
    return F.round(x, 6) + F.lit(0.0)
