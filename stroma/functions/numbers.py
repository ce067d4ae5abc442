"""Numeric expressions: bins, intervals of confidence, distances, robust nulls."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    """NaN as NULL: averages in Spark otherwise pass it on."""
    return F.when(~F.isnan(x), x)


def cut(x: Column, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """Label of the interval (a, b] (``right``) or [a, b) that holds ``x``; NULL outside all. Use infinities for open ends."""
    out = F.lit(None).cast("string")
    for a, b, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        low = F.lit(True) if math.isinf(a) else (x > a if right else x >= a)
        high = F.lit(True) if math.isinf(b) else (x <= b if right else x < b)
        out = F.when(low & high, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def wilson(k: Column, n: Column, z: float = 1.96, least: int = 30) -> tuple[Column, Column]:
    """Bounds of Wilson's interval of the share k / n; NULL below ``least`` cases."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    enough = n >= least
    return F.when(enough, centre - half), F.when(enough, centre + half)


def mean_interval(mean: Column, sd: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    half = z * sd / F.sqrt(n)
    return mean - half, mean + half


def fisher_interval(r: Column, n: Column, z: float = 1.96, least: int = 30) -> tuple[Column, Column]:
    """Bounds of a correlation's interval by Fisher's transform; NULL below ``least`` cases."""
    t, half = F.atanh(r), z / F.sqrt(n - 3)
    return F.when(n >= least, F.tanh(t - half)), F.when(n >= least, F.tanh(t + half))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Great-circle distance in metres between points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def r6(x: Column) -> Column:
    """Six decimals: sums differ in their last bits from one engine to another."""
    return F.round(x, 6)


def harmonics(hours: Column, orders: list[tuple[float, int]]) -> list[Column]:
    """Sines and cosines of the given (period in hours, number of harmonics)."""
    out = []
    for period, many in orders:
        for k in range(1, many + 1):
            angle = hours * (2 * math.pi * k / period)
            out += [F.sin(angle), F.cos(angle)]
    return out


def spline_basis(x: Column, knots: list[float]) -> list[Column]:
    """Restricted cubic splines: x itself and len(knots) - 2 cubic terms, linear beyond the outer knots."""
    t, last, before = knots, knots[-1], knots[-2]
    cube = lambda v: F.pow(F.greatest(v, F.lit(0.0)), 3)
    scale = (last - t[0]) ** 2
    terms = [
        (cube(x - k) - cube(x - before) * ((last - k) / (last - before)) + cube(x - last) * ((before - k) / (last - before))) / scale
        for k in t[:-2]
    ]
    return [x, *terms]
