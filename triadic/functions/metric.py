"""The WCC metric as column expressions. Counts are longs, results doubles.

Divisions follow IEEE 754 (0/0 is NaN, x/0 infinite) under ANSI mode, where
Spark's own operator raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def ieee_div(n: Column, d: Column) -> Column:
    """The divisor stands in the expression once, so nested quotients stay small."""
    n = n.cast("double")
    return F.coalesce(F.try_divide(n, d.cast("double")), n * F.lit(INF))


def clustering(t: Column, vt: Column) -> Column:
    """Local clustering coefficient: 2t / (vt (vt - 1)), 0 below two supported neighbours."""
    vt = vt.cast("long")
    return F.when(vt < 2, F.lit(0.0)).otherwise(F.lit(2.0) * t / (vt * (vt - 1)))


def density(r: Column, a: Column) -> Column:
    """2a / r^2, of a community of r vertices with a edges inside."""
    return ieee_div(F.lit(2.0) * a, (r * r))


def with_vertex(r: Column, a: Column, b: Column, d_in: Column, d_out: Column) -> tuple[Column, Column, Column]:
    """(r, a, b) after a vertex joins that has d_in edges into the community and d_out elsewhere."""
    return r + 1, a + d_in, b - d_in + d_out


def without_vertex(r: Column, a: Column, b: Column, d_in: Column, d_out: Column) -> tuple[Column, Column, Column]:
    """(r, a, b) after such a vertex leaves."""
    return r - 1, a - d_in, b + d_in - d_out


def vertex_wcc(t: Column, vt: Column, t_c: Column, vt_c: Column, r: Column) -> Column:
    """WCC of a vertex with t_c triangles and vt_c neighbours in its community of r vertices."""
    return F.when(t == 0, F.lit(0.0)).otherwise(ieee_div((t_c * vt).cast("double"), t * (r - 1 + vt - vt_c).cast("double")))


def insert_gain(r: Column, a: Column, b: Column, d_in: Column, d_out: Column, omega: Column, v: Column) -> Column:
    """Approximate gain in global WCC when a vertex joins a community: three terms, for the
    members it is linked to, those it is not, and itself."""
    r, b, k, o, w = (x.cast("double") for x in (r, b, d_in, d_out, omega))
    d = density(r, a.cast("double"))
    q = ieee_div(b - k, r)
    cube, pairs, open_q = F.pow(d, F.lit(3.0)), (r - 1) * (r - 2), q * (q - 1)
    linked = ieee_div(((r - 1) * d + 1 + q) * (k - 1) * d, (r + q) * pairs * cube + (k - 1) * d + open_q * d * w + open_q * w + o + w)
    others = -ieee_div(pairs * cube * ((r - 1) * d + q), (pairs * cube + open_q * w + q * (r - 1) * d * w) * (r + q) * (r - 1 + q))
    own = ieee_div((k * (k - 1) * d) * (k + o), (k * (k - 1) * d + o * (o - 1) * w + o * k * w + o * k * w) * (r + o))
    return (k * linked + (r - k) * others + own) / v


def remove_gain(r: Column, a: Column, b: Column, d_in: Column, d_out: Column, omega: Column, v: Column) -> Column:
    """Gain when a vertex leaves its community: minus that of joining what is left; 0 if it is alone."""
    return F.when(r == 1, F.lit(0.0)).otherwise(-insert_gain(*without_vertex(r, a, b, d_in, d_out), d_in, d_out, omega, v))


def above(x: Column, y) -> Column:
    """x > y as on IEEE hardware: false for NaN (Spark sorts NaN last)."""
    return ~F.isnan(x) & (x > y)
