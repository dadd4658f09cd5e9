"""Distances and errors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: WGS-84: equatorial radius in km, flattening (fixed values).
RADIUS, FLATTENING = 6378.137, 1 / 298.257223563


def euclid_error(xp: Column, yp: Column, xt: Column, yt: Column) -> Column:
    return F.sqrt((xp - xt) * (xp - xt) + (yp - yt) * (yp - yt))


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the ellipsoid in km by Andoyer's first-order formula; 0 for equal points."""
    f, g, l = (F.radians((lat1 + lat2) / 2), F.radians((lat1 - lat2) / 2), F.radians((lon1 - lon2) / 2))  # noqa: E741
    sq = lambda c: c * c
    s = sq(F.sin(g)) * sq(F.cos(l)) + sq(F.cos(f)) * sq(F.sin(l))
    c = sq(F.cos(g)) * sq(F.cos(l)) + sq(F.sin(f)) * sq(F.sin(l))
    w = F.atan(F.sqrt(F.try_divide(s, c)))
    r = F.try_divide(F.sqrt(s * c), w)
    h1, h2 = F.try_divide(3 * r - 1, 2 * c), F.try_divide(3 * r + 1, 2 * s)
    d = 2 * w * F.lit(RADIUS) * (1 + F.lit(FLATTENING) * (h1 * sq(F.sin(f)) * sq(F.cos(g)) - h2 * sq(F.cos(f)) * sq(F.sin(g))))
    return F.when((lon1 == lon2) & (lat1 == lat2), F.lit(0.0)).otherwise(d)


def _bound(values: Column, then) -> Column:
    """Give a struct a name within one expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(values), then), 1)


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, steps: int = 30) -> Column:
    """Geodesic distance in km by Vincenty's inverse formula (1975), as one expression of so many steps.

    Near-antipodal pairs, where the iteration does not settle, are null; ``with_geodesic_km`` fills them in.
    """
    a, f = F.lit(RADIUS), FLATTENING
    b = a * (1 - f)
    u = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    base = F.struct(
        F.sin(u(lat1)).alias("s1"), F.cos(u(lat1)).alias("c1"), F.sin(u(lat2)).alias("s2"), F.cos(u(lat2)).alias("c2"), F.radians(lon2 - lon1).alias("l")
    )

    def parts(k: Column, lam: Column) -> Column:
        sl, cl = F.sin(lam), F.cos(lam)
        p = k["c2"] * sl
        q = k["c1"] * k["s2"] - k["s1"] * k["c2"] * cl
        sin_s = F.sqrt(p * p + q * q)
        cos_s = k["s1"] * k["s2"] + k["c1"] * k["c2"] * cl
        return F.struct(sin_s.alias("ss"), cos_s.alias("cs"), F.coalesce(F.try_divide(k["c1"] * k["c2"] * sl, sin_s), F.lit(0.0)).alias("sa"))

    def angles(x: Column) -> Column:
        ca = 1 - x["sa"] * x["sa"]
        return F.struct(x["ss"].alias("ss"), x["cs"].alias("cs"), x["sa"].alias("sa"), ca.alias("ca"), F.atan2(x["ss"], x["cs"]).alias("s"), F.lit(0.0).alias("z"))

    def middle(k: Column, x: Column) -> Column:
        return F.coalesce(x["cs"] - F.try_divide(2 * k["s1"] * k["s2"], x["ca"]), F.lit(0.0))

    def next_lambda(k: Column, lam: Column) -> Column:
        def finish(x: Column) -> Column:
            m = middle(k, x)
            c = f / 16 * x["ca"] * (4 + f * (4 - 3 * x["ca"]))
            return k["l"] + (1 - c) * f * x["sa"] * (x["s"] + c * x["ss"] * (m + c * x["cs"] * (2 * m * m - 1)))

        return _bound(parts(k, lam), lambda x: _bound(angles(x), finish))

    def length(k: Column, lam: Column) -> Column:
        def finish(x: Column) -> Column:
            m = middle(k, x)
            u2 = x["ca"] * (a * a - b * b) / (b * b)
            big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
            big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
            ds = big_b * x["ss"] * (m + big_b / 4 * (x["cs"] * (2 * m * m - 1) - big_b / 6 * m * (4 * x["ss"] * x["ss"] - 3) * (4 * m * m - 3)))
            return b * big_a * (x["s"] - ds)

        return _bound(parts(k, lam), lambda x: _bound(angles(x), finish))

    def solve(k: Column) -> Column:
        start = F.struct(k["l"].alias("now"), (k["l"] + 1).alias("was"))
        end = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), start,
            lambda acc, _: F.when(F.abs(acc["now"] - acc["was"]) < 1e-12, acc).otherwise(F.struct(next_lambda(k, acc["now"]).alias("now"), acc["now"].alias("was"))),
        )
        settled = lambda e: F.when((F.abs(e["now"] - e["was"]) < 1e-11) & (F.abs(e["now"]) <= 3.2), length(k, e["now"]))
        return _bound(end, settled)

    return F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0)).otherwise(_bound(base, solve))


def with_geodesic_km(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, name: str = "km") -> DataFrame:
    """Add the geodesic distance. Null coordinates give null. Rows that the expression leaves open are told apart first, and only they go through a pandas UDF."""
    places = [F.col(c) for c in (lat1, lon1, lat2, lon2)]
    near = df.withColumn(name, geodesic_km(*places))
    left_open = F.col(name).isNull()
    for c in places:
        left_open = left_open & c.isNotNull()
    return near.where(~left_open).unionByName(near.where(left_open).withColumn(name, _antipodal(*places)))


@F.pandas_udf(T.DoubleType())
def _antipodal(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The length of the best meridian-like path: by halving the distance at a midpoint found by search."""
    import numpy as np

    def short(la1, lo1, la2, lo2):
        f = FLATTENING
        u1, u2 = np.arctan((1 - f) * np.tan(np.radians(la1))), np.arctan((1 - f) * np.tan(np.radians(la2)))
        l = np.radians(lo2 - lo1)  # noqa: E741
        lam = l
        for _ in range(200):
            ss = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            s, sa = np.arctan2(ss, cs), np.cos(u1) * np.cos(u2) * np.sin(lam) / np.maximum(ss, 1e-300)
            ca = 1 - sa * sa
            m = np.where(ca > 0, cs - 2 * np.sin(u1) * np.sin(u2) / np.maximum(ca, 1e-300), 0.0)
            c = f / 16 * ca * (4 + f * (4 - 3 * ca))
            lam = l + (1 - c) * f * sa * (s + c * ss * (m + c * cs * (2 * m * m - 1)))
        e = ca * (1 / (1 - f) ** 2 - 1)
        aa = 1 + e / 16384 * (4096 + e * (-768 + e * (320 - 175 * e)))
        bb = e / 1024 * (256 + e * (-128 + e * (74 - 47 * e)))
        ds = bb * ss * (m + bb / 4 * (cs * (2 * m * m - 1) - bb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))
        return RADIUS * (1 - f) * aa * (s - ds)

    for lat1, lon1, lat2, lon2 in parts:
        out = []
        for p in zip(lat1, lon1, lat2, lon2, strict=True):
            if any(x is None or x != x for x in p):
                out.append(None)
                continue
            # a shortest path to a near-antipode crosses every great circle between: least sum over midpoints a quarter turn away
            best, width, centre = np.inf, 180.0, 0.0
            for _ in range(24):
                turn = np.linspace(centre - width, centre + width, 61)
                la, lo = np.radians(p[0]), np.radians(p[1])
                mid_la = np.degrees(np.arcsin(np.clip(np.cos(la) * np.cos(np.radians(turn)), -1, 1)))
                mid_lo = np.degrees(lo + np.arctan2(np.sin(np.radians(turn)), -np.sin(la) * np.cos(np.radians(turn))))
                total = short(p[0], p[1], mid_la, mid_lo) + short(mid_la, mid_lo, p[2], p[3])
                k = int(np.argmin(total))
                best, centre, width = min(best, float(total[k])), turn[k], width / 8
            out.append(best)
        yield pd.Series(out, dtype="float64")


def digitize(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The right-closed bin of x among equal bins from low to high, 0 to bins - 1; all of it in bin 0 if they are equal."""
    k = F.ceil(F.try_divide(x - low, (high - low) / F.lit(bins))).cast("int") - 1
    return F.when(x.isNull(), F.lit(None)).when(high == low, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(k, F.lit(bins - 1)))).cast("int")


def range_penalty(error: Column, valid: Column, weight: float) -> Column:
    """An error with a penalty for places outside the range: weight times the square of 1 - valid."""
    return error + F.lit(float(weight)) * (1 - valid) * (1 - valid)
