"""Column expressions on coordinates: projection, tiles, distances, angles, polygons, quadtiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_M = 6372797.560856
#: Bits of a quantised coordinate.
BITS = 30


@F.pandas_udf(T.DoubleType())
def atan2(y: pd.Series, x: pd.Series) -> pd.Series:
    """The angle by the C library, as SQL engines take it. The JVM's differs in the last place for some, and then edges that are
    straight on would turn left."""
    return pd.Series(np.fromiter(map(math.atan2, y.tolist(), x.tolist()), float, len(x)))


def mercator_x(lon: Column) -> Column:
    return (lon + 180.0) / 360.0


def mercator_y(lat: Column) -> Column:
    """Mercator ordinate in [0, 1], growing southwards."""
    phi = lat * (math.pi / 180.0)
    return (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0


def longitude(x: Column) -> Column:
    return x * 360.0 - 180.0


def latitude(y: Column) -> Column:
    n = math.pi - 2.0 * math.pi * y
    return 180.0 / math.pi * F.atan(0.5 * (F.exp(n) - F.exp(-n)))


def quantise(v: Column) -> Column:
    return F.floor(v * float(1 << BITS)).cast("long")


def tile(v: Column, zoom: int) -> Column:
    """Tile index of a quantised coordinate; zoom 0 has one tile."""
    return F.shiftright(v, BITS - zoom)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = math.pi / 180.0
    a = F.pow(F.sin((lat2 - lat1) * rad / 2), 2) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(F.sin((lon2 - lon1) * rad / 2), 2)
    return 2.0 * EARTH_M * F.asin(F.sqrt(a))


def bearing(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx)


def turn_class(degrees: Column) -> Column:
    """Class of a turn by the angle of the old direction less that of the new one, y growing southwards: 0 straight on, up to
    10 degrees; 1, 2, 3 rightwards or -1, -2, -3 leftwards, slight up to 30 degrees and sharp from 135 on."""
    whole = (degrees + 720.0).cast("int") % 360
    right = F.when(whole > 350, 0).when(whole > 330, 1).when(whole > 225, 2).otherwise(3)
    left = F.when(whole > 135, -3).when(whole > 30, -2).when(whole > 10, -1).otherwise(0)
    return F.when(whole > 180, right).otherwise(left).cast("int")


def sub_tile(v: Column, zoom: int, precision: int) -> Column:
    """Place within its tile of a quantised coordinate, in `precision` bits."""
    return F.shiftright(v.bitwiseAND((1 << (BITS - zoom)) - 1), BITS - zoom - precision)


def box_distance2(x: Column, y: Column, low_x: Column, low_y: Column, high_x: Column, high_y: Column) -> Column:
    """Squared distance of a point to a box; 0 within it."""
    out = lambda v, low, high: F.greatest(low - v, F.lit(0), v - high)
    return out(x, low_x, high_x) * out(x, low_x, high_x) + out(y, low_y, high_y) * out(y, low_y, high_y)


def units_per_metre(lat: Column) -> Column:
    """Quantised units of a metre eastwards at a latitude."""
    return float(1 << BITS) / 360.0 / haversine_m(lat, F.lit(0.0), lat, F.lit(1.0))


def _vincenty(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int) -> np.ndarray:
    """vincenty_m of arrays, NaN for null. A pair that has settled takes no part in further iterations."""
    a, b, f = 6378137.0, 6356752.314245, 1 / 298.257223563
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(lat))) for lat in (lat1, lat2))
    known = np.stack([np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), np.radians(lon2 - lon1)])

    def parts(k: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, ...]:
        s1, c1, s2, c2, _ = k
        sin_s = np.sqrt((c2 * np.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * np.cos(lam)) ** 2)
        cos_s = s1 * s2 + c1 * c2 * np.cos(lam)
        sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * np.sin(lam) / sin_s)
        cos2_a = 1 - sin_a * sin_a
        return sin_s, cos_s, sin_a, cos2_a, np.where(cos2_a < 1e-15, 0.0, cos_s - 2 * s1 * s2 / cos2_a)

    lam, off, left = known[4].copy(), np.ones(len(lat1)), np.flatnonzero(~np.isnan(known).any(axis=0))
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            if not len(left):
                break
            k = known[:, left]
            sin_s, cos_s, sin_a, cos2_a, cos_m = parts(k, lam[left])
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = k[4] + (1 - c) * f * sin_a * (np.arctan2(sin_s, cos_s) + c * sin_s * (cos_m + c * cos_s * (-1 + 2 * cos_m * cos_m)))
            off[left] = np.abs(new - lam[left])
            lam[left] = new
            left = left[~(off[left] <= 1e-12)]
        sin_s, cos_s, _, cos2_a, cos_m = parts(known, lam)
    v2 = cos2_a * (a * a - b * b) / (b * b)
    big_a = 1 + v2 / 16384 * (4096 + v2 * (-768 + v2 * (320 - 175 * v2)))
    big_b = v2 / 1024 * (256 + v2 * (-128 + v2 * (74 - 47 * v2)))
    inner = cos_s * (-1 + 2 * cos_m * cos_m) - big_b / 6 * cos_m * (-3 + 4 * sin_s * sin_s) * (-3 + 4 * cos_m * cos_m)
    bent = big_b * sin_s * (cos_m + big_b / 4 * inner)
    return np.where(off <= 1e-9, b * big_a * (np.arctan2(sin_s, cos_s) - bent), np.nan)


def vincenty_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 50) -> Column:
    """Distance on the WGS84 ellipsoid by Vincenty's inverse formula, of up to `rounds` iterations; they end within 1e-12.
    Null where they don't settle (nearly opposite points). In NumPy, since an aggregate over rounds takes them all for
    every row."""

    @F.pandas_udf("double")
    def metres(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(_vincenty(*(v.to_numpy(dtype=float) for v in (a, b, c, d)), rounds))

    return metres(*(v.cast("double") for v in (lat1, lon1, lat2, lon2)))


def segment_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on segment a-b its point nearest to p lies, from 0 to 1."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / F.when(length2 == 0, F.lit(None)).otherwise(length2)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_fraction(px, py, ax, ay, bx, by)
    dx, dy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return dx * dx + dy * dy


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a ring, an array of structs (x, y) whose last point joins its first."""
    n = F.size(ring)

    def crosses(acc: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["y"] > y) != (b["y"] > y)
        left = x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(None)).otherwise(b["y"] - a["y"]) + a["x"]
        return F.when(spans & left, ~acc).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crosses)


# The masks that leave 16, 8, 4, 2 and 1 bits together, each group followed by as many zero bits.
_GROUPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def spread_bits(v: Column) -> Column:
    """The low 31 bits of v, each followed by a zero bit."""
    v = v.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    for shift, mask in _GROUPS:
        v = F.shiftleft(v, shift).bitwiseOR(v).bitwiseAND(F.lit(mask).cast("long"))
    return v


def quadtile(x: Column, y: Column) -> Column:
    """Interleaved bits of two coordinates of up to 31 bits, those of x first."""
    return F.shiftleft(spread_bits(x.cast("long")), 1).bitwiseOR(spread_bits(y.cast("long")))


def gathered_bits(v: Column) -> Column:
    """Every second bit of a quadtile, from the lowest on: the inverse of spread_bits."""
    v = v.bitwiseAND(F.lit(0x5555555555555555).cast("long"))
    for (shift, _), mask in zip(reversed(_GROUPS), [m for _, m in reversed(_GROUPS[:-1])] + [0xFFFFFFFF]):
        v = F.shiftright(v, shift).bitwiseOR(v).bitwiseAND(F.lit(mask).cast("long"))
    return v


def quadtile_xy(q: Column) -> tuple[Column, Column]:
    """The two coordinates of a quadtile."""
    return gathered_bits(F.shiftright(q, 1)), gathered_bits(q)


def distance_text(metres: Column) -> Column:
    """Metres up to 100, tens of metres up to 1 km, tenths of km up to 10 km, then whole km."""
    whole = metres.cast("long")
    km10 = (metres / 100.0).cast("long")
    return (
        F.when(whole < 100, F.concat(whole.cast("string"), F.lit("m")))
        .when(whole < 1000, F.concat((whole - whole % 10).cast("string"), F.lit("m")))
        .when(whole < 10000, F.concat(F.floor(km10 / 10).cast("string"), F.lit("."), (km10 % 10).cast("string"), F.lit("km")))
        .otherwise(F.concat((metres / 1000.0).cast("long").cast("string"), F.lit("km")))
    )


def max_speed_kmh(text: Column) -> Column:
    """Number of a speed limit in km/h; 'mph' values are converted; null where there is no number."""
    number = F.regexp_extract(F.lower(F.trim(text)), r"^([0-9]+(?:\.[0-9]+)?)\s*(mph|km/h|kmh|kph)?$", 1)
    unit = F.regexp_extract(F.lower(F.trim(text)), r"^([0-9]+(?:\.[0-9]+)?)\s*(mph|km/h|kmh|kph)?$", 2)
    return F.nullif(number, F.lit("")).try_cast("double") * F.when(unit == "mph", 1.609344).otherwise(1.0)


def title_case(text: Column) -> Column:
    """First letters after spaces and hyphens in upper case, the others in lower case."""
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    spaced = F.array_join(F.transform(F.split(F.lower(text), " "), word), " ")
    return F.array_join(F.transform(F.split(spaced, "-"), word), "-")
