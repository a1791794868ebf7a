"""Spectral indices, angles, stretches and small arithmetic on bands.

Reflectance is double in 0..1 and every division is guarded, as ANSI mode raises on x / 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("green", "red", "nir", "swir16")
#: Index name -> the two bands of its normalised difference.
PAIRS = {"ndvi": ("nir", "red"), "ndbi": ("swir16", "nir"), "mndwi": ("green", "swir16"), "ndsi": ("green", "swir16"), "ndwi": ("green", "nir"), "ndmi": ("nir", "swir16")}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def nd(a, b) -> Column:
    """(a - b) / (a + b), clipped to -1..1; 0 where the sum is within 1e-6 of zero."""
    a, b = _c(a), _c(b)
    return F.when(F.abs(a + b) > 1e-6, clip((a - b) / (a + b), -1.0, 1.0)).otherwise(0.0)


def nd_floor(a, b, floor: float = 0.01) -> Column:
    """Difference over the sum, which counts as ``floor`` at least, clipped."""
    a, b = _c(a), _c(b)
    return clip((a - b) / F.greatest(a + b, F.lit(floor)), -1.0, 1.0)


def nd_epsilon(a, b, eps: float = 1e-6) -> Column:
    """Difference over the sum and ``eps``; null where that is zero."""
    a, b = _c(a), _c(b)
    return F.try_divide(a - b, a + b + F.lit(eps))


def nd_raw(a, b) -> Column:
    """Plain ratio; null (for not-a-number) where the sum is zero."""
    a, b = _c(a), _c(b)
    return F.try_divide(a - b, a + b)


def nd_finite(a, b) -> Column:
    """Plain ratio; 0 for missing or non-finite bands and sums of at most 1e-6."""
    a, b = _c(a), _c(b)
    ok = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) != float("inf")) & (F.abs(b) != float("inf"))
    return F.when(ok & (F.abs(a + b) > 1e-6), (a - b) / (a + b)).otherwise(0.0)


def index(name: str, prefix: str = "", suffix: str = "", macro=nd) -> Column:
    a, b = PAIRS[name]
    return macro(f"{prefix}{a}{suffix}", f"{prefix}{b}{suffix}")


def brightness(*bands) -> Column:
    total = _c(bands[0])
    for b in bands[1:]:
        total = total + _c(b)
    return total / float(len(bands))


def spectral_angle(before, after) -> Column:
    """Angle between two band vectors in radians."""
    dot = sum_of(*[_c(a) * _c(b) for a, b in zip(before, after)])
    norm = lambda v: F.sqrt(sum_of(*[_c(x) * _c(x) for x in v]))
    return F.acos(clip(dot / (norm(before) * norm(after) + 1e-9), -1.0, 1.0))


def magnitude(before, after) -> Column:
    """Euclidean length of the band difference."""
    return F.sqrt(sum_of(*[(_c(a) - _c(b)) * (_c(a) - _c(b)) for b, a in zip(before, after)]))


def mean_abs_difference(before, after) -> Column:
    return sum_of(*[F.abs(_c(a) - _c(b)) for b, a in zip(before, after)]) / float(len(before))


def sum_of(*terms) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def stretch(x, low, high) -> Column:
    """0..1 between two bounds; 0 everywhere if they do not rise."""
    x, low, high = _c(x), _c(low), _c(high)
    return F.when(high > low, clip((x - low) / F.when(high > low, high - low).otherwise(1.0), 0.0, 1.0)).otherwise(0.0)


def rgb_proxy(before, after) -> Column:
    """Score 0..1 of 8-bit colours (r, g, b): half the change of brightness, half that of green against red."""
    bright = lambda c: (_c(c[0]) + _c(c[1]) + _c(c[2])) / 3.0
    green = lambda c: clip((_c(c[1]) / 255.0 - _c(c[0]) / 255.0) / F.greatest(_c(c[1]) / 255.0 + _c(c[0]) / 255.0, F.lit(0.02)), -1.0, 1.0)
    return clip(0.5 * F.abs(bright(before) - bright(after)) / 255.0 + 0.5 * F.abs(green(before) - green(after)), 0.0, 1.0)


def gray(r, g, b) -> Column:
    """Perceptual grey."""
    return 0.299 * _c(r) + 0.587 * _c(g) + 0.114 * _c(b)


def calibrate(dn, p99, scale=None, offset=None) -> Column:
    """Digital numbers to reflectance: tags win; else numbers beyond 2 are ten-thousandths; clipped to 0..1."""
    dn = _c(dn).cast("double")
    if scale is not None:
        return clip(dn * scale + (offset or 0.0), 0.0, 1.0)
    return clip(F.when(_c(p99) > 2.0, dn / 10000.0).otherwise(dn), 0.0, 1.0)


def baseline_offset(date) -> Column:
    """Additive offset of products processed since the 2022 baseline; dates are YYYYMMDD text."""
    return F.when(_c(date) >= "20220125", F.lit(-0.1)).otherwise(F.lit(0.0))


def position_word(cx, cy) -> Column:
    """Compass word of a relative position; the middle is center."""
    cx, cy = _c(cx), _c(cy)
    v = F.when(cy < 0.33, "N").when(cy > 0.66, "S").otherwise("")
    h = F.when(cx < 0.33, "W").when(cx > 0.66, "E").otherwise("")
    word = F.concat(v, h)
    return F.when(word == "", "center").otherwise(word)


def area_ha(pixels, pixel_m2: float = 100.0) -> Column:
    return F.round(_c(pixels) * pixel_m2 / 10000.0, 3)


def utm_epsg(lat, lon, cap: bool = True) -> Column:
    """EPSG code of the UTM zone; the capped form keeps 180 degrees east in zone 60."""
    zone = F.floor((_c(lon) + 180.0) / 6.0).cast("int") + 1
    if cap:
        zone = F.least(zone, F.lit(60))
    return F.when(_c(lat) >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone


def affine(col, row, t: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Pixel to world with (a, b, c, d, e, f)."""
    a, b, c, d, e, f = t
    return a * _c(col) + b * _c(row) + c, d * _c(col) + e * _c(row) + f


def inverse_affine(t: tuple[float, ...]) -> tuple[float, ...]:
    a, b, c, d, e, f = t
    det = a * e - b * d
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def ground_distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Plane distance with 111 320 m a degree."""
    dy = (_c(lat2) - _c(lat1)) * 111320.0
    dx = (_c(lon2) - _c(lon1)) * 111320.0 * F.cos(F.radians(_c(lat1)))
    return F.sqrt(dx * dx + dy * dy)


def weighted_mean(signals: dict[str, float], available: set[str] | None = None) -> Column:
    """Weights over signal columns; missing columns and nulls drop out of both sums."""
    names = [s for s in signals if available is None or s in available]
    top = sum_of(*[F.coalesce(F.col(s) * signals[s], F.lit(0.0)) for s in names])
    weight = sum_of(*[F.when(F.col(s).isNotNull(), F.lit(signals[s])).otherwise(0.0) for s in names])
    return F.when(weight > 0, top / F.when(weight > 0, weight).otherwise(1.0)).otherwise(0.0)


def cosine_distance(a, b) -> Column:
    """1 - a . b of unit vectors, clipped to 0..2."""
    dot = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return clip(1.0 - dot, 0.0, 2.0)


def crop_box(x, y, w, h, width: int, height: int, pad: float = 0.8, least: int = 24) -> tuple[Column, ...]:
    """Box widened by a share of its longer side, at least ``least`` pixels, cut to the image: x0, y0, x1, y1."""
    side = F.greatest((F.greatest(_c(w), _c(h)) * (1 + 2 * pad)).cast("int"), F.lit(least))
    cx, cy = _c(x) + F.floor(_c(w) / 2.0), _c(y) + F.floor(_c(h) / 2.0)
    x0 = F.greatest(F.lit(0), (cx - F.floor(side / 2.0)).cast("int"))
    y0 = F.greatest(F.lit(0), (cy - F.floor(side / 2.0)).cast("int"))
    return x0, y0, F.least(F.lit(width), x0 + side), F.least(F.lit(height), y0 + side)


def zscore(rows, column: str):
    """Rows with a column less its mean, over its deviation."""
    mean, sd = rows.agg(F.avg(column), F.stddev_pop(column)).first()
    return rows.withColumn(column, (F.col(column) - (mean or 0.0)) / max(sd or 0.0, 1e-9))


def utm_inverse(easting: Column, northing: Column, zone: int) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees of a northern UTM point, to centimetres even in the zone beside it.

    The usual series: footpoint latitude from the meridian arc, then powers of the distance
    from the central meridian.
    """
    # fixed values: WGS 84 axis and squared eccentricity, scale on the central meridian
    a, e2, k0 = 6378137.0, 0.00669437999014, 0.9996
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    ep = e2 / (1 - e2)
    mu = northing / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    series = ((2, 3 * e1 / 2 - 27 * e1**3 / 32), (4, 21 * e1**2 / 16 - 55 * e1**4 / 32), (6, 151 * e1**3 / 96), (8, 1097 * e1**4 / 512))
    foot = sum_of(mu, *[F.sin(mu * k) * v for k, v in series])
    t, c = F.tan(foot) * F.tan(foot), F.cos(foot) * F.cos(foot) * ep
    bend = 1 - F.sin(foot) * F.sin(foot) * e2
    n, r = a / F.sqrt(bend), a * (1 - e2) / F.pow(bend, F.lit(1.5))
    d = (easting - 500000.0) / (n * k0)
    power = lambda k: F.pow(d, F.lit(k))
    lat = foot - n * F.tan(foot) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * power(4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * power(6) / 720)
    lon = (d - (1 + 2 * t + c) * power(3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * power(5) / 120) / F.cos(foot)
    return F.degrees(lat), zone * 6 - 183.0 + F.degrees(lon)


def utm_forward(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """(easting, northing) of a northern point in degrees, also from the zone beside its own; the usual series."""
    # fixed values: as for the inverse
    a, e2, k0 = 6378137.0, 0.00669437999014, 0.9996
    ep = e2 / (1 - e2)
    f = F.radians(lat)
    t, c = F.tan(f) * F.tan(f), F.cos(f) * F.cos(f) * ep
    n = a / F.sqrt(1 - F.sin(f) * F.sin(f) * e2)
    d = F.radians(lon - (zone * 6 - 183.0)) * F.cos(f)
    arc = f * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) - F.sin(f * 2) * (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)
    arc = a * (arc + F.sin(f * 4) * (15 * e2**2 / 256 + 45 * e2**3 / 1024) - F.sin(f * 6) * (35 * e2**3 / 3072))
    power = lambda k: F.pow(d, F.lit(k))
    x = d + (1 - t + c) * power(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * power(5) / 120
    y = d * d / 2 + (5 - t + 9 * c + 4 * c * c) * power(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * power(6) / 720
    return 500000.0 + k0 * n * x, k0 * (arc + n * F.tan(f) * y)
