"""Vector, colour and time functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; 0 for different lengths, empty or zero vectors."""
    na, nb = dot(a, a), dot(b, b)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(na * nb)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0), value).otherwise(0.0)


def safe_vector(v: Column, dims: int, most: float = 1e12) -> Column:
    """Whether a vector has the dimension, finite components and a bounded norm."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (F.size(v) == dims) & finite & (dot(v, v) <= most)


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v)


def shares(v: Column) -> Column:
    """Non-negative components divided by their sum."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(v, lambda x: x / total)).otherwise(v)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def recency(now: Column, then: Column, half_days: float = 30.0) -> Column:
    """``1 / (1 + age in days / 30)``; the future counts as now."""
    days = F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis(then)) / 86_400_000
    return 1 / (1 + days / half_days)


def rgb(hex_color: Column) -> Column:
    """Red, green and blue of ``#RRGGBB``."""
    part = lambda at: F.conv(F.substring(hex_color, at, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lpad(F.lower(F.hex(F.round(clamp(c, 0, 255)).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def to_linear(channel: Column) -> Column:
    """sRGB channel (0-255) to linear light (0-1)."""
    s = channel / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, 2.4))


def from_linear(light: Column) -> Column:
    s = F.when(light <= 0.0031308, light * 12.92).otherwise(1.055 * F.pow(light, 1 / 2.4) - 0.055)
    return F.round(clamp(s, 0, 1) * 255)


def hsl_to_rgb(h: Column, s: Column, light: Column) -> Column:
    """Red, green and blue (0-255) of a hue in degrees and saturation and lightness in [0, 1]."""
    k = lambda n: (F.lit(float(n)) + h / 30.0) % 12
    a = s * F.least(light, 1 - light)
    f = lambda n: F.round(255 * (light - a * F.greatest(F.lit(-1.0), F.least(k(n) - 3, 9 - k(n), F.lit(1.0)))))
    return F.struct(f(0).alias("r"), f(8).alias("g"), f(4).alias("b"))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    x, y, z = r / 255.0, g / 255.0, b / 255.0
    high, low = F.greatest(x, y, z), F.least(x, y, z)
    d, light = high - low, (high + low) / 2
    s = F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1)))
    h = F.when(d == 0, 0.0).when(high == x, ((y - z) / d) % 6).when(high == y, (z - x) / d + 2).otherwise((x - y) / d + 4)
    return F.struct(((h * 60 + 360) % 360).alias("h"), s.alias("s"), light.alias("l"))


def golden_hue(index: Column, start: float = 0.0) -> Column:
    """The hue of the n-th colour of a palette by golden angles."""
    return (start + index * 137.50776405003785) % 360
