"""Colour spaces and distances as column expressions over 8-bit channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The OKLab matrices and the BT.601 chroma rows.
TO_LMS = [(0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)]
TO_LAB = [(0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766)]
TO_CHROMA = [(-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312)]

#: Fixed values of the perceptual distance: weights of RGB, chroma and OKLab; chroma and OKLab spans that count as 100; the
#: least vividness of a hue, the degrees that are free, those that cost all, and that cost; dark, light, and their cost.
WEIGHTS, CHROMA_SPAN, LAB_SPAN = (0.22, 0.46, 0.32), 0.7072, 0.8
VIVID, FREE, TURN, TURN_COST, DARK, LIGHT, DARK_COST = 0.035, 15, 30, 24, 0.22, 0.32, 28.0
#: Fixed values of skin: least red, green and blue; red over green, green over blue; least red less blue, most red less green.
SKIN_LEAST, SKIN_RATIOS, SKIN_APART = (45, 22, 12), (1.12, 1.06), (18, 135)

#: The inverses of both.
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def _dot(row: tuple[float, ...], xs: list[Column]) -> Column:
    return xs[0] * row[0] + xs[1] * row[1] + xs[2] * row[2]


def srgb_to_linear(channel: Column) -> Column:
    c = channel / 255
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(linear: Column) -> Column:
    v = clamp(linear, 0, 1)
    return F.floor(F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055) * 255 + 0.5).cast("int")


def oklab(r: Column, g: Column, b: Column) -> Column:
    """Struct (l, a, b)."""
    linear = [srgb_to_linear(c) for c in (r, g, b)]
    roots = [F.cbrt(_dot(row, linear)) for row in TO_LMS]
    return F.struct(*[_dot(row, roots).alias(n) for row, n in zip(TO_LAB, "lab", strict=True)])


def from_oklab(l: Column, a: Column, b: Column) -> Column:
    """Struct (r, g, b) of whole channels, clamped."""
    cubes = [F.pow(_dot(row, [l, a, b]), F.lit(3.0)) for row in FROM_LAB]
    return F.struct(*[linear_to_srgb(_dot(row, cubes)).alias(n) for row, n in zip(FROM_LMS, "rgb", strict=True)])


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Struct (h in degrees, s, v)."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    sector = F.when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    h = F.when(d == 0, 0.0).otherwise(F.when(sector < 0, sector + 360).otherwise(sector))
    return F.struct(h.alias("h"), F.when(top == 0, 0.0).otherwise(d / top).alias("s"), (top / 255).alias("v"))


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def redmean_distance(a: list[Column], b: list[Column]) -> Column:
    """Weighted RGB distance, 0 to 100."""
    mean = (a[0] + b[0]) / 2
    d = [x - y for x, y in zip(a, b, strict=True)]
    return clamp(F.sqrt((2 + mean / 256) * d[0] * d[0] + 4 * d[1] * d[1] + (2 + (255 - mean) / 256) * d[2] * d[2]) / 764.834 * 100, 0, 100)


def perceptual_distance(a: list[Column], b: list[Column]) -> Column:
    """0 to 100: RGB, chroma and OKLab differences at 0.22, 0.46 and 0.32, and penalties for another hue and for dark on light."""
    la, lb = oklab(*a), oklab(*b)
    chroma = [_dot(row, [(x - y) / 255 for x, y in zip(a, b, strict=True)]) for row in TO_CHROMA]
    lab = F.sqrt(sum(((la[n] - lb[n]) * (la[n] - lb[n]) for n in "lab"), F.lit(0.0)))
    mix = redmean_distance(a, b) * WEIGHTS[0] + clamp(F.hypot(*chroma) / CHROMA_SPAN * 100, 0, 100) * WEIGHTS[1] + clamp(lab / LAB_SPAN * 100, 0, 100) * WEIGHTS[2]
    hue = lambda x: F.degrees(F.atan2(x["b"], x["a"]))
    vivid = (F.hypot(la["a"], la["b"]) > VIVID) & (F.hypot(lb["a"], lb["b"]) > VIVID)
    apart = hue_distance(hue(la), hue(lb))
    mix = mix + F.when(vivid & (apart > FREE), clamp((apart - FREE) / TURN * TURN_COST, 0, TURN_COST)).otherwise(0.0)
    return clamp(mix + F.when((la["l"] < DARK) & (lb["l"] > LIGHT), DARK_COST).otherwise(0.0), 0, 100)


def hex_to_rgb(text: Column) -> Column:
    """Array of channels of #rgb or #rrggbb; null for anything else."""
    t = F.regexp_extract(text, "^#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})$", 1)
    full = F.when(F.length(t) == 3, F.regexp_replace(t, "(.)", "$1$1")).otherwise(t)
    return F.when(t != "", F.array(*[F.conv(F.substring(full, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b)])


def skin(r: Column, g: Column, b: Column) -> Column:
    """Whether a colour looks like exposed skin."""
    bright = (r > SKIN_LEAST[0]) & (g > SKIN_LEAST[1]) & (b > SKIN_LEAST[2])
    return bright & (r > g * SKIN_RATIOS[0]) & (g > b * SKIN_RATIOS[1]) & (r - b > SKIN_APART[0]) & (r - g < SKIN_APART[1])
