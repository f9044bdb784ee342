"""Colour parsing, contrast and difference as column expressions; all stay in the JVM.

A colour is struct<r: int, g: int, b: int>, null where it can't be resolved. Nothing coalesces an unresolved colour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below it a channel is linear. Two conventions are in use: the standard's and an older one.
LINEAR, LINEAR_OLD = 0.04045, 0.03928


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def hex_rgb(text: Column) -> Column:
    """#rrggbb or #rgb, else null."""
    own = F.lower(F.trim(text))
    long = F.when(own.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(own, "([0-9a-f])", "$1$1")).when(own.rlike("^#[0-9a-f]{6}$"), own)
    part = lambda k: F.conv(F.substring(long, k, 2), 16, 10)
    return F.when(long.isNotNull(), rgb(part(2), part(4), part(6)))


def function_rgb(text: Column) -> Column:
    """rgb(r, g, b) or rgba(r, g, b, a); the alpha doesn't count."""
    form = r"^\s*rgba?\(\s*(\d+)[\s,]+(\d+)[\s,]+(\d+)"
    part = lambda k: F.regexp_extract(text, form, k).cast("int")
    return F.when(text.rlike(form), rgb(part(1), part(2), part(3)))


def oklch_rgb(text: Column) -> Column:
    """oklch(L C H): L as a share or per cent, H in degrees; clamped to sRGB."""
    form = r"^\s*oklch\(\s*([0-9.]+)(%?)\s+([0-9.]+)\s+([0-9.]+)"
    number = lambda k: F.regexp_extract(text, form, k).try_cast("double")
    light = number(1) / F.when(F.regexp_extract(text, form, 2) == "%", 100.0).otherwise(1.0)
    # Each step is bound once, so that the expression doesn't multiply.
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    polar = F.struct(light.alias("l"), number(3).alias("c"), F.radians(number(4)).alias("h"))

    def cones(p: Column) -> Column:
        a, b = p["c"] * F.cos(p["h"]), p["c"] * F.sin(p["h"])
        cube = lambda x, y: F.pow(p["l"] + x * a + y * b, 3)
        return F.struct(cube(0.3963377774, 0.2158037573).alias("l"), cube(-0.1055613458, -0.0638541728).alias("m"), cube(-0.0894841775, -1.2914855480).alias("s"))

    def shown(v: Column) -> Column:
        return F.bround(255 * F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, 1 / 2.4) - 0.055))

    def channels(q: Column) -> Column:
        linear = lambda x, y, z: bound(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x * q["l"] + y * q["m"] + z * q["s"])), shown)
        return rgb(linear(4.0767416621, -3.3077115913, 0.2309699292), linear(-1.2684380046, 2.6097574011, -0.3413193965), linear(-0.0041960863, -0.7034186147, 1.7076147010))

    return F.when(text.rlike(form), bound(bound(polar, cones), channels))


def parse(text: Column) -> Column:
    """Any of the notations, else null."""
    return F.coalesce(hex_rgb(text), function_rgb(text), oklch_rgb(text))


def to_hex(colour: Column) -> Column:
    part = lambda k: F.lower(F.lpad(F.hex(colour[k].cast("bigint")), 2, "0"))
    return F.when(colour.isNotNull(), F.concat(F.lit("#"), part("r"), part("g"), part("b")))


def luminance(colour: Column, linear: float = LINEAR) -> Column:
    """Relative luminance, 0 to 1."""

    def channel(k: str) -> Column:
        v = colour[k] / 255.0
        return F.when(v <= linear, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return 0.2126 * channel("r") + 0.7152 * channel("g") + 0.0722 * channel("b")


def contrast(one: Column, other: Column, *, linear: float = LINEAR, digits: int | None = None) -> Column:
    """Contrast ratio, 1 to 21; rounded half to even before any comparison if digits are given."""
    a, b = luminance(one, linear), luminance(other, linear)
    # greatest and least pass over nulls, which must not make an unknown colour equal to the known one.
    ratio = F.when(a.isNotNull() & b.isNotNull(), (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05))
    return ratio if digits is None else F.bround(ratio, digits)


def over(top: Column, alpha: Column, under: Column) -> Column:
    """A translucent colour upon another, each channel rounded half to even."""
    mix = lambda k: F.bround(top[k] * alpha + under[k] * (1 - alpha))
    return F.when(top.isNotNull() & under.isNotNull() & alpha.isNotNull(), rgb(mix("r"), mix("g"), mix("b")))


def heat(colour: Column) -> Column:
    """A quarter of the luma, rounded half up: the grey of an unchanged pixel."""
    return F.floor(0.25 * (0.2126 * colour["r"] + 0.7152 * colour["g"] + 0.0722 * colour["b"]) + 0.5).cast("int")


def lab(colour: Column) -> Column:
    """CIE L*a*b* (D65) of an sRGB colour."""

    def linear(k: str) -> Column:
        v = colour[k] / 255.0
        return F.when(v <= LINEAR, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    r, g, b = linear("r"), linear("g"), linear("b")

    def f(t: Column) -> Column:
        return F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)

    x = f((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047)
    y = f(0.2126729 * r + 0.7151522 * g + 0.0721750 * b)
    z = f((0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883)
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def delta_e(one: Column, other: Column) -> Column:
    """CIEDE2000 between two L*a*b* colours."""
    c1, c2 = F.hypot(one["a"], one["b"]), F.hypot(other["a"], other["b"])
    c7 = F.pow((c1 + c2) / 2, 7)
    g = 0.5 * (1 - F.sqrt(c7 / (c7 + 25.0**7)))
    a1, a2 = (1 + g) * one["a"], (1 + g) * other["a"]
    d1, d2 = F.hypot(a1, one["b"]), F.hypot(a2, other["b"])

    def hue(a: Column, b: Column) -> Column:
        h = F.degrees(F.atan2(b, a))
        return F.when((a == 0) & (b == 0), 0.0).when(h < 0, h + 360).otherwise(h)

    h1, h2 = hue(a1, one["b"]), hue(a2, other["b"])
    flat = (d1 * d2) == 0
    dh = F.when(flat, 0.0).when(F.abs(h2 - h1) <= 180, h2 - h1).when(h2 > h1, h2 - h1 - 360).otherwise(h2 - h1 + 360)
    mean = F.when(flat, h1 + h2).when(F.abs(h1 - h2) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2)
    dl, dc = other["l"] - one["l"], d2 - d1
    dbig = 2 * F.sqrt(d1 * d2) * F.sin(F.radians(dh / 2))
    lm, cm = (one["l"] + other["l"]) / 2, (d1 + d2) / 2
    t = 1 - 0.17 * F.cos(F.radians(mean - 30)) + 0.24 * F.cos(F.radians(2 * mean)) + 0.32 * F.cos(F.radians(3 * mean + 6)) - 0.20 * F.cos(F.radians(4 * mean - 63))
    m7 = F.pow(cm, 7)
    rt = -F.sin(F.radians(60 * F.exp(-F.pow((mean - 275) / 25, 2)))) * 2 * F.sqrt(m7 / (m7 + 25.0**7))
    sl = 1 + 0.015 * F.pow(lm - 50, 2) / F.sqrt(20 + F.pow(lm - 50, 2))
    sc, sh = 1 + 0.045 * cm, 1 + 0.015 * cm * t
    return F.sqrt(F.pow(dl / sl, 2) + F.pow(dc / sc, 2) + F.pow(dbig / sh, 2) + rt * (dc / sc) * (dbig / sh))
