"""Column functions over colours: packed 24-bit rgb integers and channels from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b).cast("int")


def red(rgb: Column) -> Column:
    return F.shiftright(rgb, 16).bitwiseAND(255)


def green(rgb: Column) -> Column:
    return F.shiftright(rgb, 8).bitwiseAND(255)


def blue(rgb: Column) -> Column:
    return rgb.bitwiseAND(255)


def luma(rgb: Column) -> Column:
    """Brightness in thousandths, from 0 to 255000: integers, so that sums don't depend on their order."""
    return (red(rgb) * 299 + green(rgb) * 587 + blue(rgb) * 114).cast("long")


def distance2(a: Column, b: Column) -> Column:
    """Squared distance of two colours, red, green and blue weighed 2, 4 and 3 (our choice)."""
    parts = ((red, 2), (green, 4), (blue, 3))
    return sum((w * (f(a) - f(b)) * (f(a) - f(b)) for f, w in parts), F.lit(0)).cast("long")


def flatten(value: Column, alpha: Column, background: int) -> Column:
    """A channel over an opaque background, rounded half up in integers."""
    return F.floor((value * alpha + background * (255 - alpha) + 127) / 255).cast("int")


def hex_colour(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(rgb), 6, "0")))
