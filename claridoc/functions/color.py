"""Colour column functions: hex parsing, relative luminance and contrast ratio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claridoc.functions.text import let


def hex_to_rgb(c: Column) -> Column:
    """STRUCT<r,g,b> of a three- or six-digit hex colour, NULL when it is not one."""
    bare = F.when(F.startswith(c, F.lit("#")), F.substr(c, F.lit(2))).otherwise(c)

    def long_form(s: Column) -> Column:
        twice = [F.repeat(F.substring(s, i, 1), 2) for i in (1, 2, 3)]
        return F.when(F.length(s) == 3, F.concat(*twice)).otherwise(s)

    def number(s: Column) -> Column:
        return F.when(s.rlike("^[0-9a-fA-F]{6}$"), F.conv(s, 16, 10).cast("int"))

    def channels(n: Column) -> Column:
        parts = F.struct(*[F.shiftright(n, k).bitwiseAND(255).alias(name) for name, k in (("r", 16), ("g", 8), ("b", 0))])
        return F.when(n.isNotNull(), parts)

    return let(let(let(bare, long_form), number), channels)


def _linear(channel: Column) -> Column:
    x = channel / 255.0
    return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * _linear(r) + 0.7152 * _linear(g) + 0.0722 * _linear(b)


def contrast_ratio(one: Column, other: Column) -> Column:
    """Ratio of two luminances, 1 to 21, in either order."""
    return (F.greatest(one, other) + 0.05) / (F.least(one, other) + 0.05)


def round2(c: Column) -> Column:
    """Two decimals, halves upward, computed in binary floating point."""
    return F.floor(c * 100 + 0.5) / 100.0
