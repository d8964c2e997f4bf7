"""Palettes and pixel colours as Column expressions."""
from pyspark.sql import Column, functions as F

from .nulls import clamp, num


def hex_rgb(code: Column) -> Column:
    """'#rrggbb' or 'rrggbb' -> struct(r, g, b)."""
    h = F.regexp_replace(code, "#", "")
    return F.struct(*[
        F.conv(F.substring(h, start, 2), 16, 10).cast("int").alias(name)
        for start, name in ((1, "r"), (3, "g"), (5, "b"))])


def palette_stops(palette: list[str]) -> list[tuple[int, int, int]]:
    return [tuple(int(p.lstrip("#")[i:i + 2], 16) for i in (0, 2, 4)) for p in palette]


def ramp_channel(t: Column, values: list[float]) -> Column:
    """Linear interpolation of evenly spaced stops at t in [0, 1]."""
    last = len(values) - 1
    pos = t * num(last)
    low = F.least(F.greatest(F.floor(pos), F.lit(0)), F.lit(last - 1)).cast("int")
    stops = F.array(*[num(v) for v in values])
    frac = pos - low
    return F.element_at(stops, low + 1) * (num(1) - frac) + F.element_at(stops, low + 2) * frac


def colorize(value: Column, palette: list[str], vmin: float, vmax: float,
             alpha: tuple[float, float] = (0.35, 0.92)) -> Column:
    """Value -> struct(r, g, b, a); missing values are transparent."""
    t = F.coalesce(clamp((value - num(vmin)) / num(vmax - vmin), 0, 1), num(0))
    stops = palette_stops(palette)
    rgb = [F.floor(ramp_channel(t, [s[i] for s in stops])).cast("int").alias(n)
           for i, n in enumerate("rgb")]
    opacity = F.floor((num(alpha[0]) + num(alpha[1] - alpha[0]) * t) * num(255)).cast("int")
    return F.struct(*rgb, F.when(value.isNull(), 0).otherwise(opacity).alias("a"))


def categorical_rgba(code: Column, colours: dict[int, str], alpha: float = 0.85) -> Column:
    """Class code -> struct(r, g, b, a); unknown codes are transparent black."""
    table = F.create_map(*[F.lit(v) for kv in colours.items() for v in kv])
    rgb = hex_rgb(F.coalesce(F.element_at(table, code), F.lit("000000")))
    known = code.isin(*colours)
    return F.struct(rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"),
                    F.when(known, int(alpha * 255)).otherwise(0).alias("a"))
