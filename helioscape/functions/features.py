"""Membership functions, look-ups, exclusions and model features."""
from pyspark.sql import Column, functions as F

from . import constants as K
from .nulls import clamp, floor_at, num


def benefit(x: Column, lo: float, hi: float) -> Column:
    """0 at or below lo, 1 at or above hi."""
    return clamp((x - num(lo)) / num(hi - lo), 0, 1)


def cost(x: Column, lo: float, hi: float) -> Column:
    return num(1) - benefit(x, lo, hi)


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    rise, fall = (x - num(a)) / num(b - a), (num(d) - x) / num(d - c)
    return clamp(F.when(x.isNotNull(), F.least(rise, fall)), 0, 1)


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(part) for item in table.items() for part in item])


def code_of(x: Column) -> Column:
    """Integer class code of a measured (float) code; half-even like numpy."""
    return F.bround(x, 0).cast("int")


def code_lookup(codes: Column, table: dict, default: float = 0.0) -> Column:
    """Score of a class code: unknown code -> default, missing code -> missing."""
    hit = F.element_at(literal_map({k: float(v) for k, v in table.items()}), code_of(codes))
    return F.when(codes.isNotNull(), F.coalesce(hit, num(default)))


def code_in(codes: Column, members) -> Column:
    return F.coalesce(code_of(codes).isin(*[int(m) for m in members]), F.lit(False))


def landcover_name(codes: Column, names: dict) -> Column:
    return F.element_at(literal_map(names), code_of(codes))


def region_group(raw: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(K.REGION_GROUPS), raw), F.lit("Other"))


def steepness(slope: Column) -> Column:
    return clamp(slope / num(10), 0, 1)


def aspect_equator(aspect: Column, slope: Column, lat: Column) -> Column:
    hemisphere = F.when(lat >= 0, num(1)).otherwise(num(-1))
    return F.coalesce(-F.cos(F.radians(aspect)) * hemisphere * steepness(slope), num(0))


def aspect_south(aspect: Column, slope: Column) -> Column:
    return F.coalesce(-F.cos(F.radians(aspect)) * steepness(slope), num(0))


def aspect_east(aspect: Column, slope: Column) -> Column:
    return F.coalesce(F.sin(F.radians(aspect)) * steepness(slope), num(0))


def log_floor(x: Column) -> Column:
    return F.log1p(floor_at(x, 0))


def one_hot(codes: Column, members) -> Column:
    return code_in(codes, members).cast("int")


def exclusion_reason(landcover: Column, slope: Column) -> Column:
    """Land cover first, then slope; null when the site is usable."""
    by_cover = F.element_at(literal_map(K.IGBP_EXCLUDED), code_of(landcover))
    return F.coalesce(by_cover, F.when(slope > num(K.MAX_SLOPE_DEG), F.lit(K.SLOPE_REASON)))


def exclusion_message(reason: Column) -> Column:
    known = F.element_at(literal_map(K.EXCLUSION_MESSAGES), reason)
    return F.when(reason.startswith("slope"), F.lit(K.SLOPE_MESSAGE)).otherwise(known)


def temper(p: Column, temperature: float = K.SCORE_TEMPERATURE) -> Column:
    """0-100 score of a probability, flattened in logit space."""
    q = F.least(F.greatest(p, num(1e-6)), num(1 - 1e-6))
    return num(100) / (num(1) + F.exp(-F.log(q / (num(1) - q)) / num(temperature)))


def score_class(score: Column) -> Column:
    return (F.when(score >= num(K.HIGH_SCORE), "High")
            .when(score >= num(K.MEDIUM_SCORE), "Medium").otherwise("Low"))


def energy(ghi: Column, area_m2: Column, efficiency: Column | None = None,
           ratio: Column | None = None) -> dict[str, Column]:
    """Annual yield of an array, as named columns."""
    efficiency = num(K.PANEL_EFFICIENCY) if efficiency is None else efficiency
    ratio = num(K.PERFORMANCE_RATIO) if ratio is None else ratio
    annual = area_m2 * ghi * num(365) * efficiency * ratio
    peak = area_m2 * efficiency
    return {
        "area_acres": area_m2 / num(K.ACRE_M2),
        "annual_kwh": annual,
        "annual_mwh": annual / num(1000),
        "peak_kwp": peak,
        "specific_yield": F.when(area_m2 == 0, num(0)).otherwise(annual / peak),
        "co2_tonnes": annual * num(K.EMISSION_KG_PER_KWH) / num(1000),
        "households": annual / num(K.HOUSEHOLD_KWH_PER_YEAR),
    }


def monthly_energy(monthly_ghi: Column, area_m2: Column, efficiency: Column | None = None, ratio: Column | None = None) -> Column:
    """Twelve monthly yields from twelve daily means, with the request's efficiency and ratio where it names them."""
    days = F.array(*[num(d) for d in K.MONTH_DAYS])
    efficiency = num(K.PANEL_EFFICIENCY) if efficiency is None else efficiency
    ratio = num(K.PERFORMANCE_RATIO) if ratio is None else ratio
    rate = efficiency * ratio
    return F.zip_with(monthly_ghi, days, lambda g, d: area_m2 * g * d * rate)
