"""Quality masks, unit conversions and indices of optical and thermal observations."""
from pyspark.sql import Column, functions as F

from .nulls import num


def normalized_difference(a: Column, b: Column) -> Column:
    """(a-b)/(a+b), null when the sum is zero."""
    total = a + b
    return F.when(total != 0, (a - b) / total)


def landsat_clear(qa: Column) -> Column:
    """Fill, dilated cloud, cirrus, cloud and shadow flags (bits 0-4) are all off."""
    return qa.bitwiseAND(31) == 0


def state_clear(qa: Column) -> Column:
    """Cloud state (bits 0-1) clear and shadow flag (bit 2) off."""
    return (qa.bitwiseAND(3) == 0) & (qa.bitwiseAND(4) == 0)


def thermal_clear(qa: Column) -> Column:
    """Mandatory quality bits 0-1 are good or other-quality."""
    return qa.bitwiseAND(3) <= 1


def summary_clear(qa: Column) -> Column:
    return qa <= 1


def score_clear(score: Column, threshold: float = 0.60) -> Column:
    return score >= num(threshold)


def landsat_reflectance(dn: Column) -> Column:
    return dn * num(0.0000275) - num(0.2)


def landsat_celsius(dn: Column) -> Column:
    return dn * num(0.00341802) + num(149.0) - num(273.15)


def sentinel_reflectance(dn: Column) -> Column:
    return dn / num(10_000)


def modis_celsius(dn: Column) -> Column:
    return dn * num(0.02) - num(273.15)


def daily_ghi(monthly_joules: Column) -> Column:
    """Mean monthly radiation sum in J/m2 -> kWh/m2/day."""
    return monthly_joules / num(3.6e6) / num(30.4375)


def people_per_km2(per_hectare_cell: Column) -> Column:
    return per_hectare_cell * num(100)
