"""Input views over the base tables, one SQL text for both engines.

The tables carry no coordinates, so each view derives points, cells, observations or polylines from keys
and measures.  Double literals are written with an exponent because 100.0 would be a decimal in Spark.
"""
from pyspark.sql import DataFrame, SparkSession

from ..operators.ordered import ordinal

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

VIEWS = {
    "sites": """
select c_custkey as site_id, r_name as region,
  -20e0 + ((c_custkey*7919) % 4000)/1e2 as lat,
  60e0 + ((c_custkey*104729) % 3989)/1e2 as lon,
  case when c_custkey % 5 < 2 then 1 else 0 end as label,
  case when c_custkey % 5 < 2 then '' when c_custkey % 2 = 0 then 'background' else 'hard' end as neg_type,
  2e0 + ((c_custkey*31) % 500)/1e2 as ghi,
  -10e0 + ((c_custkey*29) % 450)/1e1 as temperature,
  ((c_custkey*43) % 1000)/1e1 as cloud_cover,
  ((c_custkey*61) % 3000)*1e0 as elevation,
  case when c_custkey % 37 = 0 then null else ((c_custkey*53) % 2200)/1e2 end as slope,
  case when c_custkey % 37 = 0 then null else ((c_custkey*71) % 3600)/1e1 end as aspect,
  ((c_custkey*97) % 600)*1e0 as accessibility,
  case when c_custkey % 41 = 0 then null else -1e-1 + ((c_custkey*17) % 900)/1e3 end as ndvi,
  case when c_custkey % 41 = 0 then null else -1e-1 + ((c_custkey*19) % 900)/1e3 end as ndvi_pre,
  -4e-1 + ((c_custkey*23) % 700)/1e3 as ndbi,
  -4e-1 + ((c_custkey*47) % 700)/1e3 as ndbi_pre,
  -5e0 + ((c_custkey*59) % 500)/1e1 as lst,
  -5e0 + ((c_custkey*67) % 500)/1e1 as lst_pre,
  case when c_custkey % 43 = 0 then null else (1 + (c_custkey*13) % 17)*1e0 end as landcover,
  case when c_custkey % 43 = 0 then null else (1 + (c_custkey*11) % 17)*1e0 end as landcover_pre,
  ((c_custkey*73) % 800)/1e1 - 1e0 as nightlights,
  ((c_custkey*79) % 800)/1e1 - 1e0 as nightlights_pre,
  ((c_custkey*83) % 6000)*1e0 as population,
  ((c_custkey*89) % 6000)*1e0 as population_pre,
  (10*(1 + c_custkey % 9))*1e0 as worldcover
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""",
    "plants": """
select s_suppkey as plant_id,
  -20e0 + ((s_suppkey*6007+11) % 4000)/1e2 as plat,
  60e0 + ((s_suppkey*7103+5) % 3989)/1e2 as plon,
  5e3 + (s_acctbal + 1e3)*1e1 as area_m2,
  ((s_suppkey*37) % 500)/1e1 as capacity_mw,
  case s_suppkey % 4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end as confidence,
  r_name as region
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""",
    "obs": """
select event_id as obs_id, ts, user_id as pixel_id, event_type as sensor,
  cast(event_id % 32 as int) as qa,
  7e3 + value*1e1 as red_dn, 9e3 + value*2e1 as nir_dn, 8e3 + value*1.5e1 as swir_dn,
  4e4 + value*1e1 as thermal_dn, (event_id % 100)/1e2 as clear_score, (event_id % 90)*1e0 as scene_cloud_pct
from events
""",
    "cells": """
select cast(floor(p_partkey/50e0) as int) as r, cast(p_partkey % 50 as int) as c,
  case when p_partkey % 29 = 0 then null else p_retailprice end as z,
  8e0 + cast(floor(p_partkey/50e0) as int)*5e-1 as lat, 70e0 + (p_partkey % 50)*5e-1 as lon,
  (10*(1 + p_size % 9))*1e0 as code
from part
""",
    "ways": """
select o_custkey as way_id, row_number() over (partition by o_custkey order by o_orderkey) as seq,
  ((o_orderkey*7919) % 100000)*1e0 as x, ((o_orderkey*104729) % 99991)*1e0 as y
from orders
""",
    "band_samples": """
select l_partkey as pixel_id, l_returnflag as band, l_shipdate as ts, l_extendedprice as value,
  cast(l_linenumber as int) as qa, l_quantity as weight
from lineitem
""",
    "gazetteer": """
select p_partkey as place_id, p_name as name, p_brand as context, lower(p_type) as osm_value from part
""",
    "requests": """
select event_id as request_id, ts, user_id as site_id, 4e3 + value*1e1 as area_m2 from events
""",
}


def _footprint_sql() -> str:
    """Four outer edges per supplier, plus a square hole in every fourth footprint."""
    base = (
        "select s_suppkey as poly, case when s_suppkey % 3 = 0 then 'plant' else 'generator' end as kind, "
        "case when s_suppkey % 4 = 1 then '' else s_name end as name, "
        "case when s_suppkey % 5 = 2 then '' else concat('20', cast(10 + s_suppkey % 9 as varchar(4))) end as start_date, "
        "cast(floor(s_suppkey/3e0) as bigint)*6007 % 40000 * 5e1 + (s_suppkey % 3)*1.7e2 as cx, "
        "cast(floor(s_suppkey/3e0) as bigint)*7103 % 39989 * 5e1 as cy, 3e1 + (s_suppkey % 7)*1e1 as w from supplier"
    )
    corners = [("-1e0", "-1e0"), ("1e0", "-1e0"), ("1e0", "8e-1"), ("-1e0", "1e0")]
    parts = []
    for role, ring, f, where in (("outer", 0, "1e0", ""), ("inner", 1, "5e-1", " where poly % 4 = 0")):
        for i in range(4):
            (ax, ay), (bx, by) = corners[i], corners[(i + 1) % 4]
            parts.append(
                f"select poly, kind, name, start_date, cx, cy, w, '{role}' as role, {ring} as ring, "
                f"cx + {ax}*{f}*w as x1, cy + {ay}*{f}*w as y1, cx + {bx}*{f}*w as x2, cy + {by}*{f}*w as y2 "
                f"from ({base}) b{where}")
    return " union all ".join(parts)


def _border_sql() -> str:
    """One slanted quadrilateral per nation on a 5 x 5 lattice, with a triangular hole in every fourth."""
    base = ("select n_nationkey as poly, r_name as region, 605e-1 + 8e0*(n_nationkey % 5) as x0, "
            "-1963e-2 + 8e0*floor(n_nationkey/5e0) as y0 from nation join region on n_regionkey = r_regionkey")
    rings = [("outer", 0, [("0e0", "0e0"), ("7.1e0", "4e-1"), ("6.6e0", "7.2e0"), ("3e-1", "6.9e0")], ""),
             ("inner", 1, [("2e0", "2e0"), ("4.1e0", "2.3e0"), ("3e0", "4.4e0")], " where poly % 4 = 0")]
    parts = []
    for role, ring, pts, where in rings:
        for i, (ax, ay) in enumerate(pts):
            bx, by = pts[(i + 1) % len(pts)]
            parts.append(f"select poly, region, '{role}' as role, {ring} as ring, x0 + {ax} as x1, y0 + {ay} as y1, "
                         f"x0 + {bx} as x2, y0 + {by} as y2 from ({base}) b{where}")
    return " union all ".join(parts)


VIEWS["footprints"] = _footprint_sql()
VIEWS["borders"] = _border_sql()



def view_sql(name: str) -> str:
    return VIEWS[name].strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Base tables are registered only if the view's text names them."""
    text = view_sql(name)
    for t in TABLES:
        if t in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as the `ways` text; the position in a way is computed without a window per way."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as way_id", "o_orderkey",
        "((o_orderkey*7919) % 100000)*1e0 as x", "((o_orderkey*104729) % 99991)*1e0 as y")
    return ordinal(orders, ["way_id"], "o_orderkey", "seq").drop("o_orderkey")
