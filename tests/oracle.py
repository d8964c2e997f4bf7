"""Runs a registered query and its SQL text side by side."""
import datetime
import math

import duckdb
from pyspark.sql import SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("helioscape-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql: str):
    """None when equal, otherwise a description of the difference."""
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    dc, dr = rows_of([d[0] for d in rel.description], rel.fetchall())
    if sc != dc:
        return f"columns differ: {sc} vs {dc}"
    if len(sr) != len(dr):
        return f"row counts differ: {len(sr)} vs {len(dr)}; first {sr[:2]} vs {dr[:2]}"
    if sr != dr:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b]
        types = [(a, b) for a, b in zip(sr[0], dr[0]) if type(a) is not type(b)]
        return f"{len(bad)} of {len(sr)} rows differ; first {bad[0]}; types {types}"
    if not sr:
        return "both empty"
    kinds = [(c, type(a[i]).__name__, type(b[i]).__name__) for a, b in zip(sr, dr) for i, c in enumerate(sc)
             if a[i] is not None and b[i] is not None and type(a[i]) is not type(b[i])]
    if kinds:
        return f"types differ: {sorted(set(kinds))}"
    return None
