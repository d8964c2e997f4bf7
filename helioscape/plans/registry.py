"""Registry of queries and of the SQL text each one is compared with."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: str = ""):
    """Register `fn(spark, sf_dir)`; `views` names the input views that the SQL text starts from."""
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            body = oracle.strip()
            ctes = [f"{v} as ({view_sql(v)})" for v in views.split()]
            if body.lower().startswith("with recursive "):
                ORACLES[name] = "with recursive " + ", ".join([*ctes, body[len("with recursive "):]])
            elif body.lower().startswith("with "):
                ORACLES[name] = "with " + ", ".join([*ctes, body[5:]])
            elif ctes:
                ORACLES[name] = "with " + ", ".join(ctes) + " " + body
            else:
                ORACLES[name] = body
        return fn
    return register
