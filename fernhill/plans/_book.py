"""Registration of catalog queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernhill.fixtures import duck_sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, *inputs: str):
    """Register a function of the named views; it gets them as DataFrames."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(*(view(spark, sf_dir, x) for x in inputs))
        if sql:
            ORACLES[name] = duck_sql(sql)
        return build

    return add


def rows(like: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """A small rule table in the session of ``like``; the planner does not know the size of local rows and would shuffle for them."""
    return F.broadcast(like.sparkSession.createDataFrame(values, schema))
