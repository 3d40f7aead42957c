"""Registry of named queries: ``name -> fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column as ``round(x * 10^d) / 10^d`` (and +0.0 so
    -0.0 prints as 0.0).  Scaling first makes both engines round the same
    binary value, where rounding the decimal form would differ on ties.

    Floating sums depend on partition order; the oracle compares rounded
    values, so results are published rounded.
    """
    scale = f"{float(10 ** digits)!r}"
    exprs = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # one SQL string per column: parsed JVM-side in a single call
            exprs.append(f"round(CAST({name} AS DOUBLE) * {scale}, 0) / {scale} + 0.0 AS {name}")
        else:
            exprs.append(name)
    return df.selectExpr(*exprs)
