"""Registration of queries and of the SQL that states the same result."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def local_checkpoints(spark: SparkSession) -> None:
    """A folder for a local session that names none; a cluster must name its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and spark.conf.get("spark.checkpoint.dir", None) is None and sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without SQL only its rows are checked."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            local_checkpoints(spark)
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that results can be compared by value."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rnd(expr: str, digits: int = 6) -> str:
    """SQL text of the same rounding (adding 0 turns -0.0 into 0.0)."""
    return f"(round({expr}, {digits}) + 0.0)"
