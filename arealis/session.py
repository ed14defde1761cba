"""Session settings that suit the generated code of wide flag expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

# HotSpot does not compile methods above 8000 bytes of bytecode (fixed value);
# Spark then runs such a stage in smaller, compiled pieces.
HOTSPOT_METHOD_LIMIT = "8000"
SPARK_DEFAULT_LIMIT = "65535"


def tune(spark: SparkSession) -> SparkSession:
    """Lower the method-size limit, unless the session sets its own."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, SPARK_DEFAULT_LIMIT) == SPARK_DEFAULT_LIMIT:
        spark.conf.set(key, HOTSPOT_METHOD_LIMIT)
    return spark
