"""Points (x, y, z, v) drawn from the driver's tables, and the specs that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import TreeSpec

EMBEDDINGS = TreeSpec((-0.5, -0.5, -0.5), (0.5, 0.5, 0.5), leaf_tiles=16)
LINEITEM = TreeSpec((0.0, 0.0, 0.0), (51.0, 0.11, 0.09), leaf_tiles=16)
EVENTS = TreeSpec((0.0, 0.0, 0.0), (2.592e12, 160.0, 500.0), leaf_tiles=16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(*[F.get(F.col("embedding"), n).cast("double").alias(c) for n, c in enumerate("xyz")], F.col("label").alias("v"))


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"), F.col("l_tax").cast("double").alias("z"), F.col("l_linenumber").alias("v"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, F.col("ts")) if hasattr(F, "timestamp_diff") else F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    return e.select(micros.cast("double").alias("x"), F.col("user_id").cast("double").alias("y"), F.col("value").cast("double").alias("z"), F.lit(1).alias("v"))
