"""Vessel positions derived from the test tables, by the same arithmetic in Spark and in SQL.

The clock of ``events`` is divided by CLOCK, so that gaps, jumps and stops occur;
``scale`` spreads positions over a larger or smaller area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLOCK = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """(event_id, mmsi, t, lon, lat, sog, cog, heading, vessel_type, transceiver_class)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / F.lit(1e6) / F.lit(float(CLOCK))
    turn = lambda k, m: F.pmod(F.col("event_id") * k, F.lit(m)).cast("double")
    return e.select(
        "event_id",
        (F.lit(100000000) + F.col("user_id")).alias("mmsi"),
        at.alias("t"),
        (F.lit(-118.5) + F.lit(float(scale)) * F.lit(0.005) * turn(37, 1000) / F.lit(1000.0)).alias("lon"),
        (F.lit(33.45) + F.lit(float(scale)) * F.lit(0.004) * turn(91, 1000) / F.lit(1000.0)).alias("lat"),
        (F.col("value") / F.lit(20.0)).alias("sog"),
        turn(53, 400).alias("cog"),
        F.when(F.col("event_id") % 7 == 0, F.lit(511.0)).otherwise(turn(29, 360)).alias("heading"),
        (F.lit(60) + F.col("event_id") % 40).cast("int").alias("vessel_type"),
        F.when(F.col("event_id") % 3 == 0, F.lit(" a ")).when(F.col("event_id") % 3 == 1, F.lit("B")).alias("transceiver_class"),
    )


def positions_sql(scale: float = 1.0) -> str:
    """The same as the body of a CTE."""
    return f"""
    SELECT event_id, 100000000 + user_id AS mmsi, epoch_us(ts)::DOUBLE / 1e6 / {float(CLOCK)} AS t,
           -118.5::DOUBLE + {float(scale)}::DOUBLE * 0.005::DOUBLE * ((event_id * 37) % 1000)::DOUBLE / 1000.0::DOUBLE AS lon,
           33.45::DOUBLE + {float(scale)}::DOUBLE * 0.004::DOUBLE * ((event_id * 91) % 1000)::DOUBLE / 1000.0::DOUBLE AS lat,
           value / 20.0::DOUBLE AS sog, ((event_id * 53) % 400)::DOUBLE AS cog,
           CASE WHEN event_id % 7 = 0 THEN 511.0::DOUBLE ELSE ((event_id * 29) % 360)::DOUBLE END AS heading,
           (60 + event_id % 40)::INTEGER AS vessel_type,
           CASE event_id % 3 WHEN 0 THEN ' a ' WHEN 1 THEN 'B' END AS transceiver_class
    FROM events"""


def paths(spark: SparkSession, sf_dir: str, most: int = 1 << 62) -> DataFrame:
    """(vec_id, label, path): each embedding as a path of 32 points."""
    point = lambda k: F.struct(F.col("embedding")[2 * k].cast("double").alias("lon"), F.col("embedding")[2 * k + 1].cast("double").alias("lat"))
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") < most).select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(31)), point).alias("path"))


PATH_POINTS_SQL = """
    SELECT vec_id, label, k::INTEGER AS k, embedding[(2 * k + 1)::INTEGER]::DOUBLE AS lon, embedding[(2 * k + 2)::INTEGER]::DOUBLE AS lat
    FROM embeddings, (SELECT unnest(range(32)) AS k)"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"least(greatest(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 0), 1)"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"
