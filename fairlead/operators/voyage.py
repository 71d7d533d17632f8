"""Voyages: splitting, numbering, direction, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Domain, Voyages
from ..functions.geo import haversine
from .components import numbered


def vessel_order(order: tuple[str, ...] = ("t",)):
    return Window.partitionBy("mmsi").orderBy(*order)


def split_voyages(df: DataFrame, rules: Voyages = Voyages(), order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Add ``voyage``, from 0 within each vessel: a new one after more than ``gap_seconds`` without a report."""
    by = vessel_order(order)
    start = F.coalesce(F.col("t") - F.lag("t").over(by) > rules.gap_seconds, F.lit(False)).cast("int")
    return df.withColumn("voyage", F.sum(start).over(by).cast("int"))


def long_enough(df: DataFrame, rules: Voyages = Voyages()) -> DataFrame:
    """Voyages of at least ``min_points`` reports."""
    size = F.count("*").over(Window.partitionBy("mmsi", "voyage"))
    return df.withColumn("points", size).where(F.col("points") >= rules.min_points).drop("points")


def short_voyages(df: DataFrame, rules: Voyages = Voyages()) -> DataFrame:
    """How many voyages are too short."""
    sizes = df.groupBy("mmsi", "voyage").agg(F.count("*").alias("points"))
    short = F.count_if(F.col("points") < rules.min_points)
    return sizes.agg(F.count("*").alias("voyages"), short.alias("short_voyages"), (short / F.greatest(F.count("*"), F.lit(1))).alias("short_ratio"))


def number_voyages(df: DataFrame) -> DataFrame:
    """Add ``traj_id`` from 0, in order of vessel and time.

    Only keys of voyages are ranked, one row each.
    """
    return df.join(numbered(df.select("mmsi", "voyage").distinct(), ["mmsi", "voyage"], "traj_id"), ["mmsi", "voyage"])


def direction(lon0: Column, lat0: Column, lon1: Column, lat1: Column, domain: Domain) -> Column:
    """inbound, outbound, intra-harbor or unknown, from the ends of a voyage; the sea lies to the west."""
    if not domain.active:
        return F.lit("unknown")
    box = domain.box
    sea = F.lit(box.lon_min - 0.02)
    from_sea0, from_sea1 = F.abs(lon0 - sea), F.abs(lon1 - sea)
    within = lon0.between(box.lon_min, box.lon_max) & lon1.between(box.lon_min, box.lon_max) & lat0.between(box.lat_min, box.lat_max) & lat1.between(box.lat_min, box.lat_max)
    return (
        F.when((lon1 > lon0 + F.lit(1e-4)) & (from_sea0 < from_sea1), "inbound")
        .when((lon0 > lon1 + F.lit(1e-4)) & (from_sea1 < from_sea0), "outbound")
        .when(within & (F.abs(lon1 - lon0) < F.lit(1e-3)), "intra-harbor")
        .otherwise("unknown")
    )


def ends(df: DataFrame, keys: list[str], order: tuple[str, ...] = ("t",)) -> DataFrame:
    """First and last position of each group: (keys, s_lon, s_lat, e_lon, e_lat)."""
    place, at = F.struct("lon", "lat"), F.struct(*order)
    found = df.groupBy(*keys).agg(F.min_by(place, at).alias("s"), F.max_by(place, at).alias("e"))
    return found.select(*keys, F.col("s.lon").alias("s_lon"), F.col("s.lat").alias("s_lat"), F.col("e.lon").alias("e_lon"), F.col("e.lat").alias("e_lat"))


def label_directions(df: DataFrame, domain: Domain, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """(mmsi, voyage, direction_label)."""
    found = ends(df, ["mmsi", "voyage"], order)
    return found.select("mmsi", "voyage", direction(F.col("s_lon"), F.col("s_lat"), F.col("e_lon"), F.col("e_lat"), domain).alias("direction_label"))


def summaries(df: DataFrame, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """For each voyage its reports, start, end and length in metres."""
    by = Window.partitionBy("mmsi", "voyage").orderBy(*order)
    leg = haversine(F.lag("lat").over(by), F.lag("lon").over(by), F.col("lat"), F.col("lon"))
    legs = df.withColumn("leg", F.coalesce(leg, F.lit(0.0)))
    return legs.groupBy("mmsi", "voyage").agg(F.count("*").alias("points"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.sum("leg").alias("metres"))
