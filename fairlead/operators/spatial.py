"""Polygon filters, berth labels, channels and junctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Berth
from ..functions.geo import haversine
from ..functions.rings import Polygon, covers


def inside(df: DataFrame, polygons: list[Polygon] | None) -> DataFrame:
    """Rows in any polygon, edges included; without polygons all rows."""
    return df.where(covers(polygons, F.col("lon"), F.col("lat"))) if polygons else df


def outside(df: DataFrame, polygons: list[Polygon] | None) -> DataFrame:
    """Rows in no polygon and on no edge; without polygons all rows."""
    return df.where(~covers(polygons, F.col("lon"), F.col("lat"))) if polygons else df


def domain_polygons(df: DataFrame, outer=None, inner=None, corridor=None, terminals=None, anchorages=None) -> DataFrame:
    """Within outer area, inner area and corridor, outside terminals and anchorages: one filter."""
    return outside(outside(inside(inside(inside(df, outer), inner), corridor), terminals), anchorages)


def label_berths(df: DataFrame, terminals: list[Polygon], anchorages: list[Polygon], corridor: list[Polygon], rules: Berth = Berth()) -> DataFrame:
    """Three flags for slow reports in an area; no row goes."""

    def slow(polygons: list[Polygon], knots: float) -> Column:
        return F.coalesce(covers(polygons, F.col("lon"), F.col("lat")) & (F.col("sog") <= knots), F.lit(False))

    return df.withColumns({
        "is_terminal_dwell": slow(terminals, rules.terminal_knots),
        "is_anchorage_wait": slow(anchorages, rules.anchorage_knots),
        "is_channel_low_speed": slow(corridor, rules.channel_knots),
    })


def channel_segments(spark, lines: list[tuple[str, list[tuple[float, float]]]]) -> DataFrame:
    """Segments of centrelines: (channel_id, segment, lon0, lat0, lon1, lat1)."""
    rows = [(name, k, *map(float, a), *map(float, b)) for name, line in lines for k, (a, b) in enumerate(zip(line, line[1:]))]
    return spark.createDataFrame(rows, "channel_id string, segment int, lon0 double, lat0 double, lon1 double, lat1 double")


def channel_samples(segments: DataFrame, samples: int = 20) -> DataFrame:
    """Evenly spaced points of each segment, its ends included: (channel_id, c_lon, c_lat)."""
    share = F.col("k") / F.lit(float(samples))
    spread = segments.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples))))
    return spread.select("channel_id", (F.col("lon0") + share * (F.col("lon1") - F.col("lon0"))).alias("c_lon"), (F.col("lat0") + share * (F.col("lat1") - F.col("lat0"))).alias("c_lat"))


def channel_distances(points: DataFrame, segments: DataFrame, key: str, largest: int = 20_000) -> DataFrame:
    """(key, channel_id, metres): least distance of each point to the samples of each channel.

    The samples of a port's channels are few; they are broadcast if the segments
    are at most ``largest``, and left to the planner beyond. Each point is compared
    in generated code and folded at once, before anything is shuffled.
    """
    samples = channel_samples(segments)
    side = F.broadcast(samples) if segments.limit(largest + 1).count() <= largest else samples
    near = points.join(side).select(key, "channel_id", haversine(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")).alias("metres"))
    return near.groupBy(key, "channel_id").agg(F.min("metres").alias("metres"))


def channels_near(points: DataFrame, segments: DataFrame, key: str, radius: float) -> DataFrame:
    """Channels within a radius of each point, edge included."""
    return channel_distances(points, segments, key).where(F.col("metres") <= radius).select(key, "channel_id")


def junction_table(spark, junctions: list[dict]) -> DataFrame:
    """(place, junction_id, lon, lat, radius_m, clusters), malformed entries left out; radius 500 m if none is named."""
    rows = []
    for entry in junctions:
        try:
            rows.append((len(rows), str(entry["id"]), float(entry["lon"]), float(entry["lat"]), float(entry.get("radius_m", 500.0)), [int(c) for c in entry.get("cluster_ids", [])]))
        except (KeyError, TypeError, ValueError):
            continue
    return spark.createDataFrame(rows, "place int, junction_id string, j_lon double, j_lat double, radius_m double, clusters array<int>")


def junction_of(points: DataFrame, junctions: DataFrame, key: str, largest: int = 20_000) -> DataFrame:
    """The first junction whose circle holds a point; null if none does. Up to ``largest`` junctions are broadcast; the planner chooses beyond."""
    side = F.broadcast(junctions) if junctions.limit(largest + 1).count() <= largest else junctions
    # A degree of latitude is the same everywhere, so most pairs are dismissed before any sine is taken.
    level = F.abs(F.col("lat") - F.col("j_lat")) <= F.col("radius_m") / F.lit(111_000.0)
    near = points.join(side, level & (haversine(F.col("lat"), F.col("lon"), F.col("j_lat"), F.col("j_lon")) <= F.col("radius_m")), "left")
    return near.groupBy(key).agg(F.min_by("junction_id", "place").alias("junction_id"), F.min_by("clusters", "place").alias("clusters"))


def clusters_at(junctions: DataFrame, junction_id: str) -> set[int]:
    """The routes that fork at a junction; none for one that is not known."""
    found = junctions.where(F.col("junction_id") == junction_id).orderBy("place").select("clusters").first()
    return set(found["clusters"] or []) if found else set()
