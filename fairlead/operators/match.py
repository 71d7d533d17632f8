"""Which route a vessel follows, and forks between routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Prediction
from ..functions.dtw import match_column

UNKNOWN = -1


def route_distances(vessels: DataFrame, routes: DataFrame, steps: Column | None = None) -> DataFrame:
    """(mmsi, cluster_id, d): least distance of each vessel's last points to any stretch of each route.

    vessels: (mmsi, path); routes: (cluster_id, path, steps). A vessel with fewer
    points than a route's window has no row for it. Routes are few by design, but
    the side to broadcast is left to the planner's size check.
    """
    right = routes.select("cluster_id", F.col("path").alias("route"), "steps")
    left = vessels.select("mmsi", F.col("path").alias("track"), *(["allowed"] if "allowed" in vessels.columns else []))
    both = left.join(right, F.size("track") >= F.col("steps"))
    if "allowed" in vessels.columns:
        both = both.where(F.col("allowed").isNull() | F.array_contains("allowed", F.col("cluster_id")))
    recent = F.slice("track", -F.col("steps"), F.col("steps"))
    return both.select("mmsi", "cluster_id", match_column(recent, F.col("route")).alias("d"))


def threshold(rules: Prediction, calibrated: float | None) -> float:
    """The set threshold, else the calibrated one, else the fallback."""
    return next(x for x in (rules.unknown_threshold, calibrated, rules.unknown_fallback) if x is not None)


def best_route(distances: DataFrame, limit: float) -> DataFrame:
    """(mmsi, cluster_id, match_distance): the nearest route, -1 if none is near enough."""
    best = distances.groupBy("mmsi").agg(F.min_by("cluster_id", F.struct("d", "cluster_id")).alias("best"), F.min("d").alias("match_distance"))
    return best.select("mmsi", F.when(F.col("match_distance") <= limit, F.col("best")).otherwise(UNKNOWN).cast("int").alias("cluster_id"), "match_distance")


def fork_candidates(distances: DataFrame, rules: Prediction = Prediction()) -> DataFrame:
    """(mmsi, rank, cluster_id, d): the nearest routes where the second is about as near as the first.

    An infinite second distance is no fork.
    """
    by = Window.partitionBy("mmsi").orderBy("d", "cluster_id")
    ranked = distances.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(2, rules.branches))
    whole = Window.partitionBy("mmsi")
    first, second = F.min(F.when(F.col("rank") == 1, F.col("d"))).over(whole), F.min(F.when(F.col("rank") == 2, F.col("d"))).over(whole)
    marked = ranked.withColumns({"d1": first, "d2": second})
    return marked.where((F.col("d2") > 0) & (F.col("d2") < float("inf")) & ((F.col("d2") - F.col("d1")) / F.col("d2") <= rules.fork_ratio)).select("mmsi", "rank", "cluster_id", "d")


def fork_probabilities(candidates: DataFrame, counts: DataFrame | None) -> DataFrame:
    """(mmsi, cluster_id, probability): past voyages of the vessel on each route; equal shares where none are known."""
    whole = Window.partitionBy("mmsi")
    if counts is None:
        return candidates.select("mmsi", "cluster_id", (F.lit(1.0) / F.count("*").over(whole)).alias("probability"))
    seen = candidates.join(counts.select("mmsi", "cluster_id", "voyages"), ["mmsi", "cluster_id"], "left").select("mmsi", "cluster_id", F.coalesce("voyages", F.lit(0)).alias("n"))
    total = F.sum("n").over(whole)
    return seen.select("mmsi", "cluster_id", F.when(total > 0, F.col("n") / total).otherwise(F.lit(1.0) / F.count("*").over(whole)).alias("probability"))


def prune_branches(first_points: DataFrame, near_channels: DataFrame, channel_metres: DataFrame, rules: Prediction = Prediction()) -> DataFrame:
    """(mmsi, cluster_id): branches whose first point stays near a channel that the vessel is near.

    first_points: (mmsi, cluster_id, point_id); near_channels: (mmsi, channel_id);
    channel_metres: (point_id, channel_id, metres). All branches stay if no channel
    is near, or if none would be left.
    """
    branch = first_points.join(near_channels, "mmsi", "left").join(channel_metres, ["point_id", "channel_id"], "left")
    closest = branch.groupBy("mmsi", "cluster_id").agg(F.min("metres").alias("metres"), F.count("channel_id").alias("channels"))
    good = F.coalesce(F.col("metres") <= rules.deviation_metres, F.lit(True))
    some = F.max(good.cast("int")).over(Window.partitionBy("mmsi"))
    return closest.withColumns({"good": good, "some": some}).where(F.col("good") | (F.col("some") == 0)).select("mmsi", "cluster_id")


def locked_branches(totals: DataFrame, rules: Prediction = Prediction()) -> DataFrame:
    """(mmsi, locked): the branch whose first predictions have been clearly nearest; null where none is, yet.

    totals: (mmsi, cluster_id, seen, metres), metres being the sum over ``seen`` observations. It takes
    ``lock_observations`` and two branches, the second of them finite and more than ``lock_ratio`` as far.
    """
    by = Window.partitionBy("mmsi").orderBy("metres", "cluster_id")
    ranked = totals.select("mmsi", "cluster_id", "seen", "metres", F.row_number().over(by).alias("rank")).where("rank <= 2")
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    both = ranked.groupBy("mmsi").agg(at(1, "cluster_id").alias("best"), at(1, "metres").alias("d1"), at(2, "metres").alias("d2"), F.max("seen").alias("seen"))
    clear = (F.col("seen") >= rules.lock_observations) & (F.col("d2") < float("inf")) & (F.col("d1") * rules.lock_ratio < F.col("d2"))
    return both.select("mmsi", F.when(clear, F.col("best")).alias("locked"))
