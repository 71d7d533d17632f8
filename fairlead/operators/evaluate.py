"""Errors of predicted tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bearing_error, haversine

FEATURES = ("lon", "lat", "sog", "cog")


def step_errors(predicted: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("traj_id", "step"), strict: bool = False) -> DataFrame:
    """(keys, distance, speed_error, heading_error, square): for steps that both sides have, so the shorter side counts.

    With ``strict`` a step that only one side has is an error, raised when the result is computed.
    """
    truth = actual.select(*keys, *[F.col(c).alias(f"true_{c}") for c in FEATURES], F.lit(True).alias("in truth"))
    both = predicted.select(*keys, *FEATURES, F.lit(True).alias("in guess")).join(truth, list(keys), "full" if strict else "inner")
    if strict:
        known = F.col("in truth") & F.col("in guess")
        both = both.where(F.when(known.isNull(), F.raise_error(F.lit("predicted and actual tracks differ in length")).cast("boolean")).otherwise(known))
    square = sum((F.pow(F.col(c) - F.col(f"true_{c}"), 2) for c in FEATURES), F.lit(0.0)) / len(FEATURES)
    return both.select(
        *keys,
        haversine(F.col("lat"), F.col("lon"), F.col("true_lat"), F.col("true_lon")).alias("distance"),
        F.abs(F.col("sog") - F.col("true_sog")).alias("speed_error"),
        bearing_error(F.col("cog"), F.col("true_cog")).alias("heading_error"),
        square.alias("square"),
    )


def mean(column: str) -> Column:
    """The mean by exact decimal sums, the same in any order of rows and partitions; values that are no decimals are averaged as they are."""
    exact = F.col(column).try_cast("decimal(38,12)")
    return F.when(F.count(exact) == F.count(column), F.sum(exact).cast("double") / F.count(column)).otherwise(F.avg(column))


def by_trajectory(errors: DataFrame, keys: tuple[str, ...] = ("traj_id",), trajectories: DataFrame | None = None) -> DataFrame:
    """Mean and largest errors of each trajectory.

    One without common steps has no row, or, where it is named in ``trajectories`` (keys), a row of NaN.
    """
    found = errors.groupBy(*keys).agg(
        mean("distance").alias("ade"),
        F.max("distance").alias("mde"),
        mean("speed_error").alias("avg_speed_error"),
        F.max("speed_error").alias("max_speed_error"),
        mean("heading_error").alias("avg_heading_error"),
        F.max("heading_error").alias("max_heading_error"),
        (1 / (1 + mean("square"))).alias("norm_space_fit"),
    )
    if trajectories is None:
        return found
    return trajectories.select(*keys).distinct().join(found, list(keys), "left").fillna(float("nan"), [c for c in found.columns if c not in keys])


def by_cluster(reports: DataFrame) -> DataFrame:
    """Means over the trajectories of each route. reports: by_trajectory with a cluster_id."""
    return reports.groupBy("cluster_id").agg(
        F.count("*").alias("n_trajectories"),
        F.avg("ade").alias("ade_mean"),
        F.median("ade").alias("ade_median"),
        F.stddev_pop("ade").alias("ade_std"),
        F.avg("mde").alias("mde_mean"),
        F.max("mde").alias("mde_max"),
        F.avg("avg_speed_error").alias("avg_speed_error_mean"),
        F.avg("max_speed_error").alias("max_speed_error_mean"),
        F.avg("avg_heading_error").alias("avg_heading_error_mean"),
        F.avg("max_heading_error").alias("max_heading_error_mean"),
        F.avg("norm_space_fit").alias("norm_space_fit_mean"),
    )


def markdown(report: dict) -> str:
    """A route's report as a table."""
    lines = [f"# Route {report.get('cluster_id')}", "", "| Measure | Value |", "|---|---|"]
    return "\n".join(lines + [f"| {k} | {v:.6g} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in report.items() if k != "cluster_id"]) + "\n"
