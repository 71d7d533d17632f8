"""Voyages at even intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Resampling
from ..functions.geo import between_bearings


def filled(column: str, keys: list[str], order: tuple[str, ...], last_resort: float | None = 0.0) -> Column:
    """The latest known value, else the next known one, else ``last_resort``."""
    by = Window.partitionBy(*keys).orderBy(*order)
    past = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = [F.last(column, ignorenulls=True).over(past), F.first(column, ignorenulls=True).over(ahead)]
    return F.coalesce(*found, *([] if last_resort is None else [F.lit(last_resort)]))


def resample(df: DataFrame, rules: Resampling = Resampling(), keys: tuple[str, ...] = ("traj_id",), order: tuple[str, ...] = ("t",), carry: tuple[str, ...] = ("mmsi", "direction_label")) -> DataFrame:
    """Positions at the start of each voyage and every ``seconds`` after it, up to its end.

    Every report looks at the next one and makes the grid points between them, so
    no range join is needed. Positions and speeds run straight, courses the shorter
    way round. Voyages of one report or no length give nothing. Columns other than
    ``keys``, ``carry`` and the values go.
    """
    keys_, step = list(keys), F.lit(float(rules.seconds))
    whole, by = Window.partitionBy(*keys_), Window.partitionBy(*keys_).orderBy(*order)
    kept = [c for c in carry if c in df.columns]
    with_heading = rules.heading != "omit" and "heading" in df.columns
    values = ["lon", "lat", "sog", "cog", *(["heading"] if with_heading else [])]
    full = df.select(*keys_, *kept, *order, *values).withColumns({
        "sog": filled("sog", keys_, order),
        "cog": filled("cog", keys_, order),
        **({"heading": filled("heading", keys_, order, None)} if with_heading else {}),
        "t0": F.min("t").over(whole),
        "t_end": F.max("t").over(whole),
        "t_next": F.lead("t").over(by),
        "t_last": F.lag("t").over(by),
        **{c: F.first(c).over(by) for c in kept},
    })
    full = full.withColumns({f"{v}_next": F.lead(v).over(by) for v in values})
    # The interval [t, t_next) owns its grid points; the last one with a length also the end of the voyage.
    low = F.ceil((F.col("t") - F.col("t0")) / step - F.lit(1e-12)).cast("long")
    closes = F.col("t_next") == F.col("t_end")
    exact = F.floor((F.col("t_next") - F.col("t0")) / step + F.lit(1e-12)).cast("long")
    before = F.when(F.col("t0") + exact * step >= F.col("t_next"), exact - 1).otherwise(exact)
    high = F.when(closes, F.floor((F.col("t_end") - F.col("t0")) / step + F.lit(1e-12)).cast("long")).otherwise(before)
    spans = full.where((F.col("t_next") > F.col("t")) & (F.col("t_end") > F.col("t0")))
    grid = spans.withColumns({"low": low, "high": high}).where("high >= low").withColumn("k", F.explode(F.sequence("low", "high")))
    grid = grid.withColumn("at", F.col("t0") + F.col("k") * step).withColumn("share", (F.col("at") - F.col("t")) / (F.col("t_next") - F.col("t")))
    straight = lambda v: F.col(v) + F.col("share") * (F.col(f"{v}_next") - F.col(v))
    out = [*keys_, *kept, F.col("at").alias("t"), *[straight(v).alias(v) for v in ("lon", "lat", "sog")], between_bearings(F.col("cog"), F.col("cog_next"), F.col("share")).alias("cog")]
    if with_heading:
        out.append((between_bearings(F.col("heading"), F.col("heading_next"), F.col("share")) if rules.heading == "circular" else F.col("heading")).alias("heading"))
    return grid.select(*out)


def resample_intervals(df: DataFrame, rules: Resampling = Resampling(), **more) -> DataFrame:
    """The same for each distinct interval of the ablation, with a column ``interval_sec``."""
    parts = [resample(df, Resampling(seconds=s, heading=rules.heading), **more).withColumn("interval_sec", F.lit(float(s))) for s in sorted(set(rules.ablation))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def at_least(df: DataFrame, points: int = 2, keys: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """Only voyages that still have so many points."""
    size = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("points", size).where(F.col("points") >= points).drop("points")
