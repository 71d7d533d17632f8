"""Filters on position reports (mmsi, t, lon, lat, sog, cog, heading)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Box, Cleaning, Domain
from ..functions.geo import class_name, number
from .folds import flag_duplicates, flag_jumps


def valid(df: DataFrame) -> DataFrame:
    """Coordinates on the globe, a time, and an identity of nine digits."""
    return df.where(is_valid())


def is_valid() -> Column:
    mmsi = F.expr("try_cast(mmsi AS BIGINT)")
    return F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & F.col("t").isNotNull() & mmsi.between(100000000, 999999999), F.lit(False))


def in_box(box: Box) -> Column:
    """Inside a box, edges included."""
    return F.col("lon").between(box.lon_min, box.lon_max) & F.col("lat").between(box.lat_min, box.lat_max)


def within(df: DataFrame, box: Box) -> DataFrame:
    return df.where(in_box(box))


def speed_range(df: DataFrame, rules: Cleaning = Cleaning()) -> DataFrame:
    """Speeds from least to most, both included; a missing speed is dropped."""
    return df.where(F.col("sog").between(rules.sog_min, rules.sog_max))


def without_sentinels(df: DataFrame, rules: Cleaning = Cleaning()) -> DataFrame:
    """A course of 360 or more and a heading of 511 mean that none is known."""
    out = df.withColumn("cog", F.when(F.col("cog") < rules.cog_unavailable, F.col("cog")))
    return out.withColumn("heading", F.nullif("heading", number(rules.heading_unavailable))) if "heading" in df.columns else out


def course_ok(rules: Cleaning = Cleaning()) -> Column:
    """A course from 0 to below 360; a missing one only where the rules keep it."""
    bad = (F.col("cog") < 0) | (F.col("cog") >= 360)
    return F.coalesce(~bad, F.lit(rules.keep_missing_cog))


def course_rule(df: DataFrame, rules: Cleaning = Cleaning()) -> DataFrame:
    return df.where(course_ok(rules))


def cheap_domain(df: DataFrame, domain: Domain) -> DataFrame:
    """The coarse filter before anything else: box, vessel types, and transceiver classes if any are named."""
    if not domain.active:
        return df
    out = df.where(in_box(domain.box) & F.col("vessel_type").isin(*domain.vessel_types))
    return out.where(class_name(F.col("transceiver_class")).isin(*[c.strip().upper() for c in domain.classes])) if domain.classes else out


def without_jumps(df: DataFrame, rules: Cleaning = Cleaning(), order: tuple[str, ...] = ("t",)) -> DataFrame:
    return flag_jumps(df, rules, order).where("kept").drop("kept")


def without_duplicates(df: DataFrame, rules: Cleaning = Cleaning(), order: tuple[str, ...] = ("t",)) -> DataFrame:
    return flag_duplicates(df, rules, order).where("kept").drop("kept")


def speed_candidates(df: DataFrame, limits: tuple[float, ...]) -> DataFrame:
    """For each limit: rows above it, as a share of all, and their vessels. One pass for all limits."""
    sums = [F.count("*").alias("total")]
    for k, limit in enumerate(limits):
        over = ~F.coalesce((F.col("sog") >= 0) & (F.col("sog") <= limit), F.lit(False))
        sums += [F.count_if(over).alias(f"dropped{k}"), F.count_distinct(F.when(over, F.col("mmsi"))).alias(f"vessels{k}")]
    one = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(float(x)).alias("sog_limit"), F.col(f"dropped{k}").alias("dropped"), F.col(f"vessels{k}").alias("vessels")) for k, x in enumerate(limits)])
    return one.select("total", F.explode(rows).alias("x")).select("x.sog_limit", "x.dropped", (F.col("x.dropped") / F.greatest("total", F.lit(1))).alias("dropped_ratio"), F.col("x.vessels").alias("dropped_vessels"))


def rule_counts(df: DataFrame, rules: Cleaning = Cleaning(), box: Box | None = None) -> DataFrame:
    """Rows left after each row-wise rule, in one pass."""
    bare = df.withColumn("cog", F.when(F.col("cog") < rules.cog_unavailable, F.col("cog")))
    checks = [("after_validity", is_valid()), ("after_box", in_box(box or rules.box)), ("after_speed", F.col("sog").between(rules.sog_min, rules.sog_max)), ("after_course", course_ok(rules))]
    so_far, sums = F.lit(True), [F.count("*").alias("rows_in")]
    for name, check in checks:
        so_far = so_far & F.coalesce(check, F.lit(False))
        sums.append(F.count_if(so_far).alias(name))
    return bare.agg(*sums)


def rowwise(df: DataFrame, rules: Cleaning = Cleaning()) -> DataFrame:
    """The rules on single rows, in their fixed order: validity, box, speed, sentinels, course."""
    return course_rule(without_sentinels(speed_range(within(valid(df), rules.box), rules), rules), rules)


def clean(df: DataFrame, rules: Cleaning = Cleaning(), order: tuple[str, ...] = ("t",)) -> DataFrame:
    """All rules in their fixed order: those on single rows, jumps, near duplicates."""
    return without_duplicates(without_jumps(rowwise(df, rules), rules, order), rules, order)


def all_counts(df: DataFrame, rules: Cleaning = Cleaning(), order: tuple[str, ...] = ("t",)) -> DataFrame:
    """One row: rows left after each rule, jumps and near duplicates among them."""
    steady = flag_jumps(rowwise(df, rules), rules, order).where("kept").drop("kept")
    last = flag_duplicates(steady, rules, order).agg(F.count("*").alias("after_jumps"), F.count_if("kept").alias("after_duplicates"))
    return rule_counts(df, rules).crossJoin(last)  # one row each
