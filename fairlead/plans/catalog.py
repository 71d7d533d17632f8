"""All queries on trajectories by name, and their SQL."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Berth, Box, Cleaning, Clustering, Domain, Prediction, Resampling, Settings, Training, Voyages
from ..functions import geo
from ..functions.dtw import dtw_column
from ..operators import clean, cluster, evaluate, folds, learn, lstm, match, pairs, resample, spatial, voyage
from ..operators.components import forget, settle, shared_folder
from ..sources import live
from ..sources import reports as report_files
from ..streaming.vessel import replay
from . import offline
from .views import PATH_POINTS_SQL, haversine_sql, paths, positions, positions_sql, table

ORDER = ("t", "event_id")
HALF = Box(-118.4, 33.5, -118.1, 33.75)
DOMAIN = Domain(enabled=True, box=HALF, classes=("A", "b"))
ANY_BOX = dataclasses.replace(Cleaning(), box=Box(-119, 33, -117, 35))
SQUARE = [[(-118.4, 33.5), (-118.1, 33.5), (-118.1, 33.75), (-118.4, 33.75), (-118.4, 33.5)]]
WITH_HOLE = [SQUARE[0], [(-118.3, 33.55), (-118.2, 33.55), (-118.2, 33.7), (-118.3, 33.7), (-118.3, 33.55)]]
TRIANGLE = [[(-118.45, 33.46), (-118.05, 33.5), (-118.2, 33.8), (-118.45, 33.46)]]
CHANNELS = [("west", [(-118.4, 33.5), (-118.3, 33.6), (-118.2, 33.6)]), ("east", [(-118.15, 33.7), (-118.1, 33.8)])]
JUNCTIONS = [
    {"id": "J1", "lon": -118.3, "lat": 33.6, "radius_m": 5000, "cluster_ids": [0, 1, 2]},
    {"id": "J2", "lon": -118.28, "lat": 33.62, "radius_m": 8000, "cluster_ids": [3, 4]},
    {"id": "broken"},
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def on(scale: float, body: str) -> str:
    return f"WITH RECURSIVE p AS ({positions_sql(scale)})" + body


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, as both engines may differ in the last bits."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def rounded_length(length: Column, digits: int = 6) -> Column:
    """A number that is not negative to so many digits, as ``round`` in SQL, without the decimal number that Spark makes for each row."""
    power = F.lit(10.0**digits)
    return F.when(length * power < F.lit(float(1 << 52)), F.floor(length * power + F.lit(0.5)) / power).otherwise(length)


# Filters and projections


@query(on(1, " SELECT event_id, mmsi FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND t IS NOT NULL AND mmsi BETWEEN 100000000 AND 999999999"))
def basic_validity(spark, sf_dir):
    return clean.valid(positions(spark, sf_dir)).select("event_id", "mmsi")


@query(on(100, " SELECT event_id FROM p WHERE lon BETWEEN -118.4 AND -118.1 AND lat BETWEEN 33.5 AND 33.75"))
def geo_range(spark, sf_dir):
    return clean.within(positions(spark, sf_dir, 100), HALF).select("event_id")


@query(on(1, " SELECT event_id, sog FROM p WHERE sog BETWEEN 0 AND 3.5"))
def sog_range(spark, sf_dir):
    return clean.speed_range(positions(spark, sf_dir), Cleaning(sog_max=3.5)).select("event_id", "sog")


@query(on(1, " SELECT event_id, CASE WHEN cog < 360 THEN cog END AS cog, nullif(heading, 511) AS heading FROM p"))
def cog_sentinel(spark, sf_dir):
    return clean.without_sentinels(positions(spark, sf_dir)).select("event_id", "cog", "heading")


@query(on(1, " SELECT event_id, cog FROM p WHERE cog >= 0 AND cog < 360"))
def cog_rule(spark, sf_dir):
    return clean.course_rule(positions(spark, sf_dir), Cleaning(keep_missing_cog=False)).select("event_id", "cog")


@query(on(1, """, l AS (SELECT unnest([3.0::DOUBLE, 5.0::DOUBLE, 8.0::DOUBLE]) AS sog_limit)
    SELECT sog_limit, count(*) FILTER (sog < 0 OR sog > sog_limit OR sog IS NULL) AS dropped,
           round(count(*) FILTER (sog < 0 OR sog > sog_limit OR sog IS NULL)::DOUBLE / greatest(count(*), 1), 6) AS dropped_ratio,
           count(DISTINCT CASE WHEN sog < 0 OR sog > sog_limit OR sog IS NULL THEN mmsi END) AS dropped_vessels
    FROM p, l GROUP BY sog_limit"""))  # fmt: skip
def sog_candidates(spark, sf_dir):
    return rounded(clean.speed_candidates(positions(spark, sf_dir), (3.0, 5.0, 8.0)))


@query(on(100, """, q AS (SELECT *, mmsi BETWEEN 100000000 AND 999999999 AS a, lon BETWEEN -118.4 AND -118.1 AND lat BETWEEN 33.5 AND 33.75 AS b,
        sog BETWEEN 0 AND 8 AS c, NOT coalesce(CASE WHEN cog < 360 THEN cog END < 0, false) AS d FROM p)
    SELECT count(*) AS rows_in, count(*) FILTER (a) AS after_validity, count(*) FILTER (a AND b) AS after_box,
           count(*) FILTER (a AND b AND c) AS after_speed, count(*) FILTER (a AND b AND c AND d) AS after_course FROM q"""))  # fmt: skip
def filter_stats(spark, sf_dir):
    return clean.rule_counts(positions(spark, sf_dir, 100), Cleaning(sog_max=8.0), HALF)


@query(on(100, " SELECT event_id FROM p WHERE lon BETWEEN -118.4 AND -118.1 AND lat BETWEEN 33.5 AND 33.75 AND vessel_type BETWEEN 70 AND 89 AND upper(trim(transceiver_class)) IN ('A', 'B')"))
def domain_filter(spark, sf_dir):
    return clean.cheap_domain(positions(spark, sf_dir, 100), DOMAIN).select("event_id")


IN_SQUARE = "(lon BETWEEN -118.4 AND -118.1 AND lat BETWEEN 33.5 AND 33.75)"
IN_HOLE = "(lon > -118.3 AND lon < -118.2 AND lat > 33.55 AND lat < 33.7)"


def edge_sql(a, b):
    (x0, y0), (x1, y1) = a, b
    return f"CASE WHEN ({y0} > lat) <> ({y1} > lat) AND lon < ({x1}::DOUBLE - {x0}::DOUBLE) * (lat - {y0}::DOUBLE) / ({y1}::DOUBLE - {y0}::DOUBLE) + {x0}::DOUBLE THEN 1 ELSE 0 END"


IN_TRIANGLE = "((" + " + ".join(edge_sql(a, b) for a, b in zip(TRIANGLE[0], TRIANGLE[0][1:])) + ") % 2 = 1)"


@query(on(100, f" SELECT event_id FROM p WHERE {IN_TRIANGLE}"))
def polygon_filter(spark, sf_dir):
    return spatial.inside(positions(spark, sf_dir, 100), [TRIANGLE]).select("event_id")


@query(on(100, f" SELECT event_id FROM p WHERE NOT ({IN_SQUARE} AND NOT {IN_HOLE})"))
def exclusion_filter(spark, sf_dir):
    return spatial.outside(positions(spark, sf_dir, 100), [WITH_HOLE]).select("event_id")


@query(on(100, f" SELECT event_id FROM p WHERE {IN_TRIANGLE} AND {IN_SQUARE} AND NOT (lon BETWEEN -118.3 AND -118.2 AND lat BETWEEN 33.55 AND 33.7)"))
def domain_polygons(spark, sf_dir):
    return spatial.domain_polygons(positions(spark, sf_dir, 100), outer=[TRIANGLE], inner=[SQUARE], terminals=[[WITH_HOLE[1]]]).select("event_id")


SEGMENTS_SQL = "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for n, line in CHANNELS for a, b in zip(line, line[1:])) + ") v(channel_id, lon0, lat0, lon1, lat1))"
CHANNEL_METRES_SQL = f"""{SEGMENTS_SQL}, d AS (SELECT event_id, channel_id, min({haversine_sql('lat', 'lon', 'lat0 + k / 20.0::DOUBLE * (lat1 - lat0)', 'lon0 + k / 20.0::DOUBLE * (lon1 - lon0)')}) AS metres
    FROM p, s, (SELECT unnest(range(21)) AS k) GROUP BY event_id, channel_id)"""


@query(on(100, f", {CHANNEL_METRES_SQL} SELECT event_id, channel_id, round(metres, 4) AS metres FROM d"))
def centerline_distance(spark, sf_dir):
    return rounded(spatial.channel_distances(positions(spark, sf_dir, 100).select("event_id", "lon", "lat"), spatial.channel_segments(spark, CHANNELS), "event_id"), 4)


@query(on(100, f", {CHANNEL_METRES_SQL} SELECT event_id, channel_id FROM d WHERE metres <= 3000"))
def near_channels(spark, sf_dir):
    return spatial.channels_near(positions(spark, sf_dir, 100).select("event_id", "lon", "lat"), spatial.channel_segments(spark, CHANNELS), "event_id", 3000.0)


@query(on(100, f""" SELECT event_id, CASE WHEN {haversine_sql('lat', 'lon', '33.6::DOUBLE', '-118.3::DOUBLE')} <= 5000 THEN 'J1'
    WHEN {haversine_sql('lat', 'lon', '33.62::DOUBLE', '-118.28::DOUBLE')} <= 8000 THEN 'J2' END AS junction_id FROM p"""))  # fmt: skip
def junction_lookup(spark, sf_dir):
    return spatial.junction_of(positions(spark, sf_dir, 100).select("event_id", "lon", "lat"), spatial.junction_table(spark, JUNCTIONS), "event_id").select("event_id", "junction_id")


# Folds along a vessel's reports

NUMBERED = ", o AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t, event_id) AS i FROM p)"


def jump_sql(knots: float) -> str:
    """Rows ``o`` with ``kept``, as relation ``w``."""
    jump = f"(n.t - w.kt <= 0 OR {haversine_sql('w.klat', 'w.klon', 'n.lat', 'n.lon')} / (n.t - w.kt) > {knots}::DOUBLE * 0.5144::DOUBLE * 1.5::DOUBLE)"
    return f""", w AS (
    SELECT mmsi, i, event_id, true AS kept, t AS kt, lon AS klon, lat AS klat FROM o WHERE i = 1
    UNION ALL
    SELECT n.mmsi, n.i, n.event_id, NOT {jump}, CASE WHEN {jump} THEN w.kt ELSE n.t END, CASE WHEN {jump} THEN w.klon ELSE n.lon END, CASE WHEN {jump} THEN w.klat ELSE n.lat END
    FROM w JOIN o n ON n.mmsi = w.mmsi AND n.i = w.i + 1)"""


JUMP_SQL = NUMBERED + jump_sql(25.0)
#: All rules one after another: ``q`` by row, ``w`` without jumps, ``d`` with the near duplicates marked.
CLEAN_SQL = f""", q AS (SELECT event_id, mmsi, t, lon, lat, CASE WHEN cog < 360 THEN cog END AS cog FROM p WHERE lon BETWEEN -119 AND -117 AND lat BETWEEN 33 AND 35 AND t IS NOT NULL
        AND mmsi BETWEEN 100000000 AND 999999999 AND sog BETWEEN 0 AND 20 AND coalesce(cog >= 0, true)),
    o AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t, event_id) AS i FROM q){jump_sql(20.0)},
    s AS (SELECT o.*, row_number() OVER (PARTITION BY o.mmsi ORDER BY o.i) AS j FROM o JOIN w ON w.mmsi = o.mmsi AND w.i = o.i WHERE w.kept),
    d AS (SELECT mmsi, j, event_id, cog, true AS kept, t AS kt FROM s WHERE j = 1
        UNION ALL SELECT n.mmsi, n.j, n.event_id, n.cog, n.t - d.kt >= 1, CASE WHEN n.t - d.kt >= 1 THEN n.t ELSE d.kt END FROM d JOIN s n ON n.mmsi = d.mmsi AND n.j = d.j + 1)"""


@query(on(10, f"{JUMP_SQL} SELECT event_id, mmsi FROM w WHERE kept"))
def jump_filter(spark, sf_dir):
    return clean.without_jumps(positions(spark, sf_dir, 10), order=ORDER).select("event_id", "mmsi")


@query(on(1, f"""{NUMBERED}, w AS (SELECT mmsi, i, event_id, true AS kept, t AS kt FROM o WHERE i = 1
    UNION ALL SELECT n.mmsi, n.i, n.event_id, n.t - w.kt >= 600, CASE WHEN n.t - w.kt >= 600 THEN n.t ELSE w.kt END FROM w JOIN o n ON n.mmsi = w.mmsi AND n.i = w.i + 1)
    SELECT event_id, mmsi FROM w WHERE kept"""))  # fmt: skip
def near_duplicate(spark, sf_dir):
    return clean.without_duplicates(positions(spark, sf_dir), Cleaning(duplicate_seconds=600.0), ORDER).select("event_id", "mmsi")


TWENTY = dataclasses.replace(ANY_BOX, sog_max=20.0)


@query(on(10, f"{CLEAN_SQL} SELECT event_id, mmsi, cog FROM d WHERE kept"))
def clean_all(spark, sf_dir):
    return clean.clean(positions(spark, sf_dir, 10), TWENTY, ORDER).select("event_id", "mmsi", "cog")


@query(on(10, f"""{CLEAN_SQL} SELECT (SELECT count(*) FROM p) AS rows_in, (SELECT count(*) FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND t IS NOT NULL AND mmsi BETWEEN 100000000 AND 999999999) AS after_validity,
    (SELECT count(*) FROM p WHERE lon BETWEEN -119 AND -117 AND lat BETWEEN 33 AND 35 AND t IS NOT NULL AND mmsi BETWEEN 100000000 AND 999999999) AS after_box,
    (SELECT count(*) FROM p WHERE lon BETWEEN -119 AND -117 AND lat BETWEEN 33 AND 35 AND t IS NOT NULL AND mmsi BETWEEN 100000000 AND 999999999 AND sog BETWEEN 0 AND 20) AS after_speed,
    (SELECT count(*) FROM q) AS after_course, (SELECT count(*) FROM s) AS after_jumps, (SELECT count(*) FROM d WHERE kept) AS after_duplicates"""))  # fmt: skip
def clean_counts(spark, sf_dir):
    return clean.all_counts(positions(spark, sf_dir, 10), TWENTY, ORDER)


SLOW = Berth(knots=5.0)
#: From every row the last row of its stretch; stretches that count are then taken one after another.
BERTH_SQL = f"""{NUMBERED}, brk AS (
    SELECT a.mmsi, a.i, min(b.i) AS stop FROM o a JOIN o b ON a.mmsi = b.mmsi AND b.i > a.i
    WHERE {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} >= 50 OR coalesce(b.sog >= 5, false) OR coalesce(a.sog >= 5, false) GROUP BY a.mmsi, a.i),
    n AS (SELECT mmsi, max(i) AS n FROM o GROUP BY mmsi),
    e AS (SELECT o.mmsi, o.i, coalesce(brk.stop, n.n + 1) AS j, z.t - o.t > 1800 AS long FROM o JOIN n ON n.mmsi = o.mmsi LEFT JOIN brk ON brk.mmsi = o.mmsi AND brk.i = o.i
          JOIN o z ON z.mmsi = o.mmsi AND z.i = coalesce(brk.stop, n.n + 1) - 1),
    w AS (SELECT mmsi, i, j, long FROM e WHERE i = 1 UNION ALL SELECT e.mmsi, e.i, e.j, e.long FROM w JOIN e ON e.mmsi = w.mmsi AND e.i = CASE WHEN w.long THEN w.j ELSE w.i + 1 END),
    m AS (SELECT o.mmsi, o.i, o.event_id, bool_or(coalesce(w.long, false)) AS in_berth FROM o LEFT JOIN w ON w.mmsi = o.mmsi AND w.long AND o.i >= w.i AND o.i < w.j GROUP BY ALL)"""


@query(on(1, f"""{BERTH_SQL}, g AS (SELECT mmsi, i - 1 AS r, i - row_number() OVER (PARTITION BY mmsi ORDER BY i) AS run FROM m WHERE in_berth)
    SELECT mmsi, min(r) AS first_row, max(r) AS last_row FROM g GROUP BY mmsi, run"""))  # fmt: skip
def berth_segments(spark, sf_dir):
    return folds.berth_segments(positions(spark, sf_dir), SLOW, ORDER)


@query(on(1, f"{BERTH_SQL} SELECT event_id, mmsi FROM m WHERE NOT in_berth"))
def berth_remove(spark, sf_dir):
    return folds.flag_berths(positions(spark, sf_dir), SLOW, ORDER).where("NOT in_berth").select("event_id", "mmsi")


@query(on(100, f""" SELECT event_id, {IN_SQUARE} AND coalesce(sog <= 3, false) AS is_terminal_dwell, {IN_TRIANGLE} AND coalesce(sog <= 3, false) AS is_anchorage_wait,
    {IN_SQUARE} AND NOT {IN_HOLE} AND coalesce(sog <= 4, false) AS is_channel_low_speed FROM p"""))  # fmt: skip
def berth_label(spark, sf_dir):
    return spatial.label_berths(positions(spark, sf_dir, 100), [SQUARE], [TRIANGLE], [WITH_HOLE]).select("event_id", "is_terminal_dwell", "is_anchorage_wait", "is_channel_low_speed")


# Voyages

SPLIT = ", s AS (SELECT *, CASE WHEN t - lag(t) OVER w > 7200 THEN 1 ELSE 0 END AS cut FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY t, event_id)), v AS (SELECT *, (sum(cut) OVER (PARTITION BY mmsi ORDER BY t, event_id))::INTEGER AS voyage FROM s)"
LONG = SPLIT + ", c AS (SELECT *, count(*) OVER (PARTITION BY mmsi, voyage) AS n FROM v), g AS (SELECT *, dense_rank() OVER (ORDER BY mmsi, voyage) - 1 AS traj_id FROM c WHERE n >= 20)"


def voyages(spark, sf_dir, scale=1.0) -> DataFrame:
    return voyage.split_voyages(positions(spark, sf_dir, scale), order=ORDER)


def trajectories(spark, sf_dir, scale=1.0) -> DataFrame:
    """Long voyages with their numbers."""
    return voyage.number_voyages(voyage.long_enough(voyages(spark, sf_dir, scale)))


@query(on(1, f"""{SPLIT}, l AS (SELECT *, coalesce({haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS leg FROM v WINDOW w AS (PARTITION BY mmsi, voyage ORDER BY t, event_id))
    SELECT mmsi, voyage, count(*) AS points, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end, round(sum(leg), 4) AS metres FROM l GROUP BY mmsi, voyage"""))  # fmt: skip
def voyage_split(spark, sf_dir):
    found = voyage.summaries(voyages(spark, sf_dir), ORDER)
    return found.select("mmsi", "voyage", "points", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), F.round("metres", 4).alias("metres"))


@query(on(1, f"{SPLIT}, z AS (SELECT mmsi, voyage, count(*) AS n FROM v GROUP BY ALL) SELECT count(*) AS voyages, count(*) FILTER (n < 20) AS short_voyages, round(count(*) FILTER (n < 20)::DOUBLE / greatest(count(*), 1), 6) AS short_ratio FROM z"))
def short_voyage(spark, sf_dir):
    return rounded(voyage.short_voyages(voyages(spark, sf_dir)))


@query(on(1, f"{LONG} SELECT event_id, traj_id FROM g"))
def traj_ids(spark, sf_dir):
    return trajectories(spark, sf_dir).select("event_id", "traj_id")


ENDS_SQL = "x AS (SELECT traj_id, arg_min(lon, (t, event_id)) AS s_lon, arg_min(lat, (t, event_id)) AS s_lat, arg_max(lon, (t, event_id)) AS e_lon, arg_max(lat, (t, event_id)) AS e_lat FROM g GROUP BY traj_id)"
SEA = "(-118.4::DOUBLE - 0.02::DOUBLE)"


@query(on(100, f"""{SPLIT}, x AS (SELECT mmsi, voyage, arg_min(lon, (t, event_id)) AS a, arg_min(lat, (t, event_id)) AS c, arg_max(lon, (t, event_id)) AS b, arg_max(lat, (t, event_id)) AS d FROM v GROUP BY ALL)
    SELECT mmsi, voyage, CASE WHEN b > a + 1e-4::DOUBLE AND abs(a - {SEA}) < abs(b - {SEA}) THEN 'inbound' WHEN a > b + 1e-4::DOUBLE AND abs(b - {SEA}) < abs(a - {SEA}) THEN 'outbound'
    WHEN a BETWEEN -118.4 AND -118.1 AND b BETWEEN -118.4 AND -118.1 AND c BETWEEN 33.5 AND 33.75 AND d BETWEEN 33.5 AND 33.75 AND abs(b - a) < 1e-3::DOUBLE THEN 'intra-harbor' ELSE 'unknown' END AS direction_label FROM x"""))  # fmt: skip
def direction_label(spark, sf_dir):
    return voyage.label_directions(voyages(spark, sf_dir, 100), DOMAIN, ORDER)


@query(on(1, f"{LONG}, {ENDS_SQL} SELECT * FROM x"))
def endpoints(spark, sf_dir):
    return voyage.ends(trajectories(spark, sf_dir), ["traj_id"], ORDER)


@query(on(1, " SELECT event_id, mmsi, row_number() OVER (PARTITION BY mmsi ORDER BY t, event_id) AS place FROM p"))
def stable_sort(spark, sf_dir):
    from pyspark.sql import Window

    return positions(spark, sf_dir).select("event_id", "mmsi", F.row_number().over(Window.partitionBy("mmsi").orderBy(*ORDER)).cast("long").alias("place"))


# Resampling


def resample_sql(seconds: float, heading: str = "omit", prefix: str = LONG) -> str:
    fill = lambda c: f"coalesce(last_value({c} IGNORE NULLS) OVER past, first_value({c} IGNORE NULLS) OVER ahead{'' if c == 'heading' else ', 0'}) AS {c}"
    turn = lambda c: f"({c}_b - {c}_a + CASE WHEN {c}_b - {c}_a > 180 THEN -360 WHEN {c}_b - {c}_a < -180 THEN 360 ELSE 0 END)"
    around = lambda c: f"(({c}_a + share * {turn(c)}) % 360 + 360) % 360"
    head = {"omit": "", "circular": f", round({around('heading')}, 5) AS heading", "forward_fill": ", round(heading_a, 5) AS heading"}[heading]
    return f"""{prefix}, b AS (SELECT traj_id, mmsi, event_id, t, lon, lat, sog, CASE WHEN cog < 360 THEN cog END AS cog, nullif(heading, 511) AS heading FROM g),
    f AS (SELECT traj_id, mmsi, event_id, t, lon, lat, {fill('sog')}, {fill('cog')}, {fill('heading')} FROM b
        WINDOW past AS (PARTITION BY traj_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), ahead AS (PARTITION BY traj_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    d AS (SELECT *, lead(t) OVER w AS t_b, lead(lon) OVER w AS lon_b, lead(lat) OVER w AS lat_b, lead(sog) OVER w AS sog_b, cog AS cog_a, lead(cog) OVER w AS cog_b, heading AS heading_a, lead(heading) OVER w AS heading_b
        FROM f WINDOW w AS (PARTITION BY traj_id ORDER BY t, event_id)),
    z AS (SELECT traj_id, min(t) AS t0, max(t) AS t1 FROM g GROUP BY traj_id),
    k AS (SELECT traj_id, t0, t1, t0 + unnest(range(0, (floor((t1 - t0) / {seconds}) + 1)::BIGINT)) * {seconds}::DOUBLE AS gt FROM z WHERE t1 > t0),
    j AS (SELECT k.traj_id, d.mmsi, k.gt, (k.gt - d.t) / (d.t_b - d.t) AS share, d.* EXCLUDE (traj_id, mmsi) FROM k JOIN d ON d.traj_id = k.traj_id AND d.t_b > d.t AND k.gt >= d.t AND (k.gt < d.t_b OR (k.gt = k.t1 AND d.t_b = k.t1)) WHERE k.gt <= k.t1),
    r AS (SELECT traj_id, mmsi, round(gt, 4) AS t, round(lon + share * (lon_b - lon), 8) AS lon, round(lat + share * (lat_b - lat), 8) AS lat, round(sog + share * (sog_b - sog), 6) AS sog, round({around('cog')}, 5) AS cog{head} FROM j)"""


def shown(df: DataFrame) -> DataFrame:
    digits = {"t": 4, "lon": 8, "lat": 8, "sog": 6, "cog": 5, "heading": 5}
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def bare(spark, sf_dir) -> DataFrame:
    return clean.without_sentinels(trajectories(spark, sf_dir))


@query(on(1, resample_sql(120) + " SELECT * FROM r"))
def resample_120(spark, sf_dir):
    return shown(resample.resample(bare(spark, sf_dir), order=ORDER))


@query(on(1, resample_sql(60) + " SELECT * FROM r"))
def resample_60(spark, sf_dir):
    return shown(resample.resample(bare(spark, sf_dir), Resampling(seconds=60.0), order=ORDER))


@query(on(1, resample_sql(60) + " SELECT 60.0::DOUBLE AS interval_sec, traj_id, count(*) AS points FROM r GROUP BY ALL UNION ALL SELECT 120.0::DOUBLE, traj_id, count(*) FROM (WITH RECURSIVE p AS (" + positions_sql(1) + ")" + resample_sql(120) + " SELECT * FROM r) GROUP BY ALL"))
def resample_ablation(spark, sf_dir):
    return resample.resample_intervals(bare(spark, sf_dir), order=ORDER).groupBy("interval_sec", "traj_id").agg(F.count("*").alias("points"))


@query(on(1, resample_sql(120, "circular") + " SELECT * FROM r"))
def heading_circular(spark, sf_dir):
    return shown(resample.resample(bare(spark, sf_dir), Resampling(heading="circular"), order=ORDER))


@query(on(1, resample_sql(120, "forward_fill") + " SELECT * FROM r"))
def heading_forward(spark, sf_dir):
    return shown(resample.resample(bare(spark, sf_dir), Resampling(heading="forward_fill"), order=ORDER))


# Scalar functions

LAGS = ", l AS (SELECT event_id, lat, lon, t, cog, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(t) OVER w AS t0, lag(cog) OVER w AS cog0 FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY t, event_id))"


def lags(spark, sf_dir, scale=10.0):
    from pyspark.sql import Window

    w = Window.partitionBy("mmsi").orderBy(*ORDER)
    return positions(spark, sf_dir, scale).select("event_id", "lat", "lon", "t", "cog", *[F.lag(c).over(w).alias(f"{c}0") for c in ("lat", "lon", "t", "cog")])


@query(on(10, f"{LAGS} SELECT event_id, round({haversine_sql('lat0', 'lon0', 'lat', 'lon')}, 4) AS metres FROM l"))
def haversine(spark, sf_dir):
    return lags(spark, sf_dir).select("event_id", F.round(geo.haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 4).alias("metres"))


@query(on(10, f"{LAGS} SELECT event_id, round({haversine_sql('lat0', 'lon0', 'lat', 'lon')} / (t - t0), 4) AS speed FROM l WHERE t > t0"))
def implied_speed(spark, sf_dir):
    d = geo.haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return lags(spark, sf_dir).where("t > t0").select("event_id", F.round(geo.implied_speed(d, F.col("t") - F.col("t0")), 4).alias("speed"))


@query(on(10, f"""{LAGS} SELECT event_id, round(((cog % 360) + 360) % 360, 6) AS bearing, round(least(abs(cog - cog0) % 360, 360 - abs(cog - cog0) % 360), 6) AS error,
    round(((cog0 + 0.25::DOUBLE * (cog - cog0 + CASE WHEN cog - cog0 > 180 THEN -360 WHEN cog - cog0 < -180 THEN 360 ELSE 0 END)) % 360 + 360) % 360, 6) AS between, round(sqrt((lon - lon0) * (lon - lon0) + (lat - lat0) * (lat - lat0)), 8) AS degrees FROM l"""))  # fmt: skip
def bearings(spark, sf_dir):
    c, c0 = F.col("cog"), F.col("cog0")
    degrees = geo.planar(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    return lags(spark, sf_dir).select("event_id", F.round(geo.bearing(c), 6).alias("bearing"), F.round(geo.bearing_error(c, c0), 6).alias("error"), F.round(geo.between_bearings(c0, c, F.lit(0.25)), 6).alias("between"), F.round(degrees, 8).alias("degrees"))


CURVE_SQL = f"""WITH x AS ({PATH_POINTS_SQL}), l AS (SELECT *, {haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS leg, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0 FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
    c AS (SELECT vec_id, sum(leg) AS len, max(CASE WHEN k = 31 THEN {haversine_sql('lat0', 'lon0', 'lat', 'lon')} END) AS chord FROM l GROUP BY vec_id), q AS (SELECT vec_id, CASE WHEN chord < 1e-6 THEN 1 ELSE greatest(1, len / chord) END AS curvature FROM c)"""


@query(f"{CURVE_SQL} SELECT vec_id, round(curvature, 6) AS curvature FROM q")
def curvature(spark, sf_dir):
    return paths(spark, sf_dir).select("vec_id", F.round(geo.curvature(F.col("path")), 6).alias("curvature"))


def curve_steps(values) -> str:
    return "CASE " + " ".join(f"WHEN c < {b} THEN {v}" for b, v in values[:-1]) + f" ELSE {values[-1][1]} END"


@query(f"{CURVE_SQL}, z AS (SELECT vec_id, 1 + (curvature % 2) AS c FROM q) SELECT vec_id, {curve_steps(Training().steps)} AS steps, {curve_steps(Training().width)} AS width FROM z")
def curvature_to_size(spark, sf_dir):
    bent = paths(spark, sf_dir).select("vec_id", (F.lit(1.0) + geo.curvature(F.col("path")) % 2).alias("c"))
    return bent.select("vec_id", geo.stepwise(F.col("c"), Training().steps).alias("steps"), geo.stepwise(F.col("c"), Training().width).alias("width"))


# Manifests


@query("SELECT cast(cast(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS vessels FROM events GROUP BY 1")
def day_manifest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return report_files.manifest(e, F.to_date("ts").cast("string").alias("day"), "ts", "user_id").select("day", "rows", "first_ts", "last_ts", "vessels")


@query(on(1, " SELECT 'transceiver_class' AS column_name, transceiver_class AS value, count(*) AS rows FROM p GROUP BY 2 UNION ALL SELECT 'vessel_type', vessel_type::VARCHAR, count(*) FROM p GROUP BY 2"))
def value_counts(spark, sf_dir):
    return report_files.value_counts(positions(spark, sf_dir), ["transceiver_class", "vessel_type"])


@query("""WITH d AS (SELECT cast(ts AS DATE) AS day, count(*) AS size FROM events GROUP BY 1), l AS (SELECT day, size FROM d WHERE dayofmonth(day) % 2 = 0 UNION ALL SELECT day, size + 1 FROM d WHERE dayofmonth(day) % 3 = 0 AND dayofmonth(day) % 2 <> 0)
    SELECT cast(day AS VARCHAR) AS day, size FROM d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.day = d.day AND l.size = d.size)""")  # fmt: skip
def incremental_antijoin(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("size"))
    ledger = days.where(F.dayofmonth("day") % 2 == 0).union(days.where((F.dayofmonth("day") % 3 == 0) & (F.dayofmonth("day") % 2 != 0)).select("day", F.col("size") + 1))
    return report_files.not_ingested(days, ledger, ["day", "size"]).select(F.col("day").cast("string").alias("day"), "size")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def ndjson_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", live.parsed(F.col("props"), "k BIGINT")["k"].alias("k"))


# Clusters


def end_points(spark, sf_dir, which: str) -> DataFrame:
    found = voyage.ends(voyages(spark, sf_dir, 3).withColumn("pos", F.col("mmsi") * 100000 + F.col("voyage")), ["pos"], ORDER)
    return found.select("pos", F.col(f"{which}_lon").alias("x"), F.col(f"{which}_lat").alias("y"))


POS_SQL = SPLIT + ", x AS (SELECT mmsi * 100000 + voyage AS pos, arg_min(lon, (t, event_id)) AS s_lon, arg_min(lat, (t, event_id)) AS s_lat, arg_max(lon, (t, event_id)) AS e_lon, arg_max(lat, (t, event_id)) AS e_lat FROM v GROUP BY mmsi, voyage)"


def dbscan_sql(which: str, n: str) -> str:
    return f""", n{n} AS (SELECT a.pos, b.pos AS near FROM x a JOIN x b ON sqrt((a.{which}_lon - b.{which}_lon) * (a.{which}_lon - b.{which}_lon) + (a.{which}_lat - b.{which}_lat) * (a.{which}_lat - b.{which}_lat)) <= 0.001::DOUBLE),
    c{n} AS (SELECT pos FROM n{n} GROUP BY pos HAVING count(*) >= 5),
    e{n} AS (SELECT n{n}.pos, near FROM n{n} SEMI JOIN c{n} ON c{n}.pos = n{n}.pos SEMI JOIN c{n} c2 ON c2.pos = n{n}.near),
    r{n} AS (SELECT pos, pos AS root FROM c{n} UNION SELECT e{n}.near, r{n}.root FROM r{n} JOIN e{n} ON e{n}.pos = r{n}.pos WHERE r{n}.root < e{n}.near OR true),
    m{n} AS (SELECT pos, min(root) AS root FROM r{n} GROUP BY pos), k{n} AS (SELECT pos, dense_rank() OVER (ORDER BY root) - 1 AS label FROM m{n}),
    l{n} AS (SELECT x.pos, coalesce(min(own.label), min(k{n}.label), -1)::INTEGER AS label FROM x LEFT JOIN n{n} ON n{n}.pos = x.pos LEFT JOIN k{n} ON k{n}.pos = n{n}.near LEFT JOIN k{n} own ON own.pos = x.pos GROUP BY x.pos)"""


@query(on(3, POS_SQL + dbscan_sql("s", "1") + " SELECT * FROM l1"))
def dbscan_start(spark, sf_dir):
    return cluster.dbscan(end_points(spark, sf_dir, "s"))


@query(on(3, POS_SQL + dbscan_sql("e", "1") + " SELECT * FROM l1"))
def dbscan_end(spark, sf_dir):
    return cluster.dbscan(end_points(spark, sf_dir, "e"))


@query(on(3, POS_SQL + dbscan_sql("s", "1") + dbscan_sql("e", "2") + " SELECT l1.pos, CASE WHEN l1.label = -1 OR l2.label = -1 THEN -1 ELSE l1.label END AS s_label, CASE WHEN l1.label = -1 OR l2.label = -1 THEN -1 ELSE l2.label END AS e_label FROM l1 JOIN l2 ON l1.pos = l2.pos"))
def initial_groups(spark, sf_dir):
    return cluster.initial_groups(cluster.dbscan(end_points(spark, sf_dir, "s")), cluster.dbscan(end_points(spark, sf_dir, "e")))


PATH_LISTS = f"WITH RECURSIVE pts AS ({PATH_POINTS_SQL}), l AS (SELECT vec_id, label, list(lon ORDER BY k) AS xs, list(lat ORDER BY k) AS ys FROM pts GROUP BY vec_id, label)"


def dtw_sql(pairs: str, name: str = "dist") -> str:
    """Distances of the rows (g, a, b, ax, ay, bx, by) of a relation, as relation ``name`` (g, a, b, d)."""
    inf = "'infinity'::DOUBLE"
    return f""", {name}_dp AS (SELECT g, a, b, ax, ay, bx, byy, 0 AS m, [{inf}, 0.0::DOUBLE] || list_transform(bx, lambda v: {inf}) AS p1, [{inf}, {inf}] || list_transform(bx, lambda v: {inf}) AS p2 FROM {pairs}
    UNION ALL SELECT g, a, b, ax, ay, bx, byy, m + 1, [{inf}, {inf}] || list_transform(range(1, len(bx) + 1), lambda n: sqrt((ax[m + 1] - bx[n]) * (ax[m + 1] - bx[n]) + (ay[m + 1] - byy[n]) * (ay[m + 1] - byy[n])) + least(p1[n + 1], p2[n + 1], p1[n])), p1
    FROM {name}_dp WHERE m < len(ax)), {name} AS (SELECT g, a, b, p1[len(bx) + 2] AS d FROM {name}_dp WHERE m = len(ax))"""


PAIRS_SQL = PATH_LISTS + ", pr AS (SELECT x.label AS g, x.vec_id AS a, y.vec_id AS b, x.xs AS ax, x.ys AS ay, y.xs AS bx, y.ys AS byy FROM l x JOIN l y ON x.label = y.label AND x.vec_id < y.vec_id)" + dtw_sql("pr")


def vector_groups(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Embeddings as paths, grouped by label: members (gid, pos) and paths (pos, path)."""
    found = paths(spark, sf_dir)
    return found.select(F.col("label").alias("gid"), F.col("vec_id").alias("pos")), found.select(F.col("vec_id").alias("pos"), "path")


@query(PAIRS_SQL + " SELECT g AS gid, a, b, round(d, 6) AS d FROM dist")
def dtw_pairs(spark, sf_dir):
    return cluster.pair_distances(*vector_groups(spark, sf_dir)).withColumn("d", rounded_length(F.col("d")))


MEDOID_SQL = PAIRS_SQL + ", bw AS (SELECT g, a, b, d FROM dist UNION ALL SELECT g, b, a, d FROM dist), tot AS (SELECT g, a, sum(d) AS total FROM bw GROUP BY ALL), rep AS (SELECT g, arg_min(a, (total, a)) AS rep FROM tot GROUP BY g)"


@query(MEDOID_SQL + " SELECT g AS gid, rep FROM rep")
def representatives(spark, sf_dir):
    return cluster.representatives(*vector_groups(spark, sf_dir))


@query(MEDOID_SQL + ", far AS (SELECT bw.g, bw.b, bw.d FROM bw JOIN rep ON rep.g = bw.g AND rep.rep = bw.a), lim AS (SELECT g, avg(d) + 2 * stddev_pop(d) AS lim FROM far GROUP BY g) SELECT far.g AS gid, far.b AS pos FROM far JOIN lim ON lim.g = far.g WHERE d > lim")
def split_outliers(spark, sf_dir):
    members, tracks = vector_groups(spark, sf_dir)
    far = settle(pairs.to_one(members, tracks, cluster.representatives(members, tracks)).select("gid", "pos", F.col("ahead").alias("d")))
    limits = far.groupBy("gid").agg(cluster.split_limit(F.col("d"), 2.0).alias("limit"))
    return far.join(limits, "gid").where(cluster.beyond(F.col("d"), F.col("limit"))).select("gid", "pos")


def routes_of(spark, sf_dir):
    """Refined, merged and finished routes of the embeddings: (clusters, members, paths)."""
    members, tracks = vector_groups(spark, sf_dir)
    tracks = settle(tracks)
    groups = members.select("pos", F.col("gid").alias("s_label"), F.col("gid").alias("e_label"))
    fine, heads = cluster.refine(groups, tracks)
    merged = settle(cluster.merge(fine, heads, tracks, Clustering(merge_threshold=MERGE_BELOW)))
    return (*cluster.finalize(merged, tracks), tracks)


def refine_sql(rules: Clustering = Clustering()) -> str:
    """Groups split again and again, a few relations for each level: ``mem`` (cluster, pos) and ``cl`` (cluster, gid, rep, intra)."""
    parts = [PAIRS_SQL + ", bw AS MATERIALIZED (SELECT a, b, d FROM dist UNION ALL SELECT b, a, d FROM dist), v0 AS MATERIALIZED (SELECT lpad((min(vec_id) OVER (PARTITION BY label))::VARCHAR, 20, '0') || '/' AS gid, vec_id AS pos FROM l)"]
    levels = range(rules.max_depth + 2)
    for k in levels:
        parts.append(f"""z{k} AS MATERIALIZED (SELECT gid, min(pos) AS first, count(*) < {max(2, rules.min_size)} OR {k > rules.max_depth} AS closed FROM v{k} GROUP BY gid),
    p{k} AS MATERIALIZED (SELECT v.gid, bw.a, bw.b, bw.d FROM bw JOIN v{k} v ON v.pos = bw.a JOIN v{k} w ON w.pos = bw.b AND w.gid = v.gid JOIN z{k} z ON z.gid = v.gid AND NOT closed),
    h{k} AS (SELECT gid, arg_min(a, (total, a)) AS rep FROM (SELECT gid, a, sum(d) AS total FROM p{k} GROUP BY ALL) GROUP BY gid),
    f{k} AS MATERIALIZED (SELECT p.gid, rep, p.b AS pos, p.d FROM p{k} p JOIN h{k} h ON h.gid = p.gid AND p.a = h.rep),
    k{k} AS MATERIALIZED (SELECT gid, rep, pos, avg(d) OVER w AS mean, d > avg(d) OVER w + {rules.split_sigma}::DOUBLE * stddev_pop(d) OVER w AS away FROM f{k} WINDOW w AS (PARTITION BY gid)),
    s{k} AS MATERIALIZED (SELECT gid, rep, avg(mean) AS mean, bool_or(away) AS split FROM k{k} GROUP BY gid, rep),
    v{k + 1} AS MATERIALIZED (SELECT v.gid || CASE WHEN coalesce(away, false) THEN '1' ELSE '0' END AS gid, v.pos FROM v{k} v JOIN s{k} s ON s.gid = v.gid AND s.split LEFT JOIN k{k} k ON k.gid = v.gid AND k.pos = v.pos)""")
    done = " UNION ALL ".join(f"SELECT gid, first AS rep, 0.0::DOUBLE AS intra FROM z{k} WHERE closed UNION ALL SELECT gid, rep, mean FROM s{k} WHERE NOT split" for k in levels)
    held = " UNION ALL ".join(f"SELECT gid, pos FROM v{k}" for k in levels)
    parts.append(f"cl AS MATERIALIZED (SELECT row_number() OVER (ORDER BY gid) - 1 AS cluster, gid, rep, intra FROM ({done})), mem AS MATERIALIZED (SELECT cluster, pos FROM ({held}) v JOIN cl ON cl.gid = v.gid)")
    return ", ".join(parts)


REFINED_SQL = refine_sql()
#: Of the routes of the embeddings some are nearer than this, some not.
MERGE_BELOW = 2.4


@query(REFINED_SQL + " SELECT mem.cluster, pos, rep, round(intra, 6) AS intra_avg_dist FROM mem JOIN cl ON cl.cluster = mem.cluster")
def refine_clusters(spark, sf_dir):
    members, tracks = vector_groups(spark, sf_dir)
    fine, heads = cluster.refine(members.select("pos", F.col("gid").alias("s_label"), F.col("gid").alias("e_label")), settle(tracks))
    return rounded(fine.join(heads, "cluster"))


SPLIT_FIRST = PATH_LISTS + ", hd AS (SELECT label, min(vec_id) AS rep FROM l GROUP BY label), rt AS (SELECT l.label, l.xs, l.ys FROM l JOIN hd ON hd.rep = l.vec_id)"
CROSS_REPS = SPLIT_FIRST + ", pr AS (SELECT 0 AS g, x.label AS a, y.label AS b, x.xs AS ax, x.ys AS ay, y.xs AS bx, y.ys AS byy FROM rt x JOIN rt y ON x.label < y.label), pq AS (SELECT g, a, b, ax, ay, list_reverse(bx) AS bx, list_reverse(byy) AS byy FROM pr)" + dtw_sql("pr", "ahead") + dtw_sql("pq", "back")


def label_routes(spark, sf_dir) -> DataFrame:
    """The first path of each label as its route: (cluster_id, path)."""
    return paths(spark, sf_dir).groupBy(F.col("label").alias("cluster_id")).agg(F.min_by("path", "vec_id").alias("path"))


@query(CROSS_REPS + ", z AS (SELECT a.a, a.b, least(a.d, b.d) AS d FROM ahead a JOIN back b ON a.a = b.a AND a.b = b.b), th AS (SELECT avg(d) + 0.5::DOUBLE * stddev_pop(d) AS th FROM z) SELECT a, b FROM z, th WHERE d < th")
def merge_pairs(spark, sf_dir):
    routes = settle(label_routes(spark, sf_dir))
    heads = routes.select(F.col("cluster_id").alias("cluster"), F.col("cluster_id").alias("rep"))
    return cluster.merge_pairs(heads, routes.select(F.col("cluster_id").alias("pos"), "path"), Clustering(merge_sigma=0.5))


def either_way(pairs: str, name: str) -> str:
    """Distances ahead and to the reverse of the rows (g, a, b, ax, ay, bx, by) of a relation, as ``name`` (g, a, b, ahead, back)."""
    reverse = f", {pairs}_r AS (SELECT g, a, b, ax, ay, list_reverse(bx) AS bx, list_reverse(byy) AS byy FROM {pairs})"
    return reverse + dtw_sql(pairs, f"{name}_a") + dtw_sql(f"{pairs}_r", f"{name}_b") + f", {name} AS MATERIALIZED (SELECT x.g, x.a, x.b, x.d AS ahead, y.d AS back FROM {name}_a x JOIN {name}_b y ON x.g = y.g AND x.a = y.a AND x.b = y.b)"


ROUTES_SQL = (
    REFINED_SQL
    + ", rp AS MATERIALIZED (SELECT 0 AS g, x.cluster AS a, y.cluster AS b, lx.xs AS ax, lx.ys AS ay, ly.xs AS bx, ly.ys AS byy FROM cl x JOIN l lx ON lx.vec_id = x.rep JOIN cl y ON x.cluster < y.cluster JOIN l ly ON ly.vec_id = y.rep)"
    + either_way("rp", "rd")
    + f""", ed AS MATERIALIZED (SELECT a, b FROM rd WHERE least(ahead, back) < {MERGE_BELOW}::DOUBLE UNION SELECT b, a FROM rd WHERE least(ahead, back) < {MERGE_BELOW}::DOUBLE),
    rc AS (SELECT cluster AS node, cluster AS root FROM cl UNION SELECT ed.b, rc.root FROM rc JOIN ed ON ed.a = rc.node),
    ow AS (SELECT node AS cluster, dense_rank() OVER (ORDER BY min(root)) - 1 AS cluster_id FROM rc GROUP BY node),
    fm AS MATERIALIZED (SELECT cluster_id::INTEGER AS cluster_id, pos FROM mem JOIN ow ON ow.cluster = mem.cluster),
    fp AS MATERIALIZED (SELECT x.cluster_id AS g, x.pos AS a, y.pos AS b, lx.xs AS ax, lx.ys AS ay, ly.xs AS bx, ly.ys AS byy FROM fm x JOIN fm y ON x.cluster_id = y.cluster_id AND x.pos < y.pos JOIN l lx ON lx.vec_id = x.pos JOIN l ly ON ly.vec_id = y.pos)"""
    + either_way("fp", "fd")
    + """, fb AS MATERIALIZED (SELECT g, a, b, ahead, back FROM fd UNION ALL SELECT g, b, a, ahead, back FROM fd),
    fh AS (SELECT g, arg_min(a, (total, a)) AS rep FROM (SELECT g, a, sum(least(ahead, back)) AS total FROM fb GROUP BY ALL) GROUP BY g),
    rt AS MATERIALIZED (SELECT n.cluster_id, coalesce(rep, first) AS rep, size FROM (SELECT cluster_id, min(pos) AS first, count(*) AS size FROM fm GROUP BY cluster_id) n LEFT JOIN fh ON fh.g = n.cluster_id),
    tr AS MATERIALIZED (SELECT rt.cluster_id, fb.b AS pos, ahead, back FROM rt JOIN fb ON fb.g = rt.cluster_id AND fb.a = rt.rep)"""
)


@query(ROUTES_SQL + " SELECT fm.cluster_id, fm.pos, coalesce(back < ahead, false) AS flip, size FROM fm JOIN rt ON rt.cluster_id = fm.cluster_id LEFT JOIN tr ON tr.cluster_id = fm.cluster_id AND tr.pos = fm.pos")
def merge_clusters(spark, sf_dir):
    clusters, members, _ = routes_of(spark, sf_dir)
    return members.join(clusters.select("cluster_id", "size"), "cluster_id")


@query(ROUTES_SQL + " SELECT rt.cluster_id, rep, round(coalesce(mean, 0), 6) AS intra_avg_dist, size FROM rt LEFT JOIN (SELECT cluster_id, avg(least(ahead, back)) AS mean FROM tr GROUP BY cluster_id) q ON q.cluster_id = rt.cluster_id")
def cluster_quality(spark, sf_dir):
    return rounded(routes_of(spark, sf_dir)[0])


SLIDE = "SELECT x.label AS g, x.label AS a, y.label * 1000 + s AS b, x.xs[1:12] AS ax, x.ys[1:12] AS ay, y.xs[s + 1:s + 12] AS bx, y.ys[s + 1:s + 12] AS byy FROM rt x JOIN rt y ON x.label <> y.label, (SELECT unnest(range(21)) AS s)"


@query(SPLIT_FIRST + f", pr AS ({SLIDE})" + dtw_sql("pr") + ", z AS (SELECT a, b // 1000 AS r, min(d) AS d FROM dist GROUP BY ALL) SELECT round(greatest(quantile_cont(d, 0.75), 1e-8), 6) AS unknown_threshold, 12 AS calibration_steps, count(*) AS n_cross_samples, (SELECT count(*) FROM rt) AS n_clusters FROM z WHERE d < 'infinity'")
def unknown_threshold(spark, sf_dir):
    return rounded(cluster.unknown_threshold(label_routes(spark, sf_dir)))


@query(on(1, f"{LONG} SELECT mmsi, (traj_id % 5)::INTEGER AS cluster_id, count(DISTINCT traj_id) AS voyages FROM g GROUP BY ALL"))
def mmsi_counts(spark, sf_dir):
    points = trajectories(spark, sf_dir).select(F.col("traj_id").alias("pos"), "mmsi")
    members = points.select("pos", (F.col("pos") % 5).cast("int").alias("cluster_id")).distinct()
    return cluster.voyage_counts(points, members)


# Samples and evaluation

POINTS_SQL = LONG + ", u AS (SELECT (traj_id % 5)::INTEGER AS cluster_id, traj_id, event_id, t, lon, lat, sog, cog FROM g)"
BOUNDS_SQL = POINTS_SQL + ", b AS (SELECT cluster_id, " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in learn.FEATURES) + " FROM u GROUP BY cluster_id)"


def route_points(spark, sf_dir) -> DataFrame:
    return trajectories(spark, sf_dir).select((F.col("traj_id") % 5).cast("int").alias("cluster_id"), "traj_id", "event_id", "t", *learn.FEATURES)


@query(on(1, BOUNDS_SQL + " SELECT *, '1' AS schema_version FROM b"))
def norm_params(spark, sf_dir):
    return learn.norm_params(route_points(spark, sf_dir))


def scale_sql(c: str) -> str:
    return f"CASE WHEN abs({c}_max - {c}_min) < 1e-8 THEN 0.5 ELSE ({c} - {c}_min) / ({c}_max - {c}_min + 1e-8::DOUBLE) END"


SCALED_SQL = BOUNDS_SQL + ", sc AS (SELECT u.cluster_id, traj_id, event_id, t, " + ", ".join(f"{scale_sql(c)} AS {c}" for c in learn.FEATURES) + " FROM u JOIN b ON b.cluster_id = u.cluster_id)"


def scaled_points(spark, sf_dir) -> DataFrame:
    points = settle(route_points(spark, sf_dir))
    return learn.normalize(points, learn.norm_params(points))


@query(on(1, SCALED_SQL + " SELECT event_id, round(lon, 6) AS lon, round(lat, 6) AS lat, round(sog, 6) AS sog, round(cog, 6) AS cog FROM sc"))
def normalize(spark, sf_dir):
    return rounded(scaled_points(spark, sf_dir).select("event_id", *learn.FEATURES))


@query(on(1, SCALED_SQL + " SELECT event_id, " + ", ".join(f"round(CASE WHEN abs({c}_max - {c}_min) < 1e-8 THEN {c}_min ELSE {c} * ({c}_max - {c}_min) + {c}_min END, 6) AS {c}" for c in learn.FEATURES) + " FROM sc JOIN b ON b.cluster_id = sc.cluster_id"))
def denormalize(spark, sf_dir):
    points = settle(route_points(spark, sf_dir))
    params = learn.norm_params(points)
    return rounded(learn.denormalize(learn.normalize(points, params), params).select("event_id", *learn.FEATURES))


@query(on(1, POINTS_SQL + ", o AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t, event_id) - 1 AS i FROM u) SELECT o.traj_id, o.i - 12 AS k, round(sum(h.lon), 6) AS x_lon, round(sum(h.sog), 6) AS x_sog, round(o.lon, 6) AS y_lon, round(o.cog, 6) AS y_cog FROM o JOIN o h ON h.traj_id = o.traj_id AND h.i >= o.i - 12 AND h.i < o.i WHERE o.i >= 12 GROUP BY o.traj_id, o.i, o.lon, o.cog"))
def lstm_samples(spark, sf_dir):
    made = learn.samples(route_points(spark, sf_dir), 12, order=ORDER)
    total = lambda j: F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v[j])
    return rounded(made.select("traj_id", F.col("k").cast("long").alias("k"), total(0).alias("x_lon"), total(2).alias("x_sog"), F.col("y")[0].alias("y_lon"), F.col("y")[3].alias("y_cog")))


YEARS = Training(train_years=(2024,), validation_years=(2025,), test_years=(2026,))


@query("WITH y AS (SELECT user_id, max(year(ts + to_days((user_id % 4)::INTEGER * 366))) AS y FROM events GROUP BY user_id) SELECT user_id, CASE y WHEN 2024 THEN 'train' WHEN 2025 THEN 'validation' ELSE 'test' END AS split FROM y WHERE y BETWEEN 2024 AND 2026")
def split_by_year(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + (F.col("user_id") % 4) * 366 * 86400).alias("t"))
    return learn.split_by_year(e, YEARS, ("user_id",))


@query()
def split_random(spark, sf_dir):
    members = route_points(spark, sf_dir).select("cluster_id", F.col("traj_id").alias("pos")).distinct()
    return learn.split_at_random(members)



def exact_mean(c: str) -> str:
    return f"sum({c}::DECIMAL(30, 12))::DOUBLE / count({c})"


ERRORS_SQL = POINTS_SQL + f""", o AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t, event_id) AS step FROM u),
    a AS (SELECT traj_id, step, lon, lat, sog, cog FROM o), q AS (SELECT traj_id, step - 1 AS step, lon, lat, sog, cog FROM o WHERE step > 1),
    e AS (SELECT a.traj_id, a.step, {haversine_sql('a.lat', 'a.lon', 'q.lat', 'q.lon')} AS distance, abs(a.sog - q.sog) AS speed_error, least(abs(a.cog - q.cog) % 360, 360 - abs(a.cog - q.cog) % 360) AS heading_error,
        (pow(a.lon - q.lon, 2) + pow(a.lat - q.lat, 2) + pow(a.sog - q.sog, 2) + pow(a.cog - q.cog, 2)) / 4 AS square FROM a JOIN q ON q.traj_id = a.traj_id AND q.step = a.step),
    tr AS (SELECT traj_id, {exact_mean('distance')} AS ade, max(distance) AS mde, {exact_mean('speed_error')} AS avg_speed_error, max(speed_error) AS max_speed_error, {exact_mean('heading_error')} AS avg_heading_error, max(heading_error) AS max_heading_error, 1 / (1 + {exact_mean('square')}) AS norm_space_fit FROM e GROUP BY traj_id)"""  # fmt: skip


def track_reports(spark, sf_dir) -> DataFrame:
    """Each report as a guess of the next one."""
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("traj_id").orderBy(*ORDER))
    points = route_points(spark, sf_dir).withColumn("step", step)
    ahead = points.where("step > 1").withColumn("step", F.col("step") - 1)
    return evaluate.by_trajectory(evaluate.step_errors(points, ahead))


REPORT = ("ade", "mde", "avg_speed_error", "max_speed_error", "avg_heading_error", "max_heading_error", "norm_space_fit")


#: Means of speeds and courses are exact sums on both sides and are shown whole; what sines have a part in is rounded.
SHOWN = {c: f"{c}" if c in ("avg_speed_error", "avg_heading_error") else f"round({c}, 4) AS {c}" for c in REPORT}


@query(on(1, ERRORS_SQL + " SELECT traj_id, " + ", ".join(SHOWN.values()) + " FROM tr"))
def eval_trajectory(spark, sf_dir):
    return track_reports(spark, sf_dir).selectExpr("traj_id", *SHOWN.values())


@query(on(1, ERRORS_SQL + """ SELECT (traj_id % 5)::INTEGER AS cluster_id, count(*) AS n_trajectories, round(avg(ade), 4) AS ade_mean, round(median(ade), 4) AS ade_median, round(stddev_pop(ade), 4) AS ade_std, round(avg(mde), 4) AS mde_mean, round(max(mde), 4) AS mde_max,
    round(avg(avg_speed_error), 4) AS avg_speed_error_mean, round(avg(max_speed_error), 4) AS max_speed_error_mean, round(avg(avg_heading_error), 4) AS avg_heading_error_mean, round(avg(max_heading_error), 4) AS max_heading_error_mean, round(avg(norm_space_fit), 4) AS norm_space_fit_mean FROM tr GROUP BY 1"""))  # fmt: skip
def eval_cluster(spark, sf_dir):
    return rounded(evaluate.by_cluster(track_reports(spark, sf_dir).withColumn("cluster_id", (F.col("traj_id") % 5).cast("int"))), 4)


# Matching and forks

MATCH_SQL = SPLIT_FIRST + ", pr AS (SELECT l.vec_id AS g, rt.label AS a, s AS b, l.xs[25:32] AS ax, l.ys[25:32] AS ay, rt.xs[s + 1:s + 8] AS bx, rt.ys[s + 1:s + 8] AS byy FROM l, rt, (SELECT unnest(range(25)) AS s))" + dtw_sql("pr") + ", md AS (SELECT g AS mmsi, a AS cluster_id, min(d) AS d FROM dist GROUP BY ALL)"


def matches(spark, sf_dir) -> DataFrame:
    vessels = paths(spark, sf_dir).select(F.col("vec_id").alias("mmsi"), "path")
    return match.route_distances(vessels, label_routes(spark, sf_dir).withColumn("steps", F.lit(8)))


@query(MATCH_SQL + ", z AS (SELECT mmsi, arg_min(cluster_id, (d, cluster_id)) AS best, min(d) AS d FROM md GROUP BY mmsi) SELECT mmsi, (CASE WHEN d <= 0.9 THEN best ELSE -1 END)::INTEGER AS cluster_id, round(d, 6) AS match_distance FROM z")
def route_match(spark, sf_dir):
    return rounded(match.best_route(matches(spark, sf_dir), 0.9))


FORK_SQL = MATCH_SQL + ", rk AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY d, cluster_id) AS rank FROM md), tp AS (SELECT *, min(CASE WHEN rank = 1 THEN d END) OVER w AS d1, min(CASE WHEN rank = 2 THEN d END) OVER w AS d2 FROM rk WHERE rank <= 3 WINDOW w AS (PARTITION BY mmsi)), fk AS (SELECT * FROM tp WHERE d2 > 0 AND d2 < 'infinity' AND (d2 - d1) / d2 <= 0.15)"


@query(FORK_SQL + " SELECT mmsi, rank::INTEGER AS rank, cluster_id, round(d, 6) AS d FROM fk")
def fork_topk(spark, sf_dir):
    return rounded(match.fork_candidates(matches(spark, sf_dir)))


@query(FORK_SQL + ", n AS (SELECT mmsi, cluster_id, (mmsi + cluster_id) % 3 AS n FROM fk) SELECT mmsi, cluster_id, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS probability FROM n WINDOW w AS (PARTITION BY mmsi)")
def fork_probability(spark, sf_dir):
    forks = settle(match.fork_candidates(matches(spark, sf_dir)))
    counts = forks.select("mmsi", "cluster_id", ((F.col("mmsi") + F.col("cluster_id")) % 3).alias("voyages")).where("voyages > 0")
    return rounded(match.fork_probabilities(forks, counts))


@query(on(100, f""", {CHANNEL_METRES_SQL}, br AS (SELECT event_id // 3 AS mmsi, (event_id % 3)::INTEGER AS cluster_id, event_id FROM p),
    ob AS (SELECT br.mmsi, channel_id FROM br JOIN d ON d.event_id = br.event_id WHERE cluster_id = 0 AND metres <= 6000),
    cl AS (SELECT br.mmsi, br.cluster_id, min(d.metres) AS metres, count(d.channel_id) AS n FROM br LEFT JOIN ob ON ob.mmsi = br.mmsi LEFT JOIN d ON d.event_id = br.event_id AND d.channel_id = ob.channel_id GROUP BY ALL),
    gd AS (SELECT *, coalesce(metres <= 4000, true) AS good FROM cl), sm AS (SELECT *, bool_or(good) OVER (PARTITION BY mmsi) AS any_good FROM gd) SELECT mmsi, cluster_id FROM sm WHERE good OR NOT any_good"""))  # fmt: skip
def geometry_prune(spark, sf_dir):
    points = positions(spark, sf_dir, 100).select("event_id", "lon", "lat")
    metres = settle(spatial.channel_distances(points, spatial.channel_segments(spark, CHANNELS), "event_id")).withColumnRenamed("event_id", "point_id")
    branch = points.select(F.floor(F.col("event_id") / 3).alias("mmsi"), (F.col("event_id") % 3).cast("int").alias("cluster_id"), F.col("event_id").alias("point_id"))
    seen = branch.where("cluster_id = 0").join(metres, "point_id").where("metres <= 6000").select("mmsi", "channel_id")
    return match.prune_branches(branch, seen, metres, dataclasses.replace(Prediction(), deviation_metres=4000.0))


# Sums of distances stand for three branches' first predictions, after one to three observations.
@query(on(100, f""", bt AS (SELECT event_id // 3 AS mmsi, (event_id % 3)::INTEGER AS cluster_id, 1 + (event_id // 3) % 3 AS seen, {haversine_sql('lat', 'lon', '33.6::DOUBLE', '-118.3::DOUBLE')} AS metres FROM p),
    rk AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY metres, cluster_id) AS r FROM bt),
    tw AS (SELECT mmsi, max(seen) AS seen, max(CASE WHEN r = 1 THEN cluster_id END) AS best, max(CASE WHEN r = 1 THEN metres END) AS d1, max(CASE WHEN r = 2 THEN metres END) AS d2 FROM rk GROUP BY mmsi)
    SELECT mmsi, CASE WHEN seen >= 2 AND d1 * 1.35::DOUBLE < d2 THEN best END AS locked FROM tw"""))  # fmt: skip
def fork_lock(spark, sf_dir):
    p = positions(spark, sf_dir, 100)
    vessel = F.floor(F.col("event_id") / 3)
    metres = geo.haversine(F.col("lat"), F.col("lon"), F.lit(33.6), F.lit(-118.3))
    return match.locked_branches(p.select(vessel.alias("mmsi"), (F.col("event_id") % 3).cast("int").alias("cluster_id"), (vessel % 3 + 1).alias("seen"), metres.alias("metres")))


@query("SELECT * FROM (VALUES ('J1', 0), ('J1', 1), ('J1', 2), ('J2', 3), ('J2', 4)) v(junction_id, cluster_id)")
def junction_clusters(spark, sf_dir):
    known = spatial.junction_table(spark, JUNCTIONS)
    return spark.createDataFrame([(j, c) for j in ("J1", "J2", "broken", "J9") for c in sorted(spatial.clusters_at(known, j))], "junction_id string, cluster_id int")


@query(on(1, " SELECT mmsi, floor(t) AS t, lon, lat, sog, CASE WHEN cog < 360 THEN cog END AS cog, nullif(heading, 511) AS heading, CASE WHEN event_id % 5 <> 0 THEN vessel_type END AS vessel_type FROM p WHERE event_id % 11 <> 0 AND event_id % 13 <> 0"))
def typed_reports(spark, sf_dir):
    """Reports as their files write them, all text, some of it broken, and back."""
    p = positions(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    raw = p.select(
        F.when(F.col("event_id") % 11 == 0, "no number").otherwise(F.concat(text("mmsi"), F.lit(".0"))).alias("MMSI"),
        F.when(F.col("event_id") % 13 == 0, "never").otherwise(F.date_format(F.timestamp_seconds(F.floor("t")), "yyyy-MM-dd'T'HH:mm:ss")).alias("BaseDateTime"),
        text("lat").alias("LAT"), text("lon").alias("LON"), text("sog").alias("SOG"), text("cog").alias("COG"), text("heading").alias("Heading"),
        F.when(F.col("event_id") % 5 == 0, "unknown").otherwise(text("vessel_type")).alias("VesselType"),
    )
    return report_files.typed(raw).select("mmsi", "t", "lon", "lat", "sog", "cog", "heading", "vessel_type")


# Models and live data


def first_routes(spark, sf_dir, training: Training, scale: float = 1.0) -> tuple[DataFrame, offline.Routes]:
    """Points of five routes, and the routes; the path of each is that of its first voyage."""
    long = trajectories(spark, sf_dir, scale)
    owned = settle(long.select((F.col("traj_id") % 5).cast("int").alias("cluster_id"), F.col("traj_id").alias("pos"), "mmsi", "t", *learn.FEATURES))
    members = settle(owned.select("cluster_id", "pos").distinct())
    tracks = settle(cluster.pack_paths(owned))
    heads = members.groupBy("cluster_id").agg(F.min("pos").alias("rep"), F.count("*").alias("size"), F.lit(0.0).alias("intra_avg_dist"))
    routes = settle(heads.join(tracks.withColumnRenamed("pos", "rep"), "rep"))
    return owned, offline.Routes(routes, members, tracks, settle(learn.norm_params(owned)), settle(learn.route_shape(routes, training)), cluster.voyage_counts(owned, members), cluster.unknown_threshold(routes))


@query()
def lstm_train(spark, sf_dir):
    """A model for each route by the production settings."""
    return offline.train_models(*first_routes(spark, sf_dir, Training())).drop("weights")


@query()
def live_replay(spark, sf_dir):
    return replay(positions(spark, sf_dir, 10).withColumn("arrival", F.col("event_id")), cleaning=ANY_BOX).drop("window")


SMALL_TRAINING = Training(epochs=3, steps=((float("inf"), 8),), width=((float("inf"), 8),))


@query()
def live_predict(spark, sf_dir):
    """All messages against five routes with models, channels and past voyages, saved by a run and loaded again; a row for each message,
    with the routes of its branches and the last of its predicted points.

    What the run saved is deleted once it is loaded. The models are small, as ``lstm_train`` trains those of production.
    """
    settings = dataclasses.replace(Settings(), cleaning=ANY_BOX, training=SMALL_TRAINING)
    owned, found = first_routes(spark, sf_dir, settings.training, 10)
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    offline.save(folder, found, offline.train_models(owned, found, settings), settings)
    assets, counts = offline.load_assets(spark, folder)
    counts = settle(counts)
    forget(spark, folder)
    assets.channels = dict(CHANNELS)
    messages = positions(spark, sf_dir, 10).withColumn("arrival", F.col("event_id"))
    answers = replay(messages, assets, ANY_BOX, counts=counts, every=True)
    last = F.try_element_at("points", F.lit(-1))
    shown = {"branches": F.array_sort(F.map_keys("branch_predictions")), "last_t": last["t"], "last_lon": last["lon"], "last_lat": last["lat"]}
    return answers.withColumns(shown).drop("window", "points", "branch_predictions")
