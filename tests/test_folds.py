"""Folds against plain loops, and their boundaries."""

import random

import pytest

from fairlead.config import Berth, Cleaning
from fairlead.functions.geo import haversine_number
from fairlead.operators import clean, folds


def loop_jumps(rows, limit=Cleaning().jump_speed):
    out, last = [], None
    for t, lon, lat in rows:
        ok = last is None or (t > last[0] and haversine_number(last[2], last[1], lat, lon) / (t - last[0]) <= limit)
        out.append(ok)
        last = (t, lon, lat) if ok else last
    return out


def loop_berths(rows, rules=Berth()):
    marked, i = set(), 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and haversine_number(rows[i][2], rows[i][1], rows[j][2], rows[j][1]) < rules.metres and not any(s is not None and s >= rules.knots for *_, s in rows[i : j + 1]):
            j += 1
        if rows[j - 1][0] - rows[i][0] > rules.seconds:
            marked |= set(range(i, j))
            i = j
        else:
            i += 1
    return [k in marked for k in range(len(rows))]


def wander(seed, n=300):
    draw, t, lon, lat, out = random.Random(seed), 0.0, -118.3, 33.6, []
    for _ in range(n):
        t += draw.choice([0.0, 0.5, 30, 120, 700])
        if draw.random() < 0.2:
            lon += draw.choice([0, 0.0003, 0.01, 0.3])
        out.append((t, lon, lat, draw.choice([None, 0.0, 0.1, 0.49, 0.5, 3.0]) if draw.random() < 0.1 else 0.0))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_folds_equal_loops(seed):
    rows = wander(seed)
    assert folds.sequential(lambda: folds.JumpFold(Cleaning().jump_speed, 6371000.0), [r[:3] for r in rows]) == loop_jumps([r[:3] for r in rows])
    assert folds.sequential(lambda: folds.BerthFold(Berth(), 6371000.0), rows) == loop_berths(rows)


def test_folds_in_spark_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(m, float(k), *r) for m in range(3) for k, r in enumerate(wander(m, 90))]
        df = spark.createDataFrame(rows, "mmsi long, k double, t double, lon double, lat double, sog double")
        found = {(r["mmsi"], r["k"]): r["in_berth"] for r in folds.flag_berths(df, order=("t", "k")).collect()}
        for m in range(3):
            assert [found[(m, float(k))] for k in range(90)] == loop_berths(wander(m, 90))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_berth_boundaries():
    still = lambda seconds: [(0.0, 0.0, 0.0, 0.0), (float(seconds), 0.0, 0.0, 0.0)]
    assert loop_berths(still(1800)) == folds.sequential(lambda: folds.BerthFold(Berth(), 6371000.0), still(1800)) == [False, False]
    assert folds.sequential(lambda: folds.BerthFold(Berth(), 6371000.0), still(1801)) == [True, True]
    metres = haversine_number(0, 0, 0, 0.0004)
    edge = [(0.0, 0.0, 0.0, 0.0), (2000.0, 0.0004, 0.0, 0.0)]
    assert folds.sequential(lambda: folds.BerthFold(Berth(metres=metres), 6371000.0), edge) == [False, False]


def test_duplicate_and_jump_boundaries():
    assert folds.sequential(lambda: folds.DuplicateFold(1.0), [(0.0,), (0.999,), (1.0,), (1.5,), (2.0,)]) == [True, False, True, False, True]
    limit = haversine_number(0, 0, 0, 0.001) / 10
    assert folds.sequential(lambda: folds.JumpFold(limit, 6371000.0), [(0.0, 0.0, 0.0), (10.0, 0.001, 0.0), (10.0, 0.001, 0.0)]) == [True, True, False]


def test_null_vessels_are_left_out_and_empty_tables_work(spark):
    df = spark.createDataFrame([(None, 1.0, 0.0, 0.0, 0.0)], "mmsi long, t double, lon double, lat double, sog double")
    assert folds.flag_jumps(df).count() == 0 and folds.flag_berths(df.where("false")).count() == 0


def test_sentinels_keep_the_row(spark):
    df = spark.createDataFrame([(1, 360.0, 511.0), (2, 359.0, 10.0)], "k int, cog double, heading double")
    assert [tuple(r) for r in clean.without_sentinels(df).orderBy("k").collect()] == [(1, None, None), (2, 359.0, 10.0)]


def test_rows_without_time_or_place(spark):
    rows = [(1, 0.0, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0, 0.0), (1, 1000.0, None, 0.0, 0.0), (1, 2000.0, 0.0, 0.0, 0.0), (1, 3000.0, 0.0, float("nan"), 0.0), (None, 1.0, 0.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "mmsi long, t double, lon double, lat double, sog double")
    berth = {r["t"]: r["in_berth"] for r in folds.flag_berths(frame).collect()}
    assert berth == {0.0: True, None: False, 1000.0: False, 2000.0: True, 3000.0: False}
    kept = {r["t"]: r["kept"] for r in folds.flag_jumps(frame).collect()}
    assert kept == {0.0: True, None: False, 1000.0: False, 2000.0: True, 3000.0: False}
    assert [r["t"] for r in folds.flag_duplicates(frame).where("NOT kept").collect()] == [None]
