"""Tracks of live vessels, routes and forks, in replay and in a stream."""

import dataclasses
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.config import Box, Cleaning, Prediction
from fairlead.operators.lstm import Lstm
from fairlead.sources import live
from fairlead.streaming import vessel
from fairlead.streaming.vessel import Assets, Forecaster, Route, Track, follow, replay

WIDE = dataclasses.replace(Cleaning(), box=Box(-180, -90, 180, 90))
TAKE = dict(cleaning=WIDE, interval=120.0, timeout=7200.0)


def test_grid_of_two_minutes():
    track, sizes = Track(), []
    for t in (0, 30, 150):
        assert track.accept(t, 0.0, t * 1e-5, 5.0, 90.0, **TAKE)
        sizes.append(len(track.grid))
    assert sizes == [1, 1, 2] and track.grid[-1][0] == 120 and track.grid[-1][2] == pytest.approx(120e-5)


def test_courses():
    track = Track()
    assert track.accept(0, 0.0, 0.0, 1.0, None, **TAKE)
    assert not track.accept(10, 0.0, 0.0, 1.0, -5.0, **TAKE)
    assert track.accept(20, 0.0, 0.0, 1.0, 360.0, **TAKE) and track.raw[-1][4] is None
    assert track.accept(130, 0.0, 0.0, 1.0, 40.0, **TAKE) and track.grid[-1][4] == 40.0
    assert track.accept(250, 0.0, 0.0, 1.0, None, **TAKE) and track.grid[-1][4] == 40.0


def test_duplicates_late_messages_jumps_and_gaps():
    track = Track()
    assert track.accept(0, 0.0, 0.0, 1.0, 0.0, **TAKE)
    assert track.accept(100, 0.0, 0.0, 1.0, 0.0, **TAKE)
    assert not track.accept(100.5, 0.0, 0.0, 1.0, 0.0, **TAKE)
    assert not track.accept(50, 0.0, 0.0, 1.0, 0.0, **TAKE)
    assert track.accept(100, 0.0001, 0.0, 1.0, 0.0, **TAKE) and track.raw[-1][1] == 0.0001
    assert not track.accept(130, 5.0, 0.0, 1.0, 0.0, **TAKE)
    assert track.segment == 0 and track.accept(7300, 5.0, 0.0, 1.0, 0.0, **TAKE)
    assert track.segment == 1 and len(track.grid) == 1


def test_capacity_and_saved_state():
    track = Track(capacity=3)
    for k in range(10):
        track.accept(k * 120.0, 0.0, k * 1e-4, 1.0, 0.0, **TAKE)
    assert track.ready and [p[0] for p in track.grid] == [840, 960, 1080] and len(track.raw) == 1
    again = Track.load(track.dump())
    assert again == track
    again.resize(2)
    assert len(again.grid) == 2


def routes(spread=0.02, weights=True):
    made = {}
    for k in (0, 1):
        model = Lstm.fresh(4, k)
        made[k] = Route(k, [(x * 0.001, k * spread * x * 0.01) for x in range(20)], 3, 4, model.pack() if weights else None, (0, 0, 0, 0), (0.02, 0.02, 20, 360))
    return made


def ready_track(lat=0.0):
    track = Track(capacity=3)
    for k in range(3):
        track.accept(k * 120.0, k * 0.001, lat, 1.0, 90.0, **TAKE)
    return track


def test_match_unknown_and_fork():
    far = Forecaster(Assets(routes(spread=10.0)), Prediction(), WIDE)
    found = far.answer(1, ready_track(), 0.0)
    assert found["cluster_id"] == 0 and len(found["points"]) == 15 and not found["is_fork"]
    assert far.answer(1, ready_track(5.0), 0.0)["status"] in ("unknown_cluster", "predicted")
    assert Forecaster(Assets(routes(10.0), threshold=1e-9), Prediction(), WIDE).answer(1, ready_track(0.001), 0.0)["status"] == "unknown_cluster"
    near = Forecaster(Assets(routes(spread=0.0), counts={(1, 1): 3}), Prediction(), WIDE)
    fork = near.answer(1, ready_track(0.0005), 0.0)
    assert fork["is_fork"] and fork["fork_probabilities"] == {0: 0.0, 1: 1.0} and set(fork["branch_predictions"]) == {0, 1}


def test_fork_locks_after_two_observations():
    caster = Forecaster(Assets(routes(0.0)), Prediction(), WIDE)
    track = ready_track(0.0005)
    caster.answer(1, track, 0.0)
    track.fork["last"] = {"0": (0.002, 0.0005), "1": (10.0, 10.0)}
    caster.answer(1, track, 1.0)
    track.fork["last"] = {"0": (0.002, 0.0005), "1": (10.0, 10.0)}
    found = caster.answer(1, track, 2.0)
    assert found["fork_locked_by_disambiguation"] and found["cluster_id"] == 0
    assert caster.answer(1, track, 3.0)["fork_locked_by_disambiguation"]


def test_junctions_and_channels():
    here, away = [(0.002, 0.0, 500.0, [0, 1])], [(50.0, 50.0, 500.0, [0, 1])]
    assert Forecaster(Assets(routes(0.0), junctions=here), Prediction(), WIDE).answer(1, ready_track(0.0005), 0.0)["is_fork"]
    assert not Forecaster(Assets(routes(0.0), junctions=away), Prediction(), WIDE).answer(1, ready_track(0.0005), 0.0)["is_fork"]
    caster = Forecaster(Assets(routes(0.0), channels={"c": [(0.0, 0.0), (0.01, 0.0)]}), Prediction(), WIDE)
    branches = {0: [{"lon": 0.003, "lat": 0.0}], 1: [{"lon": 0.003, "lat": 0.01}]}
    assert set(caster.pruned(ready_track(), branches)) == {0}
    assert set(caster.pruned(ready_track(), {1: branches[1]})) == {1}


def messages(spark):
    rows = [(100000000 + v, v * 1000 + k, k * 60.0, -118.3 + k * 1e-4, 33.6 + v * 0.01, 5.0, 90.0 if k % 3 else None) for v in range(3) for k in range(60)]
    return spark.createDataFrame(rows, "mmsi long, arrival long, t double, lon double, lat double, sog double, cog double")


def test_stream_equals_replay(spark, tmp_path):
    source = messages(spark)
    for name, part in (("a", source.where("t < 1500")), ("b", source.where("t >= 1500"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = follow(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), cleaning=WIDE, idle_ms=None)
    query = stream.writeStream.format("memory").queryName("live_out").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    pick = lambda df: sorted((r["mmsi"], r["t"], r["segment"], tuple(map(tuple, r["window"]))) for r in df.collect())
    assert pick(spark.table("live_out")) == pick(replay(source, cleaning=WIDE)) != []


def test_messages_from_json(spark):
    lines = ['{"MMSI": 1, "Timestamp": 1000, "LON": 1.0, "LAT": 2.0, "SOG": 3, "COG": 4}', '[{"MMSI": 2, "Timestamp": "1970-01-01T00:16:40", "LON": 1, "LAT": 2, "SOG": null, "COG": null}]', "junk", '{"LON": 1}']
    got = sorted(tuple(r) for r in live.messages(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert [(g[0], g[1]) for g in got] == [(1, 1000.0), (2, 1000.0)]
    assert live.records(json.dumps([{"a": 1}])) == live.records('{"a": 1}\nbad\n') == [{"a": 1}]


def test_poll_goes_on_after_a_failure():
    answers = iter([OSError("down"), b'{"a": 2}'])

    class Answer:
        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self):
            return self.body

    def opener(url, timeout):
        found = next(answers)
        if isinstance(found, Exception):
            raise found
        return Answer(found)

    assert list(live.poll("http://x", every=0, times=2, opener=opener)) == [[], [{"a": 2}]]


def test_windows_for_prediction(spark):
    from fairlead.operators import lstm

    windows = lstm.first_windows(messages(spark).na.fill(0.0), 5)
    assert windows.count() == 3
    model = Lstm.fresh(4, 1)
    models = spark.createDataFrame([(0, 4, model.pack())], "cluster_id int, width int, weights array<double>")
    bounds = [-118.3, -118.2, 33.5, 33.7, 0.0, 10.0, 0.0, 360.0]
    params = spark.createDataFrame([(0, *bounds, "1")], "cluster_id int, lon_min double, lon_max double, lat_min double, lat_max double, sog_min double, sog_max double, cog_min double, cog_max double, schema_version string")
    ahead = lstm.predict_ahead(windows.withColumn("cluster_id", F.lit(0)), models, params)
    assert ahead.count() == 45 and np.isfinite([r["lon"] for r in ahead.collect()]).all()


def test_vessel_counts_statuses_and_shapes():
    near = Forecaster(Assets(routes(spread=0.0), counts={(1, 1): 3}), Prediction(), WIDE)
    assert near.shares(1, [0, 1], '{"0": 1, "1": 3}') == {0: 0.25, 1: 0.75} and near.shares(1, [0, 1], "{}") == {0: 0.5, 1: 0.5}
    assert vessel.fitted(Prediction(), Assets({1: vessel.Route(1, [], 20)})).capacity == 20
    track = Track(2)
    told = [vessel.step(1, track, (t, lon, 30.0, 1.0, None), WIDE, 120.0, Prediction(capacity=2), None, True) for t, lon in ((0.0, 999.0), (0.0, 114.0), (60.0, 114.0), (120.0, 114.0))]
    assert [x["status"] for x in told] == ["no_buffer", "buffering", "buffering", "ready"]
    assert vessel.shaped([{"lon": 1, "lat": 2, "sog": 3, "cog": 4, "timestamp": 5}]) == [{"lon": 1.0, "lat": 2.0, "sog": 3.0, "cog": 4.0, "t": 5.0}]
    with pytest.raises(ValueError):
        vessel.shaped([{"lon": 1, "lat": 2, "sog": 3, "cog": 4}])


def test_messages_from_a_web_address(spark, tmp_path):
    import http.server
    import threading
    import time

    asked = []

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(1)
            self.send_response(500 if len(asked) == 2 else 200)
            self.end_headers()
            self.wfile.write(b'[{"MMSI": 5, "Timestamp": %d, "LON": 1.5, "LAT": 2.5}]' % len(asked))

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    stream = live.watch_url(spark, f"http://127.0.0.1:{server.server_port}/", every=0.2)
    running = stream.writeStream.format("memory").queryName("heard").option("checkpointLocation", str(tmp_path)).start()
    until = time.time() + 90
    while time.time() < until and spark.table("heard").count() < 4:
        time.sleep(1)
    running.stop()
    server.shutdown()
    times = [r["t"] for r in spark.table("heard").orderBy("t").collect()]
    assert times[:4] == [1.0, 3.0, 4.0, 5.0]
