"""Live vessels: an even-spaced track for each, its route, and where it goes next.

The rules for one vessel are plain Python (``Track``, ``Forecaster``); Spark deals
messages to vessels. ``follow`` keeps a track for each vessel in a streaming
query's state, ``replay`` runs the same rules over a table. Messages of a vessel
are taken in order of ``arrival``, which is what a live receiver sees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Cleaning, Prediction, Resampling
from ..functions.dtw import windows_least_many
from ..functions.geo import haversine_number
from ..operators.components import dealt_by
from ..operators.lstm import Lstm, forecast_many

SAME = 1e-6


def known(x) -> bool:
    return x is not None and not math.isnan(x)


def turned(a: float, b: float, share: float) -> float:
    """A bearing on the shorter way from a to b."""
    turn = b - a
    turn += -360 if turn > 180 else 360 if turn < -180 else 0
    return (a + share * turn) % 360


@dataclass
class Track:
    """State of one vessel: even-spaced points, and the reports still needed to make more."""

    capacity: int = 14
    segment: int = 0
    grid: list[list[float]] = field(default_factory=list)
    raw: list[list] = field(default_factory=list)
    course: float | None = None  # the last known one
    fork: dict | None = None

    def clear(self) -> None:
        self.grid, self.raw, self.course, self.fork = [], [], None, None
        self.segment += 1

    @property
    def ready(self) -> bool:
        return len(self.grid) >= self.capacity

    def resize(self, capacity: int) -> None:
        self.capacity = capacity
        del self.grid[:-capacity]

    def window(self, steps: int) -> np.ndarray:
        return np.array([p[1:] for p in self.grid[-steps:]], float)

    def accept(self, t: float, lon: float, lat: float, sog: float, cog: float | None, cleaning: Cleaning, interval: float, timeout: float) -> bool:
        """Take in a message; whether it passed all checks."""
        cog = cog if known(cog) and cog < cleaning.cog_unavailable else None
        box = cleaning.box
        if not (known(lon) and known(lat) and known(sog) and box.lon_min <= lon <= box.lon_max and box.lat_min <= lat <= box.lat_max and cleaning.sog_min <= sog <= cleaning.sog_max) or (cog is not None and cog < 0):
            return False
        if self.raw and abs(t - self.raw[-1][0]) < SAME:
            self.raw[-1] = [t, lon, lat, sog, cog]
            self.course = cog if cog is not None else self.course
            self._extend(interval)
            return True
        if self.raw and 0 < t - self.raw[-1][0] < cleaning.duplicate_seconds:
            return False
        if self.grid and t - self.grid[-1][0] > timeout:
            self.clear()
        if self.grid:
            t0, lon0, lat0 = self.grid[-1][:3]
            if t - t0 <= 0 or haversine_number(lat0, lon0, lat, lon, cleaning.earth_radius) / (t - t0) > cleaning.jump_speed or t < self.raw[-1][0]:
                return False
        self.course = cog if cog is not None else self.course
        self.raw.append([t, lon, lat, sog, cog])
        if not self.grid:
            self.grid.append([t, lon, lat, sog, cog if cog is not None else 0.0])
        self._extend(interval)
        return True

    def _extend(self, interval: float) -> None:
        """Points up to the newest report; reports before the last point's bracket go."""
        filled = self._courses()
        at = 0
        while self.grid[-1][0] + interval <= self.raw[-1][0] + SAME:
            t = self.grid[-1][0] + interval
            while at + 2 < len(self.raw) and self.raw[at + 1][0] <= t:
                at += 1
            a, b = self.raw[at], self.raw[min(at + 1, len(self.raw) - 1)]
            share = min(1.0, max(0.0, (t - a[0]) / (b[0] - a[0]))) if b[0] > a[0] else 0.0
            values = [a[k] + share * (b[k] - a[k]) for k in (1, 2, 3)]
            self.grid.append([t, *values, turned(filled[at], filled[min(at + 1, len(self.raw) - 1)], share)])
        del self.grid[: -self.capacity]
        keep = 0
        while keep + 1 < len(self.raw) and self.raw[keep + 1][0] <= self.grid[-1][0]:
            keep += 1
        for k in range(keep, len(self.raw)):  # a course filled forward must outlive what it came from
            if self.raw[k][4] is None and k == keep and any(r[4] is not None for r in self.raw[: keep + 1]):
                self.raw[k][4] = filled[k]
        del self.raw[:keep]

    def _courses(self) -> list[float]:
        """Courses of the reports: the last known one, else the next known one, else 0."""
        out, last = [], None
        for r in self.raw:
            last = r[4] if r[4] is not None else last
            out.append(last)
        ahead = next((c for c in out if c is not None), 0.0)
        return [ahead if c is None else c for c in out]

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Track:
        return cls(**json.loads(text))


class Moment(Track):
    """A track as it was at a message, with what was found for it beforehand: distances to routes and predicted points by route."""

    near: list[tuple[float, int]] | None = None
    made: dict[int, np.ndarray] | None = None

    @classmethod
    def of(cls, track: Track) -> Moment:
        return cls(track.capacity, track.segment, list(track.grid))


@dataclass
class Route:
    """What is known of a route: its path, window, model and bounds."""

    cluster_id: int
    path: list[tuple[float, float]]
    steps: int
    width: int = 0
    weights: list[float] | None = None
    low: tuple[float, ...] = (0, 0, 0, 0)
    high: tuple[float, ...] = (1, 1, 1, 1)


@dataclass
class Assets:
    """Small tables that every task needs. Channels: lists of points by id; junctions: (lon, lat, radius, routes)."""

    routes: dict[int, Route] = field(default_factory=dict)
    threshold: float = 0.15
    counts: dict[tuple[int, int], int] | None = None
    channels: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    junctions: list[tuple[float, float, float, list[int]]] = field(default_factory=list)


class Forecaster:
    """Routes and predictions for tracks."""

    def __init__(self, assets: Assets, rules: Prediction = Prediction(), cleaning: Cleaning = Cleaning(), interval: float = 120.0):
        self.assets, self.rules, self.cleaning, self.interval = assets, rules, cleaning, interval
        self.models = {k: Lstm.unpack(r.width, r.weights) for k, r in assets.routes.items() if r.weights is not None}

    def distances(self, track: Track, allowed: set[int] | None) -> list[tuple[float, int]]:
        near = track.near if isinstance(track, Moment) and track.near is not None else self.all_distances([track])[0]
        return [x for x in near if allowed is None or x[1] in allowed]

    def all_distances(self, tracks: list[Track]) -> list[list[tuple[float, int]]]:
        """For each track its distances to all routes, the least first."""
        found: list[list[tuple[float, int]]] = [[] for _ in tracks]
        for k, route in self.assets.routes.items():
            own = [n for n, track in enumerate(tracks) if len(track.grid) >= route.steps]
            path = np.array(route.path, float)
            for n, d in zip(own, windows_least_many([tracks[n].window(route.steps)[:, :2] for n in own], [path] * len(own))):
                found[n].append((float(d), k))
        return [sorted(x) for x in found]

    def prepare(self, moments: list[Moment]) -> None:
        """Distances and predictions of many moments, all of a route at once; any that ``answer`` lacks it makes itself."""
        wanted: dict[int, list[Moment]] = {}
        for moment, near in zip(moments, self.all_distances(moments)):
            moment.near, moment.made = near, {}
            for k in self.likely(moment):
                if k in self.models and len(moment.grid) >= self.assets.routes[k].steps:
                    wanted.setdefault(k, []).append(moment)
        for k, own in wanted.items():
            route = self.assets.routes[k]
            made = forecast_many(self.models[k], np.stack([m.window(route.steps) for m in own]), np.array(route.low), np.array(route.high), self.rules.steps)
            for moment, points in zip(own, made):
                moment.made[k] = points

    def forked(self, near: list[tuple[float, int]]) -> list[tuple[float, int]]:
        """The nearest routes if they are a fork, else none."""
        top = near[: max(2, self.rules.branches)]
        return top if len(top) >= 2 and 0 < top[1][0] < math.inf and (top[1][0] - top[0][0]) / top[1][0] <= self.rules.fork_ratio else []

    def likely(self, track: Track) -> list[int]:
        """Routes that ``answer`` will predict, unless a branch is locked."""
        allowed = self.fork_routes(track)
        top = self.forked(self.distances(track, allowed)) if allowed is None or len(allowed) >= 2 else []
        return [k for d, k in top if math.isfinite(d)] or [k for d, k in self.distances(track, None)[:1] if d <= self.assets.threshold]

    def fork_routes(self, track: Track) -> set[int] | None:
        """Routes that may fork here; None means anywhere, as no junctions are known."""
        if not self.assets.junctions:
            return None
        _, lon, lat, *_ = track.grid[-1]
        return next((set(r) for jlon, jlat, radius, r in self.assets.junctions if haversine_number(lat, lon, jlat, jlon) <= radius), set())

    def ahead(self, track: Track, cluster: int, now: float) -> list[dict]:
        route, model = self.assets.routes[cluster], self.models.get(cluster)
        if model is None or len(track.grid) < route.steps:
            return []
        made = track.made.get(cluster) if isinstance(track, Moment) and track.made else None
        if made is None:
            made = forecast_many(model, track.window(route.steps)[None], np.array(route.low), np.array(route.high), self.rules.steps)[0]
        return [{"step": k + 1, "t": now + (k + 1) * self.interval, "lon": y[0], "lat": y[1], "sog": y[2], "cog": y[3]} for k, y in enumerate(made.tolist())]

    def channel_metres(self, lon: float, lat: float, line: list[tuple[float, float]]) -> float:
        return min((haversine_number(lat, lon, a[1] + k / 20 * (b[1] - a[1]), a[0] + k / 20 * (b[0] - a[0])) for a, b in zip(line, line[1:]) for k in range(21)), default=math.inf)

    def pruned(self, track: Track, branches: dict[int, list[dict]]) -> dict[int, list[dict]]:
        _, lon, lat, *_ = track.grid[-1]
        near = [line for line in self.assets.channels.values() if self.channel_metres(lon, lat, line) <= self.rules.search_metres]
        kept = {k: b for k, b in branches.items() if b and near and min(self.channel_metres(b[0]["lon"], b[0]["lat"], line) for line in near) <= self.rules.deviation_metres}
        return kept or branches

    def shares(self, mmsi: int, clusters: list[int], seen: str | None = None) -> dict[int, float]:
        """Shares of the vessel's past voyages: from ``seen`` (route to count, as JSON), else from the assets, else equal."""
        if seen is None and self.assets.counts is None:
            return {k: 1 / len(clusters) for k in clusters}
        own = {int(k): v for k, v in json.loads(seen).items()} if seen is not None else {k: self.assets.counts.get((mmsi, k), 0) for k in clusters}
        n = {k: own.get(k, 0) for k in clusters}
        total = sum(n.values())
        return {k: (v / total if total else 1 / len(clusters)) for k, v in n.items()}

    def lock(self, state: dict) -> int | None:
        """The branch whose predictions have been clearly nearest, after enough of them."""
        far = sorted((d, int(k)) for k, d in state["metres"].items())
        if state["seen"] < self.rules.lock_observations or len(far) < 2 or not math.isfinite(far[1][0]):
            return None
        return far[0][1] if far[0][0] * self.rules.lock_ratio < far[1][0] else None

    def answer(self, mmsi: int, track: Track, now: float, seen: str | None = None) -> dict:
        """The result for a vessel whose track is ready; a matched route without a model has the status missing_cluster_asset."""
        out = {"status": "predicted", "cluster_id": None, "match_distance": None, "points": [], "is_fork": False, "fork_probabilities": None, "branch_predictions": None, "fork_locked_by_disambiguation": False}

        def locked(cluster: int) -> dict:
            return out | modelled(cluster) | {"cluster_id": cluster, "points": self.ahead(track, cluster, now), "fork_locked_by_disambiguation": True}

        def modelled(cluster: int) -> dict:
            return {} if cluster in self.models else {"status": "missing_cluster_asset"}

        state = track.fork
        if self.rules.disambiguate and state and state["locked"] is not None:
            if state["locked"] in self.assets.routes:
                return locked(state["locked"])
            track.fork = state = None
        allowed = self.fork_routes(track)
        near = self.distances(track, allowed) if allowed is None or len(allowed) >= 2 else []
        top = self.forked(near)
        if not top:
            track.fork = None
            best = (near if allowed is None else self.distances(track, None))[:1]
            if not best or not best[0][0] <= self.assets.threshold:
                return out | {"status": "unknown_cluster", "match_distance": best[0][0] if best and math.isfinite(best[0][0]) else None}
            return out | modelled(best[0][1]) | {"cluster_id": best[0][1], "match_distance": best[0][0], "points": self.ahead(track, best[0][1], now)}
        clusters = [k for d, k in top if math.isfinite(d)]
        branches = self.pruned(track, {k: self.ahead(track, k, now) for k in clusters})
        if self.rules.disambiguate:
            if state is None or sorted(state["candidates"]) != sorted(clusters):
                state = track.fork = {"candidates": sorted(clusters), "metres": {}, "seen": 0, "last": {}, "locked": None}
            elif state["last"]:
                _, lon, lat, *_ = track.grid[-1]
                for k, (plon, plat) in state["last"].items():
                    state["metres"][k] = state["metres"].get(k, 0.0) + haversine_number(lat, lon, plat, plon)
                state["seen"] += 1
            state["locked"] = self.lock(state)
            if state["locked"] in self.models:
                return locked(state["locked"])
            if state["locked"] is not None:  # no model: the lock is dropped
                state = track.fork = {"candidates": sorted(clusters), "metres": {}, "seen": 0, "last": {}, "locked": None}
            state["last"] = {str(k): (b[0]["lon"], b[0]["lat"]) for k, b in branches.items() if b}
        primary = next((k for k in clusters if k in branches), clusters[0])
        return out | modelled(primary) | {"cluster_id": primary, "match_distance": top[0][0], "points": branches.get(primary, []), "is_fork": True, "fork_probabilities": self.shares(mmsi, clusters, seen), "branch_predictions": branches}


POINT = "struct<step:int,t:double,lon:double,lat:double,sog:double,cog:double>"
RESULT = f"mmsi long, t double, segment int, status string, cluster_id int, match_distance double, points array<{POINT}>, prediction_count int, is_fork boolean, fork_probabilities map<int,double>, branch_predictions map<int,array<{POINT}>>, fork_locked_by_disambiguation boolean, window array<array<double>>, schema_version string"
NAMES = [c.split()[0] for c in RESULT.replace("<", "(").split(", ")]


def heard(mmsi: int, track: Track, row: tuple, cleaning: Cleaning, interval: float, rules: Prediction, every: bool = False) -> dict | Moment | None:
    """Take in a message: the moment of the track if it was accepted and the track is ready. With ``every`` any other message has a
    result: ``buffering`` where the vessel has a track that is not full or did not take the message, else ``no_buffer``."""
    t, lon, lat, sog, cog, *_ = row
    if track.accept(float(t), lon, lat, sog, cog, cleaning, interval, rules.timeout_seconds) and track.ready:
        return Moment.of(track)
    if not every:
        return None
    found = {"status": "buffering" if track.grid else "no_buffer", "points": []}
    return {k: None for k in NAMES} | found | {"mmsi": mmsi, "t": float(t), "segment": track.segment, "prediction_count": 0, "schema_version": "1"}


def answers(messages: list[tuple[int, Track, tuple]], cleaning: Cleaning, interval: float, rules: Prediction, forecaster: Forecaster | None, every: bool = False) -> list[dict]:
    """The results of messages (mmsi, track, row) in order of vessel and arrival. Distances and predictions need only
    the points of a track, so those of all messages are made at once; forks follow the messages one by one."""
    forks = {id(track): (track.segment, track.fork) for _, track, _ in messages}
    taken = [(mmsi, track, row, found) for mmsi, track, row in messages if (found := heard(mmsi, track, row, cleaning, interval, rules, every)) is not None]
    if forecaster:
        forecaster.prepare([found for *_, found in taken if isinstance(found, Moment)])
    out = []
    for mmsi, track, row, found in taken:
        if isinstance(found, Moment):
            moment, t, (segment, fork) = found, float(row[0]), forks[id(track)]
            moment.fork = fork if segment == moment.segment else None  # a fork ends with its segment
            made = forecaster.answer(mmsi, moment, t, row[5] if len(row) > 5 and row[5] else None) if forecaster else {"status": "ready", "points": []}
            forks[id(track)] = moment.segment, moment.fork
            found = {k: None for k in NAMES} | made | {"mmsi": mmsi, "t": t, "segment": moment.segment, "prediction_count": len(made["points"]), "window": [p[1:] for p in moment.grid], "schema_version": "1"}
        out.append(found)
    for _, track, _ in messages:
        segment, fork = forks[id(track)]
        track.fork = fork if segment == track.segment else None
    return out


def step(mmsi: int, track: Track, row: tuple, cleaning: Cleaning, interval: float, rules: Prediction, forecaster: Forecaster | None, every: bool = False) -> dict | None:
    """A message's result, if it has one."""
    return next(iter(answers([(mmsi, track, row)], cleaning, interval, rules, forecaster, every)), None)


def shaped(points: list[dict]) -> list[dict]:
    """Predicted points as (lon, lat, sog, cog, t); the time may be named ``timestamp``. A point without one is an error."""
    out = []
    for p in points:
        t = p.get("timestamp", p.get("t"))
        if t is None:
            raise ValueError("a predicted point needs a timestamp")
        out.append({**{c: float(p[c]) for c in ("lon", "lat", "sog", "cog")}, "t": float(t)})
    return out


#: Messages whose distances and predictions are made at once.
MESSAGES = 2000

_made: dict[int, tuple] = {}


def forecaster_of(shared) -> Forecaster | None:
    """The forecaster of a broadcast (assets, rules, cleaning, interval), made once in each worker."""
    held = shared.value
    if held[0] is None:
        return None
    if _made.get(id(held), (None,))[0] is not held:
        _made.clear()
        _made[id(held)] = held, Forecaster(*held)
    return _made[id(held)][1]


def dealt(messages: DataFrame, arrival: str, counts: DataFrame | None) -> DataFrame:
    """Messages with a vessel and a time, with the vessel's past voyages (mmsi, cluster_id, voyages) as JSON in ``seen``."""
    wanted = messages.where("mmsi IS NOT NULL AND t IS NOT NULL").select("mmsi", arrival, "t", "lon", "lat", "sog", "cog")
    if counts is None:
        return wanted.withColumn("seen", F.lit(None).cast("string"))
    entry = F.struct(F.col("cluster_id").cast("string"), F.col("voyages").cast("long"))
    packed = counts.groupBy("mmsi").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("seen"))
    return wanted.join(packed, "mmsi", "left").withColumn("seen", F.coalesce("seen", F.lit("{}")))


def fitted(rules: Prediction, assets: Assets | None) -> Prediction:
    """Rules whose tracks are long enough for the longest window of any route."""
    longest = max((r.steps for r in assets.routes.values()), default=0) if assets else 0
    return replace(rules, capacity=max(rules.capacity, longest))


def replay(messages: DataFrame, assets: Assets | None = None, cleaning: Cleaning = Cleaning(), resampling: Resampling = Resampling(), rules: Prediction = Prediction(), arrival: str = "arrival", counts: DataFrame | None = None, every: bool = False) -> DataFrame:
    """The results of a table of messages (mmsi, t, lon, lat, sog, cog, arrival).

    Rows are sorted inside partitions, and one vessel's track is in memory at a time.
    Past voyages are joined by vessel, so no task holds those of all. ``every`` adds
    a row for each message without an answer.
    """
    rules = fitted(rules, assets)
    shared = messages.sparkSession.sparkContext.broadcast((assets, rules, cleaning, resampling.seconds))  # the routes of a port
    ordered = dealt_by(dealt(messages, arrival, counts), "mmsi").sortWithinPartitions("mmsi", arrival)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forecaster = forecaster_of(shared)
        current, track = None, None
        for batch in batches:
            messages = []
            for mmsi, _, *row in batch.itertuples(index=False, name=None):
                if mmsi != current:
                    current, track = mmsi, Track(rules.capacity)
                messages.append((int(mmsi), track, tuple(row)))
            for a in range(0, len(messages), MESSAGES):
                yield pd.DataFrame(answers(messages[a : a + MESSAGES], cleaning, resampling.seconds, rules, forecaster, every), columns=NAMES)

    return ordered.mapInPandas(run, RESULT)


def follow(messages: DataFrame, assets: Assets | None = None, cleaning: Cleaning = Cleaning(), resampling: Resampling = Resampling(), rules: Prediction = Prediction(), arrival: str = "arrival", idle_ms: int | None = 24 * 3600 * 1000, counts: DataFrame | None = None, every: bool = False) -> DataFrame:
    """The same for a stream. A track that hears nothing for ``idle_ms`` is forgotten; with None none ever is."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    rules = fitted(rules, assets)
    shared = messages.sparkSession.sparkContext.broadcast((assets, rules, cleaning, resampling.seconds))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        track = Track.load(state.get[0]) if state.exists else Track(rules.capacity)
        track.resize(rules.capacity)
        told = pd.concat(list(batches)).sort_values(arrival, kind="stable")  # of one vessel since the last trigger
        messages = [(int(key[0]), track, row) for row in told[["t", "lon", "lat", "sog", "cog", "seen"]].itertuples(index=False, name=None)]
        rows = answers(messages, cleaning, resampling.seconds, rules, forecaster_of(shared), every)
        state.update((track.dump(),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=NAMES)

    return dealt(messages, arrival, counts).groupBy("mmsi").applyInPandasWithState(run, RESULT, "track string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
