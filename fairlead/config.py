"""Settings, one frozen record for each part of the work."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any


# The defaults of all records below are those of the method.


@dataclass(frozen=True)
class Box:
    lon_min: float
    lat_min: float
    lon_max: float
    lat_max: float


@dataclass(frozen=True)
class Domain:
    """The port area: a coarse box, vessel types, and polygon files for the fine filter."""

    enabled: bool = False
    subset_root: str = ""
    raw_root: str = ""
    box: Box = Box(-118.5, 33.45, -118.0, 33.85)
    vessel_types: tuple[int, ...] = tuple(range(70, 90))
    classes: tuple[str, ...] = ()
    outer_roi: str = ""
    inner_roi: str = ""
    corridor: str = ""
    terminals: tuple[str, ...] = ()
    anchorages: tuple[str, ...] = ()

    @property
    def active(self) -> bool:
        return self.enabled or bool(self.subset_root.strip())


@dataclass(frozen=True)
class Cleaning:
    box: Box = Box(113.5, 29.8, 115.5, 31.2)
    sog_min: float = 0.0
    sog_max: float = 25.0
    sog_candidates: tuple[float, ...] = (30.0, 35.0, 40.0)
    cog_unavailable: float = 360.0
    heading_unavailable: float = 511.0
    keep_missing_cog: bool = True
    duplicate_seconds: float = 1.0
    jump_factor: float = 1.5
    knot: float = 0.5144
    earth_radius: float = 6371000.0

    @property
    def jump_speed(self) -> float:
        """Metres a second above which two positions cannot be of one vessel."""
        return self.sog_max * self.knot * self.jump_factor


@dataclass(frozen=True)
class Berth:
    mode: str = "delete"
    metres: float = 50.0
    knots: float = 0.5
    seconds: float = 1800.0
    terminal_knots: float = 3.0
    anchorage_knots: float = 3.0
    channel_knots: float = 4.0


@dataclass(frozen=True)
class Voyages:
    gap_seconds: float = 7200.0
    min_points: int = 20


@dataclass(frozen=True)
class Resampling:
    seconds: float = 120.0
    ablation: tuple[float, ...] = (60.0, 120.0)
    heading: str = "omit"


@dataclass(frozen=True)
class Clustering:
    eps: float = 0.001
    min_points: int = 5
    split_sigma: float = 2.0
    max_depth: int = 5
    min_size: int = 3
    merge_threshold: float | None = None
    merge_sigma: float = 2.0


@dataclass(frozen=True)
class Training:
    epsilon: float = 1e-8
    train_share: float = 0.7
    validation_share: float = 0.15
    seed: int = 42
    batch: int = 128
    epochs: int = 500
    rate: float = 0.001
    dropout: float = 0.2
    stop_patience: int = 40
    rate_patience: int = 15
    rate_factor: float = 0.5
    train_years: tuple[int, ...] = (2023,)
    validation_years: tuple[int, ...] = ()
    test_years: tuple[int, ...] = (2024,)
    #: (curvature below, value); the last holds for all else.
    steps: tuple[tuple[float, int], ...] = ((1.05, 14), (1.45, 12), (2.0, 10), (float("inf"), 8))
    width: tuple[tuple[float, int], ...] = ((1.05, 88), (1.35, 108), (1.45, 128), (2.0, 168), (float("inf"), 188))


@dataclass(frozen=True)
class Prediction:
    steps: int = 15
    timeout_seconds: float = 7200.0
    capacity: int = 14
    unknown_threshold: float | None = None
    unknown_fallback: float = 0.15
    branches: int = 3
    fork_ratio: float = 0.15
    deviation_metres: float = 10.0
    search_metres: float = 800.0
    lock_observations: int = 2
    lock_ratio: float = 1.35
    disambiguate: bool = True


@dataclass(frozen=True)
class Settings:
    domain: Domain = field(default_factory=Domain)
    cleaning: Cleaning = field(default_factory=Cleaning)
    berth: Berth = field(default_factory=Berth)
    voyages: Voyages = field(default_factory=Voyages)
    resampling: Resampling = field(default_factory=Resampling)
    clustering: Clustering = field(default_factory=Clustering)
    training: Training = field(default_factory=Training)
    prediction: Prediction = field(default_factory=Prediction)

    def with_domain_box(self) -> Settings:
        """The cleaning box becomes the domain's, if the domain is active."""
        return dataclasses.replace(self, cleaning=dataclasses.replace(self.cleaning, box=self.domain.box)) if self.domain.active else self

    def with_interval(self, seconds: float | None) -> Settings:
        return self if seconds is None else dataclasses.replace(self, resampling=dataclasses.replace(self.resampling, seconds=seconds))


def port_cleaning(settings: Settings, sog_max: float | None = None, duplicate_seconds: float | None = None, cog_unavailable: float | None = None, heading_unavailable: float | None = None, gap_seconds: float | None = None, channel_knots: float | None = None) -> Settings:
    """Settings with a port's own values in all parts that use them; None leaves a value as it is."""
    given = lambda **x: {k: v for k, v in x.items() if v is not None}
    return dataclasses.replace(
        settings,
        cleaning=dataclasses.replace(settings.cleaning, **given(sog_max=sog_max, duplicate_seconds=duplicate_seconds, cog_unavailable=cog_unavailable, heading_unavailable=heading_unavailable)),
        voyages=dataclasses.replace(settings.voyages, **given(gap_seconds=gap_seconds)),
        berth=dataclasses.replace(settings.berth, **given(channel_knots=channel_knots)),
    )


def raw_folder(domain: Domain, plain: str) -> str:
    """Where the zip files lie: the domain's own root before the plain one."""
    return domain.raw_root.strip() or plain


def store_folder(domain: Domain, plain: str) -> str:
    """Where reports are stored: below the subset root, else the domain's part of the plain folder, else its part for all reports."""
    if domain.subset_root.strip():
        return f"{domain.subset_root.strip().rstrip('/')}/raw_daily_filtered"
    return f"{plain.rstrip('/')}/{'subsets' if domain.enabled else 'all'}"


def override(settings: Any, changes: dict) -> Any:
    """Settings with nested changes; unknown names are ignored, and nothing is overwritten later."""
    known = {f.name: getattr(settings, f.name) for f in dataclasses.fields(settings)}
    fresh = {}
    for name, value in changes.items():
        if name in known:
            old = known[name]
            fresh[name] = override(old, value) if dataclasses.is_dataclass(old) and isinstance(value, dict) else tuple(value) if isinstance(value, list) else value
    return dataclasses.replace(settings, **fresh)


def snapshot(settings: Settings) -> str:
    """Settings as JSON."""
    return json.dumps(dataclasses.asdict(settings), sort_keys=True)
