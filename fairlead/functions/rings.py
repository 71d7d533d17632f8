"""Points in polygons, as columns."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]
Polygon = list[Ring]


def polygons_of(document: dict | str, bare: bool = True) -> list[Polygon]:
    """Polygons of a GeoJSON document: a collection, a feature, or with ``bare`` also a geometry alone."""
    data = json.loads(document) if isinstance(document, str) else document
    kind = data.get("type")
    if kind == "FeatureCollection":
        return [p for f in data.get("features", []) for p in polygons_of(f)]
    if kind == "Feature":
        return polygons_of(data.get("geometry") or {})
    if not bare:
        return []
    if kind == "Polygon":
        return [[[(float(x), float(y)) for x, y, *_ in ring] for ring in data["coordinates"]]]
    if kind == "MultiPolygon":
        return [[[(float(x), float(y)) for x, y, *_ in ring] for ring in part] for part in data["coordinates"]]
    if kind == "GeometryCollection":
        return [p for g in data.get("geometries", []) for p in polygons_of(g)]
    return []


def covers(polygons: list[Polygon], lon: Column, lat: Column) -> Column:
    """Whether a point is in any polygon or on its edge. No polygon covers nothing."""
    found = [_one(p, lon, lat) for p in polygons if p]
    known = lon.isNotNull() & lat.isNotNull()
    return known & reduce(Column.__or__, found) if found else F.lit(False)


def _one(polygon: Polygon, lon: Column, lat: Column) -> Column:
    inside, edge = None, None
    for ring in polygon:
        crossings, on = _ring(ring, lon, lat)
        inside = crossings if inside is None else inside + crossings
        edge = on if edge is None else edge | on
    box = [v for ring in polygon for v in ring]
    near = lon.between(min(x for x, _ in box), max(x for x, _ in box)) & lat.between(min(y for _, y in box), max(y for _, y in box))
    # Crossings of all rings together: odd inside the outer ring and outside its holes.
    return near & (edge | (inside % 2 == 1))


def _ring(ring: Ring, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Edges crossed by a ray to the east, and whether the point lies on an edge."""
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (*a, *b))]) for a, b in zip(closed, closed[1:])])
    side = lambda e: (e["x1"] - e["x0"]) * (lat - e["y0"]) - (e["y1"] - e["y0"]) * (lon - e["x0"])
    crossed = F.size(F.filter(edges, lambda e: ((e["y0"] > lat) != (e["y1"] > lat)) & (lon < (e["x1"] - e["x0"]) * (lat - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])))
    on = F.exists(edges, lambda e: (side(e) == 0) & lon.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & lat.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"])))
    return crossed, on
