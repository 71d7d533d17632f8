"""Small files of a port: polygons, channel centrelines, fork junctions, voyage counts.

All are read through Spark, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rings import Polygon, polygons_of
from ..operators.spatial import channel_segments, junction_table


def document(spark: SparkSession, path: str) -> dict | list | None:
    """The JSON in a file; None if it is missing or no JSON."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()  # one small file
        return json.loads(rows[0]["value"]) if rows else None
    except ValueError:
        return None
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return None


def load_polygons(spark: SparkSession, *paths: str, bare: bool = True) -> list[Polygon]:
    """The polygons of all files together; blank paths and missing files have none."""
    return [p for path in paths if path.strip() for p in polygons_of(document(spark, path) or {}, bare)]


def centrelines(data: dict | None) -> list[tuple[str, list[tuple[float, float]]]]:
    """(channel id, points) of the line features with two points or more; named by id, name, or place."""
    out = []
    for k, feature in enumerate((data or {}).get("features", [])):
        shape, known = feature.get("geometry") or {}, feature.get("properties") or {}
        if shape.get("type") == "LineString" and len(shape.get("coordinates", [])) >= 2:
            out.append((str(known.get("channel_id") or known.get("name") or f"line_{k}"), [(float(x), float(y)) for x, y, *_ in shape["coordinates"]]))
    return out


def load_channels(spark: SparkSession, path: str) -> DataFrame:
    """Segments of the centrelines in a file; none if it is missing or holds no lines."""
    found = document(spark, path)
    return channel_segments(spark, centrelines(found if isinstance(found, dict) else None))


def load_junctions(spark: SparkSession, path: str) -> DataFrame:
    """Junctions of a file, a list or an object with ``junctions``."""
    found = document(spark, path)
    entries = found.get("junctions", []) if isinstance(found, dict) else found or []
    return junction_table(spark, [e for e in entries if isinstance(e, dict)])


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    """(mmsi, cluster_id, voyages) from JSON of vessel to route to count; keys that are no numbers are left out."""
    nested = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, MAP<STRING, BIGINT>>").alias("m"))
    vessels = nested.select(F.explode("m").alias("mmsi", "routes"))
    rows = vessels.select(F.expr("try_cast(mmsi AS BIGINT)").alias("mmsi"), F.explode("routes").alias("route", "voyages"))
    return rows.select("mmsi", F.expr("try_cast(route AS INT)").alias("cluster_id"), "voyages").dropna()
