"""Live messages as JSON: an array or one object a line, from files, streams or a web address."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

MESSAGE = "MMSI BIGINT, Timestamp STRING, LON DOUBLE, LAT DOUBLE, SOG DOUBLE, COG DOUBLE"


def parsed(text: Column, schema: str) -> Column:
    """One JSON object; null where the text is none."""
    return F.from_json(text, schema)


def messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """(mmsi, t, lon, lat, sog, cog) from lines that hold an object or an array of objects; times as numbers or ISO text."""
    body = F.trim(F.col(column))
    many = F.from_json(body, f"ARRAY<STRUCT<{MESSAGE.replace(' ', ': ').replace(',: ', ', ')}>>")
    each = lines.select(F.explode(many).alias("m"))
    seconds = F.coalesce(F.expr("try_cast(m.Timestamp AS DOUBLE)"), F.unix_micros(F.expr("try_cast(m.Timestamp AS TIMESTAMP)")) / F.lit(1e6))
    return each.select(F.col("m.MMSI").alias("mmsi"), seconds.alias("t"), F.col("m.LON").alias("lon"), F.col("m.LAT").alias("lat"), F.col("m.SOG").alias("sog"), F.col("m.COG").alias("cog")).dropna(subset=["mmsi", "t", "lon", "lat"])


def watch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of messages from text files that arrive in a folder."""
    return messages(spark.readStream.text(folder))


def records(text: str) -> list[dict]:
    """Objects of a JSON array, or of lines of JSON; lines that are none are left out."""
    text = text.strip()
    if text.startswith("["):
        return [x for x in json.loads(text) if isinstance(x, dict)]
    out = []
    for line in text.splitlines():
        try:
            value = json.loads(line)
        except ValueError:
            continue
        if isinstance(value, dict):
            out.append(value)
    return out


def poll(url: str, every: float = 5.0, times: int | None = None, opener=urllib.request.urlopen) -> Iterator[list[dict]]:
    """Answers of a web address, again and again; one that fails is empty and asked for again."""
    asked = 0
    while times is None or asked < times:
        asked += 1
        try:
            with opener(url, timeout=30) as answer:
                yield records(answer.read().decode())
        except (OSError, ValueError):
            yield []
        if times is None or asked < times:
            time.sleep(every)


class HttpReader(SimpleDataSourceStreamReader):
    """Each read asks the address once; an answer that fails is empty and the next read asks again."""

    def __init__(self, options: dict):
        self.url, self.timeout, self.every = options["url"], float(options.get("timeout", 30)), float(options.get("every", 5))
        self.held: dict[int, list[tuple[str]]] = {}
        self.asked_at = 0.0

    def initialOffset(self) -> dict:
        return {"asked": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        time.sleep(max(0.0, self.asked_at + self.every - time.monotonic()))
        self.asked_at = time.monotonic()
        try:
            with urllib.request.urlopen(self.url, timeout=self.timeout) as answer:
                rows = [(json.dumps(r),) for r in records(answer.read().decode())]
        except (OSError, ValueError):
            rows = []
        self.held[start["asked"]] = rows
        return iter(rows), {"asked": start["asked"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        """What was read before; nothing after a restart, as an address does not answer for the past."""
        return iter([row for k in range(start["asked"], end["asked"]) for row in self.held.get(k, [])])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.held if k < end["asked"]]:
            del self.held[k]


class HttpMessages(DataSource):
    """Stream of JSON objects, one a row, from a web address. Options: url, every (seconds between two reads), timeout."""

    @classmethod
    def name(cls) -> str:
        return "http_messages"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> HttpReader:
        return HttpReader(dict(self.options))


def watch_url(spark: SparkSession, url: str, every: float = 5.0) -> DataFrame:
    """A stream of messages from a web address that answers with a JSON array or one object a line."""
    spark.dataSource.register(HttpMessages)
    return messages(spark.readStream.format("http_messages").option("url", url).option("every", str(every)).load())
