"""Order-dependent rules for each vessel, as folds over sorted partitions.

Rows are dealt by key and sorted inside partitions by Spark, which spills if it
must. A Python fold then reads the sorted rows in Arrow batches and carries its
state from one to the next, so a vessel with very many rows costs time but never
memory: no group is collected.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..config import Berth, Cleaning
from ..functions.geo import haversine_number

#: A fold is made anew for each key: it takes a row's values and says for which earlier or present rows it knows the answer.
Fold = Callable[[], Any]


def sorted_fold(df: DataFrame, key: str, order: list[str], reads: list[str], make: Callable[[], Any], flag: str) -> DataFrame:
    """Add the boolean column ``flag`` from a fold along ``order`` within ``key``.

    ``make()`` gives an object with ``push(values) -> list[bool]`` and ``close() ->
    list[bool]``: answers for rows in order, as soon as they are known. Rows with a
    null key are left out, as no vessel owns them.
    """
    dealt = df.where(df[key].isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    schema = T.StructType([*dealt.schema.fields, T.StructField(flag, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        answers: list[bool] = []
        fold, current = None, None

        def ready(everything: bool) -> Iterator[pa.RecordBatch]:
            while waiting and (len(answers) >= waiting[0].num_rows):
                batch = waiting.pop(0)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers[:n], pa.bool_())], names=schema.names)
                del answers[:n]
            if not everything and waiting and answers and len(answers) > 0 and len(waiting) > 1:
                head = waiting[0].slice(0, len(answers))
                waiting[0] = waiting[0].slice(len(answers))
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array(answers, pa.bool_())], names=schema.names)
                answers.clear()

        for batch in batches:
            waiting.append(batch)
            names = batch.schema.names
            keys = batch.column(names.index(key)).to_pylist()
            values = zip(*[batch.column(names.index(c)).to_pylist() for c in reads])
            for k, row in zip(keys, values):
                if fold is None or k != current:
                    if fold is not None:
                        answers += fold.close()
                    fold, current = make(), k
                answers += fold.push(row)
            yield from ready(False)
        if fold is not None:
            answers += fold.close()
        yield from ready(True)

    return dealt.mapInArrow(run, schema)


class Skipping:
    """A fold that answers no for rows without a time or place, and does not show them to the fold inside."""

    def __init__(self, inner: Any, needed: int):
        self.inner, self.needed = inner, needed
        self.order: deque[bool] = deque()  # for each row not answered yet, whether it is shown
        self.known: deque[bool] = deque()

    def _answers(self, more: list[bool]) -> list[bool]:
        self.known.extend(more)
        out: list[bool] = []
        while self.order and (not self.order[0] or self.known):
            out.append(self.known.popleft() if self.order.popleft() else False)
        return out

    def push(self, row: tuple) -> list[bool]:
        whole = all(x is not None and x == x for x in row[: self.needed])
        self.order.append(whole)
        return self._answers(self.inner.push(row) if whole else [])

    def close(self) -> list[bool]:
        return self._answers(self.inner.close())


class JumpFold:
    """Keeps a row unless the speed from the last kept one is impossible, or no time has passed."""

    def __init__(self, limit: float, radius: float):
        self.limit, self.radius, self.last = limit, radius, None

    def push(self, row: tuple) -> list[bool]:
        t, lon, lat = row
        if self.last is not None:
            t0, lon0, lat0 = self.last
            if t - t0 <= 0 or haversine_number(lat0, lon0, lat, lon, self.radius) / (t - t0) > self.limit:
                return [False]
        self.last = row
        return [True]

    def close(self) -> list[bool]:
        return []


class DuplicateFold:
    """Keeps a row unless it follows the last kept one by less than ``seconds``."""

    def __init__(self, seconds: float):
        self.seconds, self.last = seconds, None

    def push(self, row: tuple) -> list[bool]:
        if self.last is not None and row[0] - self.last < self.seconds:
            return [False]
        self.last = row[0]
        return [True]

    def close(self) -> list[bool]:
        return []


class BerthFold:
    """Marks stretches in which a vessel stays near their first position, slow, for long.

    From an anchor the stretch runs on while positions are nearer than ``metres`` to
    the anchor and no speed in it reaches ``knots`` (a missing speed counts as slow).
    If it spans more than ``seconds`` all of it is marked and the next row is the new
    anchor; otherwise the row after the anchor is. As soon as a stretch is long
    enough its rows are answered, so only rows of the last ``seconds`` ever wait.
    """

    def __init__(self, rules: Berth, radius: float):
        self.rules, self.radius = rules, radius
        self.rows: list[tuple] = []  # from the anchor on, or after a stretch that is long enough
        self.checked = 1  # rows from the anchor on that are known to belong together
        self.berth: tuple | None = None  # the anchor of a stretch that is long enough

    def _fits(self, anchor: tuple, row: tuple) -> bool:
        _, lon, lat, sog = row
        _, lon0, lat0, sog0 = anchor
        fast = (sog is not None and sog >= self.rules.knots) or (sog0 is not None and sog0 >= self.rules.knots)
        return not fast and haversine_number(lat0, lon0, lat, lon, self.radius) < self.rules.metres

    def _advance(self, closing: bool) -> list[bool]:
        out: list[bool] = []
        rows = self.rows
        while rows:
            if self.berth is not None:
                k = 0
                while k < len(rows) and self._fits(self.berth, rows[k]):
                    k += 1
                out += [True] * k
                del rows[:k]
                if rows:
                    self.berth, self.checked = None, 1
                continue
            long = False
            while self.checked < len(rows) and not long and self._fits(rows[0], rows[self.checked]):
                self.checked += 1
                long = rows[self.checked - 1][0] - rows[0][0] > self.rules.seconds
            if long:
                self.berth = rows[0]
                out += [True] * self.checked
                del rows[: self.checked]
            elif self.checked == len(rows) and not closing:
                break
            else:
                out.append(False)
                del rows[0]
                self.checked = 1
        return out

    def push(self, row: tuple) -> list[bool]:
        self.rows.append(row)
        return self._advance(False)

    def close(self) -> list[bool]:
        return self._advance(True)


def flag_jumps(df: DataFrame, rules: Cleaning = Cleaning(), order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Add ``kept``: false where a position cannot be reached from the last kept one, or where time or place is missing."""
    return sorted_fold(df, "mmsi", list(order), ["t", "lon", "lat"], lambda: Skipping(JumpFold(rules.jump_speed, rules.earth_radius), 3), "kept")


def flag_duplicates(df: DataFrame, rules: Cleaning = Cleaning(), order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Add ``kept``: false where a report follows the last kept one too soon, or has no time."""
    return sorted_fold(df, "mmsi", list(order), ["t"], lambda: Skipping(DuplicateFold(rules.duplicate_seconds), 1), "kept")


def flag_berths(df: DataFrame, rules: Berth = Berth(), order: tuple[str, ...] = ("t",), radius: float = 6371000.0) -> DataFrame:
    """Add ``in_berth``: true where a vessel lies still; reports without time or place are in no berth and end none."""
    return sorted_fold(df, "mmsi", list(order), ["t", "lon", "lat", "sog"], lambda: Skipping(BerthFold(rules, radius), 3), "in_berth")


def berth_segments(df: DataFrame, rules: Berth = Berth(), order: tuple[str, ...] = ("t",)) -> DataFrame:
    """(mmsi, first_row, last_row): runs of rows in berth, numbered from 0 in order within each vessel."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    by = Window.partitionBy("mmsi").orderBy(*order)
    numbered = flag_berths(df, rules, order).withColumn("row", F.row_number().over(by) - 1)
    inside = numbered.where("in_berth").withColumn("run", F.col("row") - F.row_number().over(by))
    return inside.groupBy("mmsi", "run").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row")).drop("run")


def sequential(make: Callable[[], Any], rows: list[tuple]) -> list[bool]:
    """A fold over rows of one key in memory, for tests."""
    fold = make()
    return list(np.concatenate([*(fold.push(r) for r in rows), fold.close()]).astype(bool)) if rows else []
