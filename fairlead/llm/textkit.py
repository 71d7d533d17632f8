"""Helpers that Arrow-batch operators on texts share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-8 bytes that one pass of numpy works on; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of any name do no harm.

    Where a table repeats a column name in another case, the first exact match counts.
    """
    found = {}
    for k, name in enumerate(df.columns):
        found.setdefault(name, k)
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*columns)
    return by_place(df).select(*[F.col(f"c{found[c]}").alias(c) for c in columns])


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where a scan gives fewer partitions than there are, as of one small file.

    Plans with an exchange stay as they are: their partitions are the planner's, and asking for them would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, at least one row."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        if k > first and held + len(text) > limit:
            yield first, k
            first, held = k, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def arrow_map(df: DataFrame, schema: T.StructType, rows: Callable[[pa.RecordBatch], Iterator[list]]) -> DataFrame:
    """``mapInArrow`` for a function that yields lists of columns for parts of a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, field.type) if not isinstance(c, pa.Array) else c.cast(field.type) for c, field in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)


def same_columns(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[list]]) -> DataFrame:
    """``arrow_map`` that keeps the columns of ``df``, whatever their names: inside they go by their places."""
    placed = by_place(spread(df))
    return arrow_map(placed, placed.schema, rows).toDF(*df.columns)


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, and so on, so that names which differ in case only, or not at all, do no harm."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


#: Multiplier of the positional hash and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse for at least ``n`` positions."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            made = []
            for base in (BASE, INVERSE):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                made.append(np.multiply.accumulate(out))
            _powers[size] = (made[0], made[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each span [start, end) of an integer array, whatever its place."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
