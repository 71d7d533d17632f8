"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters (lower-cased), digits and characters beyond
ASCII. Of every ten consecutive words, a span that is a *window*, the least of
its five hashes of six words is kept as fingerprint. Equal windows have equal
fingerprints, so every shared span of ten words or more has a fingerprint that
both sides keep. Document fingerprints are joined with the fingerprints of the
benchmark; where they meet, the hit is extended to the whole window around it,
and the words are compared exactly.

An item of fewer than ten words is one window of its own length, whose
fingerprint is the hash of all its words.

The size of the benchmark's texts is measured first. Up to ``map_bytes`` they go
to all tasks and the join is done where the documents are, without a shuffle.
Beyond, both sides are fingerprinted in Spark and joined by a shuffle: a sieve of
fixed size (2**24 bits of the benchmark's fingerprints) lets documents pass on
only windows that may meet one, equal windows of equal texts are folded, and the
join on fingerprint, length and words finds what occurs. Documents take part by
a digest of their text, so copies are joined once; no group is collected but the
items found in one text.

Defined results: null texts have no words; items without words never occur;
items with the same text all count; a null item id is shown as ``null``; repeated
document rows give repeated results; an empty benchmark contaminates nothing; an
empty table of documents gives an empty one. Columns other than the id and the
text are ignored by the report; ``decontaminate`` keeps all columns, also where
their names clash, and drops each copy of a contaminated row.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import settle
from .textkit import arrow_map, blocks, by_place, keyed, mix, powers, same_columns, spread, utf8

WINDOW, GRAM = 10, 6
SLIDE = WINDOW - GRAM + 1
MAP_BYTES = 4 << 20
_word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
BITS = 20
#: Bits of a fingerprint that the sieve of the shuffled join looks at.
SIEVE_BITS = 24


def words_of(text: bytes) -> list[bytes]:
    return _word.findall(text.lower())


def grams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words."""
    size = max(0, len(word_hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : k + size]
    return mix(out)


def least(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    size = max(0, len(hashes) - n + 1)
    out = hashes[:size].copy()
    for k in range(1, n):
        np.minimum(out, hashes[k : k + size], out=out)
    return out


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, word starts and ends, word hashes, words in each text."""
    data = _lower[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    flag = _is_word[data]
    edge = np.diff(flag.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data))
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mix((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    stops = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    return data, starts, ends, hashes, counts


class Block:
    """Fingerprints, window hashes and window texts of some benchmark items."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [i for i, _ in items]
        self.windows: dict[bytes, list[int]] = {}
        prints, hashes = [], {}
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            *_, own, _ = split_words([text])
            n = min(WINDOW, len(words))
            for a in range(len(words) - n + 1):
                owners = self.windows.setdefault(b" ".join(words[a : a + n]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
            hashes.setdefault(n, []).append(grams(own, n))
            if n == WINDOW:
                prints.append(least(grams(own, GRAM), SLIDE))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.hashes = {n: np.unique(np.concatenate(x)) for n, x in hashes.items()}
        self.sieve = np.zeros(1 << BITS, bool)
        self.sieve[(self.prints >> np.uint64(64 - BITS)).astype(np.int64)] = True


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    place = np.searchsorted(table, values)
    place[place == len(table)] = 0
    return table[place] == values


def scan(texts: list[bytes], block: Block) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Words, hit words and the items that occur, for each text."""
    with np.errstate(over="ignore"):
        data, starts, ends, hashes, counts = split_words(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        edge = np.zeros(len(starts) + 1, np.int32)
        found: list[set] = [set() for _ in texts]
        for n, table in block.hashes.items():
            inside = len(starts) - n + 1
            if inside <= 0:
                continue
            if n == WINDOW:
                minima = least(grams(hashes, GRAM), SLIDE)
                where = np.flatnonzero(block.sieve[(minima >> np.uint64(64 - BITS)).astype(np.int64)])
                where = where[member(minima[where], block.prints)]
            else:
                where = np.arange(inside)
            where = where[owner[where] == owner[where + n - 1]]
            if not len(where):
                continue
            whole = np.zeros(len(where), np.uint64)
            for k in range(n):
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + hashes[where + k]
            where = where[member(mix(whole), table)]
            for a in where.tolist():
                owners = block.windows.get(window_bytes(data, starts, ends, a, n))
                if owners:
                    edge[a] += 1
                    edge[a + n] -= 1
                    found[owner[a]].update(block.ids[k] for k in owners)
        hit = np.cumsum(edge[:-1]) > 0
    return counts, np.bincount(owner[hit], minlength=len(texts)), found


def window_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, n: int) -> bytes:
    """The words of a window, a space between them."""
    return b" ".join([data[s:e].tobytes() for s, e in zip(starts[a : a + n].tolist(), ends[a : a + n].tolist())])


def prints(hashes: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each window of ``n`` words: the least hash of its grams, or of a shorter one its only hash."""
    with np.errstate(over="ignore"):
        return least(grams(hashes, GRAM), SLIDE) if n == WINDOW else grams(hashes, n)


WINDOWS = T.StructType([T.StructField("item", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("window", T.BinaryType())])


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item, n, print, window): the different windows of each item of (item, text)."""

    def rows(batch: pa.RecordBatch):
        texts, ids = utf8(batch.column(1)), batch.column(0).to_pylist()
        for a, b in blocks(texts):
            data, starts, ends, hashes, counts = split_words(texts[a:b])
            out: list[list] = [[], [], [], []]
            first = 0
            for item, count in zip(ids[a:b], counts.tolist()):
                n = min(WINDOW, count)
                if n:
                    made = prints(hashes[first : first + count], n).view(np.int64).tolist()
                    known = {window_bytes(data, starts, ends, first + k, n): p for k, p in enumerate(made)}
                    for column, more in zip(out, ([item] * len(known), [n] * len(known), list(known.values()), list(known))):
                        column.extend(more)
                first += count
            yield out

    return arrow_map(items, WINDOWS, rows).distinct()


def sieve_of(windows: DataFrame) -> np.ndarray:
    """Bits of all fingerprints, by their highest ``SIEVE_BITS`` bits: at most 2**18 rows reach the driver."""
    place = F.shiftrightunsigned("print", 64 - SIEVE_BITS)
    words = windows.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - SIEVE_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


CANDIDATE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("window", T.BinaryType())]))


def candidates(chosen: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (id, text) as (id, digest, n_words, may): ``may`` are windows whose fingerprint passes the sieve."""
    sizes = [r["n"] for r in windows.select("n").distinct().collect()]  # at most ten
    shared = chosen.sparkSession.sparkContext.broadcast(sieve_of(windows))  # 2 MB
    schema = T.StructType([chosen.schema[0], T.StructField("digest", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("may", CANDIDATE)])

    def rows(batch: pa.RecordBatch):
        texts, bits = utf8(batch.column(1)), shared.value
        for a, b in blocks(texts):
            data, starts, ends, hashes, counts = split_words(texts[a:b])
            owner = np.repeat(np.arange(b - a), counts)
            first = np.cumsum(counts) - counts
            may: list[list] = [[] for _ in range(b - a)]
            for n in sizes:
                if len(starts) < n:
                    continue
                own = prints(hashes, n)
                top = own >> np.uint64(64 - SIEVE_BITS)
                where = np.flatnonzero((bits[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63)).astype(np.int64)) & 1)
                where = where[owner[where] == owner[where + n - 1]]
                for k, p in zip(where.tolist(), own[where].view(np.int64).tolist()):
                    may[owner[k]].append({"start": k - int(first[owner[k]]), "n": n, "print": p, "window": window_bytes(data, starts, ends, k, n)})
            yield [batch.column(0).slice(a, b - a), [hashlib.sha256(t).hexdigest() for t in texts[a:b]], counts.tolist(), may]

    return arrow_map(chosen, schema, rows)


def occurrences(held: DataFrame, windows: DataFrame) -> DataFrame:
    """(digest, start, n, print, window) of benchmark windows in texts, from what ``candidates`` gives."""
    each = held.select("digest", F.explode("may").alias("m")).select("digest", "m.*").distinct()
    return each.join(windows.select("n", "print", "window").distinct(), ["n", "print", "window"], "left_semi")


def found_by_join(held: DataFrame, windows: DataFrame) -> DataFrame:
    """(digest, n_hit, items) of texts in which windows occur."""
    met = settle(occurrences(held, windows))
    before = F.coalesce(F.max(F.col("start") + F.col("n")).over(Window.partitionBy("digest").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(before, F.col("start")))
    hits = met.select("digest", fresh.alias("fresh")).groupBy("digest").agg(F.sum("fresh").alias("n_hit"))
    items = met.select("digest", "n", "print", "window").distinct().join(windows, ["n", "print", "window"]).groupBy("digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return hits.join(items, "digest")


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Items as (item, text), and the bytes of their texts."""
    items = keyed(benchmark, id_col, text_col).toDF("item", "text").where("text IS NOT NULL")
    items = items.select(F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), "text")
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shared_block(items: DataFrame):
    """A broadcast of a benchmark whose size has been checked."""
    return items.sparkSession.sparkContext.broadcast(Block([(i, t.encode()) for i, t in items.collect()]))


REPORT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")]
    + [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType()))]
)


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", map_bytes: int = MAP_BYTES) -> DataFrame:
    """For each document its words, hit words and the benchmark items found in it."""
    items, size = items_of(benchmark, item_col, text_col)
    chosen = spread(keyed(docs, id_col, text_col))
    if size > map_bytes:
        windows = settle(benchmark_windows(items))
        held = settle(candidates(chosen, windows))
        whole = held.select(id_col, "digest", "n_words").join(found_by_join(held, windows), "digest", "left")
        names = F.coalesce("items", F.array().cast("array<string>"))
        hits = F.coalesce("n_hit", F.lit(0)).cast("long")
        return whole.select(id_col, "n_words", hits.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"), names.alias("items"))
    index = shared_block(items)

    def rows(batch: pa.RecordBatch):
        texts = utf8(batch.column(1))
        for a, b in blocks(texts):
            counts, hits, found = scan(texts[a:b], index.value)
            names = [sorted(x) for x in found]
            yield [batch.column(0).slice(a, b - a), counts.tolist(), hits.tolist(), list(map(len, names)), [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], (hits > 0).tolist(), names]

    return arrow_map(chosen, T.StructType([chosen.schema[id_col], *REPORT.fields]), rows)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", map_bytes: int = MAP_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns."""
    items, size = items_of(benchmark, item_col, text_col)
    at = docs.columns.index(text_col)
    if size > map_bytes:
        windows = settle(benchmark_windows(items))
        placed = by_place(docs)
        text = F.coalesce(F.col(f"c{at}"), F.lit(""))
        bad = settle(occurrences(candidates(placed.select(F.lit(0).alias("id"), text.alias("text")), windows), windows).select("digest").distinct())
        return placed.withColumn("digest", F.sha2(text.cast("binary"), 256)).join(bad, "digest", "left_anti").drop("digest").toDF(*docs.columns)
    index = shared_block(items)

    def rows(batch: pa.RecordBatch):
        texts = utf8(batch.column(at))
        for a, b in blocks(texts):
            _, hits, _ = scan(texts[a:b], index.value)
            stay = pa.array(np.flatnonzero(hits == 0) + a, pa.int64())
            yield [batch.column(c).take(stay) for c in range(batch.num_columns)]

    return same_columns(docs, rows)
