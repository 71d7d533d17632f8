"""SimHash near-duplicates through pivot distance tables.

A text's words (ASCII white space between them, A-Z lower-cased) give 3-word
shingles, each hashed by XXH64 with seed 42. A fingerprint bit is 1 if it is
set in over half of the hashes. Rows whose fingerprints differ in at most two
bits are linked, and a component is named by its least id.

Equal fingerprints are first folded into one row, so a group of exact copies
costs one row however large it is. Of the distinct fingerprints:

1. Distances to ``PIVOTS`` reference fingerprints are precomputed. By the
   triangle inequality the coordinates of linked fingerprints differ by at most
   two, and their parities tell nothing more.
2. Two differing bits touch at most two of the four 16-bit blocks, so linked
   fingerprints agree in two blocks. These six keys bring candidates together.
3. Pairs whose largest coordinate difference exceeds two are discarded.
4. Survivors are verified bit by bit.

Where many fingerprints share a key, as in a large group of near copies, their
pairs would grow with the square of the group. Such buckets use an exact other
way: fingerprints at most two bits apart have a point at most one bit from
either, so each one is sent to its 65 points, and the at most 65 fingerprints
at a point are all joined to the least of them. Components come out the same.

Defined results: a null text is empty and has fingerprint zero, which links like
any other; fewer than three words make one shingle; a null id never names a
component unless all ids in it are null; repeated rows give repeated results;
an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components, settle
from .textkit import arrow_map, blocks, by_place, keyed, spread, utf8

SEED = 42
SHINGLE = 3
RADIUS = 2
PIVOTS = 24
#: A key with more fingerprints than this takes the exact way without pairs.
PAIRED = 64


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = min(SHINGLE, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits): a signed 64-bit fingerprint for each row."""
    chosen = spread(keyed(docs, id_col, text_col))

    def rows(batch: pa.RecordBatch):
        texts = utf8(batch.column(1))
        for a, b in blocks(texts):
            made = np.array([fingerprint(t) for t in texts[a:b]], np.uint64).view(np.int64)
            yield [batch.column(0).slice(a, b - a), pa.array(made)]

    return arrow_map(chosen, T.StructType([chosen.schema[id_col], T.StructField("bits", T.LongType())]), rows)


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, signed: hashes of the numbers from 0."""
    return [x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(str(k), SEED) for k in range(n))]


def near_pairs(distinct: DataFrame, n_pivots: int = PIVOTS, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) that join all of ``distinct(bits)`` within the radius; linear in its rows."""
    bits = F.col("bits")
    table = distinct.select(bits, F.array(*[F.bit_count(bits.bitwiseXOR(F.lit(p))).cast("byte") for p in pivots(n_pivots)]).alias("far"))
    block = [F.shiftrightunsigned(bits, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = F.array(*[F.lit(j << 32).bitwiseOR(F.shiftleft(block[a], 16)).bitwiseOR(block[b]) for j, (a, b) in enumerate(combinations(range(4), 2))])
    spread = table.select("bits", "far", F.explode(keys).alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = settle(spread.join(sizes, "key"))
    few = shared.where(F.col("size") <= paired)
    left, right = few.select("key", F.col("bits").alias("a"), F.col("far").alias("far_a")), few.select("key", F.col("bits").alias("b"), F.col("far").alias("far_b"))
    apart = F.array_max(F.zip_with("far_a", "far_b", lambda x, y: F.abs(x - y)))
    pairs = left.join(right, "key").where("a < b").where(apart <= RADIUS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    many = shared.where(F.col("size") > paired).select("bits").distinct()
    points = many.select("bits", F.explode(F.array(bits, *[bits.bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])).alias("point"))
    least = points.groupBy("point").agg(F.min("bits").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    stars = points.join(least, "point").where("bits <> b").select(F.col("bits").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``."""
    marked = settle(fingerprints(docs, id_col, text_col))
    return classes(marked, id_col).select(id_col, F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def classes(marked: DataFrame, id_col: str) -> DataFrame:
    """Add ``component`` (its least fingerprint) and ``component_id`` (its least id) to rows (id, bits)."""
    folded = settle(marked.groupBy("bits").agg(F.min(id_col).alias("least_id")))
    linked = components(near_pairs(folded.select("bits"))).select(F.col("node").alias("bits"), "component")
    placed = folded.join(linked, "bits", "left").select("bits", "least_id", F.coalesce("component", "bits").alias("component"))
    named = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return marked.join(placed.join(named, "component").select("bits", "component", "component_id"), "bits")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the least id; all columns stay, also where their names clash.

    Where ids are unique, rows are chosen by id. Otherwise the fingerprint joins the
    key, and of rows that share both, the one with the least text, then with the
    least other columns (as JSON, in order), stays.
    """
    held = settle(fingerprints(docs, id_col, text_col))
    named = classes(held, id_col)
    first = settle(named.groupBy("component").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "bits")).alias("chosen")))
    own, at, placed = f"c{docs.columns.index(id_col)}", docs.columns.index(text_col), by_place(docs)
    if not held.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        wanted = first.select(F.col("chosen.id").alias("chosen_id"))
        return placed.join(wanted, placed[own].eqNullSafe(wanted["chosen_id"]), "left_semi").toDF(*docs.columns)
    wanted = first.select(F.col("chosen.id").alias("chosen_id"), F.col("chosen.bits").alias("chosen_bits"))

    def rows(batch: pa.RecordBatch):
        texts = utf8(batch.column(at))
        for a, b in blocks(texts):
            made = np.array([fingerprint(t) for t in texts[a:b]], np.uint64).view(np.int64)
            yield [*[c.slice(a, b - a) for c in batch.columns], pa.array(made)]

    full = arrow_map(placed, T.StructType([*placed.schema.fields, T.StructField("bits", T.LongType())]), rows)
    kept = full.join(wanted, full[own].eqNullSafe(wanted["chosen_id"]) & (full["bits"] == wanted["chosen_bits"]), "left_semi")
    whole = F.struct(*placed.columns)
    one = kept.groupBy(own, "bits").agg(F.min_by(whole, F.struct(F.col(f"c{at}"), F.to_json(whole))).alias("row"))
    return one.select("row.*").toDF(*docs.columns)
