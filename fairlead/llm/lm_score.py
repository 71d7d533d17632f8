"""Masked pseudo-likelihood of documents.

A small network reads the words on both sides of a place and predicts the word
there. The sum over all places of the conditional log-probabilities is the
document's pseudo-log-likelihood.

Words are lower-cased runs between white space. The network predicts a class: each
of the most frequent words is a class of its own, all others fall into classes by
length and kind. A word's probability is that of its class at the place, times its
share of the class by the counts of the whole corpus, one occurrence of each class
being kept for words never counted. Tasks hold the counts of the more frequent
words; those of all others are joined in Spark, so no word goes without its own.
Words are looked up once: the classes of each text's words are written to the
shared folder, two bytes a word, and all later passes read these.

Training predicts every place of every document once, without a sample. A hash
deals the places to ``rounds``; in each round every partition starts from the same
weights, hides the places of the round one batch after another, and trains on them
by Adam in numpy; Spark then averages the weights of all partitions, weighted by
their hidden places. Only averaged weights reach the driver, whose size does not
depend on the corpus.

Defined results: a null text and one without words have no tokens and score 0;
repeated rows score alike; a null id is carried through; an empty table gives an
empty one; other columns are ignored. Texts are read whole. Scores depend a little
on how rows are dealt to partitions and batches, as training does (sf0.1 dealt in two
ways: 0.08 % in the median, 4.6 % for the one document that moved most).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import settle
from .textkit import BLOCK_BYTES, arrow_map, blocks, keyed, mix, spread, utf8

CLASSES = 16


@dataclass(frozen=True)
class LmRules:
    """words: classes of one word; table: most words whose counts each task holds; sides: words seen on each side; hidden: width;
    rounds: over all documents, each hiding its share of the places; batch: places in a step; rate: of Adam; entries: words that a task counts
    before it hands them on."""

    words: int = 240
    table: int = 100_000
    sides: int = 2
    hidden: int = 24
    rounds: int = 2
    batch: int = 512
    rate: float = 0.005
    entries: int = 200_000


def word_class(word: bytes) -> int:
    """A class for a word outside the vocabulary: letters only or not, and its length."""
    return (8 if not word.isalpha() and word.isascii() else 0) + min(7, len(word) // 2)


def frequencies(docs: DataFrame, text_col: str, rules: LmRules) -> DataFrame:
    """(word, n): occurrences of each word in all documents."""
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=schema.names)

        for batch in batches:
            for text in utf8(batch.column(0)):
                counts.update(text.lower().split())
                if len(counts) > rules.entries:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return spread(keyed(docs, text_col)).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def kind(word: str = "word"):
    """``word_class`` as an expression on a column of words."""
    text = F.col(word).cast("string")
    return F.when(text.rlike(r"^[\x00-\x7F]*\z") & ~text.rlike(r"^[A-Za-z]+\z"), 8).otherwise(0) + F.least(F.lit(7), F.floor(F.octet_length(word) / 2)).cast("int")


@dataclass(frozen=True)
class Words:
    """words: the table held by tasks, the classes of one word first; n_own: how many these are; outputs, shares: class
    and log-share of its class of each word in the table; totals: occurrences in each class; rare: (word, n) of others
    that occur more than once."""

    words: list[bytes]
    n_own: int
    outputs: np.ndarray
    shares: np.ndarray
    totals: np.ndarray
    rare: DataFrame

    @property
    def size(self) -> int:
        return self.n_own + CLASSES


def count_words(docs: DataFrame, text_col: str, rules: LmRules) -> Words:
    """The counts of the whole corpus. The driver gets at most ``table`` words and a row for each different count."""
    counts = settle(frequencies(docs, text_col, rules))
    top = counts.orderBy(F.desc("n"), "word").limit(rules.words).collect()
    least, held = None, 0
    for n, words in sorted(counts.groupBy("n").count().collect(), reverse=True):
        if held + words > rules.table:
            break
        least, held = n, held + words
    own = [bytes(r["word"]) for r in top]
    known = set(own)
    more = counts.where(F.col("n") >= least).collect() if least is not None else []
    others = sorted((-r["n"], w) for r in more if (w := bytes(r["word"])) not in known)
    kinds = np.zeros(CLASSES)
    for k, n in counts.groupBy(kind().alias("kind")).agg(F.sum("n")).collect():
        kinds[k] = n
    for r in top:
        kinds[word_class(bytes(r["word"]))] -= r["n"]
    classes = np.array([word_class(w) for _, w in others], np.int64)
    shares = np.concatenate([np.zeros(len(own)), np.log(np.array([-n for n, _ in others], float) / (kinds[classes] + 1))])
    outputs = np.concatenate([np.arange(len(own)), len(own) + classes]).astype(np.int32)
    totals = np.concatenate([np.array([r["n"] for r in top], float), kinds])
    rare = counts.where(F.col("n") > 1)  # a word without a row counts one
    if least is not None:
        rare = rare.where(F.col("n") < least)
    return Words(own + [w for _, w in others], len(own), outputs, shares, totals, rare)


class Network:
    """Weights and passes. Words are numbers; one more stands for what lies beyond a document's ends."""

    def __init__(self, size: int, rules: LmRules, bias: np.ndarray | None = None):
        self.size, self.rules, self.room = size, rules, None
        draw = np.random.default_rng(11)
        self.weights = {
            "place": (draw.standard_normal((2 * rules.sides, size + 1, rules.hidden)) * 0.3).astype(np.float32),
            "inner": np.zeros(rules.hidden, np.float32),
            "out": (draw.standard_normal((rules.hidden, size)) * 0.1).astype(np.float32),
            "bias": np.zeros(size, np.float32) if bias is None else bias.astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def load(self, values: np.ndarray) -> Network:
        at = 0
        for name, w in self.weights.items():
            self.weights[name] = values[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return self

    def around(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Words near each place, by offset. codes: padded documents, ``sides`` ends between any two."""
        offsets = [d for d in range(-self.rules.sides, self.rules.sides + 1) if d]
        return np.stack([codes[places + d] for d in offsets])

    def inner(self, near: np.ndarray) -> np.ndarray:
        total = self.weights["place"][0].take(near[0], axis=0)
        for k in range(1, len(near)):
            total += self.weights["place"][k].take(near[k], axis=0)
        total += self.weights["inner"]
        return np.tanh(total, out=total)

    def shares(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the outputs (until the next call) and their sum in each row. Lowered by the highest only where they could overflow."""
        if self.room is None or self.room.dtype != hidden.dtype or len(self.room) < len(hidden):
            self.room = np.empty((max(512, len(hidden)), self.size), hidden.dtype)
        widened = np.concatenate([hidden, np.ones((len(hidden), 1), hidden.dtype)], axis=1)  # the bias as one more weight
        logits = np.matmul(widened, np.vstack([self.weights["out"], self.weights["bias"]]), out=self.room[: len(hidden)])
        if (np.abs(self.weights["out"]).sum(axis=0) + np.abs(self.weights["bias"])).max(initial=0) > 60:
            logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(self.size, logits.dtype)

    def log_probabilities(self, codes: np.ndarray, places: np.ndarray, step: int = 512) -> np.ndarray:
        """Log-probability of the word at each place, given those around it."""
        out = np.empty(len(places), np.float32)
        for a in range(0, len(places), step):
            own = places[a : a + step]
            hidden = self.inner(self.around(codes, own))
            share, total = self.shares(hidden)
            chosen = share[np.arange(len(own)), codes[own]]
            out[a : a + step] = np.log(np.maximum(chosen, 1e-30) / total)
            for k in np.flatnonzero(chosen <= 1e-30).tolist():  # too small for an exponential
                logits = hidden[k].astype(float) @ self.weights["out"] + self.weights["bias"]
                out[a + k] = logits[codes[own[k]]] - np.logaddexp.reduce(logits)
        return out

    def gradients(self, codes: np.ndarray, places: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss at some places and its gradient."""
        near, target = self.around(codes, places), codes[places]
        hidden = self.inner(near)
        share, total = self.shares(hidden)
        rows = np.arange(len(places))
        loss = float(-np.log(np.maximum(share[rows, target] / total, 1e-30)).mean())
        share[rows, target] -= total
        scale = (1 / (total * len(places)))[:, None]
        back = (share @ self.weights["out"].T) * ((1 - hidden * hidden) * scale)
        place = np.zeros_like(self.weights["place"])
        at = (near + (np.arange(len(near)) * (self.size + 1))[:, None]).ravel().astype(np.int16 if place[..., 0].size < 1 << 15 else np.int64)
        order = np.argsort(at, kind="stable")
        at = at.take(order)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        spread = back.take(order % len(places), axis=0)
        sums = np.add.reduceat(spread, first, axis=0)
        place.reshape(-1, place.shape[2])[at[first].astype(np.int64)] = sums
        return loss, {"place": place, "inner": back.sum(axis=0), "out": (hidden * scale).T @ share, "bias": scale[:, 0] @ share}

    def fit(self, codes: np.ndarray, places: np.ndarray, state: dict) -> None:
        """Adam over the places, in order. state: moments and steps, kept between calls."""
        rules = self.rules
        for a in range(0, len(places), rules.batch):
            _, slopes = self.gradients(codes, places[a : a + rules.batch])
            state["step"] = state.get("step", 0) + 1
            size = rules.rate * (1 - 0.999 ** state["step"]) ** 0.5 / (1 - 0.9 ** state["step"])
            for name, slope in slopes.items():
                first, second = state.setdefault(name, (np.zeros_like(slope), np.zeros_like(slope)))
                first *= 0.9
                first += 0.1 * slope
                second *= 0.999
                slope *= slope
                slope *= 0.001
                second += slope
                root = np.sqrt(second)
                root += 1e-8
                np.divide(first, root, out=root)
                root *= size
                self.weights[name] -= root


def round_of(codes: np.ndarray, places: np.ndarray, sizes: np.ndarray, rounds: int) -> np.ndarray:
    """The round that hides each place, by its place in its document and the word class: the same in every pass."""
    inside = np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        return mix(inside.astype(np.uint64) * np.uint64(4099) + codes[places].astype(np.uint64)) % np.uint64(rounds)


@dataclass(frozen=True)
class Lookup:
    """What tasks hold of the words."""

    numbers: dict[bytes, int]
    n_own: int
    outputs: np.ndarray
    shares: np.ndarray

    def found(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All words, their numbers in the table (-1: not there), words in each document."""
        words: list[bytes] = []
        sizes = []
        for text in texts:
            own = text.lower().split()
            sizes.append(len(own))
            words += own
        get = self.numbers.get
        return words, np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)), np.array(sizes, np.int64)


def classes_of(words: list[bytes], numbers: np.ndarray, known: Lookup) -> np.ndarray:
    """Classes of all words."""
    classes = np.append(known.outputs, 0)[numbers]
    away = np.flatnonzero(numbers < 0)
    classes[away] = [known.n_own + word_class(words[k]) for k in away.tolist()]
    return classes


def coded(classes: np.ndarray, sizes: np.ndarray, end: int, rules: LmRules) -> tuple[np.ndarray, np.ndarray]:
    """Classes with ends around each document, and places of the words."""
    places = np.arange(len(classes)) + rules.sides * (1 + np.repeat(np.arange(len(sizes)), sizes))
    codes = np.full(len(classes) + rules.sides * (1 + len(sizes)), end, np.int32)
    codes[places] = classes
    return codes, places


def code_type(size: int) -> np.dtype:
    """How classes are stored: two bytes each, or four where there are more."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def code_table(texts: DataFrame, counted: Words) -> DataFrame:
    """(row, id, n_tokens, held, codes, away) for rows (id, text): the classes of the words in order, the sum of the log-shares of
    those in the table, and the words that are not in it. Computed once."""
    shared = texts.sparkSession.sparkContext.broadcast(lookup(counted))  # at most ``table`` words
    fields = [("n_tokens", T.LongType()), ("held", T.DoubleType()), ("codes", T.BinaryType()), ("away", T.ArrayType(T.BinaryType()))]
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType)] + [T.StructField(*f) for f in fields])
    kind_of = code_type(counted.size)

    def rows(batch: pa.RecordBatch):
        known = shared.value
        bodies = utf8(batch.column(1))
        for a, b in blocks(bodies):
            words, numbers, sizes = known.found(bodies[a:b])
            stored = classes_of(words, numbers, known).astype(kind_of).tobytes()
            sums = np.append(0.0, np.cumsum(np.append(known.shares, 0.0)[numbers]))
            ends = np.cumsum(sizes)
            cuts = np.append(0, ends * kind_of.itemsize).tolist()
            away = np.flatnonzero(numbers < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(away, np.append(0, ends)), pa.int32()), pa.array([words[k] for k in away.tolist()], pa.binary()))
            yield [batch.column(0).slice(a, b - a), sizes.tolist(), sums[ends] - sums[ends - sizes], [stored[i:j] for i, j in zip(cuts, cuts[1:])], lists]

    return settle(arrow_map(spread(texts), schema, rows).withColumn("row", F.monotonically_increasing_id()))


def read_codes(column: pa.Array, size: int, rules: LmRules) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows of stored codes: first and last row, codes, places, words in each document."""
    kind_of = code_type(size)
    stored = column.to_pylist()
    for a, b in blocks(stored, BLOCK_BYTES // 2):
        sizes = np.array([len(x) // kind_of.itemsize for x in stored[a:b]], np.int64)
        yield a, b, *coded(np.frombuffer(b"".join(stored[a:b]), kind_of), sizes, size, rules), sizes


def train_part(parts: Iterator[pa.Array], turn: int, network: Network) -> tuple[np.ndarray, int]:
    """Weights after the places that a round hides in the documents (stored codes) of a partition, and how many these are."""
    state, n = {}, 0
    for part in parts:
        for _, _, codes, places, sizes in read_codes(part, network.size, network.rules):
            hidden = places[round_of(codes, places, sizes, network.rules.rounds) == turn]
            network.fit(codes, hidden, state)
            n += len(hidden)
    return network.flat(), n


def train(texts: DataFrame, counted: Words, rules: LmRules) -> np.ndarray:
    """Weights. texts: a ``code_table``."""
    size = counted.size
    bias = np.log(counted.totals + 1)
    weights = Network(size, rules, bias - bias.mean()).flat()
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("w", T.ArrayType(T.FloatType())), T.StructField("n", T.LongType())])
    width = 1024
    for turn in range(rules.rounds):
        shared = texts.sparkSession.sparkContext.broadcast(weights)  # some 10**4 numbers

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            flat, n = train_part((batch.column(0) for batch in batches), turn, Network(size, rules).load(shared.value))
            if n:
                pieces = [flat[a : a + width] for a in range(0, len(flat), width)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tolist() for p in pieces], pa.list_(pa.float32())), pa.array([n] * len(pieces), pa.int64())], names=schema.names)

        trained = texts.select("codes").mapInArrow(run, schema).select("part", "n", F.posexplode("w").alias("at", "w"))
        mean = trained.groupBy("part", "at").agg((F.sum(F.col("w").cast("double") * F.col("n")) / F.sum("n")).alias("w")).toArrow()
        if mean.num_rows:
            fresh = np.empty_like(weights)
            fresh[mean["part"].to_numpy().astype(np.int64) * width + mean["at"].to_numpy()] = mean["w"].to_numpy()
            weights = fresh
    return weights


def lookup(counted: Words) -> Lookup:
    return Lookup({w: k for k, w in enumerate(counted.words)}, counted.n_own, counted.outputs, counted.shares)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LmRules = LmRules()) -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob): the pseudo-log-likelihood of each text, and for each of its words."""
    counted = count_words(docs, text_col, rules)
    chosen = keyed(docs, id_col, text_col)
    texts = code_table(chosen.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), counted)
    shared = docs.sparkSession.sparkContext.broadcast(train(texts, counted, rules))
    placed = texts.select("row", "id", "n_tokens", "held", "codes")
    schema = T.StructType(placed.schema.fields[:-1])
    size = counted.size
    held: dict = {}

    def rows(batch: pa.RecordBatch):
        if "network" not in held:
            held["network"] = Network(size, rules).load(shared.value)
        for a, b, codes, places, sizes in read_codes(batch.column(4), size, rules):
            sums = np.append(0.0, np.cumsum(held["network"].log_probabilities(codes, places), dtype=float))
            ends = np.cumsum(sizes)
            yield [*[batch.column(k).slice(a, b - a) for k in range(3)], batch.column(3).to_numpy()[a:b] + sums[ends] - sums[ends - sizes]]

    scored = arrow_map(placed, schema, rows)
    away = texts.select("row", F.explode("away").alias("word")).join(counted.rare, "word", "left")
    totals = F.array(*[F.lit(float(t + 1)) for t in counted.totals[counted.n_own :]])
    share = F.log(F.coalesce("n", F.lit(1)) / F.element_at(totals, kind() + 1))
    rest = away.groupBy("row").agg(F.sum(F.round(share * 1e9).cast("long")).alias("rest"))  # whole numbers add up alike in any order
    total = F.round(F.col("held") + F.coalesce("rest", F.lit(0)) / 1e9, 6)
    whole = scored.join(rest, "row", "left").select(F.col("id").alias(id_col), "n_tokens", total.alias("log_prob"))
    return whole.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).otherwise(0.0))
