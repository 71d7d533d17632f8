"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces of the
product of their probabilities, which a forward algorithm computes; a text's is
the product over its words. Piece probabilities are learnt by
expectation-maximisation over all segmentations (forward and backward sums).

Training reads a sample of labelled rows, about ``per_language`` of each
language, chosen by a hash of the id; their texts are read whole. The expectation
step runs in Spark over the sample's different words, and piece sums of all tasks
are added there; the driver holds pieces x languages numbers. Words are cut at
white space after lower-casing. In training a word longer than ``block`` code
points is taken in blocks of that length, each summed over all its segmentations;
scoring takes every word whole. A worker keeps the scores of words it has met, in
bounded memory. Scores may differ beyond nine digits with the partitioning.

Defined results: a null text and one without a letter are ``und`` with score 0,
and so is every text if nothing could be learnt; ties go to the language that
sorts first; rows with a null id are scored but never trained on; repeated rows
get repeated results; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import settle
from .textkit import arrow_map, blocks, keyed, mix, powers, span_hashes, spread

UNDETERMINED = "und"
MARK = "▁"
UNKNOWN = 1e-9
#: Up to so many languages their row counts go to all tasks; beyond, they are joined by a shuffle.
MOST_SENT = 10_000
_letter = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageRules:
    """per_language: bound of the training sample, in rows of each language (about); block: code points of a word that
    training takes at a time; rounds: of EM; words: scores that a worker keeps; smoothing: added to each piece's count."""

    per_language: int = 500
    block: int = 64
    rounds: int = 4
    words: int = 300_000
    smoothing: float = 0.05


def public_pieces(path: str) -> list[str]:
    """All pieces of a SentencePiece vocabulary, lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(k).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    return sorted(found - {""})


class Lattice:
    """All pieces of words, and sums over their segmentations."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        codes, starts, ends = self.flat(pieces, "")
        with np.errstate(over="ignore"):
            hashes = span_hashes(codes, starts, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        slots = (self.hashes >> np.uint64(46)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << 18) + 1))
        self.most = int(np.diff(self.first).max()) if len(pieces) else 0

    @staticmethod
    def flat(words: list[str], mark: str = MARK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all words, each after ``mark``, with starts and ends."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(mark)
        text = mark + mark.join(words) if words else ""
        ends = np.cumsum(sizes)
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), ends - sizes, ends

    def ids(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """For each place the id of the piece there that has one of some hashes; len(pieces) if it is none."""
        out = np.full(size, len(self.pieces), np.int32)
        if not len(hashes) or not self.pieces:
            return out
        slots = (hashes >> np.uint64(46)).astype(np.int64)
        low, high = self.first[slots], self.first[slots + 1]
        for k in range(self.most):
            maybe = np.flatnonzero(low + k < high)
            if not len(maybe):
                break
            at = low[maybe] + k
            same = self.hashes[at] == hashes[maybe]
            out[maybe[same]] = self.order[at[same]]
        return out

    def places(self, words: list[str], mark: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Starts and sizes of marked words, and for each length of a piece the piece at each place."""
        codes, starts, ends = self.flat(words, mark)
        n = len(codes)
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            ids = [self.ids(mix((sums[k:] - sums[: n + 1 - k]) * down[: n + 1 - k] + np.uint64(k)) if k <= n else sums[:0], n) for k in range(1, self.longest + 1)]
        single = ids[0]
        single[single == len(self.pieces)] += 1  # a character that is no piece
        return starts, ends - starts, ids

    def ways(self, ids: list[np.ndarray], at: np.ndarray, k: int) -> tuple[np.ndarray | slice, np.ndarray]:
        """Which of some places have a piece of ``k`` code points, and the pieces."""
        own = ids[k - 1][at]
        if k < 3:
            return slice(None), own
        some = np.flatnonzero(own != len(self.pieces))
        return some, own[some]

    def scores(self, words: list[str], chance: np.ndarray, mark: str = MARK) -> np.ndarray:
        """Log-probability of each word in each language. chance: (pieces + 2, languages), the last rows 0 and UNKNOWN."""
        out = np.zeros((len(words), chance.shape[1]))
        starts, sizes, ids = self.places(words, mark)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        ring = [np.ones((len(words), chance.shape[1]))]
        scale = np.zeros(len(words))
        for t in range(1, int(sizes[0]) + 1 if len(words) else 0):
            n = int(np.searchsorted(-sizes, -t, side="right"))
            now = np.zeros((n, chance.shape[1]))
            for k in range(1, min(self.longest, t) + 1):
                some, own = self.ways(ids, starts[:n] + t - k, k)
                if len(own):
                    now[some] += ring[-k][:n][some] * chance[own]
            ring.append(now)
            if len(ring) > self.longest:
                ring.pop(0)
            if t % 8 == 0:
                peak = np.maximum(now.max(axis=1), 1e-300)
                scale[:n] += np.log(peak)
                ring = [r[:n] / peak[:, None] for r in ring]
                now = ring[-1]
            done = int(np.searchsorted(-sizes, -t, side="left"))
            out[order[done:n]] = np.log(np.maximum(now[done:n], 1e-300)) + scale[done:n, None]
        return out

    def expected(self, words: list[str], counts: np.ndarray, chance: np.ndarray, mark: str = MARK) -> np.ndarray:
        """Expected uses of each piece, over all segmentations of words that occur ``counts`` times."""
        total = np.zeros_like(chance)
        starts, sizes, ids = self.places(words, mark)
        longest = int(sizes.max(initial=0))
        groups = chance.shape[1]
        ahead = np.zeros((longest + 1, len(words), groups))
        ahead[0] = 1
        for t in range(1, longest + 1):
            live = np.flatnonzero(sizes >= t)
            for k in range(1, min(self.longest, t) + 1):
                some, own = self.ways(ids, starts[live] + t - k, k)
                if len(own):
                    ahead[t, live[some]] += ahead[t - k, live[some]] * chance[own]
        back = np.zeros_like(ahead)
        back[sizes, np.arange(len(words))] = 1
        whole = np.maximum(ahead[sizes, np.arange(len(words))], 1e-300)
        for t in range(longest, 0, -1):
            live = np.flatnonzero(sizes >= t)
            for k in range(1, min(self.longest, t) + 1):
                some, own = self.ways(ids, starts[live] + t - k, k)
                if not len(own):
                    continue
                used = live[some]
                path = chance[own] * back[t, used]
                back[t - k, used] += path
                use = ahead[t - k, used] * path / whole[used] * counts[used]
                for g in range(groups):
                    total[:, g] += np.bincount(own, use[:, g], minlength=len(total))
        return total


def normalised(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Probabilities from counts of pieces, with the rows of no piece (0) and of an unknown character."""
    body = counts[:-2] + smoothing
    return np.vstack([body / body.sum(axis=0), np.zeros(counts.shape[1]), np.full(counts.shape[1], UNKNOWN)])


def word_blocks(word: str, size: int) -> list[str]:
    """A marked word in blocks of at most ``size`` code points."""
    marked = MARK + word
    return [marked[a : a + size] for a in range(0, len(marked), size)]


def piece_sums(words: DataFrame, pieces: list[str], chance: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over words (word, uses: (language, n)): the expectation step, in Spark."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, chance))  # pieces x languages numbers
    schema = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("tongue", T.IntegerType()), T.StructField("uses", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = shared.value
        lattice, total = None, np.zeros_like(held)
        for batch in batches:
            lattice = lattice or Lattice(known)
            texts, uses = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            for a in range(0, len(order), 4096):
                own = order[a : a + 4096]
                counts = np.zeros((len(own), held.shape[1]))
                for row, k in enumerate(own):
                    for use in uses[k]:
                        counts[row, use["tongue"]] += use["n"]
                total += lattice.expected([texts[k] for k in own], counts, held, "")
        piece, tongue = np.nonzero(total)
        if len(piece):
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(tongue, pa.int32()), pa.array(total[piece, tongue])], names=schema.names)

    found = words.mapInArrow(run, schema).groupBy("piece", "tongue").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros_like(chance)
    out[found["piece"].to_numpy(), found["tongue"].to_numpy()] = found["uses"].to_numpy()
    return out


def learn(words: DataFrame, pieces: list[str], n_languages: int, rules: LanguageRules) -> np.ndarray:
    """EM from even probabilities over words (word, uses)."""
    chance = normalised(np.ones((len(pieces) + 2, n_languages)), 0)
    for _ in range(rules.rounds):
        chance = normalised(piece_sums(words, pieces, chance), rules.smoothing)
    return chance


def in_training(id_col: str) -> Column:
    """Rows that may be learnt from: crc32 of the id as text is not 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def train(docs: DataFrame, pieces: list[str], id_col: str, text_col: str, lang_col: str, rules: LanguageRules) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities."""
    labelled = spread(keyed(docs, id_col, text_col, lang_col)).where(in_training(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = settle(labelled.groupBy(lang_col).agg(F.count("*").alias("rows of language")))
    languages = sorted(r[0] for r in sizes.collect())  # the columns of the model
    if not languages:
        return [], np.zeros((len(pieces) + 2, 0))
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / F.lit(float(1 << 20))
    few = F.broadcast(sizes) if len(languages) <= MOST_SENT else sizes
    sample = labelled.join(few, lang_col).where(draw < F.lit(float(rules.per_language)) / F.col("rows of language")).select(lang_col, text_col)
    schema = T.StructType([T.StructField("tongue", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def rows(batch: pa.RecordBatch):
        place, counts = {x: k for k, x in enumerate(languages)}, Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((place[lang], b) for w in text.lower().split() for b in word_blocks(w, rules.block))
        yield [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]

    counted = arrow_map(sample, schema, rows).groupBy("word", "tongue").agg(F.sum("n").alias("n"))
    words = settle(counted.groupBy("word").agg(F.collect_list(F.struct("tongue", "n")).alias("uses")))  # a use for each language
    words = settle(words.repartition(1 + words.count() // 8192))
    return languages, learn(words, pieces, len(languages), rules)


class Scorer:
    """Scores texts, remembering words."""

    def __init__(self, pieces: list[str], languages: list[str], chance: np.ndarray, rules: LanguageRules):
        self.lattice, self.languages, self.chance, self.rules = Lattice(pieces), languages, chance, rules
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, len(languages)), np.float32)

    def logs(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text in each language."""
        lists = [t.lower().split() for t in texts]
        if len(self.known) > self.rules.words:
            self.known, self.values = {}, self.values[:0]
        known = self.known
        new = list(set().union(*lists) - known.keys())
        if new:
            # In order of length, so that one very long word keeps company with few.
            new.sort(key=len)
            made = [self.lattice.scores(new[a : a + 16384], self.chance) for a in range(0, len(new), 16384)]
            known.update(zip(new, range(len(self.values), len(self.values) + len(new))))
            self.values = np.concatenate([self.values, *[m.astype(np.float32) for m in made]])
        rows = np.array([known[w] for words in lists for w in words], np.int64)
        sums = np.zeros((len(rows) + 1, len(self.languages)))
        np.cumsum(self.values[rows], axis=0, dtype=np.float64, out=sums[1:])
        ends = np.cumsum([len(x) for x in lists])
        return sums[ends] - sums[ends - [len(x) for x in lists]]


def identify(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: LanguageRules = LanguageRules()) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row. vocabulary: path of a SentencePiece file."""
    pieces = public_pieces(vocabulary)
    languages, chance = train(docs, pieces, id_col, text_col, lang_col, rules)
    model = docs.sparkSession.sparkContext.broadcast((pieces, languages, chance))  # at most pieces x languages numbers
    chosen = spread(keyed(docs, id_col, text_col)).withColumn("held_out", F.coalesce(~in_training(id_col), F.lit(False)))
    schema = T.StructType([chosen.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value, rules)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts, 4 << 20):
                names, score = verdicts(scorer, texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return chosen.mapInArrow(run, schema)


def verdicts(scorer: Scorer, texts: list[str]) -> tuple[list[str], list[float]]:
    if not scorer.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    logs = scorer.logs(texts)
    best = logs.argmax(axis=1)
    score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    speaks = [_letter.search(t) is not None for t in texts]
    return [scorer.languages[k] if s else UNDETERMINED for k, s in zip(best, speaks)], [float(x) if s else 0.0 for x, s in zip(score.round(9), speaks)]
