"""Quality rules, line first.

Each line is judged alone by punctuation, navigation and boilerplate rules.
Failing lines are removed, and a document that loses too much of its text in
this way is rejected. Two rules on the whole text (too few words, too many
words in repeated 8-word windows) reject it beforehand.

Words are maximal runs of characters other than ASCII white space.

Defined results: a null text counts as empty, has no words and is rejected;
a repeated row gives a repeated result; a null id is carried through; an empty
table gives an empty one; columns other than the id and the text are ignored.
Texts of any length are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import arrow_map, blocks, keyed, mix, same_columns, spread, utf8

# Phrases of lines that a page's frame puts into a text, lower case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here to",
    "enable javascript",
    "javascript is disabled",
    "privacy policy",
    "read more",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "this site uses cookies",
    "we use cookies",
)

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
_boilerplate = re.compile("|".join(map(re.escape, BOILERPLATE)).encode(), re.I)
_not_upper = bytes(sorted(set(range(256)) - set(UPPER)))


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Line rules: shares of a line's words. Document rules: see the fields."""

    min_words: int = 20
    max_repeat_percent: int = 30
    #: A line of menu entries: so many ``|`` or ``>`` standing alone, or so large a share of its words.
    min_separators: int = 3
    separator_percent: int = 25
    #: A line of noise: symbols for each hundred words.
    symbol_percent: int = 30
    #: A line of shouting: exclamation marks for each hundred words.
    exclaim_percent: int = 50
    #: Boilerplate phrases count in lines of at most so many words.
    boilerplate_words: int = 25
    #: A document is rejected when lines with more than this share of its words fail.
    max_lost_percent: int = 50


def line_fails(line: bytes, words: list[bytes], rules: QualityRules) -> bool:
    """Whether one line with words breaks a navigation, punctuation or boilerplate rule."""
    n = len(words)
    marks = len(line) - len(line.translate(None, SYMBOLS))
    if marks:
        alone = words.count(b"|") + words.count(b">")
        if alone and (alone >= rules.min_separators or 100 * alone >= rules.separator_percent * n):
            return True
        if 100 * marks > rules.symbol_percent * n:
            return True
    if b"!" in line and 100 * line.count(b"!") > rules.exclaim_percent * n:
        return True
    return n <= rules.boilerplate_words and _boilerplate.search(line) is not None


def repeated_words(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document, its words inside windows found at least twice in it.

    codes: a number for each distinct word, all documents after another.
    Equal hashes are compared word by word, so the counts are exact.
    """
    out = np.zeros(len(lengths), np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return out
    with np.errstate(over="ignore"):
        spread = mix(codes.astype(np.uint64) + np.uint64(1))
        hashes = mix(owner[:n].astype(np.uint64) + np.uint64(7))
        for k in range(WINDOW):
            hashes = hashes * np.uint64(0x100000001B3) + spread[k : k + n]
        hashes = mix(hashes)
    places = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    order = places[np.argsort(hashes[places], kind="stable")]
    if len(order) < 2:
        return out
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return out
    first, second = order[:-1][same], order[1:][same]
    for k in range(WINDOW):
        if (codes[first + k] != codes[second + k]).any():  # two windows share a hash
            return np.array([_repeated_slowly(codes[e - m : e]) for e, m in zip(ends, lengths)], np.int64)
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = np.unique(np.concatenate([first, second]))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    hit = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[hit], minlength=len(lengths)).astype(np.int64)


def _repeated_slowly(codes: np.ndarray) -> int:
    seen: dict[tuple, list[int]] = {}
    for k in range(len(codes) - WINDOW + 1):
        seen.setdefault(tuple(codes[k : k + WINDOW]), []).append(k)
    return len({p + k for places in seen.values() if len(places) > 1 for p in places for k in range(WINDOW)})


def judge(texts: list[bytes], chars: list[int], rules: QualityRules, clean: bool) -> list[list]:
    """Columns of measures for some texts; with ``clean`` also the text of the lines that stay."""
    names: dict[bytes, int] = {}
    codes: list[int] = []
    n_words, word_chars, symbols, dup, lost, left = [], [], [], [], [], []
    for text, n_chars in zip(texts, chars):
        words = text.split()
        codes.extend([names.setdefault(w, len(names)) for w in words])
        n_words.append(len(words))
        word_chars.append(sum(map(len, words)) - (len(text) - n_chars))
        symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
        seen: set[bytes] = set()
        doubles, gone, stay = 0, 0, []
        for line in text.split(b"\n"):
            own = line.split()
            if own:
                if line in seen:
                    doubles += 1
                else:
                    seen.add(line)
                if line_fails(line, own, rules):
                    gone += len(own)
                    continue
            if clean:
                stay.append(line)
        dup.append(doubles)
        lost.append(gone)
        if clean:
            left.append(b"\n".join(stay))
    repeat = repeated_words(np.array(codes, np.int64), np.array(n_words, np.int64)).tolist()
    base = [n < rules.min_words or 100 * r > rules.max_repeat_percent * n for n, r in zip(n_words, repeat)]
    kept = [not b and 100 * g <= rules.max_lost_percent * n for b, g, n in zip(base, lost, n_words)]
    return [n_words, word_chars, symbols, dup, repeat, base, kept, lost, left]


SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("n_lost_words", T.LongType())]
)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """A row of measures and the verdict for each row of ``docs``. Narrow: no shuffle."""
    chosen = spread(keyed(docs, id_col, text_col))
    schema = T.StructType([chosen.schema[id_col], *SCHEMA.fields])

    def rows(batch: pa.RecordBatch):
        texts = utf8(batch.column(1))
        chars = [len(t.decode()) if not t.isascii() else len(t) for t in texts]
        for a, b in blocks(texts):
            yield [batch.column(0).slice(a, b - a), *judge(texts[a:b], chars[a:b], rules, False)[:8]]

    return arrow_map(chosen, schema, rows)


def quality_filter(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, without their failing lines.

    Columns stay as they are, also where names clash; ``length_col``, if there is one, gets the new length. A null
    or empty text is rejected; repeated rows are kept or rejected alike; an empty table gives an empty one.
    """
    names = docs.columns
    at = names.index(text_col)
    measured = names.index(length_col) if length_col in names else -1

    def rows(batch: pa.RecordBatch):
        texts = utf8(batch.column(at))
        chars = [len(t.decode()) if not t.isascii() else len(t) for t in texts]
        for a, b in blocks(texts):
            *_, kept, lost, left = judge(texts[a:b], chars[a:b], rules, True)
            keep = [k for k, yes in enumerate(kept) if yes]
            columns = [batch.column(c).slice(a, b - a).take(pa.array(keep, pa.int64())) for c in range(len(names))]
            fresh = [(left[k] if lost[k] else texts[a + k]).decode() for k in keep]
            columns[at] = fresh
            if measured >= 0:
                columns[measured] = [len(x) for x in fresh]
            yield columns

    return same_columns(docs, rows)
