"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes of a text cuts it into chunks, so that a
passage which many documents share falls into the same chunks wherever it
stands. A chunk's interior (from its first white space to its last) is encoded
once for all documents that a Python worker meets, and its ids are kept. A word
that a cut has split belongs to no interior: the pieces on both sides of the
join are put together again, over as many chunks as the word spans, and are
encoded anew. The tokenizer never merges across white space, so the ids then
agree exactly with those of the whole text.

Inside a new chunk, words that are already known are not encoded again either.
Both memories hold a bounded number of bytes and forget their older half when
full, which changes speed and never results. Nothing is shuffled, and a lost
executor only loses its memory.

Ids come from the tokenizer library alone; a plain word (Latin letters, then
marks) goes straight to its merge model, any other through its whole chain. The
vocabulary file is a parameter and is never trained or copied. Truncation and padding are off.

Defined results: a null text is empty and has no ids; a repeated row gives a
repeated result; a null id is carried through; an empty table gives an empty
one; further columns are ignored. Texts of any length are read whole; special
tokens inside a text are found as the library finds them.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import arrow_map, blocks, keyed, spread, utf8

#: A cut falls after a byte where the low bits of the hash are zero: chunks of about 2**CUT_BITS bytes.
CUT_BITS = 9
#: Bytes that the rolling hash looks at.
ROLL = 16
#: Bytes that each memory of a worker may hold.
MEMORY_BYTES = 96 << 20
# Fixed value: the pattern of the vocabulary files whose plain words the simple rule may split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_gear = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 63, 256, dtype=np.uint64)
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True


def cuts(text: bytes, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of one text, the last of them its length."""
    n = len(text)
    if n <= ROLL:
        return [n] if n else []
    values = _gear[np.frombuffer(text, np.uint8)]
    # The gear hash h = 2 h + value over the last 16 bytes, by doubling.
    with np.errstate(over="ignore"):
        for k in (1, 2, 4, 8):
            values[k:] = values[k:] + (values[:-k] << np.uint64(k))
    mask = np.uint64(((1 << bits) - 1) << 20)
    places = np.flatnonzero((values[ROLL - 1 :] & mask) == 0) + ROLL
    out = places.tolist()
    if not out or out[-1] != n:
        out.append(n)
    return out


class Memory:
    """A map of bounded size in two generations; what was used of late survives."""

    def __init__(self, limit: int):
        self.limit, self.size, self.new, self.old = limit // 2, 0, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and self.old:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        self.new[key] = value
        self.size += 300 + len(key) + len(value[0]) + len(value[1])
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0


#: Words that a simple rule splits as the tokenizer does: Latin letters, then ASCII marks other than the apostrophe.
_plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_symbols() -> list[str]:
    """The character that byte-level models write for each byte: itself where it is visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Encodes whole texts; one for each vocabulary file and Python worker."""

    def __init__(self, path: str, memory_bytes: int = MEMORY_BYTES, bits: int = CUT_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits = bits
        self.words, self.cores, self.chunks = Memory(memory_bytes), Memory(memory_bytes // 2), Memory(memory_bytes // 2)
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.tokens = [(self.tokenizer.id_to_token(k) or "").encode() + b" " for k in range(size)]
        self.symbols = dict(enumerate(byte_symbols()))
        self.simple = self.follows_rule()

    def follows_rule(self) -> bool:
        """Whether plain words may be split by the simple rule: the file's own normalizer and pattern, and a trial."""
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if steps != ["NFC", "Replace", "Lowercase"] or splits[0].get("pattern", {}).get("Regex") != PATTERN or spec["model"]["type"] != "BPE" or spec["model"]["dropout"]:
            return False
        trial = ["Word", "ÀÉß.", "naïve,!!", "x***"]
        return [self.plain(w) for w in trial] == [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(trial, add_special_tokens=False)]

    def packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the tokens' text with a space after each."""
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes(), b"".join([self.tokens[k] for k in ids])

    def plain(self, word: str) -> tuple[bytes, bytes] | None:
        """The ids of a word of letters and marks, or None for any other word."""
        match = _plain.fullmatch(word)
        if match is None:
            return None
        core, marks = match.groups()
        one = self.core(core.lower())
        if not marks:
            return one
        two = self.core(marks)
        return one[0] + two[0], one[1] + two[1]

    def core(self, piece: str) -> tuple[bytes, bytes]:
        found = self.cores.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
            found = self.packed([t.id for t in self.tokenizer.model.tokenize(shown)])
            self.cores.put(piece, found)
        return found

    def learn(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Ids (little-endian, 32 bits) and token texts of words."""
        out, rest = {}, []
        for word in words:
            found = self.plain(word.decode()) if self.simple else None
            if found is None:
                rest.append(word)
            else:
                out[word] = found
                self.words.put(word, found)
        made = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        for word, encoding in zip(rest, made):
            out[word] = self.packed(encoding.ids)
            self.words.put(word, out[word])
        return out

    def interior(self, chunk: bytes, head: bool, tail: bool) -> tuple[int, int]:
        """The part of a chunk with whole words only: all of it at an end of the text."""
        if head and tail:
            return 0, len(chunk)
        flags = np.flatnonzero(_space[np.frombuffer(chunk, np.uint8)])
        if not len(flags):
            return (0, 0) if head else (len(chunk), len(chunk))
        return 0 if head else int(flags[0]), len(chunk) if tail else int(flags[-1]) + 1

    def parts(self, text: bytes) -> list[tuple[bytes, bool]]:
        """The text as interiors (True) and mended joins (False), in order."""
        out: list[tuple[bytes, bool]] = []
        ends = cuts(text, self.bits)
        a, open_from = 0, 0
        for k, b in enumerate(ends):
            head, tail = k == 0, k == len(ends) - 1
            chunk = text[a:b]
            s, e = self.interior(chunk, head, tail)
            if e > s:
                if a + s > open_from:
                    out.append((text[open_from : a + s], False))
                out.append((chunk[s:e], True))
                open_from = a + e
            a = b
        if open_from < len(text):
            out.append((text[open_from:], False))
        return out

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text, both as bytes, of each text."""
        collecting = gc.isenabled()
        gc.disable()  # millions of small tuples without cycles: walking them finds nothing
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        plans = [self.parts(t) for t in texts]
        known: dict[bytes, tuple[bytes, bytes]] = {}
        fresh: dict[bytes, list[bytes]] = {}
        for plan in plans:
            for part, inner in plan:
                if inner:
                    if part in known or part in fresh:
                        continue
                    found = self.chunks.get(part)
                    if found is not None:
                        known[part] = found
                        continue
                elif part in fresh:
                    continue
                fresh[part] = part.split()
        ids_of: dict[bytes, bytes] = {}
        text_of: dict[bytes, bytes] = {}
        get, unknown = self.words.get, []
        for w in set().union(*fresh.values()):
            found = get(w)
            if found is None:
                unknown.append(w)
            else:
                ids_of[w], text_of[w] = found
        for w, found in self.learn(unknown).items():
            ids_of[w], text_of[w] = found
        done: dict[bytes, tuple[bytes, bytes]] = {}
        for part, words in fresh.items():
            done[part] = (b"".join(map(ids_of.__getitem__, words)), b"".join(map(text_of.__getitem__, words)))
        out = []
        for plan in plans:
            pairs = []
            for part, inner in plan:
                found = done.get(part) or known[part]
                if inner and part in done:
                    self.chunks.put(part, found)
                pairs.append(found)
            out.append((b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])[:-1]))
        return out


_encoders: dict[tuple[str, int, int], Encoder] = {}


def encoder(path: str, memory_bytes: int = MEMORY_BYTES, bits: int = CUT_BITS) -> Encoder:
    key = (path, memory_bytes, bits)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, memory_bytes, bits)
    return _encoders[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): token ids of each text and the text they stand for."""
    chosen = spread(keyed(docs, id_col, text_col))
    schema = T.StructType([chosen.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def rows(batch: pa.RecordBatch):
        texts, tool = utf8(batch.column(1)), encoder(path)
        for a, b in blocks(texts):
            made = tool.encode(texts[a:b])
            yield [batch.column(0).slice(a, b - a), [np.frombuffer(i, "<i4") for i, _ in made], [d.decode() for _, d in made]]

    return arrow_map(chosen, schema, rows)


DIGEST = (T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()))


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text."""
    chosen = spread(keyed(docs, id_col, text_col))

    def rows(batch: pa.RecordBatch):
        texts, tool = utf8(batch.column(1)), encoder(path)
        for a, b in blocks(texts):
            made = tool.encode(texts[a:b])
            yield [batch.column(0).slice(a, b - a), [len(i) // 4 for i, _ in made], [hashlib.sha256(i).hexdigest() for i, _ in made], [hashlib.sha256(d).hexdigest() for _, d in made]]

    return arrow_map(chosen, T.StructType([chosen.schema[id_col], *DIGEST]), rows)
