"""Personal data by weak supervision.

Four base kinds (email, ip, card, phone) follow fixed rules, and their spans
always stay. Further candidates (written-out emails, national phone numbers,
long addresses, digit runs that a card rule refused) are only taken where a
trained classifier says so:

1. Three labelers vote yes, no or nothing on each span: a *regex* labeler on its
   form, a *gazetteer* labeler on names, prefixes and ranges, a *context*
   labeler on the words before it.
2. Votes of the whole corpus are counted by kind and pattern (Spark; at most a
   few hundred patterns, whatever the corpus), and expectation-maximisation
   estimates for each kind how often it is true and how reliable each labeler is.
3. A logistic classifier is trained on what stands in and around the spans (shapes
   of their characters, their ends, words before and after), not on the votes; its
   labels are the probabilities that the votes give. So it also knows spans on
   which no labeler spoke. It reads the counts of different spans of the corpus, of
   base spans and of added ones at most ``sample`` each, by the least hashes.
4. Added spans with a probability of ``threshold`` or more are taken.

Starts and ends count code points, ends are exclusive.

Defined results: a null text is empty; repeated rows give repeated results; a
null id is carried through; an empty table gives an empty one (nothing is
trained then); further columns are ignored by the report and kept by ``redact``,
also where their names clash. Texts are read whole, and every search is linear in
their length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import settle
from .textkit import arrow_map, by_place, keyed, same_columns, spread

KINDS = ("email", "ip", "card", "phone")
LOWER = "abcdefghijklmnopqrstuvwxyz"
ABSTAIN, NO, YES = 0, 1, 2

_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_dotted = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_chain = re.compile(r"[0-9](?:[ -]?[0-9])++")
_plus = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_at = re.compile(r"[\[(] ?at ?[\])]", re.I)
_written = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]++)++", re.I)
_national = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])")
_long_ip = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_word = re.compile(r"[a-zà-ÿ]+")

# Ends of host names, country calling codes and words around personal data.
TOP_DOMAINS = frozenset("at au be biz br ca ch cn co com cz de dk edu es eu fi fr gov gr hu ie in info int io it jp kr me mil mx net nl no nz org pl pt ro ru se tr uk us za".split())
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
CARD_PREFIXES = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
NEAR = {
    "email": frozenset("address contact correo courriel email kontakt mail reach write".split()),
    "ip": frozenset("address adresse from host ip login server".split()),
    "card": frozenset("amex card carte credit karte kreditkarte mastercard payment tarjeta visa".split()),
    "phone": frozenset("call cell fax mobile phone tel telefon telefono telephone téléphone teléfono".split()),
}
AGAINST = frozenset("build checksum id invoice isbn issn key order serial token version".split())


@dataclass(frozen=True)
class SpanRules:
    """threshold: least probability of an added span; rounds: of EM; context: characters read before and after a
    span; sample: bound of the different spans, of base and of added ones each, that the classifier is trained on."""

    threshold: float = 0.8
    rounds: int = 40
    context: int = 40
    sample: int = 10_000


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        if at >= floor and (match := _domain.match(text, at + 1)):
            start = at
            while start > floor and _local.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append((start, match.end()))
                floor = match.end()
        else:
            floor = max(floor, 0)
        at = text.find("@", max(at + 1, floor))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _dotted.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts = run[0].split(".")
        place = run.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            size = sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                out.append((place, place + size))
            place += size + 1
    return out


def digit_chains(text: str) -> list[tuple[int, int, str]]:
    """Chains of digits that have the length of a card number."""
    out = []
    for run in _chain.finditer(text):
        if run.end() - run.start() >= 12:
            digits = run[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                out.append((run.start(), run.end(), digits))
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _plus.finditer(text) if 9 <= len(_digit.findall(m[0])) <= 15]


def vote(kind: str, text: str, start: int, end: int, rules: SpanRules) -> tuple[int, int, int]:
    """The votes of the regex, gazetteer and context labelers."""
    span = text[start:end]
    digits = "".join(_digit.findall(span))
    if kind == "email":
        top = re.split(r"\.|[\])] ?", span.lower())[-1].strip("-")
        form = YES if top.isalpha() and ".." not in span else NO
        known = YES if top in TOP_DOMAINS else NO
    elif kind == "ip":
        parts = span.split(".")
        form = YES if len(parts) == 4 and all(p == str(int(p[-9:])) for p in parts) else ABSTAIN
        known = ABSTAIN if ":" in span else YES if 0 < int(parts[0]) < 224 and int(parts[0]) != 127 else NO
    elif kind == "card":
        form = YES if luhn(digits) else NO
        known = YES if digits.startswith(CARD_PREFIXES) else NO
    else:
        plus = span.startswith("+")
        form = YES if plus and len(digits) >= 10 else ABSTAIN
        known = YES if (digits.startswith(CALLING_CODES) if plus else min(digits[0], digits[3]) >= "2") else NO
    words = set(_word.findall(text[max(0, start - rules.context) : start].lower())[-6:])
    around = NO if words & AGAINST else YES if words & NEAR[kind] else ABSTAIN
    return form, known, around


def pattern(kind: int, votes: tuple[int, int, int], size: int, base: bool) -> int:
    """A number for what the classifier sees of a span."""
    return ((((base * 4 + min(3, size // 8)) * 3 + votes[2]) * 3 + votes[1]) * 3 + votes[0]) * 4 + kind


def features(code: int) -> tuple[int, list[int], int, int]:
    """Kind, votes, size class and base flag of a pattern."""
    kind, code = code % 4, code // 4
    votes = [code % 3, code // 3 % 3, code // 9 % 3]
    return kind, votes, code // 27 % 4, code // 108


def find(text: str, rules: SpanRules = SpanRules()) -> list[tuple[int, int, int, int]]:
    """Base spans and candidates of one text: (kind, start, end, pattern)."""
    base: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    if "@" in text:
        base += [(0, a, b) for a, b in emails(text)]
    if _at.search(text):
        more += [(0, m.start(), m.end()) for m in _written.finditer(text)]
    if _digit.search(text):
        base += [(1, a, b) for a, b in addresses(text)]
        for a, b, digits in digit_chains(text):
            (base if luhn(digits) else more).append((2, a, b))
        if "+" in text:
            base += [(3, a, b) for a, b in phones(text)]
        more += [(3, m.start(), m.end()) for m in _national.finditer(text)]
        if ":" in text:
            more += [(1, m.start(), m.end()) for m in _long_ip.finditer(text)]
    if not base and not more:
        return []
    base.sort(key=lambda x: (x[1], x[0]))
    out = [(k, a, b, pattern(k, vote(KINDS[k], text, a, b, rules), b - a, True)) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    reach, at = 0, 0
    for k, a, b in sorted(more, key=lambda x: (x[1], x[0])):
        while at < len(taken) and taken[at][0] < b:
            reach, at = max(reach, taken[at][1]), at + 1
        if a >= reach:  # no base span and no earlier candidate overlaps it
            out.append((k, a, b, pattern(k, vote(KINDS[k], text, a, b, rules), b - a, False)))
            reach = b
    return sorted(out, key=lambda x: (x[1], x[0]))


def reliabilities(counts: dict[int, int], rounds: int) -> dict[int, float]:
    """Expectation-maximisation on pattern counts: the probability that a span of a pattern is true."""
    truth: dict[int, float] = {}
    for kind in range(len(KINDS)):
        codes = [c for c in counts if c % 4 == kind]
        if not codes:
            continue
        votes = np.array([features(c)[1] for c in codes])
        weight = np.array([counts[c] for c in codes], float)
        belief = (1 + (votes == YES).sum(1)) / (2 + (votes != ABSTAIN).sum(1))
        for _ in range(rounds):
            share = ((weight * belief).sum() + weight.sum() / 2) / (2 * weight.sum())
            odds = np.full(len(codes), np.log(share) - np.log(1 - share))
            for j in range(3):
                for v in (NO, YES):
                    own = votes[:, j] == v
                    spoke = votes[:, j] != ABSTAIN
                    # A labeler is taken to be better than chance: a prior of eight right votes in ten, as heavy as the spans
                    # themselves (like that of the share, of half), so that it also holds where labelers never disagree.
                    prior = 10 + weight.sum()
                    right = 0.8 if v == YES else 0.2
                    true = (right * prior + (weight * belief)[own].sum()) / (prior + (weight * belief)[spoke].sum())
                    false = ((1 - right) * prior + (weight * (1 - belief))[own].sum()) / (prior + (weight * (1 - belief))[spoke].sum())
                    odds[own] += np.log(true) - np.log(false)
            belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        truth.update(zip(codes, belief.tolist()))
    return truth


#: Weights of the classifier: features fall into so many places by a hash.
WIDTH = 512
_runs = re.compile(r"0+|a+|A+")
_shape = str.maketrans("0123456789" + LOWER + LOWER.upper(), "0" * 10 + "a" * 26 + "A" * 26)


def describe(kind: int, text: str, start: int, end: int, rules: SpanRules) -> list[int]:
    """Places of the features of a span: its shape in pieces of three marks, its size and end, words before and after."""
    span = text[start:end]
    shape = "^" + _runs.sub(lambda m: m[0][0] + str(min(4, len(m[0]))), span[:256].translate(_shape)) + "$"
    before = _word.findall(text[max(0, start - rules.context) : start].lower())[-4:]
    after = _word.findall(text[end : end + rules.context].lower())[:2]
    names = [f"size {min(12, len(span) // 4)}", f"first {shape[1:2]}", f"end {_word.findall(span.lower())[-1:]}" if kind == 0 else "", "bare" if not before else ""]
    names += [f"shape {shape[k : k + 3]}" for k in range(len(shape) - 2)] + [f"before {w}" for w in before] + [f"after {w}" for w in after]
    return sorted({0, 1 + kind, *[5 + zlib.crc32(f"{kind} {n}".encode()) % (WIDTH - 5) for n in names if n]})


def fit(places: list[list[int]], labels: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic classifier: Newton steps with a ridge. places: features of each row."""
    x = np.zeros((len(places), WIDTH))
    for k, own in enumerate(places):
        x[k, own] = 1
    theta = np.zeros(WIDTH)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (labels - p)) - theta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.eye(WIDTH)
        step = np.linalg.solve(curve, slope)
        theta += step
        if np.abs(step).max() < 1e-6:
            break
    return theta.round(9)


def probability(theta: np.ndarray, places: list[int]) -> float:
    return float(1 / (1 + np.exp(-np.clip(theta[places].sum(), -30, 30))))


def train(counts: dict[int, int], spans: list[tuple[int, list[int], int]], rules: SpanRules) -> np.ndarray:
    """Weights of the final classifier. counts: of patterns, in the whole corpus; spans: (pattern, features, how often)."""
    if not spans:
        return np.zeros(WIDTH)
    truth = reliabilities(counts, rules.rounds)
    ordered = sorted((c, tuple(f), n) for c, f, n in spans)
    return fit([list(f) for _, f, _ in ordered], np.array([truth[c] for c, _, _ in ordered]), np.log1p(np.array([n for *_, n in ordered], float)))


def learnt(found: DataFrame, rules: SpanRules) -> np.ndarray:
    """The classifier's weights, from rows with arrays ``patterns`` and ``places`` (features of each span)."""
    each = found.select(F.explode(F.arrays_zip("patterns", "places")).alias("s")).select(F.col("s.patterns").alias("code"), F.col("s.places").alias("places"))
    kinds = settle(each.groupBy("code", "places").agg(F.count("*").alias("n")))
    counts = {r["code"]: r["n"] for r in kinds.groupBy("code").agg(F.sum("n").alias("n")).collect()}  # at most 864 rows
    base = F.floor(F.col("code") / 108) == 1
    picked = [r for own in (base, ~base) for r in kinds.where(own).orderBy(F.xxhash64("code", "places"), "code", "places").limit(rules.sample).collect()]
    return train(counts, [(r["code"], r["places"], r["n"]) for r in picked], rules)


FOUND = (
    *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("kinds", "starts", "ends", "patterns")],
    T.StructField("places", T.ArrayType(T.ArrayType(T.IntegerType()))),
)


def described(text: str, rules: SpanRules) -> list[tuple]:
    """What ``find`` gives, with features."""
    return [(*s, describe(*s[:1], text, *s[1:3], rules)) for s in find(text, rules)]


def candidates(docs: DataFrame, id_col: str, text_col: str, rules: SpanRules) -> DataFrame:
    """Base spans and candidates of each row."""
    chosen = spread(keyed(docs, id_col, text_col))

    def rows(batch: pa.RecordBatch):
        spans = [described(t or "", rules) for t in batch.column(1).to_pylist()]
        yield [batch.column(0), *[[[s[j] for s in x] for x in spans] for j in range(5)]]

    return arrow_map(chosen, T.StructType([chosen.schema[id_col], *FOUND]), rows)


def taken(spans: list[tuple], theta: np.ndarray, rules: SpanRules) -> list[tuple[int, int, int]]:
    """Base spans, and added ones that the classifier takes, of (kind, start, end, pattern, features)."""
    return [s[:3] for s in spans if features(s[3])[3] or probability(theta, s[4]) >= rules.threshold]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


REPORT = (*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SpanRules = SpanRules()) -> DataFrame:
    """Counts of base kinds, a digest of base spans, and all spans of each row. Texts are read once."""
    found = settle(candidates(docs, id_col, text_col, rules))
    theta = learnt(found, rules)

    def rows(batch: pa.RecordBatch):
        out: list[list] = [[] for _ in REPORT]
        for spans in zip(*[batch.column(j).to_pylist() for j in range(1, 6)]):
            every = list(zip(*spans))
            base = [s[:3] for s in every if features(s[3])[3]]
            for j in range(len(KINDS)):
                out[j].append(sum(k == j for k, _, _ in base))
            out[-2].append(hashlib.sha256(shown(base).encode()).hexdigest())
            out[-1].append(shown(taken(every, theta, rules)))
        yield [batch.column(0), *out]

    return arrow_map(found, T.StructType([found.schema[0], *REPORT]), rows)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind."""
    out, done = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], x[0])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: SpanRules = SpanRules()) -> DataFrame:
    """``docs`` with personal data replaced by ``<KIND>``; ``length_col``, if there is one, gets the new length.

    A null text stays null; repeated rows change alike; an empty table gives an empty one.
    """
    names = docs.columns
    at = names.index(text_col)
    measured = names.index(length_col) if length_col in names else -1
    theta = learnt(_patterns(by_place(spread(docs)).select(F.col(f"c{at}").alias("text")), rules), rules)

    def rows(batch: pa.RecordBatch):
        texts = batch.column(at).to_pylist()
        fresh = []
        for t in texts:
            spans = taken(described(t, rules), theta, rules) if t else []
            fresh.append(masked(t, spans) if spans else t)
        columns = list(batch.columns)
        columns[at] = fresh
        if measured >= 0:
            columns[measured] = [old if new is was else len(new) for new, was, old in zip(fresh, texts, columns[measured].to_pylist())]
        yield columns

    return same_columns(docs, rows)


def _patterns(texts: DataFrame, rules: SpanRules) -> DataFrame:
    def rows(batch: pa.RecordBatch):
        spans = [described(t or "", rules) for t in batch.column(0).to_pylist()]
        yield [[[s[j] for s in x] for x in spans if x] for j in (3, 4)]

    return arrow_map(texts, T.StructType([*FOUND[3:]]), rows)
