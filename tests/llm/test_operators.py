"""Corpus operators against brute force, and on the rows that break things."""

import hashlib
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from fairlead.llm import bpe, chat, decontam, html_extract, language_id, license_scan, lm_score, pii, quality, queries, simhash

from ..compare import same, tables
from ..conftest import SMALL

LONG = "wort " * 20000 + "x" * 30000
ODD = [None, "", " \n\t ", "a", LONG, "a", "été 日本語 ＡＢＣ", "mail a.b@c.de and +49 151 2345678", "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t, None if k % 2 else "de", "s", k, "clash") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SMALL}/documents.parquet")
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


@pytest.fixture(scope="module")
def db():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], db)


def everything(df, spark):
    return {
        "op1": lambda d: language_id.identify(d, queries.vocabulary("piece_bpe_32k.model")),
        "op2": lambda d: decontam.contamination_report(d, spark.createDataFrame([(1, "same text here"), (2, None), (3, "...")], "item_id long, text string")),
        "op4": license_scan.scan,
        "op5": lm_score.score,
        "op6": lambda d: bpe.digest(d, queries.vocabulary()),
        "op7": quality.quality_report,
        "op8": pii.pii_report,
        "op9": simhash.near_duplicates,
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    run = everything(odd, spark)[name]
    got = run(odd).collect()
    assert len(got) == len(ODD) and sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [k for k in range(len(ODD)) if k != 3]
    by = {r["doc_id"]: r for r in got}
    pick = lambda r: tuple(v for k, v in r.asDict().items() if k != "doc_id")
    if name != "op1":
        assert pick(by[8]) == pick(by[9])
        assert pick(by[0])[:1] == pick(by[1])[:1]
    assert run(odd.where("false")).count() == 0


# Quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    again = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n)


def test_quality(docs, texts):
    got = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    for k, t in texts.items():
        assert tuple(got[k])[1:7] == brute_quality(t or "")
        assert not (got[k]["kept"] and got[k]["base_failed"])


def test_quality_lines(spark):
    good = "The council met on Tuesday to discuss the plans for the old harbour, and many people came to listen and to speak."
    bad = ["Home | News | Sport | About", "BUY!! NOW!! CHEAP!!", "one&&& two*** three$$$ four###", "All rights reserved."]
    more = "Nobody could say when work would start, but the mayor promised a decision before the end of spring."
    text = "\n".join([good, bad[0], more, *bad[1:]])
    docs = spark.createDataFrame([(1, text, 0), (2, "\n".join(bad * 9), 0)], "doc_id long, text string, n_chars long")
    left = quality.quality_filter(docs).collect()
    assert [r["doc_id"] for r in left] == [1] and left[0]["text"] == good + "\n" + more and left[0]["n_chars"] == len(left[0]["text"])


def test_quality_agrees_with_labels(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality.quality_report(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    poor = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["kept"] for r in good]) > 0.97 and np.mean([not r["kept"] for r in poor]) > 0.9


# Decontamination


def brute_contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    hit, found = set(), set()
    for item, own in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in own or ""))
        n = min(10, len(own))
        for a in range(len(own) - n + 1) if n else []:
            for k in range(len(words) - n + 1):
                if words[k : k + n] == own[a : a + n]:
                    hit |= set(range(k, k + n))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


@pytest.mark.parametrize("map_bytes", [1, 1 << 20])
def test_contamination_random(spark, map_bytes):
    draw = np.random.default_rng(4)
    word = lambda n: " ".join(draw.choice(["A", "b", "c1", "Ü"], n))
    items = [(k, word(draw.integers(0, 14))) for k in range(12)] + [(50, None), (51, "b c1"), (52, "?!")]
    texts = [word(draw.integers(0, 120)).replace(" ", draw.choice([" ", ", ", "-"])) for _ in range(40)] + [items[3][1] + " x " + items[5][1], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in decontam.contamination_report(docs, bench, map_bytes=map_bytes).collect()}
    for k, t in enumerate(texts):
        assert got[k] == brute_contamination(t or "", items)
    clean = {r["doc_id"] for r in decontam.decontaminate(docs, bench, map_bytes=map_bytes).collect()}
    assert clean == {k for k in got if got[k][1] == 0}


def test_contamination_joined_as_where_the_documents_are(spark, docs):
    """A benchmark of pages' worth of text, more than one task would be sent, against copies, odd rows and a hot text."""
    whole = docs.select("doc_id", "text")
    many = whole.union(whole).union(spark.range(2000).selectExpr("id + 100000", "'one two three four five six seven eight nine ten eleven'"))
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").union(whole.where("doc_id % 3 = 0")).union(spark.createDataFrame([(7, "four five"), (None, "two three four"), (8, None), (9, "!")], "item_id long, text string"))
    near = decontam.contamination_report(many, bench, map_bytes=1 << 40).groupBy("doc_id", "n_words", "n_hit", "n_items", "items_sha256").count()
    far = decontam.contamination_report(many, bench, map_bytes=0).groupBy("doc_id", "n_words", "n_hit", "n_items", "items_sha256").count()
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    left = [sorted(r["doc_id"] for r in decontam.decontaminate(many, bench, map_bytes=m).collect()) for m in (0, 1 << 40)]
    assert left[0] == left[1]


def test_nothing_to_clean_against(spark, docs):
    assert decontam.contamination_report(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


# SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """prints: list of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: least[root(k)] for k, (i, _) in enumerate(prints)}


def test_simhash(docs, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [(k, brute_fingerprint(t)) for k, t in texts.items()]
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{p:016x}" for k, p in prints}
    assert {k: r["component_id"] for k, r in got.items()} == brute_classes(prints)


@pytest.mark.parametrize("paired", [2, 64])
def test_simhash_pairs_by_both_ways(spark, paired):
    draw = np.random.default_rng(2)
    prints = set()
    for center in draw.integers(0, 1 << 63, 6, dtype=np.uint64).tolist() + [0, (1 << 64) - 1]:
        for _ in range(40):
            x = center
            for bit in draw.integers(0, 64, draw.integers(0, 5)).tolist():
                x ^= 1 << bit
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    edges = simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "bits long"), paired=paired)
    from fairlead.operators.components import components

    mine = {r["node"]: r["component"] for r in components(edges).collect()}
    wanted = brute_classes([(x, x % (1 << 64)) for x in signed])
    assert {x: mine.get(x, x) for x in signed} == wanted


def test_keep_one(spark):
    rows = [(5, "a b c d"), (2, "A b c d"), (9, "other words stand here now"), (9, "a quite different text it is"), (9, "other words stand here now"), (None, "third thing of its own kind")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, extra int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(2, rows[1][1]), (9, rows[2][1]), (9, rows[3][1]), (0, rows[5][1])])
    unique = docs.where("text LIKE '%b c d'")
    assert [r["doc_id"] for r in simhash.keep_one(unique).collect()] == [2]


def test_keep_one_does_not_pick_at_random(spark):
    rows = [(1, "a b c", 3), (1, "A b c", 2), (1, "a b c", 1), (1, "a b c", 1)]
    for parts in (1, 3):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(parts)).collect()
        assert [tuple(r) for r in kept] == [(1, "A b c", 2)]


STAGES = {
    "quality": quality.quality_filter,
    "dedup": simhash.keep_one,
    "decontam": lambda d: decontam.decontaminate(d, d.sparkSession.createDataFrame([(1, "nothing like it in any of them")], "item_id long, text string")),
    "decontam joined": lambda d: decontam.decontaminate(d, d.sparkSession.createDataFrame([(1, "nothing like it in any of them")], "item_id long, text string"), map_bytes=0),
    "pii": pii.redact,
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_with_clashing_names_long_and_repeated_rows(spark, name):
    good = "The council met on Tuesday to discuss the plans for the old harbour, and many people came to listen and to speak."
    long = " ".join(f"wort{k} und{k}" for k in range(4000))
    rows = [(1, good, 0, "A", "x"), (2, None, 0, "B", None), (3, "", 0, None, "x"), (4, long, 0, "C", "x"), (4, long, 0, "C", "x"), (None, good + " Then they left for home.", 0, "D", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, TEXT string, Doc_Id string").toDF("doc_id", "text", "n_chars", "TEXT", "DOC_ID")
    out = STAGES[name](docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert {(r[0], r[3], r[4]) for r in got} <= {(r[0], r[3], r[4]) for r in rows} and (1, "A", "x") in {(r[0], r[3], r[4]) for r in got}
    assert sum(r[0] == 4 for r in got) == (1 if name == "dedup" else 2) and all(len(r[1]) > 40000 for r in got if r[0] == 4)
    assert STAGES[name](docs.where("false")).count() == 0


# BPE


def test_bpe_equals_the_library(docs, texts, spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.vocabulary())
    tool.no_truncation(), tool.no_padding()
    draw = np.random.default_rng(6)
    strange = ["".join(draw.choice(list("aB é́\n<|endoftext|>日　😀1.'s\x00ß"), draw.integers(0, 2500))) for _ in range(60)] + [LONG, "", "<|startoftext|>x"]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(strange)], "doc_id long, text string"))
    own = texts | {10**6 + k: t for k, t in enumerate(strange)}
    got = {r["doc_id"]: r for r in bpe.digest(frame, queries.vocabulary()).collect()}
    for k, t in own.items():
        ids = tool.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_chunks_are_reused_and_memory_is_bounded():
    tool = bpe.Encoder(queries.vocabulary(), memory_bytes=1 << 16)
    passage = " ".join(f"word{k}" for k in range(600)).encode()
    first = {p for p, inner in tool.parts(b"one start " + passage) if inner}
    second = {p for p, inner in tool.parts(b"quite another beginning of it " + passage) if inner}
    assert len(first & second) >= len(first) - 2
    plain = bpe.Encoder(queries.vocabulary())
    many = [f"t{k} ".encode() + passage for k in range(50)]
    assert tool.encode(many) == plain.encode(many) and tool.words.size <= 1 << 16


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def good(kind, s):
        digits = re.sub(r"[^0-9]", "", s)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(BASE[kind], text) if good(kind, m[0]))


def test_base_spans_random():
    draw = np.random.default_rng(7)
    bits = ["a", "@", ".", "b.", "1", "2", "25", "+", "-", " ", "(", ")", "é", "4111 1111 1111 1111", "99", ".1", "٣"]
    for _ in range(8000):
        text = "".join(draw.choice(bits, draw.integers(0, 40)))
        assert sorted((a, k, b) for k, a, b, c in pii.find(text) if pii.features(c)[3]) == brute_spans(text)


def test_pii_report(docs, texts):
    for r in pii.pii_report(docs).collect():
        base = brute_spans(texts[r["doc_id"]] or "")
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in base) for j in range(4)]
        assert set(shown.split(",")) <= set(r["spans"].split(",")) or not base


def test_classifier_takes_what_labelers_agree_on(spark):
    texts = ["call my phone +1 (521) 555-2373 now", "phone: 521-555-2373 please", "write to a.b [at] mail [dot] com", "order id 4952935900253051 and version 1.2.3.400"] * 30
    rows = pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["spans"] == "" for r in rows if r["doc_id"] % 4 == 3)
    assert all("phone" in r["spans"] for r in rows if r["doc_id"] % 4 == 0)
    clean = pii.redact(spark.createDataFrame([(1, texts[0], 0)], "doc_id long, text string, n_chars long")).first()
    assert clean["text"] == "call my phone <PHONE> now" and clean["n_chars"] == len(clean["text"])


def test_planted_spans_are_added_and_decoys_are_not(spark, texts):
    """Personal data without a base form, planted among the corpus, and numbers of the same form that are none."""
    draw = np.random.default_rng(12)
    digits = lambda n: "".join(map(str, draw.integers(2, 9, n)))
    made, truth = [], {}
    plain = [t[:300] for t in texts.values() if t]
    for k in range(600):
        number = f"{digits(3)}-{digits(3)}-{digits(4)}"
        mail = f"{draw.choice(['anna', 'b.kovac', 'li_wei', 'x99'])}{digits(2)} [at] {draw.choice(['mail', 'my-post', 'web'])} [dot] {draw.choice(['com', 'org', 'de'])}"
        span, lead, kind, good = [
            (number, draw.choice(["call my phone", "Tel", "mobile", "fax"]) + " ", "phone", True),
            (mail, draw.choice(["write to", "email", "contact"]) + " ", "email", True),
            (number, draw.choice(["invoice", "order", "serial", "token"]) + " ", "phone", False),
            ("4" + digits(15), draw.choice(["checksum", "build", "id"]) + " ", "card", False),
        ][k % 4]
        if kind == "card" and pii.luhn(span):
            continue
        head = plain[k % len(plain)].rsplit(" ", 1)[0].rstrip("+0123456789 .-") + ". " + lead
        made.append((k, head + span + " for more."))
        truth[k] = (f"{kind}:{len(head)}:{len(head) + len(span)}", good)
    rows = {r["doc_id"]: r["spans"].split(",") for r in pii.pii_report(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    good = [shown in rows[k] for k, (shown, g) in truth.items() if g]
    bad = [shown in rows[k] for k, (shown, g) in truth.items() if not g]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.05


def test_written_addresses_of_any_length_and_case():
    long = "a" * 80
    for text, span in ((f"mail {long} [at] x [dot] com now", f"{long} [at] x [dot] com"), ("bob [At] example [dot] com", "bob [At] example [dot] com"), ("x bob(AT)mail.example.org!", "bob(AT)mail.example.org"), ("p [at] " + "a." * 20 + "de", "p [at] " + "a." * 20 + "de")):
        (found,) = [text[a:b] for k, a, b, _ in pii.find(text) if k == 0]
        assert found == span
    import time

    start = time.time()
    pii.find("a" * 300_000 + " [at] " + "b" * 300_000 + "[at]" * 50_000 + "1" * 200_000 + "+1" * 100_000 + "a@" * 100_000)
    assert time.time() - start < 20


# Chat


def brute_turns(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    return [(r[1] or "", r[2] or "") for r in ordered]


TOKEN = r"[0-9A-Za-z\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]"


def test_chat_odd_tables(spark):
    rows = [(1, 0, "system", "only this", 9, "x"), (2, 0, "user", "word " * 200_000, 9, "x"), (2, 1, "assistant", "so " * 300, 9, "x"), (2, 1, "assistant", "so " * 300, 9, "x"), (3, None, None, None, 9, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, a int, b string").toDF("conv_id", "turn", "role", "text", "Role", "TEXT")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(frame)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 1, 2: 3, 3: 1} and got[2]["loss_chars"] == 1800
    assert got[1]["formatted_chars"] == len("<|im_start|>system\nonly this<|im_end|>\n")


def test_chat_long_conversations_take_linear_time(spark):
    import time

    took = []
    for n in (1000, 20_000, 80_000):
        turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, ' of many') AS text")
        start = time.time()
        (r,) = chat.read_back(chat.format_windows(turns)).collect()
        took.append(time.time() - start)
        assert r["n_turns"] == n
    assert took[2] < 8 * max(took[1], 3)


def test_chat_round_trip(spark):
    draw = np.random.default_rng(8)
    bits = ["a ", "<|im_end|>", "<\\|", "<|im_start|>assistant\nok", "\n", "\\", "é", "word " * 50]
    rows = []
    for conv in range(30):
        for turn in range(draw.integers(1, 40)):
            role = "system" if turn == 0 and conv % 2 else draw.choice(["user", "assistant", "to ol\n"])
            rows.append((conv if conv != 7 else None, turn if turn != 3 else None, str(role) if turn != 5 else None, "".join(draw.choice(bits, draw.integers(0, 12))) if turn != 6 else None))
    rows += rows[:3]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(frame)
    rules, seen = chat.WindowRules(), {}
    for w in sorted(windows.collect(), key=lambda w: w["window"]):
        turns = w["text"].split("<|im_start|>")[1:]
        cost = sum(2 + len(re.findall(TOKEN, t.removesuffix("<|im_end|>\n"))) for t in turns)
        assert cost == w["n_tokens"] and (cost <= rules.budget or len(turns) - w["n_repeated"] == 1)
        assert w["window"] == seen.setdefault(w["conv_id"], 0)  # numbered from 0, each with turns of its own
        seen[w["conv_id"]] += 1
        if w["window"]:
            old = [t.startswith("system\n") for t in turns[:1]]
            past = sum(2 + len(re.findall(TOKEN, t.removesuffix("<|im_end|>\n"))) for t in turns[sum(old) : w["n_repeated"]])
            assert past <= rules.history
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = brute_turns([r[1:] for r in rows if r[0] == conv])
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.read_back(chat.format_windows(frame.where("false"))).count() == 0


def test_chat_is_native(spark):
    plan = queries.QUERIES["op3_budgeted_chat"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Language identification


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    lattice = language_id.Lattice(pieces)
    chance = language_id.normalised(np.random.default_rng(1).random((9, 2)), 0.1)

    def total(word, g):
        if not word:
            return 1.0
        return sum((chance[pieces.index(word[:k]), g] if word[:k] in pieces else chance[8, g] if k == 1 else 0.0) * total(word[k:], g) for k in range(1, min(3, len(word)) + 1))

    words = ["a", "ab", "abba", "bab", "xa", "abab" * 5]
    got = lattice.scores(words, chance)
    assert np.allclose(got, [[np.log(total("▁" + w, g)) for g in (0, 1)] for w in words])
    counts = lattice.expected(words, np.ones((len(words), 2)), chance)
    eps = 1e-6
    for v in (1, 3, 5):
        moved = chance.copy()
        moved[v] *= 1 + eps
        slope = (lattice.scores(words, moved) - got).sum(axis=0) / np.log1p(eps)
        assert np.allclose(slope, counts[v], rtol=1e-3)


def test_long_words_do_not_underflow():
    lattice = language_id.Lattice(["▁", "a", "aa"])
    chance = language_id.normalised(np.ones((5, 2)), 0)
    long, short = lattice.scores(["a" * 3000, "a"], chance)
    assert np.isfinite(long).all() and long[0] < -500 < short[0]


def test_long_words_and_long_pieces_teach(spark):
    pieces = language_id.public_pieces(queries.vocabulary("piece_bpe_32k.model"))
    assert max(map(len, pieces)) > 8
    assert "".join(language_id.word_blocks("日本" * 100, 64)) == "▁" + "日本" * 100 and max(map(len, language_id.word_blocks("日本" * 100, 64))) == 64
    rows = [(k, ("日本語の文章" if k % 2 else "中国的文字") * (40 + k), "ja" if k % 2 else "zh") for k in range(60)] + [(100, "文章の日本", None), (101, "文字中国的", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame, queries.vocabulary("piece_bpe_32k.model")).collect()}
    assert all(got[k] == ("ja" if k % 2 else "zh") for k in range(60)) and (got[100], got[101]) == ("ja", "zh")


def test_expectation_in_spark_equals_one_lattice(spark):
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "abab", "bb"]
    words = ["▁a", "▁abab", "baab", "▁" + "ab" * 20, "▁xa"]
    frame = spark.createDataFrame([(w, [(k % 2, k + 1), (1, 2)] if k % 2 == 0 else [(1, 3)]) for k, w in enumerate(words)], "word string, uses array<struct<tongue:int,n:long>>")
    chance = language_id.normalised(np.random.default_rng(2).random((11, 2)), 0.1)
    counts = np.array([[1, 2], [0, 3], [3, 2], [0, 3], [5, 2]], float)
    assert np.allclose(language_id.piece_sums(frame.repartition(3), pieces, chance), language_id.Lattice(pieces).expected(words, counts, chance, ""))


def test_language_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = queries.QUERIES["op1_language_id"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    expected = {r["doc_id"]: r["x"] for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("x")).collect()}
    assert all(r["held_out"] == expected[r["doc_id"]] for r in rows)


# Language model


def test_lm_gradient_and_learning():
    rules = lm_score.LmRules(hidden=5, rate=0.01, batch=64)
    draw = np.random.default_rng(3)
    network = lm_score.Network(7, rules)
    codes = np.array([7, 7, *draw.integers(0, 7, 300), 7, 7])
    places = np.arange(2, 302)
    for w in network.weights.values():
        w[...] = w.astype(np.float64)
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    _, grads = network.gradients(codes, places)
    for name, w in network.weights.items():
        at = tuple(draw.integers(0, s) for s in w.shape)
        kept = w[at]
        w[at] = kept + 1e-4
        up = network.gradients(codes, places)[0]
        w[at] = kept - 1e-4
        down = network.gradients(codes, places)[0]
        w[at] = kept
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-5)
    cycle = np.array([7, 7, *[k % 7 for k in range(700)], 7, 7])
    learner, state = lm_score.Network(7, rules), {}
    for _ in range(20):
        learner.fit(cycle, np.arange(2, 702), state)
    assert learner.log_probabilities(cycle, np.arange(2, 702)).mean() > -0.2


def test_lm_scores_beat_word_counts(spark, docs):
    rows = lm_score.score(docs).collect()
    n, total = sum(r["n_tokens"] for r in rows), sum(r["log_prob"] for r in rows)
    words = lm_score.count_words(docs, "text", lm_score.LmRules()).words
    known = {w: k for k, w in enumerate(words)}
    counts = Counter(known.get(w, len(words) + lm_score.word_class(w)) for r in docs.collect() for w in (r["text"] or "").lower().encode().split())
    unigram = sum(c * np.log(c / n) for c in counts.values())
    assert sum(counts.values()) == pytest.approx(n, rel=1e-3) and total > unigram


def test_lm_uncommon_words_count(spark):
    common = " ".join(f"w{k}" for k in range(6))
    rows = [(k, f"{common} harbour {common} harbour") for k in range(30)] + [(100, f"{common} harbour {common} harbour"), (101, f"{common} xqzvkpj {common} xqzvkpj"), (102, "Ünder 12 a-b été")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    rules = lm_score.LmRules(words=6, rounds=0)
    got = {}
    for table in (1000, 7, 0):  # counts held by tasks, or joined
        got[table] = {r["doc_id"]: r["log_prob"] for r in lm_score.score(frame, rules=lm_score.LmRules(words=6, rounds=0, table=table)).collect()}
        assert got[table][100] - got[table][101] == pytest.approx(2 * np.log(62 / 2), abs=1e-4)
        assert all(v == pytest.approx(got[1000][k], abs=1e-4) for k, v in got[table].items())
    counted = lm_score.count_words(frame, "text", rules)
    assert set(counted.words) == {w for _, t in rows for w in t.encode().lower().split()}
    for r in lm_score.frequencies(frame, "text", rules).select("word", lm_score.kind().alias("kind")).collect():
        assert r["kind"] == lm_score.word_class(bytes(r["word"]))


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_lm_trains_on_every_place_once(texts, monkeypatch, rounds):
    known = lm_score.Lookup({b"the": 0}, 1, np.zeros(1, np.int32), np.zeros(1))
    size = 1 + lm_score.CLASSES

    def stored(text):
        words, numbers, _ = known.found([(text or "").encode()])
        return lm_score.classes_of(words, numbers, known).astype(lm_score.code_type(size)).tobytes()

    parts = [pa.array([stored(t) for t in list(texts.values())[a : a + 20]], pa.binary()) for a in (0, 20, 40)]
    n = sum(len((t or "").encode().split()) for t in list(texts.values())[:60])
    seen = Counter()

    def noted(self, codes, places, state):
        seen.update((hash(codes.tobytes()), p) for p in places.tolist())

    monkeypatch.setattr(lm_score.Network, "fit", noted)
    counts = [lm_score.train_part(iter(parts), turn, lm_score.Network(size, lm_score.LmRules(rounds=rounds)))[1] for turn in range(rounds)]
    assert sum(counts) == len(seen) == n and set(seen.values()) == {1} and min(counts) > 0


def test_lm_log_probabilities_equal_a_plain_loop(texts):
    """Network, classes and shares of words against loops over places and words."""
    rules = lm_score.LmRules(words=5, hidden=4)
    draw = np.random.default_rng(9)
    bodies = [t.encode()[:400] for t in list(texts.values())[:12] if t]
    counts = Counter(w for b in bodies for w in b.lower().split())
    own = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]]
    known = lm_score.Lookup({w: k for k, w in enumerate(own)}, 5, np.arange(5, dtype=np.int32), np.zeros(5))
    network = lm_score.Network(5 + lm_score.CLASSES, rules, draw.standard_normal(5 + lm_score.CLASSES))
    words, numbers, sizes = known.found(bodies)
    codes, places = lm_score.coded(lm_score.classes_of(words, numbers, known), sizes, network.size, rules)
    got = network.log_probabilities(codes, places, step=7)
    code = lambda w: own.index(w) if w in own else 5 + lm_score.word_class(w)
    weights, at = {k: v.astype(float) for k, v in network.weights.items()}, 0
    for body in bodies:
        line = [code(w) for w in body.lower().split()]
        for k in range(len(line)):
            hidden = weights["inner"].copy()
            for j, d in enumerate((-2, -1, 1, 2)):
                hidden += weights["place"][j][line[k + d] if 0 <= k + d < len(line) else 5 + lm_score.CLASSES]
            logits = np.tanh(hidden) @ weights["out"] + weights["bias"]
            assert got[at] == pytest.approx(logits[line[k]] - np.log(np.exp(logits).sum()), abs=1e-3)
            at += 1
    assert at == len(got)


def test_lm_very_unlikely_words_keep_their_score():
    network = lm_score.Network(7, lm_score.LmRules(), np.array([0, 0, 0, 0, 0, 0, 300.0]))
    codes = np.array([7, 7, 1, 2, 6, 7, 7])
    got = network.log_probabilities(codes, np.array([2, 3, 4]))
    assert got[0] == pytest.approx(-300, abs=5) and got[1] == pytest.approx(-300, abs=5) and got[2] == pytest.approx(0, abs=1e-3)


# Licences


def recognised(text):
    return license_scan.licences(license_scan.sentence_ids(text))


def test_licences():
    text = "Intro words.\nLicensed under the Apache License,\nVersion 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\nhttp://x\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    found = [i for *_, i in license_scan.sentence_ids(text)]
    assert found[1:] == ["apache-may", "apache-copy", "apache-asis"] and recognised(text) == ["Apache-2.0"]
    for name, wanted in license_scan.RULES:
        if not wanted[0].startswith("named-"):
            body = "\n".join(license_scan.SENTENCES[w][0].replace("*", "the University of Somewhere, Inc.") for w in wanted)
            assert recognised("Some words.\n" + body + "\nMore words.") == [name]
    assert license_scan.sentence_ids("This text is licensed to nobody. MIT is a school.") == []
    reverse = "\n".join(license_scan.SENTENCES[w][0] for w in ("mit-notice", "mit-grant"))
    assert recognised(reverse) == []


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("// SPDX-License-Identifier: MIT", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
        ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", ["Apache-2.0", "MIT"]),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", ["GPL-2.0"]),
        ("This project is licensed under the MIT License. See the file.", ["MIT"]),
        ("Released under the terms of the GNU Lesser General\nPublic License, version 2.1.", ["LGPL-2.1"]),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
        ("This software is distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("The MIT License is a licence that many know.", []),
        ("Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", []),
    ],
)
def test_named_licences(text, wanted):
    assert recognised("Before it.\n" + text + "\nAfter it.") == wanted


def test_a_holder_of_any_name():
    body = [license_scan.SENTENCES[w][0] for w in ("bsd-grant", "bsd-source", "bsd-binary")]
    assert recognised("\n * ".join([*body, "Neither the name of Google Inc. nor the names of its\n * contributors may be used to endorse or promote products derived from\n * this software without specific prior written permission."])) == ["BSD-3-Clause"]
    assert recognised("\n".join(body)) == ["BSD-2-Clause"]


def brute_licences(found, gap):
    """All choices of sentences for a rule, longest rules first, each taking the first that is left."""
    used, out = set(), set()
    for name, wanted in sorted(license_scan.RULES, key=lambda r: (-len(r[1]), r)):
        start = 0
        while start < len(found):
            chain = [start] if start not in used and found[start][2] == wanted[0] else []
            for want in wanted[1:]:
                nearest = [k for k in range(chain[-1] + 1, len(found)) if found[k][2] == want and k not in used][:1] if chain else []
                chain = chain + nearest if nearest and len(range(found[chain[-1]][1], found[nearest[0]][0])) <= gap else []
            if chain:
                out.add(name)
                used.update(chain)
            start += 1
    return sorted(out)


def test_licences_by_brute_force_and_gap():
    draw = np.random.default_rng(3)
    names = [w for _, wanted in license_scan.RULES for w in wanted if not w.startswith("named-")]
    others = ["Some other words.", "Nothing of note here!", "What is it?"]
    for _ in range(300):
        kinds = [str(draw.choice(names)) if draw.random() < 0.5 else "" for _ in range(draw.integers(1, 40))]
        lines = [license_scan.SENTENCES[k][0].replace("*", "Some Body") if k else str(draw.choice(others)) for k in kinds]
        ids = license_scan.sentence_ids("\n".join(lines))
        assert [i for *_, i in ids] == [k for k in kinds if k]
        assert license_scan.licences(ids) == brute_licences(ids, 6)
    for n, wanted in ((6, ["MIT"]), (7, [])):
        text = "\n".join([license_scan.SENTENCES["mit-grant"][0], *["Other words."] * n, license_scan.SENTENCES["mit-notice"][0]])
        assert recognised(text) == wanted


# Pages


def test_pages_like_a_plain_reading(spark):
    pages = pq.read_table(f"{SMALL}/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in queries.QUERIES["op10_host_paths"](spark, SMALL).collect()}
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|ul|li|br|table|tr|td|div)[^>]*>", body)]
        wanted = "\n".join(x for x in blocks if x)
        assert got[p["page_id"]]["text"] == wanted and got[p["page_id"]]["n_chars"] == len(wanted)


PAGE = """<html><head><title>t</title></head><body><header>Site name</header><div class="top-nav"><a href=1>Home</a></div>
<div id="wrap"><div class="post9"><h1>T&eacute;st &amp; more</h1><p>One <b>two</b>   three<p>Four{extra}</p><ul><li>a<li>b</ul><form>ask</form><div class="ad">buy</div></div>
<div class="comments"><p>reader says hello here</p></div></div><aside>side</aside><footer>foot</footer><script>var a="</p>";</script></body></html>"""


def test_page_parts_and_votes(spark):
    long = " word" * 40
    rows = [(k, "http://h.example/x", PAGE.replace("{extra}", long)) for k in range(3)] + [(9, None, None), (10, "bad url", ""), (11, "http://h.example/y", "<p>alone < & there")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Tést & more\nOne two three\nFour" + long + "\na\nb"
    assert got[9] == got[10] == "" and got[11] == "alone < & there"
    far = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_hosts=0)
    assert {r["page_id"]: r["text"] for r in far.collect()} == got


def test_broken_and_deep_pages():
    assert html_extract.main_text("<div>" * 3000 + "deep" + '<a href="x', None) == "deep"
    assert html_extract.main_text('<p title="a > b">x</p><p>"y', None) == 'x\n"y'
    html_extract.main_text("<a b='" * 2000, None)


LAYOUTS = [
    '<div class="page with-sidebar"><div class="menu"><a href=1>Home</a></div><div class="content"><h1>T</h1><p>{p}</p></div><div class="sidebar"><p>Look here</p></div></div>',
    '<table><tr><td class="nav"><a href=1>Home</a><td class="main"><h1>T</h1><p>{p}</table><div class="copyright footer">all mine</div>',
    '<div id="masthead">Site</div><main><article class="post"><header><h1>T</h1></header><div class="entry"><p>{p}</p><div class="share-bar">Share</div></div><footer>tags</footer></article><ol class="commentlist"><li>{p}</li></ol></main>',
    '<header><h1>Site name</h1></header><section class="body"><h1>T</h1><p>{p}</p></section><div role="complementary"><p>more</p></div><div hidden><p>secret</p></div><div class="cookie-notice"><p>We use cookies</p></div>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    words = "It was a long and quiet day at the river. " * 5
    assert html_extract.main_text(f"<html><body>{layout.replace('{p}', words)}</body></html>", None) == "T\n" + words.strip()


def test_optional_tags_hidden_words_and_many_open_quotes():
    words = "It was a long and quiet day at the river. " * 5
    assert html_extract.main_text(f"<html><head><meta charset=utf-8><title>t</title><body><h1>T</h1><p>{words}</body></html>", None) == "T\n" + words.strip()
    assert html_extract.main_text(f"<head><title>t</title><link rel=x><div><p>{words}</div>", None) == words.strip()
    assert html_extract.main_text(f"<head><title>t</title>plain {words}", None) == "plain " + words.strip()
    for shown in ('title="The hidden gem"', "data-title='A hidden life'", 'alt="display: none"', "title=hidden", "data-hidden"):
        assert html_extract.main_text(f"<div {shown}><p>{words}</p></div>", None) == words.strip()
    for gone in ("hidden", 'class="a" hidden', 'hidden=""', "hidden=until-found", 'style="color:red; display : none"'):
        assert html_extract.main_text(f"<p>{words}</p><div {gone}><p>secret</p></div>", None) == words.strip()
    page = "<p>x" + "<i a='>" * 6 + '</i><p><b title="a > b">y</b>'
    assert html_extract.main_text(page, None) == "x\ny"


def test_many_open_quotes_take_linear_time():
    import time

    start = time.time()
    html_extract.main_text("<img b='c\" d=\"" * 100_000, None)
    html_extract.main_text("<img b='" * 100_001, None)
    html_extract.main_text("<img b=\"'>\" '" * 50_001, None)
    html_extract.main_text("<img b='>\"'>" * 50_001 + '"', None)
    assert time.time() - start < 20


def test_no_article_text_is_left_outside():
    words = "It was a long and quiet day at the river. " * 20
    page = f'<body><div class="post"><h1><a href=x>Title</a></h1><p>lead</p><div class="entry"><p>{words}</p></div><p>The end.</p></div><footer>foot</footer></body>'
    assert html_extract.main_text(page, None) == f"Title\nlead\n{words.strip()}\nThe end."
    assert html_extract.vote(page) == [("html/body/div.post", 0, 0)]
    assert html_extract.main_text(page, "html/body/div.post/div.entry") == f"Title\nlead\n{words.strip()}\nThe end."
    header = f'<body><div class="post"><header><h1>Title</h1></header><div class="entry"><p>{words}</p></div></div></body>'
    assert html_extract.main_text(header, None) == f"Title\n{words.strip()}"
    parts = f'<body><div id=w><div class="part1"><p>{words}</p></div><div class="part2"><p>Other {words}</p></div></div></body>'
    assert html_extract.main_text(parts, "html/body/div/div.part") == f"{words.strip()}\nOther {words.strip()}"


def test_article_text_that_looks_like_a_frame_stays():
    words = "It was a long and quiet day at the river. " * 5
    for inside in ('<p title="a hidden gem">kept</p>', '<div class="related-work"><p>kept</p></div>', '<div class="reply-to-critics">kept</div>', "<p><math><mi>kept</mi></math></p>", '<div class="ad-hoc">kept</div>', '<p id="respondents">kept</p>'):
        assert html_extract.main_text(f"<body><article><h1>T</h1><p>{words}</p>{inside}</article></body>", None) == f"T\n{words.strip()}\nkept"
    lead = f"<body><header>Site</header><article><header><p>The lead.</p></header><p>{words}</p></article></body>"
    assert html_extract.main_text(lead, None) == f"The lead.\n{words.strip()}"
    for gone in ('<div class="related-posts">x</div>', '<div class="comment-list2">x</div>', '<div id="reply_form">x</div>', '<div class="google-ad">x</div>', '<div class="sponsored">x</div>'):
        assert html_extract.main_text(f"<body><div class=post><h1>T</h1><p>{words}</p>{gone}</div></body>", None) == f"T\n{words.strip()}"


def test_close_tags_take_linear_time():
    import time

    start = time.time()
    for page in ("<span>" * 30_000 + "</i>" * 30_000, "<i><table><td>" + "<span>" * 30_000 + "</i>" * 30_000, "<span>" * 30_000 + "<p>" * 30_000, "<ul>" + "<b>" * 30_000 + "<li>" * 30_000, "<header>" * 3_000 + "x" + "<p>y" * 3_000):
        html_extract.main_text(page, None)
    assert time.time() - start < 30


FURNITURE = '<div class="zq"><p>Our shop is open from nine to five on all days.</p></div>'


def story(k: int, furniture: str = FURNITURE) -> str:
    words = " ".join(f"word{k * 31 + j}" for j in range(60))
    return f"<body><div class=w><div class=story{k}><h1>Title {k}</h1><p>{words}</p></div>{furniture}</div></body>"


def test_the_host_path_gets_right_what_a_page_alone_does_not(spark):
    rows = [(k, "https://h.example/a", story(k)) for k in range(5)]
    rows += [(5, "https://h.example/a", story(5, "")), (6, "https://h.example/a", story(6, "<div class=zq><p>These are the last words of the article.</p></div>"))]
    rows += [(7, "https://h.example/a", story(2)), (8, "https://lone.example/a", story(8)), (9, "https://two.example/", story(9)), (10, "https://two.example/", story(9))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(frame).collect()}
    plain = {k: html_extract.main_text(story(k, ""), None) for k in range(11)}
    alone = html_extract.main_text(story(0), None)
    assert alone.endswith("on all days.") and got[0] == plain[0] and got[0] in alone  # rescued by the host's path
    assert [got[k] for k in range(6)] == [plain[k] for k in range(6)] and got[7] == plain[2]
    assert got[6] == plain[6] + "\nThese are the last words of the article."  # nothing but furniture is left out
    assert got[8] == plain[8] + "\nOur shop is open from nine to five on all days." and got[9] == got[10] != plain[9]  # no evidence


def test_random_pages_without_an_article():
    """Pages made together with the text that should come out."""
    draw = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in draw.integers(0, 999, n))
    frames = ["<nav><ul><li><a href=x>Home</a><li>More</ul></nav>", "<div class=menu><a href=x>Home</a></div>", "<aside><p>Look</p></aside>", '<div class="ad top">Buy</div>', '<div id="cookie-notice"><p>We use them</p></div>', "<form>ask <input></form>", "<script>var x='<p>no</p>'</script>", "<style>p{}</style>", "<div class=comments><p>I say</p></div>", "<!-- <p>no</p> -->"]
    for _ in range(150):
        parts, truth = [f"<h1>{(title := word(4))}</h1>"], [title]
        for _ in range(draw.integers(2, 9)):
            kind, a, b = draw.integers(0, 7), word(draw.integers(3, 30)), word(draw.integers(1, 9))
            made = [(f"<p>{a}", [a]), (f"<p>{a} <b>{b}</b>&amp;</p>", [f"{a} {b}&"]), (f"<ul><li>{a}<li>{b}</ul>", [a, b]), (f"<blockquote><p>{a}</blockquote>", [a]), (f"<div class=part><h2>{b}</h2><p>{a}</div>", [b, a]), (f"<table><tr><td>{a}<td>{b}</table>", [a, b]), (f"<div class=related-work><pre>{a}\n{b}</pre></div>", [f"{a} {b}"])][kind]
            parts.append(made[0])
            truth += made[1]
            if draw.random() < 0.3:
                parts.append(str(draw.choice(frames)))
        body = "\n".join(parts)
        for k in range(draw.integers(0, 4)):
            outside = [str(draw.choice(frames)), str(draw.choice(frames))]
            tag = ["div", "section", "main"][draw.integers(0, 2 + (k == 0))]
            body = f"{outside[0]}<{tag} class=c{k}>{body}</{tag}>{outside[1]}"
        head = ["<!doctype html><head><title>t</title>", "<html><head><title>t</title></head>", ""][draw.integers(0, 3)]
        assert html_extract.main_text(f"{head}<body><header>Site</header>{body}<footer>foot</footer></body>", None) == "\n".join(truth)


def test_odd_tables_of_pages(spark):
    long = "<body><article><h1>T</h1>" + "<p>many words</p>" * 60_000 + "</article></body>"
    rows = [(1, "http://a.b/", "<p>x</p>", "n", 3), (1, "http://a.b/", "<p>x</p>", "n", 3), (None, None, long, None, 4), (3, "u", None, "n", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, HTML2 int").toDF("page_id", "url", "html", "host", "HTML")
    got = html_extract.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1 + 60_000 * 11), (1, 1), (1, 1), (3, 0)]
    assert html_extract.extract(pages.where("false")).count() == 0
