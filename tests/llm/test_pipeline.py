"""The five stages against plain code."""

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from fairlead.llm import pii, quality, queries

from ..conftest import SMALL
from .test_operators import brute_classes, brute_contamination, brute_fingerprint


def plain(rows, items):
    """rows: (doc_id, text)."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.vocabulary())
    tool.no_truncation(), tool.no_padding()
    texts = [t.encode() for _, t in rows]
    *_, kept, _, left = quality.judge(texts, [len(t) for _, t in rows], quality.QualityRules(), True)
    rows = [(i, t.decode()) for (i, _), t, k in zip(rows, left, kept) if k]
    classes = brute_classes([(i, brute_fingerprint(t)) for i, t in rows])
    rows = [(i, t) for i, t in rows if classes[i] == i]
    rows = [(i, t) for i, t in rows if not brute_contamination(t, items)[1]]
    rules = pii.SpanRules()
    counts, spans = {}, {}
    for _, t in rows:
        for *_, code, places in pii.described(t, rules):
            counts[code] = counts.get(code, 0) + 1
            spans[code, tuple(places)] = spans.get((code, tuple(places)), 0) + 1
    theta = pii.train(counts, [(c, list(p), n) for (c, p), n in spans.items()], rules)
    out = {}
    for i, t in rows:
        clean = pii.masked(t, pii.taken(pii.described(t, rules), theta, rules))
        ids = tool.encode(clean, add_special_tokens=False).ids
        out[i] = (ids, tool.decode(ids, skip_special_tokens=False))
    return out


def test_run(spark):
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    wanted = plain([(d["doc_id"], d["text"] or "") for d in docs], items)
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == wanted and 0 < len(got) < len(docs)


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "de", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        stage(spark, docs, SMALL).collect()
        assert stage(spark, docs.where("false"), SMALL).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 2
    assert np.all([callable(f) for _, f in corpus_pipeline.STAGES])
