"""The corpus pipeline: its stages work on what the one before kept, and their decisions take effect."""

from __future__ import annotations

import random

import corpus_pipeline
from millrace.llm.bpe import default_vocabulary

from .brute import jaccard_components
from .test_operators import edited_lines, removed_lines

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == columns, name
        out = out.cache()
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left and left <= ids, name
        docs, ids = out, left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.text for r in last.collect()} == texts


def test_vocabulary_is_outside():
    assert "/repo/" not in str(default_vocabulary())


def test_join_against_brute_force(spark):
    """The stage keeps the smallest id of each group of 5-word Jaccard 0.8 or more."""
    r = random.Random(3)
    docs = []
    for i in range(12):
        text = [f"w{r.randrange(10**6)}" for _ in range(200)]
        near = list(text)
        for k in range(i):  # scattered; 1 to 4 of them leave 0.8 or more
            near[10 + 16 * k] = f"x{i}y{k}"
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
    want = jaccard_components(docs, gram=5, percent=80)
    assert {d: c for d, (_, c) in want.items()} != {d: c for d, (_, c) in jaccard_components(docs).items()}
    out = corpus_pipeline.ngram_join(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in out.collect()} == {c for _, c in want.values()}


def test_lines_and_join_against_brute_force(spark):
    docs = [(d, "\n".join(x for x in t.split("\n") if x.count(" ") > 3)) for d, t in edited_lines()]
    lines = spark.createDataFrame([(d, t, len(t)) for d, t in docs], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.line_dedup(spark, lines, "").cache()
    gone = removed_lines(docs, 5)
    left = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in docs}
    left = {d: t for d, t in left.items() if t.strip() or not gone[d]}
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {d: (t, len(t)) for d, t in left.items()}
    kept = {c for _, c in jaccard_components(list(left.items()), gram=5, percent=80).values()}
    assert {r.doc_id for r in corpus_pipeline.ngram_join(spark, out, "").collect()} == kept
