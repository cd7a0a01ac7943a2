"""Defined cases of the operators: collisions of simple hashes, repeated and null ids, names that clash, hot texts, and engines that find nothing."""

from __future__ import annotations

import collections
import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import automaton, kernel, suffixdedup
from millrace.llm.bpe import default_vocabulary, digests
from millrace.llm.exactdedup import exact_groups
from millrace.llm.langid import predict, train
from millrace.llm.linededup import dedup_lines, edit_distance
from millrace.llm.mixing import mix_rows, rake
from millrace.llm.ngramjoin import jaccard_groups
from millrace.llm.quality import Condition, Rule, judge, learn
from millrace.llm.sharding import assign_shards, number_slots

from .brute import normal_line, repeated_bytes, repeated_words
from .test_operators import by_id, corpus

TEXTS = "doc_id long, text string"


def thue_morse(n: int = 10) -> tuple[str, str]:
    """Two texts of the same letters that a polynomial modulo a power of two cannot tell apart, whatever its base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def docs_of(spark, rows):
    return spark.createDataFrame(rows, TEXTS)


def test_words_that_a_simple_hash_confuses(spark):
    a, b = thue_morse()
    groups = by_id(jaccard_groups(docs_of(spark, [(1, a), (2, b)])), "component_id")
    assert groups == {1: (1,), 2: (2,)}
    shared = " ".join(f"w{k}" for k in range(19))
    got = by_id(automaton.remove_repeated_words(docs_of(spark, [(1, f"{shared} {a}"), (2, f"{shared} {b}")])), "n_removed")
    assert got == {1: (0,), 2: (0,)}
    # lines of such words are hashed by the words' hashes
    p = kernel.prefix_of_hashes(np.array([5 if c == "a" else 9 for c in a + b], np.uint64))
    h = kernel.span_hash(p, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1]
    got = by_id(suffixdedup.remove_repeated_bytes(docs_of(spark, [(1, a[:64] + "1" * 60), (2, b[:64] + "2" * 60)])), "n_removed")
    want = {d: (x[1],) for d, x in repeated_bytes([(1, a[:64] + "1" * 60), (2, b[:64] + "2" * 60)]).items()}
    assert got == want


@pytest.mark.parametrize("module", [suffixdedup, automaton], ids=["suffix array", "suffix automaton"])
def test_without_the_engine_nothing_goes(spark, monkeypatch, module):
    """The engine names every window that goes: if it finds no two alike, nothing does, copies of whole documents included."""
    count = module._windows(20 if module is automaton else 50)
    monkeypatch.setattr(module, "_engine", lambda window: lambda data, size: np.arange(int(count(data, size).sum())))
    remove = module.remove_repeated_words if module is automaton else module.remove_repeated_bytes
    df = docs_of(spark, [(d, t) for d, t, *_ in corpus()] * 2)
    assert remove(df, hot_entries=2).agg(F.sum("n_removed")).first()[0] == 0


def test_windows_with_repeated_and_null_ids(spark):
    """Rows of one id count as one document, in the order of their texts; a null id as the last."""
    r = random.Random(2)
    words = [f"w{k}" for k in range(50)]
    passage = " ".join(r.choice(words) for _ in range(30))
    rows = [(5, passage), (5, f"{passage} end"), (3, f"start {passage}"), (None, passage), (None, None), (9, "")]
    got = automaton.remove_repeated_words(docs_of(spark, rows)).groupBy("doc_id").agg(F.sum("n_removed").alias("n"), F.count("*").alias("rows")).collect()
    assert {(x.doc_id, x.n, x.rows) for x in got} == {(3, 0, 1), (5, 60, 2), (None, 30, 2), (9, 0, 1)}
    got = suffixdedup.remove_repeated_bytes(docs_of(spark, rows)).groupBy("doc_id").agg(F.sum("n_removed").alias("n")).collect()
    assert {(x.doc_id, x.n) for x in got} == {(3, 0), (5, 2 * len(passage)), (None, len(passage)), (9, 0)}


def test_windows_of_hot_anchors(spark):
    """A passage in differing surroundings, dealt by window from two entries on, with many equal copies."""
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    rows = [(k, "".join(r.choice("xyz ") for _ in range(40)) + passage + "".join(r.choice("uvw ") for _ in range(40))) for k in range(60)]
    rows += [(100 + k, rows[7][1]) for k in range(40)]
    got = by_id(suffixdedup.remove_repeated_bytes(docs_of(spark, rows).repartition(7), hot_entries=2), "n_units", "n_removed")
    assert got == {d: x[:2] for d, x in repeated_bytes(rows).items()}
    got = by_id(automaton.remove_repeated_words(docs_of(spark, rows).repartition(7), hot_entries=2), "n_words", "n_removed")
    assert got == {d: x[:2] for d, x in repeated_words(rows).items()}


def removed_by_all_pairs(rows: list[tuple]) -> dict:
    """doc -> numbers of the lines that go: all pairs of distinct lines of fitting size and words are measured."""
    lines = [(d, k, tuple(w for w in normal_line(x) if w)) for d, t in sorted(rows) for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 5]
    distinct = sorted({x[2] for x in lines}, key=len)
    counts = [collections.Counter(x) for x in distinct]
    up = list(range(len(distinct)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where: dict = collections.defaultdict(list)
    for i, x in enumerate(distinct):
        common: dict = collections.Counter()
        for w, n in counts[i].items():
            for j, m in where[w]:
                common[j] += min(n, m)
        for j, n in common.items():
            if 100 * n >= 80 * len(x) and 100 * (len(x) - edit_distance(list(x), list(distinct[j]))) >= 80 * len(x):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
        for w, n in counts[i].items():
            where[w].append((i, n))
    group = {x: top(i) for i, x in enumerate(distinct)}
    seen, out = set(), {d: [] for d, _ in rows}
    for d, k, x in lines:
        if group[x] in seen:
            out[d].append(k)
        seen.add(group[x])
    return out


def test_recall_of_lines_against_all_pairs(spark):
    """The driver's documents at sf0.01: nothing goes wrongly, and of what should go nine in ten at the least, copies not counted."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = removed_by_all_pairs(rows)
    got = {d: x[0] for d, x in by_id(dedup_lines(df), "removed").items()}
    wanted, found = ({(d, k) for d, ks in x.items() for k in ks} for x in (want, got))
    seen, copies = set(), set()
    for d, t in sorted(rows):
        for k, x in enumerate((t or "").split("\n")):
            key = tuple(w for w in normal_line(x) if w)
            copies |= {(d, k)} if key in seen else set()
            seen.add(key)
    fuzzy = wanted - copies
    print("lines that should go", len(wanted), "fuzzy", len(fuzzy), "found", len(fuzzy & found), "wrong", len(found - wanted))
    assert len(found - wanted) == 0
    assert len(fuzzy) > 200 and len(fuzzy & found) >= 0.9 * len(fuzzy)


def test_quality_keeps_columns_and_follows_its_rules(spark):
    text = "plain words of a line that is long enough to be judged at all by rules"
    df = spark.createDataFrame([(1, text, "x", True, 7), (2, text.replace(" ", " # "), "y", False, 8), (3, None, None, None, 9)], "doc_id long, text string, n_words string, kept boolean, rule int")
    rules = [Rule((Condition("symbol_share", True, 0.1), Condition("word_length", True, 2.0)), 1, 1.0)]
    got = {r.doc_id: r for r in judge(df, rules).collect()}
    assert [(got[d].n_words, got[d].kept, got[d].rule) for d in (1, 2, 3)] == [("x", True, 7), ("y", False, 8), (None, None, 9)]
    assert [(got[d].judged.kept, got[d].judged.rule, got[d].judged.base_failed) for d in (1, 2, 3)] == [(True, 0, False), (False, 1, False), (False, 0, True)]
    with pytest.raises(ValueError):
        judge(df.withColumnRenamed("rule", "judged"), rules)
    # junk that a threshold tells is found; without labels there are no rules
    r = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(r.choice(words) + (" #" if k % 4 == 0 else "") for _ in range(40))) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(200)] + [(None, 0), (5, None)], "doc_id long, quality int")
    found = learn(docs_of(spark, docs), labels)
    assert found and {x.doc_id for x in judge(docs_of(spark, docs), found).where("NOT judged.kept").collect()} == set(range(0, 200, 4))
    assert learn(docs_of(spark, docs), labels.limit(0)) == []


def test_hot_texts_in_exact_dedup(spark):
    """A text that a third of the rows hold, in several ways of spacing, is dealt over cells and comes out as one group."""
    rows = [(k, "same \t text" if k % 2 else "same text") for k in range(300)] + [(300 + k, f"other {k}") for k in range(500)] + [(None, "same text"), (7, "same text"), (900, None), (901, "")]
    got = exact_groups(docs_of(spark, rows), hot_rows=16)
    hot = got.where("keep_id = 0").agg(F.count("*").alias("n"), F.min("group_size").alias("low"), F.max("group_size").alias("high"), F.count_if("kept").alias("kept")).first()
    assert tuple(hot) == (302, 302, 302, 1)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.where("doc_id >= 900").collect()} == {(900, 900, 2, True), (901, 900, 2, False)}
    assert got.count() == len(rows)


def spark_hash(*values) -> int:
    """Spark's xxhash64 of longs and ints."""
    h = 42
    for v, kind in values:
        h = xxhash.xxh64_intdigest(struct.pack(kind, v), seed=h)
    return h


def test_shards_against_the_law(spark):
    """The best score wins: computed in plain Python; with one shard more rows move into it alone."""
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    score = lambda k, s: -1.0 / math.log(((spark_hash((k, "<q"), (s, "<i"), (20011, "<i")) >> 11) + 0.5) / (1 << 53))
    for r in assign_shards(df, shards=10).collect():
        scores = [score(r.doc_id, s) for s in range(11)]
        now = max(range(10), key=scores.__getitem__)
        assert (r.shard, r.grown_shard) == (now, 10 if scores[10] > scores[now] else now)
    same = spark.createDataFrame([(1, k % 3) for k in range(60)] + [(None, 0)], "doc_id long, x int")
    slots = [r.slot for r in number_slots(assign_shards(same, shards=4)).where("doc_id = 1").collect()]
    assert len(set(slots)) == 60


def test_raking_against_plain_python(spark):
    r = random.Random(3)
    cells = {(s, g, t): r.randint(10, 500) for s in "ab" for g in "xyz" for t in "kl"}
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.2, "y": 0.5, "z": 0.3}, "topic": {"k": 0.4, "l": 0.6}}
    w = {c: float(n) for c, n in cells.items()}
    for _ in range(200):
        for i, name in enumerate(("source", "lang", "topic")):
            for v, share in targets[name].items():
                held = sum(x for c, x in w.items() if c[i] == v)
                for c in w:
                    if c[i] == v:
                        w[c] *= share / held
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, n_tokens long")
    got = rake(df, targets).collect()
    assert all(abs(x.weight - w[x.source, x.lang, x.topic]) < 1e-5 for x in got) and got[0].error < 1e-6
    # marginals that contradict each other: the error is told
    tied = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, n_tokens long")
    assert rake(tied, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}, "topic": {"t": 1.0}}).first().error > 0.5


def test_draws_against_plain_python(spark):
    rows = [(k, "a b c" if k % 7 else None, f"s{k % 3}", "en" if k % 2 else None) for k in range(400)] + [(5, "x y", "s1", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mix_rows(df, share=0.5).collect()
    assert len(got) == len(rows)
    for r in got:
        draw = ((spark_hash((r.doc_id, "<q"), (9001, "<i")) >> 11) + 0.5) / (1 << 53)
        assert r.sampled == (r.n_tokens > 0 and draw < r.prob) and (r.n_tokens > 0) == (r.prob > 0)
    share = sum(r.n_tokens * r.prob for r in got) / sum(r.n_tokens for r in got)
    assert abs(share - 0.5) < 1e-6


def test_every_language_has_its_part(spark):
    """More languages than were once learned at most, and one of them with most of the rows."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    r = random.Random(9)
    rows = []
    for k in range(30):
        own = r.sample(alphabet, 6)
        rows += [(len(rows) + j, " ".join("".join(r.choice(own) for _ in range(5)) for _ in range(30)), f"l{k:02}") for j in range(12 if k else 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df, sample_rows=300)
    assert len(set(model.languages)) == 30
    got = predict(df, model).join(df.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() > 0.9 * len(rows)
    odd = by_id(predict(docs_of(spark, [(1, None), (2, "123 !"), (3, "")]), model), "lang_pred", "score")
    assert set(odd.values()) == {("und", 0.0)}


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (None, text), (4, text), (4, text), (2, None), (2, ""), (None, None)]
    df = docs_of(spark, rows)
    got = jaccard_groups(df).collect()
    assert len(got) == 7 and {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(None, 37, None), (4, 37, 4), (2, 0, 2), (None, 0, None)}
    assert digests(df, default_vocabulary()).count() == 7
    lines = dedup_lines(df).collect()
    assert len(lines) == 7 and {r.doc_id for r in lines if r.n_removed} == {None}


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Null, empty, long, repeated and clashing input goes through every stage."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(900)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(20)]
    texts += [None, "", texts[0], texts[1] + " more", " ".join(r.choice(words) for _ in range(30_000)), "ß " * 30]
    rows = [(k, t, "en", "s", len(t or ""), f"keep{k}", k % 2 == 0) for k, t in enumerate(texts)] + [(3, texts[3], None, None, 1, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, judged string, kept boolean")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns, name
        docs = out.cache()
        assert docs.count() > 0, name
    assert {x.doc_id for x in docs.collect()} <= set(range(len(texts)))
