"""The operators against plain statements of their results, on small tables with awkward rows."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm.automaton import op8_suffix_automata
from millrace.llm.bpe import decode, default_vocabulary, encode, op10_bpe
from millrace.llm.clusters import linked
from millrace.llm.exactdedup import op5_content_sort_dedup
from millrace.llm.langid import op7_nearest_centroid
from millrace.llm.linededup import dedup_lines, op1_fuzzy_lines
from millrace.llm.mixing import mix_rows, op9_mix_to_targets, rake
from millrace.llm.ngramjoin import jaccard_groups, op2_ngram_jaccard
from millrace.llm.quality import op4_decision_list
from millrace.llm.sharding import assign_shards, op3_rendezvous_shards
from millrace.llm.suffixdedup import op6_suffix_dedup
from millrace.llm.workspace import Workspace

from .brute import WORD, distance, jaccard_components, normal_line, repeated_bytes, repeated_words, sha

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ALL = [op1_fuzzy_lines, op2_ngram_jaccard, op3_rendezvous_shards, op4_decision_list, op5_content_sort_dedup, op6_suffix_dedup, op7_nearest_centroid, op8_suffix_automata, op9_mix_to_targets, op10_bpe]


def corpus() -> list[tuple]:
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts: list = [" ".join(r.choice(words) for _ in range(r.randint(12, 120))) for _ in range(24)]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts += [f"{texts[0]} {passage}", f"{passage}\n{texts[1]}", f"é {passage} x"]
    near = texts[2].split(" ")
    near[-1] = "changed"
    texts += [" ".join(near), texts[3], texts[3].replace(" ", "\t\n"), texts[3], texts[2].upper()]
    texts += [None, "", " \t\n", "one", "one two", "\x1c\x85 odd spaces", "a " * 300, "ß" * 400, "#$ |" * 50, " ".join(r.choice(words) for _ in range(20_000))]
    return [(i * 3, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    return written(spark, rows, tmp_path_factory.mktemp("small"))


def written(spark, rows, path) -> str:
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(bool(t) and "#" not in t), 0) for d, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def pairs(rows):
    return [(d, t) for d, t, *_ in rows]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("query", ALL, ids=lambda q: q.__name__)
def test_one_row_a_document(spark, folder, rows, query):
    assert sorted(r.doc_id for r in query(spark, folder).collect()) == [d for d, *_ in rows]


@pytest.mark.parametrize("query", ALL, ids=lambda q: q.__name__)
def test_empty_table(spark, tmp_path, query):
    assert query(spark, written(spark, [], tmp_path)).count() == 0


def test_jaccard(spark, folder, rows):
    assert by_id(op2_ngram_jaccard(spark, folder), "n_shingles", "component_id") == jaccard_components(pairs(rows))


def test_jaccard_of_all_pairs(spark):
    """Driver's documents at sf0.01, with their near copies, against all pairs."""
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert by_id(op2_ngram_jaccard(spark, folder), "n_shingles", "component_id") == jaccard_components(docs)


def test_groups_need_no_centre(spark):
    """Items in a chain under one key: no pivot links to all, and the rounds must find every link."""
    n = 300
    keys = spark.range(n).selectExpr("0L AS col", "id AS node", "10L AS size", "10L AS room", "0L AS weight")
    groups, links = linked(Workspace(spark, "chain"), keys, lambda pairs: pairs.where("b - a <= 1 AND b <> 100"), 80)
    assert {r.node: r.component for r in groups.collect()} == {k: 0 if k < 100 else 100 for k in range(n)}
    assert links.count() == n - 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one line of some six words", 7, "a", 0), (2, "one line of some six words", 8, None, 1)], "doc_id long, text string, part int, n_lines string, item int")
    got = dedup_lines(df)
    assert {(r.doc_id, r.text, r.part, r.item, r.n_lines) for r in got.collect()} == {(1, "one line of some six words", 7, 0, 1), (2, "", 8, 1, 1)}


def test_bytes_that_repeat(spark, folder, rows):
    assert by_id(op6_suffix_dedup(spark, folder), "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeated_bytes(pairs(rows))


def test_words_that_repeat(spark, folder, rows):
    assert by_id(op8_suffix_automata(spark, folder), "n_words", "n_removed", "kept_sha256") == repeated_words(pairs(rows))


def test_exact(spark, folder, rows):
    norm = {d: " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", t or "")) for d, t in pairs(rows)}
    groups: dict = {}
    for d, n in norm.items():
        groups.setdefault(n, []).append(d)
    want = {d: (min(groups[n]), len(groups[n]), d == min(groups[n]), sha(n.encode())) for d, n in norm.items()}
    assert by_id(op5_content_sort_dedup(spark, folder), "keep_id", "group_size", "kept", "text_sha256") == want


def test_shards(spark, folder, rows):
    got = by_id(op3_rendezvous_shards(spark, folder), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    slots: dict = {}
    for d, t in pairs(rows):
        size, crc, law, shard, slot, grown = got[d]
        assert (size, crc, law) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key")
        assert 0 <= shard < 40 and grown in (shard, 40)
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    count = {r["shard"]: r["count"] for r in assign_shards(df, shards=3, weights=[1, 1, 2]).groupBy("shard").count().collect()}
    assert abs(count[2] / 20_000 - 0.5) < 0.02 and abs(count[0] / 20_000 - 0.25) < 0.02


def test_quality(spark, folder, rows):
    got = by_id(op4_decision_list(spark, folder), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, t in pairs(rows):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = {x for x in windows if windows.count(x) > 1} if len(w) < 1000 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
        covered = {k for i, x in enumerate(windows) if x in often for k in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in t)
        assert got[d][:6] == (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and got[d][6])


def test_bpe(spark, folder, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(default_vocabulary()))
    tok.no_truncation()
    tok.no_padding()
    got = by_id(op10_bpe(spark, folder), "n_tokens", "ids_sha256", "decoded_sha256")
    for d, t in pairs(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert got[d] == (len(ids), sha(raw), sha(tok.decode(ids, skip_special_tokens=False).encode()))


def test_bpe_round_trip(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text IS NOT NULL")
    back = by_id(decode(encode(docs, default_vocabulary()), default_vocabulary()), "text")
    assert back == {d: (t,) for d, t in pairs(rows) if t is not None}


def test_lines(spark):
    first = "the quick brown fox jumps over the lazy dog near the old river bank today"
    close = first.replace("today", "tonight")
    docs = [(1, f"{first}\nshort line\nsome other text that stands here alone"), (2, f"{close}\nshort line"), (3, None), (4, ""), (5, first.upper() + "!\nkeep this line of words as it is")]
    assert distance(normal_line(first), normal_line(close)) == 1
    got = by_id(dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")), "text", "removed")
    assert got[1] == (docs[0][1], [])
    assert got[2][0] == "short line"
    assert got[3][0] is None and got[4][0] == ""
    assert got[5][0] == "keep this line of words as it is"


def test_mix_holds_marginals(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100), ("a", "y", "t", 300), ("b", "x", "t", 50), ("b", "y", "t", 50)], "source string, lang string, topic string, n_tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"t": 1.0}}
    got = rake(cells, targets).groupBy("source").agg(F.sum("weight").alias("w"))
    assert all(abs(r.w - 0.5) < 1e-6 for r in got.collect())


def test_mix_takes_its_share(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'a b c d' AS text", "concat('s', id % 2) AS source", "'en' AS lang")
    got = mix_rows(df, share=0.5).where("sampled").count()
    assert abs(got / 4000 - 0.5) < 0.05


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = op7_nearest_centroid(spark, folder).where("held_out AND lang_pred <> 'und'").join(docs, "doc_id").where("lang IS NOT NULL")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("share")).first()
    assert r["share"] > 0.9


def removed_lines(docs: list[tuple], least_words: int, percent: int = 80) -> dict:
    """doc -> numbers of the lines that go, by all pairs of lines."""
    lines = [(d, k, [w for w in normal_line(x) if w]) for d, t in sorted(docs) for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least_words]
    up = list(range(len(lines)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, _, a) in enumerate(lines):
        for j, (_, _, b) in enumerate(lines[:i]):
            longer = max(len(a), len(b))
            if 100 * min(len(a), len(b)) >= percent * longer and 100 * (longer - distance(a, b)) >= percent * longer:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    out: dict = {d: [] for d, _ in docs}
    for i, (d, k, _) in enumerate(lines):
        if top(i) != i:
            out[d].append(k)
    return out


def edited_lines() -> list[tuple]:
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(2000)]
    texts = []
    for n in [5, 6, 8, 10, 12, 15, 16, 17, 19, 20, 21, 24, 25, 30, 35, 40, 41, 49, 50, 52, 60, 63, 100] * 2:
        line = [r.choice(words) for _ in range(n)]
        near = list(line)
        for _ in range(n // 5):  # scattered edits of each kind
            x = r.randrange(len(near))
            near[x : x + 1] = r.choice(([r.choice(words)], [r.choice(words)], [], [near[x], r.choice(words)]))
        texts += [" ".join(line), " ".join(near)]
    r.shuffle(texts)
    return [(i, "\n".join(texts[i::20])) for i in range(20)]


def test_lines_of_all_pairs(spark):
    docs = edited_lines()
    want = removed_lines(docs, 5)
    assert sum(map(len, want.values())) > 25
    got = by_id(dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")), "removed")
    assert {d: x[0] for d, x in got.items()} == want


def test_short_lines(spark, tmp_path):
    """Lines of few words go too, and lines of scripts without spaces count characters."""
    han = "今天天气很好我们一起去公园散步吧"
    near = han.replace("公", "花")
    docs = [(0, f"menu\nabout us\none two three four\n{han}\n---"), (1, f"Menu\nabout us!\none two three four five\n{near}\n---\nabout me"), (2, "the menu\nพิพิธภัณฑ์สถาน"), (3, "พิพิธภัณฑ์สถาณ\nมาก\nมาย")]
    written(spark, [(d, t, "en", "s", len(t)) for d, t in docs], tmp_path)
    got = by_id(op1_fuzzy_lines(spark, str(tmp_path)), "removed")
    assert {d: x[0] for d, x in got.items()} == {0: [], 1: [0, 1, 2, 3], 2: [], 3: [0]}
    lines = edited_lines() + [(20, "one\ntwo words\nthree words here"), (21, "three words there\ntwo words\none\nthree words here")]
    got = by_id(dedup_lines(spark.createDataFrame(lines, "doc_id long, text string"), least_words=1), "removed")
    assert {d: x[0] for d, x in got.items()} == removed_lines(lines, 1)


def test_links_are_counted_in_full(spark, monkeypatch):
    """Every pair of different texts that links counts, also where the component needed no more links, across blocks too."""
    monkeypatch.setattr("millrace.llm.ngramjoin.BLOCK", 16, raising=False)
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(1, 60):
        near = list(base)
        for _ in range(1 + i % 3):
            near[r.randrange(150)] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(near)))
    docs += [(60, docs[0][1]), (61, "some other text that links with none"), (62, "one pair of texts " * 3 + "a b c " * 20), (63, "x one pair of texts " * 1 + "one pair of texts " * 2 + "a b c " * 20)]
    sets = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for d, t in docs for w in [t.split()]}
    distinct = {frozenset(x) for x in sets.values()}
    want = {d: sum(x != y and 100 * len(x & y) >= 85 * len(x | y) for y in distinct) for d, x in sets.items()}
    assert max(want.values()) > 30 and min(want.values()) == 0
    got = by_id(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")), "n_links")
    assert {d: x[0] for d, x in got.items()} == want
