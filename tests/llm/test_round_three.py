"""Fingerprints, delta Lloyd and spelling variants against plain statements of their results, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprint as fp
from millrace.llm import lloyd, spelling
from millrace.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, next string, sketch int, __key int"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def hashes(text: str | None) -> set[str]:
    words = WORDS.findall(text or "")
    return {hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(words) - 4))} if words else set()


def sketched(text: str | None, least: int = 16, share: int = 8) -> tuple[bool, list[str]]:
    h = sorted(hashes(text))
    low = [x for x in h if int(x, 16) < 2**64 // share]
    kept = h[: max(least, len(low))]
    return len(kept) == len(h), kept


def near(a: tuple, b: tuple) -> tuple[float, float]:
    top = [2.0**65 if whole else max(2**64 // 8 - 1, int(h[-1], 16)) for whole, h in (a, b)]
    x, y = ({h for h in s[1] if int(h, 16) <= min(top)} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0, len(x & y) / len(x) if x else 1.0


def told(s: tuple) -> str:
    return ("w" if s[0] else "p") + "".join(s[1])


def texts() -> list:
    r = random.Random(11)
    some = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 400))) for _ in range(40)]
    return [*some, some[3], some[3] + " z", None, "", " \t", "one", "ßé one two three", "x", "🙂🙂🙂 a", " ".join(str(k % 700) for k in range(60_000))]


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 4)
    rows = [(i * 7 - 30, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(d, t, "next", 1, 2) for d, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in fp.fingerprints(df).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        text, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = sketched(text), sketched(edited), sketched(after)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (told(own), told(other))
        assert (r["near_edited"], r["within_edited"]) == near(own, other)
        assert (r["near_next"], r["within_next"]) == near(own, following)


def test_fingerprints_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 2)
    schema = "doc_id long, text string"
    assert fp.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = fp.fingerprints(spark.createDataFrame([(5, "a b c d")], schema)).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()
    rows = [(None, "n o p")] * 30 + [(None, None), (1, "a b"), (1, "a b"), (1, "c d"), (2, "e")]
    assert fp.fingerprints(spark.createDataFrame(rows, schema)).count() == len(rows)
    copies = fp.fingerprints(spark.createDataFrame(rows, schema)).where("doc_id IS NULL AND n_chars = 5")
    assert copies.where("near_next = 1").count() >= 29


def test_sketches_merge_and_are_read_back(spark):
    many = [t for t in texts() if t]
    rows = [(a, b, f"{a} § {b}") for a, b in zip(many, many[1:], strict=False)]
    df = spark.createDataFrame(rows, "a string, b string, c string").select("*", fp.sketch(F.col("a")).alias("x"), fp.sketch(F.col("b")).alias("y"))
    got = df.select("a", "b", fp.fingerprint(fp.merge(F.col("x"), F.col("y"))).alias("m"), fp.parsed(fp.fingerprint(F.col("x"))).alias("back"), "x").collect()
    for r in got:
        both = sorted(hashes(r["a"]) | hashes(r["b"]))
        low = [h for h in both if int(h, 16) < 2**61]
        kept = both[: max(16, len(low))]
        assert r["m"] == told((len(kept) == len(both), kept))
        assert r["back"] == r["x"]
    groups = df.select((F.length("a") % 2).alias("g"), F.col("x").alias("sketch"))
    found = {(r["g"], r["hash"]) for r in fp.low_hashes(groups, ["g"]).collect()}
    assert found == {(len(a) % 2, h) for a, _, _ in rows for h in hashes(a) if int(h, 16) < 2**61}


def test_containment_of_very_unequal_texts(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(40_000)]
    small, large = " ".join(words[7000:9000]), " ".join(words)
    got = spark.createDataFrame([(small, large)], "a string, b string").select(fp.overlap(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("o"))
    o = got.select(fp.containment(F.col("o")).alias("c"), fp.likeness(F.col("o")).alias("j")).first()
    assert o["c"] == 1.0 and abs(o["j"] - 0.05) < 0.02


def lloyd_plain(rows: list[tuple], k: int = 8, rounds: int = 10):
    kept = [(i, [int((x * 1024) // 1) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and abs(x) < 2**17 for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        owners = assigned()
        for j in range(len(c)):
            mine = [v for (_, v), (_, o) in zip(kept, owners, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    owners = assigned()
    per = Counter()
    for d, o in owners:
        per[o] += d
    return sorted((str(i), o, d, per[o], sum(per.values()), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), (d, o) in zip(kept, owners, strict=True))


def vectors(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    middle = [[r.uniform(-2, 2) for _ in range(64)] for _ in range(11)]
    return [(i, [x + r.gauss(0, 0.8) for x in r.choice(middle)]) for i in range(n)]


def found(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in lloyd.clusters(df).collect())


def test_delta_lloyd(spark):
    hot = vectors(1, 9)[0][1]
    odd = [(None, hot), (None, hot), (7, hot), (900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [float("inf")] * 64), (904, [None] * 64), (905, [1e300] * 64), (906, [-0.0005] * 64)]
    rows = vectors(600, 4) + odd + [(1000 + i, hot) for i in range(300)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, cluster int").repartition(6)
    assert found(df) == lloyd_plain(rows)


def test_delta_lloyd_of_few_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert lloyd.clusters(spark.createDataFrame([], schema)).count() == 0
    for rows in (vectors(3, 1), [(i, [0.5] * 64) for i in range(20)]):
        assert found(spark.createDataFrame(rows, schema)) == lloyd_plain(rows)


def test_transfers_are_what_changed_hands(spark):
    rows = [([1, 2], 0, 1), ([5, 7], 1, 1), ([3, 4], 1, -1), ([9, 9], 0, 1)]
    df = spark.createDataFrame(rows, "v array<int>, cluster int, was int")
    assert lloyd.transfers(df, 2) == {0: (2, [10, 11]), 1: (-1, [3 - 10, 4 - 11])}


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts_plain(rows: list[tuple]) -> dict[str, int]:
    n = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}


def distance_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_plain(n: dict[str, int]) -> list[tuple]:
    near = {w: [o for o in n if distance_one(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def letters() -> list[tuple]:
    r = random.Random(8)
    base = ["".join(r.choice("abcéÿÀ") for _ in range(r.randint(5, 9))) for _ in range(60)]
    rows: list[tuple] = [(None, "abcdef " * 7), (1, None), (2, ""), (3, "HELLOWORLD helloworld" * 3)]
    for i in range(300):
        words = []
        for _ in range(60):
            w = base[min(int(r.expovariate(0.08)), len(base) - 1)]
            if r.random() < 0.2:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", "a", w[at] + "b"]) + w[at + 1 :]
            words.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        rows.append((i % 290, r.choice([" ", "-", "1 "]).join(words)))
    for k in range(4):  # chains of forms
        rows.append((1000 + k, f"chainword{'qqqq'[:k]} " * (5 * 5**k)))
    return rows


@pytest.mark.parametrize(("shard_words", "batch_bytes"), [(1 << 15, 32 << 20), (7, 600)])
def test_variants(spark, shard_words, batch_bytes):
    rows = letters()
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = sorted((tuple(r) for r in spelling.variants(df, shard_words=shard_words, batch_bytes=batch_bytes).collect()), key=str)
    assert got == variants_plain(counts_plain(rows))
    assert any(r[1] for r in got) and any(r[1] != r[2] and r[1] for r in got)


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tries_give_all_neighbours():
    r = random.Random(3)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(150)})
    t = spelling.Trie.unpacked(*spelling.Trie.of(words, list(range(1, len(words) + 1))).packed())
    for w in [*words, "", "abababab", "zz"]:
        got = list(t.neighbours(w))
        assert sorted(x for _, x in got) == [x for x in words if distance_one(w, x)]
        assert all(words[c - 1] == x for c, x in got)


def test_batches_of_shards_have_a_bound(spark):
    words = spark.createDataFrame([(f"word{i:05d}", 5) for i in range(500)], "word string, n long")
    space = Workspace(spark, "test")
    found = spelling.near_words(words, space, shard_words=50, batch_bytes=4000)
    assert space.count > 3 and found.count() == 500  # the tries, and a table a batch
