"""Rows without an id, rows that repeat one, texts with equal check-sums, and many more groups than partitions."""

from __future__ import annotations

import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from millrace.llm import repeats
from millrace.llm.automaton import op8_suffix_automata
from millrace.llm.linededup import Common, common_runs, dedup_lines
from millrace.llm.ngramjoin import jaccard_groups
from millrace.llm.suffixdedup import op6_suffix_dedup

SCHEMA = "doc_id long, text string"


def twins() -> list[str]:
    """Texts of two lines and of one whose check-sums agree in the upper 22 bits."""
    r = random.Random(4)
    seen: dict[int, str] = {}
    out: list[str] = []
    while len(out) < 6:
        word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
        words = " ".join(word() for _ in range(9))
        text = words if r.random() < 0.5 else words + "\n" + " ".join(word() for _ in range(8))
        other = seen.setdefault(crc32(text.encode()) >> 10, text)
        if other != text and ("\n" in other) != ("\n" in text):
            out += [text, other]
    return out


@pytest.mark.parametrize("same", [None, 7])
def test_rows_of_one_id_whose_check_sums_agree(spark, same):
    texts = twins()
    copies = [t.split("\n")[-1].rsplit(" ", 1)[0] + " changed" for t in texts]  # near copies of the last lines
    rows = [(same, t) for t in texts] + [(100 + k, t) for k, t in enumerate(copies)]
    for name, ids in (("one id", rows), ("own ids", [(1000 + k if d == same else d, t) for k, (d, t) in enumerate(rows)])):
        got = dedup_lines(spark.createDataFrame(ids, SCHEMA).repartition(3), least_words=1).collect()
        assert len(got) == len(rows), name
        kept = {x for r in got for x in r["text"].split("\n") if x}
        assert sum(r["n_removed"] for r in got) == len(copies) and len(kept) == len({x for t in texts for x in t.split("\n")}), name


def test_five_thousand_rows_without_an_id(spark):
    rows = [(None, f"{code(k)} {code(k * 7 + 1)} {code(k * 31 + 5)} {code(k * 101 + 3)} stands\nall of these rows have this line") for k in range(5000)] + [(3, "all of these rows have this line")]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA), least_words=1)
    told = got.select("doc_id", F.instr("text", "all of these").alias("has"), "n_removed").collect()
    assert [(r["doc_id"], r["has"] > 0) for r in told if r["has"] > 0] == [(3, True)]
    assert sum(r["n_removed"] for r in told) >= 5000


def code(k: int) -> str:
    return "".join("abcdefghij"[int(x)] for x in f"{k * 7919 % 1_000_003:07d}")


def documents(spark, tmp_path):
    r = random.Random(6)
    words = [f"word{code(k)}" for k in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 160))) for _ in range(60)]
    texts = base + [f"{t} {r.choice(words)}" for t in base[:30]] + [f"{base[k]}\n{base[k + 1]}" for k in range(20)] + base[:5]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return df


def test_many_groups_over_few_partitions(spark, tmp_path, monkeypatch):
    df = documents(spark, tmp_path)
    work = {
        "lines": lambda: dedup_lines(df, least_words=1).select("doc_id", "text"),
        "join": lambda: jaccard_groups(df, gram=4, percent=80).select("doc_id", "component_id"),
        "bytes": lambda: op6_suffix_dedup(spark, str(tmp_path)),
        "words": lambda: op8_suffix_automata(spark, str(tmp_path)),
    }
    found = {k: sorted(map(tuple, f().collect())) for k, f in work.items()}
    monkeypatch.setattr(repeats, "MOST_TASKS", 8)
    for module in ("linededup", "ngramjoin", "repeats"):
        monkeypatch.setattr(f"millrace.llm.{module}.groups_of", lambda *_: 10_001)
    asked = []
    frame = type(df)
    shuffle = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: (asked.append(n), shuffle(self, n, *cols))[1])
    assert {k: sorted(map(tuple, f().collect())) for k, f in work.items()} == found
    assert max(n for n in asked if isinstance(n, int)) == 8


def test_only_common_runs_are_told(spark):
    rows = [(k, f"the same two words {k} {k * 7}") for k in range(3000)]
    found = common_runs(spark.createDataFrame(rows, SCHEMA), 1 << 18)
    assert isinstance(found, Common) and 1 <= len(found.slot) <= 20 and len(found.slot) <= found.slots // 8
