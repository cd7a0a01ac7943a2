"""The staging store, and streams with a state a key, against the batch results."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.admission import admit
from millrace.operators.lists import dedup_history, top_history
from millrace.operators.staging import StagingStore, load_files
from millrace.streaming import flows


def test_puts_clears_and_loads_in_any_order(spark, tmp_path):
    store = StagingStore(spark, str(tmp_path / "stage"))
    assert store.staged() is None
    rows = lambda *names: spark.createDataFrame([(k, n, 10 + k, "") for k, n in enumerate(names)], "seq int, name string, size long, type string")
    store.put(rows("a.png", "b.txt"), "WEBP")
    first = store.staged()
    store.put(rows("c.wav"), "MP3")  # a reader of the first goes on with it
    assert [r.name for r in first.orderBy("seq").collect()] == ["a.png", "b.txt"]
    assert [(r.name, r.target) for r in store.staged().collect()] == [("c.wav", "MP3")]
    store.clear()
    assert store.staged() is None
    store.put(rows("d.md"), "PDF")
    again = StagingStore(spark, str(tmp_path / "stage"))
    assert [r.name for r in again.staged().collect()] == ["d.md"] and len({r.id for r in again.staged().collect()}) == 1
    store.vacuum(keep=1)
    assert len(store.commits()) == 1 and [r.name for r in store.staged().collect()] == ["d.md"]
    assert len(list((tmp_path / "stage" / "snapshots").iterdir())) == 1


def test_two_puts_at_once_leave_one_for_all_readers(spark, tmp_path):
    stores = [StagingStore(spark, str(tmp_path)) for _ in range(2)]
    for s in stores:
        s._files.createNewFile(s._path(f"{tmp_path}/commits/000000000001.{'ab'[stores.index(s)]}"))
    assert stores[0].commits() == stores[1].commits() and stores[0].commits()[-1].endswith(".b")


def test_load_takes_twenty_usable_files(spark):
    rows = [(k, f"f{k}.{'png' if k % 3 else 'exe'}", 1 << (60 if k == 1 else 10), "", "GIF" if k % 2 else "PNG", k % 2) for k in range(60)]
    got = load_files(spark.createDataFrame(rows, "seq int, name string, size long, type string, target string, ts long")).collect()
    usable = sorted((r for r in rows if r[0] % 3 and r[0] != 1), key=lambda r: (r[5], r[0]))[:20]
    assert [r.seq for r in sorted(got, key=lambda r: (r.ts, r.seq))] == [r[0] for r in usable] and {r.extra for r in got} == {40}
    assert {r.target for r in got if r.ts == 0} == {"PNG"} and "GIF" not in {r.target for r in got}


def streamed(spark, df, path, parts, make, mode="append"):
    """All rows that a stream over some files, one a batch, gives."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(path / f"in{k}"))
    out = []
    for k in range(len(parts)):
        spark.read.parquet(str(path / f"in{k}")).coalesce(1).write.mode("append").parquet(str(path / "in"))
        query = make(spark.readStream.schema(df.schema).parquet(str(path / "in"))).writeStream.outputMode(mode).option("checkpointLocation", str(path / "cp")).foreachBatch(lambda b, n: out.extend(b.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    return out


@pytest.mark.parametrize("cuts", [(), (30,), (7, 8, 50)])
def test_admission_is_the_same_however_files_arrive(spark, tmp_path, cuts):
    r = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"q{k % 3}", k, r.random() < 0.7, start + dt.timedelta(seconds=k)) for k in range(120)]
    df = spark.createDataFrame(rows, "queue string, seq long, ok boolean, ts timestamp")
    edges = [0, *cuts, len(rows)]
    parts = [df.where(F.col("seq").between(a, b - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    got = streamed(spark, df, tmp_path, parts, flows.admit_arrivals)
    want = admit(df, F.col("ok"), ["queue"], "seq").select("queue", "seq", "state", "place").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {"full", "accepted", "rejected"} == {x.state for x in got}


def test_late_and_repeated_replies_do_not_show(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "tile string, request long, text string, ts timestamp"
    parts = [spark.createDataFrame([(t, n, x, start + dt.timedelta(seconds=s)) for t, n, x, s in p], schema) for p in ([("a", 2, "new", 0), ("a", 1, "old", 1), ("b", 1, "b1", 1)], [("a", 1, "late", 2), ("a", 2, "again", 2)], [("a", 3, "newest", 3), ("b", 5, "b5", 3)])]
    got = streamed(spark, parts[0], tmp_path, parts, flows.shown_replies)
    assert [tuple(r) for r in sorted(got, key=lambda r: (r.tile, r.request))] == [("a", 2, "new"), ("a", 3, "newest"), ("b", 1, "b1"), ("b", 5, "b5")]


def test_state_goes_when_a_key_is_idle(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "tile string, request long, text string, ts timestamp"
    at = lambda h: start + dt.timedelta(hours=h)
    parts = [spark.createDataFrame(p, schema) for p in ([("a", 5, "x", at(0))], [("b", 1, "y", at(30))], [("b", 2, "z", at(31))], [("a", 1, "after", at(32))])]
    got = streamed(spark, parts[0], tmp_path, parts, flows.shown_replies)
    assert ("a", 1, "after") in [tuple(r) for r in got]  # what was known of a went


@pytest.mark.parametrize("cuts", [(), (20, 21, 70)])
def test_history_of_owners_is_the_batch_result(spark, tmp_path, cuts):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"o{k % 2}", f"i{k:03d}", f"n{k % 17}", k % 3, k * 37 % 1009, start + dt.timedelta(seconds=k)) for k in range(100)]
    df = spark.createDataFrame(rows, "owner string, id string, name string, size long, ts long, at timestamp")
    edges = [0, *cuts, 100]
    parts = [df.where(F.substring("id", 2, 3).cast("int").between(a, b - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    got = streamed(spark, df, tmp_path, parts, flows.owners_history)
    last = {o: max(r.version for r in got if r.owner == o) for o in ("o0", "o1")}
    for o, version in last.items():
        mine = df.where(F.col("owner") == o).select("id", "name", "size", F.lit("PNG").alias("format"), F.lit("done").alias("state"), "ts")
        want = [r.id for r in top_history(dedup_history(mine, ["name", "size"])).orderBy(F.desc("ts")).collect()]
        assert [r.id for r in sorted((r for r in got if (r.owner, r.version) == (o, version)), key=lambda r: r.place)] == want
