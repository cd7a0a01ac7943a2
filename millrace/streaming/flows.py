"""Continuous forms of the batch operators. Each starts a query and returns it; ``once`` works off what is there and ends."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.vocab import MAX_FILES
from ..operators.convert import convert
from ..operators.lists import dedup_history, top_history


def _start(stream: DataFrame, each, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_converting(files: DataFrame, target: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Convert files as they arrive (see ``scan.arrivals``). A batch that is run again replaces its own folder and adds nothing."""

    def each(batch: DataFrame, number: int) -> None:
        convert(batch, target).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(files, each, checkpoint, once)


def keep_history(entries: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the newest entries of a stream (id, name, size, format, state, ts): the newest of each name and size, ten in all. Each
    batch writes a new state beside the last one, which it reads, so that a batch can be run again."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{out}/state={number - 1}"))
        top_history(dedup_history(rows, ["name", "size"])).drop("place").select(*batch.columns).write.mode("overwrite").parquet(f"{out}/state={number}")

    return _start(entries, each, checkpoint, once)


def latest_replies(replies: DataFrame, keys: list[str], order: str = "request") -> DataFrame:
    """Of a stream of replies the one of the highest request number of each key; a late reply to an older request shows no more."""
    rest = [c for c in replies.columns if c not in keys and c != order]
    newest = replies.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("__newest"))
    return newest.select(*keys, F.col(f"__newest.{order}").alias(order), *(F.col(f"__newest.{c}").alias(c) for c in rest))


def _keyed(stream: DataFrame, keys: list[str], time: str, delay: str, each, out: str, state: str, idle_ms: int, mode: str = "append") -> DataFrame:
    """Rows of ``each(key, rows, state value or None) -> (rows out, new state value)`` over a stream, with a state a key. The state of a key goes when the watermark is
    ``idle_ms`` past its last row, so that what is kept is bounded by the keys of that span. Rows that come later than the watermark are left out by it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)
        made, value = each(key, rows, held.get[0] if held.exists else None)
        held.update((value,))
        last = int(rows[time].max().timestamp() * 1000)
        held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + idle_ms)
        yield made

    return stream.withWatermark(time, delay).groupBy(*keys).applyInPandasWithState(run, out, f"value {state}", mode, GroupStateTimeout.EventTimeTimeout)


def admit_arrivals(files: DataFrame, queue: str = "queue", order: str = "seq", ok: str = "ok", time: str = "ts", most: int = MAX_FILES, delay: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """Of files that arrive for queues (queue, seq, ok, ts): state and place as ``admission.admit`` gives them to all at once. How many places are taken is the
    state of a queue, so a file that arrives later sees what is taken; arrivals of one batch are taken in their order."""

    def each(key: tuple, rows: pd.DataFrame, taken: int | None) -> tuple[pd.DataFrame, int]:
        taken, told = taken or 0, []
        for seq, good in rows.sort_values(order)[[order, ok]].itertuples(index=False):
            full = taken >= most
            taken += bool(good) and not full
            told.append((key[0], seq, "full" if full else "accepted" if good else "rejected", taken if good and not full else None))
        out = pd.DataFrame(told, columns=[queue, order, "state", "place"])
        return out.astype({"place": "Int64"}), taken

    kinds = dict(files.dtypes)
    return _keyed(files, [queue], time, delay, each, f"{queue} {kinds[queue]}, {order} {kinds[order]}, state string, place long", "long", idle_ms)


def shown_replies(replies: DataFrame, key: str = "tile", order: str = "request", text: str = "text", time: str = "ts", delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """What shows of replies (tile, request, text, ts): of each batch the one of the highest request, if it is higher than any that has shown; a late
    reply to an older request shows no more."""

    def each(key: tuple, rows: pd.DataFrame, newest: int | None) -> tuple[pd.DataFrame, int]:
        best = rows.loc[rows[order].idxmax()]
        if newest is not None and best[order] <= newest:
            return pd.DataFrame({key_name: pd.Series(dtype=object) for key_name in (key_col, order, text)}), newest
        return pd.DataFrame([(key[0], int(best[order]), best[text])], columns=[key_col, order, text]), int(best[order])

    key_col, kinds = key, dict(replies.dtypes)
    return _keyed(replies, [key], time, delay, each, f"{key} {kinds[key]}, {order} long, {text} {kinds[text]}", "long", idle_ms)


def owners_history(entries: DataFrame, owner: str = "owner", time: str = "at", most: int = 10, delay: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """The kept history of each owner (id, name, size, ts and the event time), told anew when it changes: the newest of each name and size, ``most`` in all. The
    state of an owner is that list. ``version`` counts how often it was told."""

    def each(key: tuple, rows: pd.DataFrame, held: str | None) -> tuple[pd.DataFrame, str]:
        before = json.loads(held) if held else {"version": 0, "rows": []}
        new = rows[["id", "name", "size", "ts"]].astype(object).values.tolist()
        newest: dict[tuple, list] = {}
        for r in [*before["rows"], *new]:
            k = (r[1], r[2])
            if k not in newest or (r[3], r[0]) > (newest[k][3], newest[k][0]):
                newest[k] = r
        kept = sorted(newest.values(), key=lambda r: (-r[3], r[0]))[:most]
        now = {"version": before["version"] + 1, "rows": kept}
        told = [(key[0], now["version"], place, *r) for place, r in enumerate(kept, 1)]
        return pd.DataFrame(told, columns=[owner, "version", "place", "id", "name", "size", "ts"]), json.dumps(now)

    kinds = dict(entries.dtypes)
    return _keyed(entries, [owner], time, delay, each, f"{owner} {kinds[owner]}, version long, place long, id string, name string, size long, ts long", "string", idle_ms)


def joined_chunks(chunks: DataFrame, key: str = "file_id", order: str = "seq", data: str = "data") -> DataFrame:
    """Chunks of recordings put together in the order of their arrival."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, data))), lambda x: F.hex(x[data]))
    return chunks.groupBy(key).agg(F.unhex(F.array_join(parts, "")).alias("content"))
