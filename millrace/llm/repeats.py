"""Finding all repeated windows of a corpus: the frame of the substring operators.

A window is a run of ``window`` units (bytes or words) within one document. Three passes:

1. Anchors. Of the grams (runs of ``gram`` units) inside a window, the one of the smallest hash is
   its anchor (winnowing). Equal windows have equal anchors at equal distance, so only anchors that
   occur twice can lie in repeated windows. Anchors are dealt to buckets by their hash and counted;
   each task first reduces its own repeats to one entry. Documents learn which of their anchors repeat.
2. Segments. The text around each repeated anchor, so far as windows with that anchor reach, is sent
   to the anchor's bucket, once for each content and group of documents, with the first of its places there and the first of those
   that are later; still later ones stay with their group, and lose what that second place loses. In the bucket an engine (suffix array
   or suffix automaton) tells which windows are equal, and each window that occurs earlier is reported. It gets each content once,
   and once more for its other places, so that without it nothing is removed. Anchors with very many entries are routed by
   window instead, so that no bucket gathers the differing surroundings of a passage that many documents share.
3. Removal. Reports go to the documents, and each is cut once.

All rows and whole texts take part; nothing is capped. Hashes of 64 bits choose anchors and routes; contents are compared byte by
byte. Documents are grouped by a hash of the id into ``buckets`` groups, by default so many that a group's texts have about
GROUP_BYTES. What a group sends to a bucket is one row, so that the rows are at most the square of that number, and never
more than the segments. Very long texts are handled whole, in chunks of whole rows.

Rows of the same id count as one document, in the order of their texts; a null id as a last one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import gathered, release, thrifty
from .kernel import U64, buffers, chunks, gram_hashes, mix, ragged, shingle_hashes, sliding_min, starts_within, word_hashes
from .workspace import Workspace

#: Bytes of text that a group of documents has, about.
GROUP_BYTES = 16 << 20
#: Most partitions of a shuffle of groups.
MOST_TASKS = 20_000
#: Entries (one for each task that has it) from which on an anchor is dealt by window.
HOT_ENTRIES = 500
_LOW = U64(0xFFFFFFFF)
_NO_ID = np.iinfo(np.int64).max
#: Rows of one id are told apart above this bit of a position.
_ROW_BIT = 40
#: Parts of a bucket that are solved one after the other, which bounds an engine's memory.
_PARTS = 8


def groups_of(docs: DataFrame, text_col: str = "text") -> int:
    """Groups into which the documents are dealt: so many that a group's texts have about GROUP_BYTES, whatever the input."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(16, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES)) | 1


def tasks_of(groups: int) -> int:
    """Partitions over which groups are dealt. Those of a partition are walked one after the other, so that neither their size
    nor what the driver keeps of a shuffle grows with their number."""
    return min(groups, MOST_TASKS)


def together(docs: DataFrame, told: DataFrame, groups: int):
    """Groups (part) of both tables side by side."""
    n = tasks_of(groups)
    return docs.repartition(n, "part").groupBy("part").cogroup(told.repartition(n, "part").groupBy("part"))


@dataclass(frozen=True)
class Units:
    words: bool  # else bytes
    window: int
    gram: int
    within: bool  # an earlier place in the same document counts too


@dataclass
class Anchors:
    row: np.ndarray
    low: np.ndarray  # first and last window start, in units of the chunk
    high: np.ndarray
    hash: np.ndarray


@dataclass
class Chunk:
    """Units of some rows; ``content`` holds them so that a run of units is a run of bytes."""

    first: np.ndarray  # first unit of each row
    begin: np.ndarray | None  # of each unit in content; None: units are bytes
    end: np.ndarray | None
    content: np.ndarray
    grams: np.ndarray

    def span(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the units [low, high)."""
        return (low, high) if self.begin is None else (self.begin[low], self.end[high - 1])


def read_chunk(u: Units, data: np.ndarray, offsets: np.ndarray) -> Chunk:
    if not u.words:
        return Chunk(offsets, None, None, data, gram_hashes(data, u.gram))
    h, starts, ends, first = word_hashes(data, offsets)
    size = ends - starts + 1  # words, each with one space after it
    word, place = ragged(size)
    content = np.full(len(word), 0x20, np.uint8)
    inside = place < size[word] - 1
    content[inside] = data[(starts[word] + place)[inside]]
    begin = np.cumsum(size) - size
    return Chunk(first, begin, begin + size - 1, content, shingle_hashes(h, u.gram))


def anchors(u: Units, c: Chunk) -> Anchors:
    """Every anchor of the chunk with the starts of the windows that it anchors."""
    start = starts_within(c.first, u.window)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Anchors(z, z, z, np.zeros(0, U64))
    # 32 bits of the hash decide, then the leftmost place: the same in whatever chunk the window lies
    x = (c.grams & ~_LOW) | np.arange(len(c.grams), dtype=U64)
    at = (sliding_min(x, u.window - u.gram + 1)[start] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    low, high = start[new], start[np.append(new[1:], len(at)) - 1]
    return Anchors(np.searchsorted(c.first, low, "right") - 1, low, high, c.grams[at[new]])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one value. 64-bit signed ones are stored as differences, byte plane by byte plane,
    which the compression of the shuffle makes small."""
    out = [np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()]
    for a in arrays:
        if a.dtype == np.int64:
            a = np.diff(a, prepend=0).view(np.uint8).reshape(-1, 8).T
        out.append(np.ascontiguousarray(a).tobytes())
    return b"".join(out)


def unpack(value: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = np.frombuffer(value, np.int64, len(kinds) + 1)[1:]
    at, out = 8 * (len(kinds) + 1), []
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        size = np.dtype(kind).itemsize * n
        raw = np.frombuffer(value, np.uint8, size, at)
        out.append(np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).reshape(-1).view(np.int64)) if kind == np.int64 else raw.view(kind))
        at += size
    return out


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket, in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        yield int(bucket[part[0]]), part


def _rows(schema: list[str], columns: list[list], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema)


def _ids(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _key(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(doc.astype(U64) + U64(0x632BE59BD9B4E019)))


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of a group by id and, where ids repeat, by text; their ids, and their place among rows of the id."""
    doc = _ids(table["doc_id"])
    order = np.argsort(doc, kind="stable")
    again = np.flatnonzero(doc[order][1:] == doc[order][:-1])
    if len(again):
        text = table["text"].to_pylist()
        order = np.array(sorted(range(len(doc)), key=lambda k: (doc[k], text[k] is not None, text[k] or "")), np.int64)
    doc = doc[order]
    new = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) if len(doc) else order
    return table.take(pa.array(order)), doc, np.arange(len(doc)) - begin


def _propose(u: Units, buckets: int) -> Callable:
    """Pass 1, before the shuffle. Kind 0: one entry for each anchor; kind 1: the others and the first of those
    that this task has more than once."""
    names, kinds = ["bucket", "kind", "payload"], [pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            doc, hashes, docs = _ids(t["doc_id"]), [], []
            for i, _, d, o in chunks(*buffers(t["text"])):
                a = anchors(u, read_chunk(u, d, o))
                hashes.append(a.hash)
                docs.append(doc[i + a.row])
            h, doc = np.concatenate(hashes), np.concatenate(docs)
            if not len(h):
                continue
            _, at, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            columns: list[list] = [[], [], []]
            for kind, which in ((0, np.sort(at)), (1, np.flatnonzero(count[back] > 1))):
                for b, part in dealt((h[which] % U64(buckets)).astype(np.int64)):
                    for x, y in zip(columns, (b, kind, pack(h[which[part]], doc[which[part]])), strict=True):
                        x.append(y)
            yield _rows(names, columns, kinds)

    return run


def _count(buckets: int, hot_entries: int) -> Callable:
    """Pass 1, after the shuffle: what each group of documents must know of its anchors."""
    names, kinds = ["part", "hot", "payload"], [pa.int32(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def answers() -> pa.RecordBatch:
            part, key, hot = (np.concatenate(x) for x in zip(*held, strict=True))
            columns: list[list] = [[], [], []]
            for flag in (False, True):
                which = np.flatnonzero(hot == flag)
                for p, at in dealt(part[which]):
                    k = key[which[at]]
                    for x, y in zip(columns, (p, flag, (k if flag else (k >> U64(32)).astype(np.uint32)).tobytes()), strict=True):
                        x.append(y)
            return _rows(names, columns, kinds)

        def add(h: np.ndarray, doc: np.ndarray, hot: np.ndarray) -> int:
            held.append((_part(doc, buckets), _key(h, doc), hot))
            return len(h)

        bucket, first, very = None, [], None
        for bucket_now, kind, value in _stream(batches):
            if bucket_now != bucket:
                if very is None and first:
                    very, n = _settle(first, hot_entries, add)
                    size += n
                bucket, first, very = bucket_now, [], None
            if kind == 0:
                first.append(value)
                continue
            if very is None:
                very, n = _settle(first, hot_entries, add)
                size += n
            h, doc = unpack(value, np.uint64, np.int64)
            size += add(h, doc, np.isin(h, very))
            if size > 2_000_000:
                yield answers()
                held, size = [], 0
        if very is None and first:
            _settle(first, hot_entries, add)
        if held:
            yield answers()

    return run


def _settle(values: list[bytes], hot_entries: int, add: Callable) -> tuple[np.ndarray, int]:
    """Answer the entries of anchors that have several; return the hot ones."""
    h, doc = (np.concatenate(x) for x in zip(*(unpack(v, np.uint64, np.int64) for v in values), strict=True)) if values else (np.zeros(0, U64), np.zeros(0, np.int64))
    u, back, count = np.unique(h, return_inverse=True, return_counts=True)
    n = count[back]
    some = n > 1
    add(h[some], doc[some], n[some] >= hot_entries)
    return u[count >= hot_entries], int(some.sum())


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    thrifty()
    for b in batches:
        release()
        yield from zip(b["bucket"].to_pylist(), b["kind"].to_pylist(), b["payload"].to_pylist(), strict=True)


def _part(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The group of a document; the same as part_column()."""
    x = doc.view(U64)
    return (x ^ (x >> U64(21)) ^ (x >> U64(42))).view(np.int64) % buckets


def part_column(doc: Column, buckets: int) -> Column:
    x = F.coalesce(doc, F.lit(_NO_ID))
    return F.pmod(x.bitwiseXOR(F.shiftrightunsigned(x, 21)).bitwiseXOR(F.shiftrightunsigned(x, 42)), F.lit(buckets)).cast("int")


def numbered(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of the spans [begin, end) of raw: equal contents, equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(raw[x:y], len(known)) for x, y in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(begin))


def _segments(u: Units, buckets: int) -> Callable:
    """Pass 2, before the shuffle. Kind 0: contents and their first two places here; kind 1: later places, each with the second
    place of its content, for the same group of documents."""
    names, kinds = ["bucket", "kind", "payload"], [pa.int32(), pa.int32(), pa.binary()]

    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        thrifty()
        release()
        empty = pa.Table.from_batches([_rows(names, [[], [], []], kinds)])
        if not docs.num_rows or not told.num_rows:
            return empty
        flags = told["hot"].to_pylist()
        values = told["payload"].to_pylist()
        cold = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(v, np.uint32) for v, f in zip(values, flags, strict=True) if not f)]))
        hot = np.unique(np.concatenate([np.zeros(0, U64), *(np.frombuffer(v, U64) for v, f in zip(values, flags, strict=True) if f)]))
        docs, doc, nth = _ordered(docs)
        columns: list[list] = [[], [], []]
        for i, _, d, o in chunks(*buffers(docs["text"])):
            c = read_chunk(u, d, o)
            a = anchors(u, c)
            k = _key(a.hash, doc[i + a.row])
            is_hot = np.isin(k, hot)
            is_cold = ~is_hot & np.isin((k >> U64(32)).astype(np.uint32), cold)
            # hot anchors: each window is a segment of its own
            which = np.flatnonzero(is_hot)
            item, place = ragged(a.high[which] - a.low[which] + 1)
            low = np.concatenate([a.low[is_cold], a.low[which][item] + place])
            high = np.concatenate([a.high[is_cold], a.low[which][item] + place])
            row = np.concatenate([a.row[is_cold], a.row[which][item]])
            if not len(low):
                continue
            x, y = c.span(low, high + u.window)
            # a route is a function of the content: of the anchor, or of the ends of the window
            route = c.grams[low[int(is_cold.sum()) :]] ^ mix(c.grams[low[int(is_cold.sum()) :] + u.window - u.gram])
            route = np.concatenate([a.hash[is_cold], mix(route)])
            own, start = doc[i + row], low - c.first[row] + (nth[i + row] << _ROW_BIT)
            content = numbered(c.content.tobytes(), x, y)
            # the first place of each content, and of the later ones the next: what it loses, all later ones lose
            order = np.lexsort((start, own, content))
            group = content[order]
            head = order[np.flatnonzero(np.append(True, group[1:] != group[:-1]))]
            later = own[order] > own[head][group]
            if u.within:
                later = np.append(False, group[1:] == group[:-1])
            second = later & np.append(True, (group[1:] != group[:-1]) | ~later[:-1])
            next_place = np.full(len(head), -1, np.int64)
            next_place[group[second]] = order[second]
            more = later & ~second
            if more.any():
                at, like = order[more], next_place[group[more]]
                for s, v in zip(columns, (key[0].as_py(), 1, pack(own[like], start[like], (high - low + 1)[at], own[at], start[at])), strict=True):
                    s.append(v)
            sent, of = order[~more], group[~more]
            for b, at in dealt((route[sent] % U64(buckets)).astype(np.int64)):
                mine, index = np.unique(of[at], return_inverse=True)
                heads = head[mine]
                size = y[heads] - x[heads]
                item, place = ragged(size)
                text = c.content[x[heads][item] + place]
                for s, v in zip(columns, (b, 0, pack(size, (route[heads] // U64(buckets) % U64(_PARTS)).astype(np.uint8), text, index.astype(np.int64), own[sent[at]], start[sent[at]])), strict=True):
                    s.append(v)
        return pa.Table.from_batches([_rows(names, columns, kinds)])

    return run


#: An engine gets the units' contents of distinct segments (bytes, sizes) and gives for each of their windows,
#: in order, the number of its class: equal windows, equal classes.
Engine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _judge(u: Units, buckets: int, engine: Engine, windows: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """Pass 2, after the shuffle: windows that occur earlier, for each group of documents."""
    names, kinds = ["part", "kind", "payload"], [pa.int32(), pa.int32(), pa.binary()]

    def solve(values: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        got = [unpack(v, np.int64, np.uint8, np.uint8, np.int64, np.int64, np.int64) for v in values]
        shift = np.cumsum([0, *(len(g[0]) for g in got[:-1])])
        size, sub, text, own, start = (np.concatenate([g[k] for g in got]) for k in (0, 1, 2, 4, 5))
        of = np.concatenate([g[3] + s for g, s in zip(got, shift, strict=True)])
        del got
        begin, raw = np.cumsum(size) - size, text.tobytes()
        for k in range(_PARTS):
            mine, members = np.flatnonzero(sub == k), np.flatnonzero(sub[of] == k)
            if len(members) > 1:
                number = np.empty(len(size), np.int64)
                number[mine] = numbered(raw, begin[mine], begin[mine] + size[mine])
                found = solve_part(text, begin, size, number, of[members], own[members], start[members])
                if found:
                    yield found

    def solve_part(text: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray, of: np.ndarray, own: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        # the engine gets a content for its first place, and again for the first of the later ones if there are any: what
        # these two lose, the places of their kind lose
        order = np.lexsort((start, own, number[of]))
        group = number[of][order]
        lead = np.append(True, group[1:] != group[:-1])
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        later = np.arange(len(order)) > head if u.within else own[order] > own[order][head]
        new = lead | (later & np.append(True, ~later[:-1]))
        given = order[new]
        copy = np.empty(len(order), np.int64)
        copy[order] = np.cumsum(new) - 1
        copy[order[~later]] = (np.cumsum(new) - 1)[head][~later]
        item, place = ragged(size[of[given]])
        data, size = text[begin[of[given]][item] + place], size[of[given]]
        cls, count = engine(data, size), windows(data, size)
        # the earliest place of each class: places as one number, by id, row of the id, and start
        by_row = np.lexsort((start[given] >> _ROW_BIT, own[given]))
        one_own, one_row = own[given][by_row], start[given][by_row] >> _ROW_BIT
        new_own = np.append(True, one_own[1:] != one_own[:-1])
        new_row = new_own | np.append(True, one_row[1:] != one_row[:-1])
        rank = np.empty(len(by_row), np.int64)
        rank[by_row] = np.cumsum(new_row) - 1
        ids = np.cumsum(new_own[new_row]) - 1
        content, t = ragged(count)
        where = ((rank << _ROW_BIT) + (start[given] & ((1 << _ROW_BIT) - 1)))[content] + t
        earliest = np.full(int(cls.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, cls, where)
        first = np.empty(len(earliest), np.int64)
        top = np.flatnonzero(earliest[cls] == where)
        first[cls[top]] = top
        gone = earliest[cls] < where
        if not u.within:
            gone &= ids[earliest[cls] >> _ROW_BIT] < ids[where >> _ROW_BIT]
        # only what the engine found equal to another window of its input
        gone &= first[cls] != np.arange(len(cls))
        if not gone.any():
            return None
        new_run = gone & np.append(True, ~gone[:-1] | (content[1:] != content[:-1]))
        heads = np.flatnonzero(new_run)
        length = np.bincount(np.cumsum(new_run)[gone] - 1, minlength=len(heads))
        runs = np.bincount(content[heads], minlength=len(size))
        member, k = ragged(runs[copy])
        run = heads[(np.cumsum(runs) - runs)[copy[member]] + k]
        return own[member], start[member] + t[run], length[(np.cumsum(new_run) - 1)[run]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def reports() -> pa.RecordBatch:
            own, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
            columns: list[list] = [[], [], []]
            for p, at in dealt(_part(own, buckets)):
                for x, y in zip(columns, (p, 0, pack(own[at], start[at], n[at])), strict=True):
                    x.append(y)
            return _rows(names, columns, kinds)

        bucket, values = None, []
        for b, kind, value in _stream(batches):
            if kind == 1:  # as it is, to the group that it came from
                yield _rows(names, [[b], [1], [value]], kinds)
                continue
            if b != bucket and values:
                for found in solve(values):
                    held.append(found)
                    size += len(found[0])
                values = []
                if size > 500_000:
                    yield reports()
                    held, size = [], 0
            bucket = b
            values.append(value)
        if values:
            held += solve(values)
        if held:
            yield reports()

    return run


def _remove(u: Units) -> Callable:
    """Pass 3: cut the documents of a group."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        thrifty()
        release()
        table, doc, nth = _ordered(docs)
        values = list(zip(told["kind"].to_pylist(), told["payload"].to_pylist(), strict=True))
        none = np.zeros(0, np.int64)

        def placed(own: np.ndarray, start: np.ndarray) -> np.ndarray:
            """Row and start of a window in one number."""
            return (np.searchsorted(doc, own) << _ROW_BIT) + start

        got = [unpack(v, *[np.int64] * 3) for k, v in values if k == 0]
        own, start, n = (np.concatenate([none, *(g[k] for g in got)]) for k in range(3))
        at = placed(own, start)
        # runs of windows that go
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        ends = np.maximum.accumulate(at + n) if len(at) else none
        new = np.append(True, at[1:] > ends[:-1]) if len(at) else np.zeros(0, bool)
        begin, end = at[new], ends[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else none
        # places that lose what the second place of their content loses
        like_own, like_start, size, own, start = (np.concatenate([none, *(g[k] for g in (unpack(v, *[np.int64] * 5) for k, v in values if k == 1))]) for k in range(5))
        like = placed(like_own, like_start)
        run_of_like = np.searchsorted(begin, like, "right") - 1
        lost = run_of_like >= 0
        lost[lost] = like[lost] + size[lost] <= end[run_of_like[lost]]
        at, n = np.append(at, placed(own, start)[lost]), np.append(n, size[lost])
        which, start = at >> _ROW_BIT, at & ((1 << _ROW_BIT) - 1)
        order = np.argsort(which, kind="stable")
        which, start, n = which[order], start[order], n[order]
        units, removed, kept, runs, run_of = [], [], [], [], []
        for i, j, d, o in chunks(*buffers(table["text"])):
            c = read_chunk(u, d, o) if u.words else Chunk(o, None, None, d, np.zeros(0, U64))
            total = int(c.first[-1])
            a, b = np.searchsorted(which, [i, j])
            depth = np.zeros(total + 1, np.int64)
            at = c.first[which[a:b] - i] + start[a:b]
            np.add.at(depth, at, 1)
            np.add.at(depth, at + n[a:b] - 1 + u.window, -1)
            gone = np.cumsum(depth)[:total] > 0
            row = np.repeat(np.arange(j - i), np.diff(c.first))
            units.append(np.diff(c.first))
            removed.append(np.bincount(row[gone], minlength=j - i))
            before = np.append(True, (row[1:] != row[:-1]) | ~gone[:-1]) if total else np.zeros(0, bool)
            after = np.append((row[1:] != row[:-1]) | ~gone[1:], True) if total else np.zeros(0, bool)
            s, e = np.flatnonzero(gone & before), np.flatnonzero(gone & after) + 1
            run_of.append(i + row[s])
            runs.append(np.stack([s - c.first[row[s]], e - c.first[row[s]]], axis=1))
            ends = np.append(0, np.cumsum(~gone))[c.first]
            if u.words:
                left = np.flatnonzero(~gone)
                size = c.end[left] - c.begin[left] + 1
                item, place = ragged(size)
                raw = c.content[c.begin[left][item] + place].tobytes()
                cuts = np.append(0, np.cumsum(size))[ends].tolist()
                kept += [raw[x : max(x, y - 1)] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            else:
                raw, cuts = d[~gone].tobytes(), ends.tolist()
                kept += [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        flat = np.concatenate([np.zeros((0, 2), np.int64), *runs])
        offsets = np.searchsorted(np.concatenate([np.zeros(0, np.int64), *run_of]), np.arange(table.num_rows + 1))
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_units": pa.array(np.concatenate([none, *units]).astype(np.int64)),
                "n_removed": pa.array(np.concatenate([none, *removed]).astype(np.int64)),
                "spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])).cast(spans),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return run


def remove_repeats(df: DataFrame, u: Units, engine: Engine, windows: Callable, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """One row per row of df: doc_id, n_units, n_removed, spans (array of start and end, in units) and
    kept (binary: the bytes or words that stay)."""
    space = Workspace(df.sparkSession, "repeats")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = buckets or groups_of(docs)

    def streamed(x: DataFrame) -> DataFrame:
        return x.repartition(tasks_of(buckets), "bucket").sortWithinPartitions("bucket", "kind")

    entries = streamed(docs.mapInArrow(_propose(u, buckets), "bucket int, kind int, payload binary"))
    told = space.save(entries.mapInArrow(_count(buckets, hot_entries), "part int, hot boolean, payload binary"))

    grouped = docs.select(part_column(F.col("doc_id"), buckets).alias("part"), "doc_id", "text")
    segments = together(grouped, told, buckets).applyInArrow(_segments(u, buckets), "bucket int, kind int, payload binary")
    reports = space.save(streamed(segments).mapInArrow(_judge(u, buckets, engine, windows), "part int, kind int, payload binary"))

    out = "doc_id long, n_units long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return together(grouped, reports, buckets).applyInArrow(_remove(u), out)
