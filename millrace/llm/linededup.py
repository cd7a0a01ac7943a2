"""Line dedup: fuzzy lines by SimHash, pigeonhole blocks and edit similarity.

Lines are normalised: lower case, digits read as 0, ASCII marks and runs of white space as one
space. Each character of a script that is written without spaces is a word. Lines of fewer than ``least_words``
words never go; op1 and the pipeline take all lines with a word. Equal normalised lines are one item. Lines of fewer than
five words have no SimHash: of three or four words they meet longer ones by near keys, and with fewer only equal ones are
similar. An item's
SimHash is the majority, bit by bit, of the hashes of its words of four bytes or more (of all, if it has
none), and is cut into ``BLOCKS`` blocks of 32 bits. Items that share a block are candidates:
whenever fewer bits differ than there are blocks, some block is equal. Similar lines seldom keep a whole block when several words
differ, so lines also meet by words that they must share (``near_keys``), which the README states with figures. Of the lines of a key
only those stay that have another of fitting size and sketch (bit by bit the parity of the words that fall on it: similar lines
differ in few bits). Lines that no chain of such fits connects are not similar, so each connected part is a key of its own, and keys of the
same lines are one key. Longer sketches are compared before the texts are fetched. Candidates are verified by edit distance over
words: similar are lines with 1 - distance / longer length of
``percent`` hundredths or more. Of each connected group of items the first occurrence (smallest id, then line)
stays and every other line goes.

Runs of words that very many lines have would make all of these meet; they are counted over all texts, and come last among what a
line must share. Words are told apart by hashes, which can only add candidates; lines by a 62-bit hash of their words in order, rows of one id by a 64-bit hash of their texts.
A line that stands everywhere is told once for each table of texts that has it. Of items that very many lines share a key with see
``clusters``.

Defined cases: null text has no lines and stays null; lines without a word, and with fewer than ``least_words``, stay; a text whose lines
all went is empty; rows of one id are
told apart by their texts, and rows that repeat both are cut alike; a null id comes last;
lines that tie for the first place do not arise, as id, text and number tell them apart; very long texts and lines are read whole;
an empty table gives an empty result; further columns are kept (the names n_lines, n_removed
and removed are the operator's own and replace columns of that name).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import gathered, release, thrifty
from .clusters import linked
from .kernel import U64, buffers, chunks, looked_up, mix, prefix_of_hashes, ragged, shingle_hashes, span_hash, starts_within, word_hashes
from .repeats import _NO_ID, _ids, _rows, dealt, groups_of, pack, tasks_of, together, unpack
from .workspace import Workspace

BLOCKS, LEAST_WORDS, PERCENT = 4, 5, 80
#: Pairs of lines meet by three shared words if the longer line has fewer words than this, else by a shared run of two.
RUNS_FROM = 10
#: Runs that a long line enters at most.
MOST_RUNS = 24
#: Slots in which runs of two words are counted, for each group of documents and at most, and how many times the mean of a task's slots, and how often at
#: least, is common: half of the slots are at most, and only these are sent out.
SLOTS_A_GROUP, MOST_SLOTS, COMMON, LEAST_COMMON = 1 << 14, 1 << 24, 2, 6
#: Lines of a key up to which the pairs of many keys are held against each other at once; up to the second, the pairs of one key.
#: Beyond the third a key is told whole.
SMALL_KEY, SQUARE_KEY, WHOLE_KEY = 12, 512, 1 << 14
#: Pairs of sketches compared at once.
_CELLS = 1 << 18
#: 64 bits each of the wide sketch by which lines of a key meet at last: of lines of sixty words a fifth of which differ, few bits are changed twice.
_SKETCH = [f"s{k}" for k in range(4)]
#: Bytes of arrays from which on a worker hands their memory back at once: those of a chunk have less, and are many.
_KEPT = 16 << 20
#: Items that a row of a key tells at most.
_ROW_ITEMS = 1 << 12

#: How bytes read in a normalised line; bytes beyond ASCII stand for themselves.
_READ = np.arange(256, dtype=np.uint8)
_READ[:128] = 0x20
for _a, _z in ((ord("a"), ord("z")), (ord("A"), ord("Z"))):
    _READ[_a : _z + 1] = np.arange(ord("a"), ord("z") + 1)
_READ[ord("0") : ord("9") + 1] = ord("0")
_READ[0x0A] = 0x0A
#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han; and the first bytes that they have.
_UNSPACED = "([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA9E0-\uA9FF\uAA60-\uAA7F\uF900-\uFAFF\uFF66-\uFF9D\U0001B000-\U0001B16F\U00020000-\U000323AF])"
_LEADS = np.zeros(256, bool)
_LEADS[[0xE0, 0xE1, *range(0xE3, 0xEB), 0xEF, 0xF0]] = True


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all lines (each with its line feed), the row of each line, and its number within the row.
    A row has one line more than line feeds, the last perhaps empty; an empty row has one empty line."""
    feeds = np.flatnonzero(data == 0x0A)
    count = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    row, number = ragged(count)
    begin = np.empty(len(row), np.int64)
    first = number == 0
    begin[first] = offsets[:-1]
    begin[~first] = feeds + 1
    return np.append(begin, len(data)), row, number


def _ranked(tokens: np.ndarray, common: np.ndarray, size: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, place and key of the tokens of each line (lines rise), in an order that is the same in all lines: the common ones come
    last, and of the others those of many bytes, which are rare, come first. Tokens that a line has several times are numbered."""
    lines, places, keys = [], [], []
    for lo in range(0, int(line[-1]) + 1 if len(line) else 0, 1 << 16):
        part = slice(*np.searchsorted(line, [lo, lo + (1 << 16)]))
        of = line[part] - lo
        code = (of.astype(U64) << U64(48)) | (common[part].astype(U64) << U64(43)) | ((63 - np.minimum(size[part], 63)).astype(U64) << U64(37)) | (tokens[part] >> U64(27))
        code.sort()
        here = np.arange(len(code))
        again = np.append(False, code[1:] == code[:-1])
        nth = here - np.maximum.accumulate(np.where(again, 0, here))
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        lines.append(line[part])
        places.append(here - np.repeat(begin, np.diff(np.append(begin, len(of)))))
        keys.append(mix((code & U64((1 << 48) - 1)) + (nth.astype(U64) << U64(48))))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *lines]), np.concatenate([none, *places]), np.concatenate([none.astype(U64), *keys])


def _leading(n: np.ndarray, percent: int) -> np.ndarray:
    """How many runs of two, in the common order, a line of n words must enter so that it shares one with every similar line.

    Similar lines of n <= m words differ by e = m - percent hundredths of m edits at most. An edit takes two runs at most from the
    longer line, so m - 1 - 2e are shared, and all but n - 1 of these less one may come last in the order of the other.
    """
    n = np.minimum(n, 10 * MOST_RUNS)  # from there on more than MOST_RUNS anyway
    size = np.unique(n)
    most = np.zeros(len(size), np.int64)
    for more in range(int(size.max(initial=0)) * (100 - percent) // percent + 1):
        longer = size + more
        edits = longer - -(-percent * longer // 100)
        most = np.maximum(most, np.where(more <= edits, 2 * edits - more, 0))
    return most[np.searchsorted(size, n)] + 1


def near_keys(h: np.ndarray, size: np.ndarray, first: np.ndarray, use: np.ndarray, common: Common, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines, and the place in ``use`` of each key's line: similar lines that are not equal share a key.

    Lines of few words meet by three words: each edit takes at most one from what two lines have in common, and if the words of both
    are in one order, lines that share t words share three among their first n - t + 3. Longer ones meet by runs of two words, of
    which an edit takes two at most (see ``_leading``). Of long lines at most ``MOST_RUNS`` runs are entered, the first of the order: of
    two lines that differ in a fifth of their words two runs in five of both are the same, so that all of these differ in one case of
    a hundred thousand or less.
    """
    n = np.diff(first)[use]
    few = np.flatnonzero((n > 3) & (n < RUNS_FROM))
    ids, place = ragged(n[few])
    at = first[use[few]][ids] + place
    token = _ranked(h[at], np.zeros(len(at), np.uint8), size[at], ids)[2]
    begin = np.cumsum(n[few]) - n[few]
    which, keys = [], []
    for words in np.unique(n[few]).tolist():
        at = np.flatnonzero(n[few] == words)
        lead = token[begin[at][:, None] + np.arange(min(words, words - -(-percent * words // 100) + 3))]
        for c in combinations(range(lead.shape[1]), 3):
            keys.append(mix(sum((lead[:, x] * U64(2 * j + 3) for j, x in enumerate(c)), np.full(len(at), 3, U64))))
            which.append(few[at])
    many = np.flatnonzero(100 * n >= percent * RUNS_FROM)
    ids, place = ragged(n[many] - 1)
    at = first[use[many]][ids] + place
    runs = shingle_hashes(h, 2)[at]
    ids, place, token = _ranked(runs, common.of(runs), size[at] + size[at + 1], ids)
    some = place < np.minimum(_leading(n[many], percent), MOST_RUNS)[ids]
    return np.concatenate([*which, many[ids[some]]]), np.concatenate([*keys, token[some]])


def _slots(runs: np.ndarray, slots: int) -> np.ndarray:
    return ((runs >> U64(8)) & U64(slots - 1)).astype(np.int64)


class Common:
    """How common the runs of two words of each slot are: 0 for all but those that have far more than the mean."""

    def __init__(self, slots: int, slot: np.ndarray, level: np.ndarray):
        self.slots, self.slot, self.level = slots, slot.astype(np.int32), level.astype(np.uint8)

    @cached_property
    def _of_slot(self) -> np.ndarray:
        full = np.zeros(self.slots, np.uint8)
        full[self.slot] = self.level
        return full

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_of_slot"}

    def of(self, runs: np.ndarray) -> np.ndarray:
        return self._of_slot[_slots(runs, self.slots)]


def common_runs(docs: DataFrame, slots: int) -> Common:
    """All texts are counted: each task counts what its chunks have and tells the slots that it has far more often than the mean (a run that is so
    common over all must be so in one of them)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for t in gathered(batches, kept=_KEPT):
            for _, _, d, o in chunks(*_read(t["text"])):
                h, _, _, first = word_hashes(d, split_lines(d, o)[0])
                slot, n = np.unique(_slots(shingle_hashes(h, 2)[starts_within(first, 2)], slots).astype(np.int32), return_counts=True)
                total[slot] += n
        usual = max(COMMON * float(total.mean()), float(LEAST_COMMON))
        slot = np.flatnonzero(total > usual)
        level = np.minimum(31, 1 + np.floor(2 * np.log2(total[slot] / usual)))
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(level.astype(np.int32))], names=["slot", "level"])

    found = docs.select("text").mapInArrow(count, "slot int, level int").groupBy("slot").agg(F.max("level").alias("level")).toArrow()
    return Common(slots, found["slot"].to_numpy(), found["level"].to_numpy())


def parities(h: np.ndarray, first: np.ndarray, width: int = 1) -> list[np.ndarray]:
    """Of lines with the words of h from ``first`` on: 64 * width bits, each the parity of the words that fall on it. Every edit
    changes two of them at most."""
    bit = (h >> U64(7)) & U64(64 * width - 1)
    one = U64(1) << (bit & U64(63))
    if not len(first):
        return [np.zeros(0, U64)] * width
    return [np.bitwise_xor.reduceat(np.where(bit >> U64(6) == k, one, U64(0)), first) for k in range(width)]


def simhash_blocks(h: np.ndarray, first: np.ndarray, total: np.ndarray) -> np.ndarray:
    """BLOCKS blocks of 32 bits of the SimHash of lines: ``h`` has the words that count, ``total`` of each line from ``first`` on."""
    out, wide = np.zeros((len(total), BLOCKS // 2), U64), total > 0xFFFF
    lanes = U64(0x0001000100010001)  # four counters of 16 bits: one bit in sixteen at a time
    for k in range(BLOCKS // 2 if len(total) else 0):
        w = mix(h + U64(k * 0x9E3779B9 + 1))
        for shift in range(16):
            ones = np.add.reduceat((w >> U64(shift)) & lanes, first)
            for lane in range(4):
                count = ((ones >> U64(16 * lane)) & U64(0xFFFF)).astype(np.int64)
                for i in np.flatnonzero(wide):  # beyond what a counter holds
                    count[i] = int(((w[first[i] : first[i] + total[i]] >> U64(16 * lane + shift)) & U64(1)).sum())
                out[:, k] |= (2 * count > total).astype(U64) << U64(16 * lane + shift)
    return out.view(np.uint32)


class Lines:
    """The lines of some texts that have ``least`` words or more."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        lines, row, number = split_lines(data, offsets)
        self.h, starts, ends, self.first = word_hashes(data, lines)
        self.bytes = ends - starts
        words = np.diff(self.first)
        self.use = np.flatnonzero(words >= least)
        self.row, self.number, self.words = row[self.use], number[self.use], words[self.use]
        #: hash of the words in their order
        self.item = span_hash(prefix_of_hashes(self.h), self.first[self.use], self.first[self.use + 1])

    def sketch(self, some: np.ndarray) -> list[np.ndarray]:
        """Wide sketches; the lanes' parity is the narrow one."""
        of, place = ragged(self.words[some])
        return parities(self.h[self.first[self.use[some]][of] + place], np.cumsum(self.words[some]) - self.words[some], len(_SKETCH))

    def entries(self, some: np.ndarray, common: Common, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these lines the places in ``some`` and what they meet others by: numbers (of a block, or beyond) and codes of 32 bits."""
        use, words = self.use[some], self.words[some]
        which, key = near_keys(self.h, self.bytes, self.first, use, common, percent)
        # numbers beyond the blocks' are part of a near key
        nth, code = (BLOCKS + (key >> U64(32)) % U64(256 - BLOCKS)).astype(np.uint8), key.astype(np.uint32)
        full = np.flatnonzero(words >= LEAST_WORDS)
        of, place = ragged(words[full])
        at = self.first[use[full]][of] + place
        # words of four bytes or more count, and all of a line that has none
        counts = self.bytes[at] >= 4
        total = np.bincount(of[counts], minlength=len(full))
        counts |= (total == 0)[of]
        total = np.bincount(of[counts], minlength=len(full))
        block = simhash_blocks(self.h[at[counts]], np.cumsum(total) - total, total)
        return (
            np.append(which, np.repeat(full, BLOCKS)),
            np.append(nth, np.tile(np.arange(BLOCKS, dtype=np.uint8), len(full))),
            np.append(code, block.reshape(-1)),
        )


def _rows_of(docs: pa.Table, own: np.ndarray, tag: np.ndarray, line: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Of each row that is meant by some of the places (own, tag, line): their places in the list, and the lines' numbers. Rows that agree in
    id and text are meant by the same places."""
    rows: dict[tuple[int, int], list[int]] = {}
    for r, k in enumerate(zip(_ids(docs["doc_id"]).tolist(), docs["tag"].to_numpy().tolist(), strict=True)):
        rows.setdefault(k, []).append(r)
    out: dict[int, list[tuple[int, int]]] = {}
    for k, (d, t, n) in enumerate(zip(own.tolist(), tag.tolist(), line.tolist(), strict=True)):
        for r in rows[d, t]:
            out.setdefault(r, []).append((k, n))
    return out


def _read(text: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    lower = pc.utf8_lower(text.fill_null(""))
    data, offsets = buffers(lower)
    found = np.flatnonzero(looked_up(data, _LEADS))
    if len(found):
        leads = np.searchsorted(found, offsets)
        unspaced = pa.array(leads[1:] > leads[:-1])
        spaced = pc.replace_substring_regex(lower.filter(unspaced), _UNSPACED, r" \1 ")
        data, offsets = buffers(pc.replace_with_mask(lower, unspaced, spaced))
    return looked_up(data, _READ), offsets


#: Kinds of payloads: what lines meet by; of each item its size and wide sketch; places; of each item how often it stands and where first; and keys.
_ENTRIES, _ITEMS, _PLACES, _FIRSTS, _KEYS = range(5)
_PLACE = (np.uint64, np.int64, np.int64, np.int32)
_SCANNED = "bucket int, kind int, payload binary"
_MET = f"{_SCANNED}, col long, nodes array<long>, big boolean"
#: What a key's item brings along.
_TOLD = np.dtype([("size", "<i4"), ("line", "<i4"), ("weight", "<i8"), ("doc", "<i8"), ("tag", "<i8"), ("sketch", "<u8", (len(_SKETCH),))])
_FIT = ", ".join(["col long, node long, n int, size int, weight long, doc long, tag long, line int", *(f"{x} long" for x in _SKETCH)])


def _bucket(item: np.ndarray, buckets: int) -> np.ndarray:
    return item.view(np.int64) % buckets


def _scan(buckets: int, least_words: int, common: Common, percent: int) -> Callable:
    """Packed by bucket: entries and sketches of items, an item once a task; and all places of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, U64)
        for t in gathered(batches, kept=_KEPT):
            ids, tags = _ids(t["doc_id"]), t["tag"].to_numpy()
            found, entered, told = [], [], []
            for i, _, d, o in chunks(*_read(t["text"])):
                x = Lines(d, o, least_words)
                found.append((x.item, ids[i + x.row], tags[i + x.row], x.number.astype(np.int32)))
                item, at = np.unique(x.item, return_index=True)
                new = np.searchsorted(seen, item, "right") == np.searchsorted(seen, item)
                which, nth, code = x.entries(at[new], common, percent)
                words, sketch = x.words[at[new]], x.sketch(at[new])
                entered.append((code, nth, np.minimum(words, 0xFFFF).astype(np.uint16)[which], item[new][which], np.bitwise_xor.reduce(sketch)[which]))
                told.append((item[new], words.astype(np.uint32), *sketch))
                seen = np.sort(np.append(seen, item[new]))
            columns: list[list] = [[], [], []]
            for kind, parts in ((_ENTRIES, entered), (_ITEMS, told), (_PLACES, found)):
                arrays = [np.concatenate(v) for v in zip(*parts, strict=True)]
                route = (mix(arrays[0].astype(U64) + (arrays[1].astype(U64) << U64(32))) % U64(buckets)).astype(np.int64) if kind == _ENTRIES else _bucket(arrays[0], buckets)
                for b, at in dealt(route):
                    for column, v in zip(columns, (b, kind, pack(*(x[at] for x in arrays))), strict=True):
                        column.append(v)
            yield _rows(["bucket", "kind", "payload"], columns, [pa.int32(), pa.int32(), pa.binary()])

    return run


def _lanes(sketch: np.ndarray) -> list[np.ndarray]:
    return [sketch] if sketch.ndim == 1 else [np.ascontiguousarray(x) for x in sketch.T]


def fit_parts(words: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Of the lines of one key, of rising sizes: the place of the first line that a chain of pairs of fitting sizes and sketches leads to."""
    part = np.arange(len(words))
    if len(words) > WHOLE_KEY:
        return np.zeros_like(part)
    lanes = _lanes(sketch)

    def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = words[a][:, None], words[b][None]
        common = -(-percent * np.maximum(x, y) // 100)  # at least, of similar lines
        differ = sum(np.bitwise_count(k[a][:, None] ^ k[b][None]).astype(np.int64) for k in lanes)
        return (np.minimum(x, y) >= common) & (differ <= x + y - 2 * common)

    if len(words) <= SQUARE_KEY:
        fits = fit(part, part)
        while True:
            low = np.where(fits, part[None], len(part)).min(axis=1)
            if (low == part).all():
                return part
            part = low
    left = part.copy()
    while len(left):
        first, reached, left = left[0], left[:1], left[1:]
        while len(reached) and len(left):
            some = max(1, _CELLS // len(left))
            met = fit(reached[:some], left).any(axis=0)
            reached = np.append(reached[some:], left[met])
            part[left[met]], left = first, left[~met]
    return part


def _parts_of_keys(key: np.ndarray, words: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines of rising keys and sizes: an order in which the connected parts of the keys stand together, and start and count of those parts that have several lines."""
    lanes = _lanes(sketch)
    # no pair fits across a gap of sizes
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (100 * words[:-1] < percent * words[1:])))
    count = np.diff(np.append(start, len(key)))
    part = np.arange(len(key))
    for m in range(2, SMALL_KEY + 1):
        at = start[count == m]
        of = np.tile(np.arange(m), (len(at), 1))
        fits = []
        for i, j in combinations(range(m), 2):
            a, b = at + i, at + j
            common = -(-percent * words[b] // 100)  # at least, of similar lines
            differ = sum(np.bitwise_count(k[a] ^ k[b]).astype(np.int64) for k in lanes)
            fits.append((i, j, (words[a] >= common) & (differ <= words[a] + words[b] - 2 * common)))
        changed = len(at) > 0
        while changed:
            before = of.copy()
            for i, j, ok in fits:
                low = np.minimum(of[:, i], of[:, j])
                of[:, i], of[:, j] = np.where(ok, low, of[:, i]), np.where(ok, low, of[:, j])
            changed = (of != before).any()
        part[at[:, None] + np.arange(m)] = at[:, None] + of
    for lo, n in zip(start[count > SMALL_KEY].tolist(), count[count > SMALL_KEY].tolist(), strict=True):
        part[lo : lo + n] = lo + fit_parts(words[lo : lo + n], sketch[lo : lo + n], percent)
    order = np.argsort(part, kind="stable")
    part = part[order]
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    count = np.diff(np.append(start, len(part)))
    return order, start[count > 1], count[count > 1]


def _names(item: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Name, start and count of runs of items: those of the same items are one."""
    if not len(start):
        return np.zeros(0, U64), start, count
    sums = np.append(U64(0), np.cumsum(mix(item)))
    name, first = np.unique(sums[start + count] - sums[start] + count.astype(U64), return_index=True)
    return name, start[first], count[first]


def _shared(percent: int) -> Callable:
    """Keys (col) that several items of fitting sizes and sketches have; of each bucket what its items are; places pass as they are."""
    names = ["bucket", "kind", "payload", "col", "nodes", "big"]

    def keys(bucket: int, values: list[bytes]) -> pa.RecordBatch:
        code, nth, words, item, sketch = (np.concatenate(x) for x in zip(*(unpack(v, np.uint32, np.uint8, np.uint16, np.uint64, np.uint64) for v in values), strict=True))
        key = code.astype(U64) + (nth.astype(U64) << U64(32))
        # most keys have one line only: those that no other falls together with go before all is sorted
        width = max(16, (2 * len(key)).bit_length())
        slot = (key * U64(0x9E3779B97F4A7C15) >> U64(64 - width)).astype(np.int64)
        several = np.flatnonzero(np.bincount(slot, minlength=1 << width)[slot] > 1)
        key, words, item, sketch = (key[several] << U64(16)) + words[several], words[several], item[several], sketch[several]
        order = np.lexsort((item, key))
        key, item, words, sketch = key[order] >> U64(16), item[order], words[order].astype(np.int64), sketch[order]
        new = np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1]))[: len(key)]
        key, item, words, sketch = key[new], item[new], words[new], sketch[new]
        order, start, count = _parts_of_keys(key, words, sketch, percent)
        item = item[order]
        name, start, count = _names(item, start, count)
        rows = -(-count // _ROW_ITEMS)
        of, nth = ragged(rows)
        size = np.minimum(count[of] - nth * _ROW_ITEMS, _ROW_ITEMS)
        which, place = ragged(size)
        nodes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(item[(start[of] + nth * _ROW_ITEMS)[which] + place].view(np.int64)))
        n = len(of)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int32)), pa.array(np.full(n, _KEYS, np.int32)), pa.nulls(n, pa.binary()), pa.array(name[of].view(np.int64)), nodes, pa.array(count[of] > WHOLE_KEY)], names=names)

    def firsts(item: np.ndarray, n: np.ndarray, doc: np.ndarray, tag: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((line, tag, doc, item))
        item, n = item[order], n[order]
        head = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        return item[head], np.add.reduceat(n, head), *(x[order][head] for x in (doc, tag, line))

    def told(rows: dict[tuple[int, int], bytes]) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array([b for b, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.int32()), pa.array(list(rows.values()), pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.bool_())], names=names)

    def end(bucket: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        if held[_ENTRIES]:
            yield keys(bucket, held[_ENTRIES])
        if held[_PLACES]:
            first = firsts(*(np.concatenate(x) for x in zip(*held[_PLACES], strict=True)))
            items = [np.concatenate(x) for x in zip(*(unpack(v, np.uint64, np.uint32, *[np.uint64] * len(_SKETCH)) for v in held[_ITEMS]), strict=True)]
            at = np.unique(items[0], return_index=True)[1]
            yield told({(bucket, _ITEMS): pack(*(x[at] for x in items)), (bucket, _FIRSTS): pack(*first)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, {}
        thrifty(_KEPT)
        for batch in batches:
            release()
            for b, kind, value in zip(*(batch[x].to_pylist() for x in names[:3]), strict=True):
                if b != bucket:
                    if held:
                        yield from end(bucket, held)
                    bucket, held = b, {_ENTRIES: [], _ITEMS: [], _PLACES: []}
                if kind == _PLACES:
                    item, doc, tag, line = unpack(value, *_PLACE)
                    value = firsts(item, np.ones(len(item), np.int64), doc, tag, line)
                held[kind].append(value)
            places = batch.filter(pc.equal(batch["kind"], _PLACES))
            if places.num_rows:
                yield pa.RecordBatch.from_arrays([*(places[x] for x in names[:3]), pa.nulls(places.num_rows, pa.int64()), pa.nulls(places.num_rows, pa.list_(pa.int64())), pa.nulls(places.num_rows, pa.bool_())], names=names)
        if held:
            yield from end(bucket, held)

    return run


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item of a key what its bucket, which comes first, knows of it."""
    thrifty(_KEPT)
    parts: dict[int, tuple] = {}
    bucket, item, told = None, np.zeros(0, U64), np.zeros(0, _TOLD)
    for batch in batches:
        release()
        head = batch.filter(pc.is_valid(batch["payload"]))
        for b, kind, value in zip(*(head[x].to_pylist() for x in ("bucket", "kind", "payload")), strict=True):
            parts[b, kind] = value
        rows = batch.filter(pc.is_null(batch["payload"]))
        of = rows["bucket"].to_numpy()
        for b in np.unique(of).tolist():
            if b != bucket:
                item, size, *sketch = unpack(parts.pop((b, _ITEMS)), np.uint64, np.uint32, *[np.uint64] * len(_SKETCH))
                _, weight, doc, tag, line = unpack(parts.pop((b, _FIRSTS)), np.uint64, *[np.int64] * 3, np.int32)
                told = np.empty(len(item), _TOLD)
                told["size"], told["line"], told["weight"], told["doc"], told["tag"], told["sketch"] = size, line, weight, doc, tag, np.stack(sketch, axis=1)
                bucket, parts = b, {k: v for k, v in parts.items() if k[0] > b}
            some = rows.filter(pa.array(of == b))
            raw = told[np.searchsorted(item, some["node"].to_numpy().view(U64))].tobytes()
            ends = np.arange(some.num_rows + 1, dtype=np.int32) * _TOLD.itemsize
            binary = pa.Array.from_buffers(pa.binary(), some.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([some["col"], some["node"], some["big"], binary], names=["col", "node", "big", "told"])


def _refine(percent: int) -> Callable:
    """Keys, each whole and in order, as the parts of them that wide sketches connect; those that are told whole stay so."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        col, node, big = t["col"].to_numpy(), t["node"].to_numpy().view(U64), t["big"].to_numpy()
        told = np.frombuffer(b"".join(t["told"].to_pylist()), _TOLD)
        order = np.lexsort((node, told["size"], col))
        order, whole = order[~big[order]], np.flatnonzero(big)
        inner, start, count = _parts_of_keys(col[order], told["size"][order].astype(np.int64), told["sketch"][order], percent)
        order = order[inner]
        name, start, count = _names(node[order], start, count)
        which, place = ragged(count)
        at = np.append(order[start[which] + place], whole)
        told = told[at]
        many = np.append(count[which], np.full(len(whole), WHOLE_KEY)).astype(np.int32)
        columns = [np.append(name[which].view(np.int64), col[whole]), node[at].view(np.int64), many, *(told[x] for x in ("size", "weight", "doc", "tag", "line")), *told["sketch"].view(np.int64).T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["col", "node", "n", "size", "weight", "doc", "tag", "line", *_SKETCH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, None
        for batch in batches:
            col = batch["col"].to_numpy()
            if not len(col):
                continue
            # what begins here of the last key may go on
            cut = int(np.searchsorted(col, col[-1]))
            if rows >= 100_000 and (cut > 0 or col[0] != last):
                held.append(batch.slice(0, cut))
                yield solve(pa.Table.from_batches(held))
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows, last = rows + batch.num_rows, col[-1]
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def _dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of items but the one that stays: by bucket first the items of groups with the place that the group keeps, then first places of
    all items, then places, walked payload by payload."""
    thrifty(_KEPT)
    bucket, own, first, kept = None, [], None, None
    for batch in batches:
        release()
        if not batch.num_rows:
            continue
        # runs of one bucket and kind
        at, kinds = batch["bucket"].to_numpy(), batch["kind"].to_numpy()
        edge = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (kinds[1:] != kinds[:-1])))[: len(at)]
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(at)], strict=True):
            if at[lo] != bucket:
                bucket, own, kept = at[lo], [], None
            some = batch.slice(lo, hi - lo)
            if kinds[lo] == -2:
                own.append([some[x].to_numpy() for x in ("node", "doc", "tag", "line")])
            elif kinds[lo] == -1:
                item, _, doc, tag, line = unpack(some["payload"][0].as_py(), np.uint64, *[np.int64] * 3, np.int32)
                first = np.rec.fromarrays([doc, tag, line], names="doc,tag,line")
                kept = item, first
                for node, *place in own:
                    k = np.searchsorted(item, node.view(U64))
                    first["doc"][k], first["tag"][k], first["line"][k] = place
            else:
                for value in some["payload"].to_pylist():
                    item, doc, tag, line = unpack(value, *_PLACE)
                    stays = kept[1][np.searchsorted(kept[0], item)]
                    gone = (stays["doc"] != doc) | (stays["tag"] != tag) | (stays["line"] != line)
                    if gone.any():
                        yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(tag[gone]), pa.array(line[gone])], names=["doc", "tag", "line"])


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, by bit vectors."""
    least, k, end = min(len(a), len(b)), 0, 0
    while k < least and a[k] == b[k]:
        k += 1
    while end < least - k and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[k : len(a) - end], b[k : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        x = eq | minus
        eq |= ((eq & plus) + plus) ^ plus
        up, down = minus | (full & ~(eq | plus)), plus & eq
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | (full & ~(x | up))) & full, up & x & full
    return score


def _similar(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a_id, b_id = t["a"].to_pylist(), t["b"].to_pylist()
            keep = []
            for x, y in zip(t["line_a"].to_pylist(), t["line_b"].to_pylist(), strict=True):
                x, y = x.split(" "), y.split(" ")
                longer = max(len(x), len(y))
                keep.append(100 * min(len(x), len(y)) >= percent * longer and 100 * (longer - edit_distance(x, y)) >= percent * longer)
            yield _rows(["a", "b"], [[x for x, k in zip(a_id, keep, strict=True) if k], [x for x, k in zip(b_id, keep, strict=True) if k]], [pa.int64(), pa.int64()])

    return run


def _fetch(key: tuple, docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """Normalised lines at the wanted places."""
    thrifty(_KEPT)
    release()
    item, ids, out = wanted["node"].to_numpy(), [], []
    rows = _rows_of(docs, wanted["doc"].to_numpy(), wanted["tag"].to_numpy(), wanted["line"].to_numpy())
    for r, places in rows.items():
        # neither lower case nor spaces between words make or take a line
        lines = docs["text"][r].as_py().split("\n")
        for k, n in places:
            ids.append(item[k])
            out.append(lines[n])
    data, offsets = _read(pa.array(out, pa.string()))
    raw, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
    text = [b" ".join(raw[x:y].tobytes().split()).decode() for x, y in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"node": pa.array(ids, pa.int64()), "text": pa.array(text, pa.string())})


def _cut(columns: list[str], text_col: str) -> Callable:
    def run(key: tuple, docs: pa.Table, gone: pa.Table) -> pa.Table:
        thrifty(_KEPT)
        release()
        by = {r: [n for _, n in places] for r, places in _rows_of(docs, gone["doc"].to_numpy(), gone["tag"].to_numpy(), gone["line"].to_numpy()).items()}
        texts = docs["text"].to_pylist()
        lines = [0 if t is None else t.count("\n") + 1 for t in texts]
        for r, drop in by.items():
            out = set(drop)
            texts[r] = "\n".join(x for k, x in enumerate(texts[r].split("\n")) if k not in out)
        removed = [sorted(by.get(r, [])) for r in range(len(texts))]
        out = {c: pa.array(texts, pa.string()) if c == text_col else docs[c] for c in columns}
        out["n_lines"] = pa.array(lines, pa.int64())
        out["n_removed"] = pa.array([len(x) for x in removed], pa.int64())
        out["removed"] = pa.array(removed, pa.list_(pa.int64()))
        return pa.table(out)

    return run


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int | None = None) -> DataFrame:
    """df with its text less the lines that go, and n_lines, n_removed and removed (their numbers, from 0)."""
    spark = df.sparkSession
    space = Workspace(spark, "lines")
    if percent < 70:
        raise ValueError("near_keys hold from 70 percent on")
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    # rows that repeat an id, or have none, are told apart by their texts, and dealt by these
    docs = df.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    buckets = buckets or groups_of(docs)
    common = common_runs(docs, min(MOST_SLOTS, max(1 << 18, 1 << (buckets * SLOTS_A_GROUP).bit_length())))
    scanned = docs.mapInArrow(_scan(buckets, least_words, common, percent), _SCANNED)
    tasks = tasks_of(buckets)
    found = space.save(scanned.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_shared(percent), _MET))

    def by_kind(*kinds: int) -> DataFrame:
        return found.where(F.col("kind").isin(*kinds)).select("bucket", "kind", "payload")

    def walked(told: DataFrame) -> DataFrame:
        return told.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind")

    def bucket_of(item: str) -> Column:
        return F.pmod(F.col(item), F.lit(buckets).cast("long")).cast("int").alias("bucket")

    # keys of the same lines are one key, here and once they are parts by wide sketches
    met = found.where(F.col("kind") == _KEYS).select("col", "nodes", "big").distinct().select("col", F.explode("nodes").alias("node"), "big")
    met = met.select(bucket_of("node"), F.lit(_KEYS).alias("kind"), "col", "node", "big")
    told = walked(by_kind(_ITEMS, _FIRSTS).unionByName(met, allowMissingColumns=True)).mapInArrow(_tell, "col long, node long, big boolean, told binary")
    salt = F.when(F.col("big"), F.pmod(F.col("node"), F.lit(tasks))).otherwise(F.lit(0))
    keys = space.save(told.repartition(tasks, "col", salt).sortWithinPartitions("col").mapInArrow(_refine(percent), _FIT).distinct())
    own = ["doc", "tag", "line", *_SKETCH]
    wanted = space.save(keys.select("node", *own).distinct())
    part, of_doc = (F.pmod(F.xxhash64(F.coalesce(F.col(x), F.lit(_NO_ID)), "tag"), F.lit(buckets)).cast("int").alias("part") for x in ("doc_id", "doc"))
    fetched = together(docs.select(part, "doc_id", "tag", "text"), wanted.select(of_doc, "node", "doc", "tag", "line"), buckets)
    texts = space.save(fetched.applyInArrow(_fetch, "node long, text string"))
    # a line that stands most often is the likely centre of its near copies
    keys = keys.select("col", "node", "n", "size", F.col("size").alias("room"), "weight")
    sketches = wanted.select("node", *_SKETCH)

    sides = {s: texts.select(F.col("node").alias(s), F.col("text").alias(f"line_{s}")) for s in "ab"}

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.join(sides["b"], "b").join(sides["a"], "a").select("a", "b", "line_a", "line_b").mapInArrow(_similar(percent), "a long, b long")

    def fits(size: Column, sketch: list[Column], pivot_size: Column, pivot_sketch: list[Column]) -> Column:
        """Similar lines have percent hundredths of the longer one's words in common."""
        differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(sketch, pivot_sketch, strict=True)), F.lit(0))
        return 100 * differ <= 100 * (size + pivot_size) - 2 * percent * F.greatest(size, pivot_size)

    groups, _ = linked(space, keys, verify, percent, sketches, fits)
    # of each group of items, and of each other item, all places but the first go
    placed = groups.join(wanted.select("node", F.struct("doc", "tag", "line").alias("first")), "node")
    kept = placed.join(placed.groupBy("component").agg(F.min("first").alias("kept")), "component").select(bucket_of("node"), F.lit(-2).alias("kind"), "node", "kept.*")
    stand = found.where(F.col("kind").isin(_FIRSTS, _PLACES)).select("bucket", F.when(F.col("kind") == _FIRSTS, -1).otherwise(F.col("kind")).alias("kind"), "payload")
    dropped = walked(stand.unionByName(kept, allowMissingColumns=True)).mapInArrow(_dropped, "doc long, tag long, line int")
    gone = space.save(dropped.select(of_doc, "doc", "tag", "line"))

    own = ["n_lines", "n_removed", "removed"]
    columns = [c for c in df.columns if c not in own]
    clash = {"part", "doc_id", "text", "tag"}
    inner = {c: c if c not in clash else f"__in_{c}" for c in columns}
    whole = df.select(*(F.col(c).alias(inner[c]) for c in columns if c != text_col), doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    fields = [T.StructField(inner[c], df.schema[c].dataType) for c in columns]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.LongType()))])
    cut = together(whole.withColumn("part", part), gone, buckets).applyInArrow(_cut([inner[c] for c in columns], inner[text_col]), schema)
    return cut.select(*(F.col(inner[c]).alias(c) for c in columns), *own)


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), least_words=1)
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op1_fuzzy_lines": op1_fuzzy_lines}
#: SimHash has no counterpart in SQL; the tests compare with brute force over all pairs of lines.
ORACLES: dict[str, str] = {}
