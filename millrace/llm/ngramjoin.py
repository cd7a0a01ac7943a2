"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

A document's row is its set of n-grams of words; two documents link when their rows overlap by at least
``percent`` hundredths of the union. The product of the matrix with its transpose is never written out:

* Columns are dealt to blocks by their hash and counted over all documents. A column of one
  document adds to no overlap and is dropped (its row keeps the size).
* Within a row the columns are ordered from rare to common. A partner must share p = n -
  ceil(percent n / 100) + 1 or fewer of the first columns (the size-derived bound), so only those propose
  entries of the product, and of those only the ones that other documents have.
* Rows with equal sets are one class, represented by its smallest id, before anything is paired.
* Proposed entries outside the bound of the sizes, or whose rows end too soon after the common column, are
  discarded; for the others a pivot's row is
  multiplied with the block of its partners' rows, which accumulates the overlap counts, and
  entries below the bound that the sizes give are discarded.
* Links lie within components, so once these are known the links of each row are counted there: in blocks of ``BLOCK``
  rows against ``BLOCK``, whose counts leave a task and whose pairs do not.
* A column that many rows share is not paired out: see ``clusters``. A row with few columns of its own is the likely
  centre of its near copies, and the pivot.

n-grams are told apart by 64-bit hashes, equal sets of them by 128-bit sums.

Defined cases: null text, and text without words, has the empty set and links with nothing; with
fewer words than n the whole sequence is the one n-gram; rows of one id are one node (a row each in
the result); a row with a null id links with nothing and has no component; very long texts are read whole; ties do not arise, as the smallest id names a component; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import gathered, release, thrifty
from .clusters import linked
from .kernel import LOWER, U64, buffers, chunks, mix, shingle_hashes, starts_within, word_hashes
from .repeats import _NO_ID, _ids, _key, _part, _rows, _stream, dealt, groups_of, pack, part_column, tasks_of, together, unpack
from .workspace import Workspace

GRAM, PERCENT = 4, 85
#: Rows of a component on each side of a block in which links are counted.
BLOCK = 512
#: Bytes of rows in such a block, about.
BLOCK_BYTES = 4 << 20
#: Columns of a block of the product: those whose hashes share so many bits, or so many columns at once.
_BLOCK_BITS, _DENSE = 3, 4096


def row_sets(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all rows, sorted within each row, and the row of each."""
    h, _, _, first = word_hashes(LOWER[data], offsets)
    at = starts_within(first, gram)
    row, key = np.searchsorted(first, at, "right") - 1, shingle_hashes(h, gram)[at]
    words = np.diff(first)
    for r in np.flatnonzero((words > 0) & (words < gram)):
        # the whole sequence; its length keeps it apart from the n-grams
        short = shingle_hashes(h[first[r] : first[r + 1]], int(words[r]))
        row, key = np.append(row, r), np.append(key, mix(short + U64(int(words[r]))))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    if len(row):
        new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))
        row, key = row[new], key[new]
    return row, key


def _columns(gram: int, buckets: int) -> Callable:
    """Count columns, before the shuffle: kind 0, a column's first document here and how many have it; kind 1, all documents of a
    column that several have here."""
    names, kinds = ["bucket", "kind", "payload"], [pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            doc, keys, docs = _ids(t["doc_id"]), [], []
            for i, _, d, o in chunks(*buffers(t["text"])):
                row, key = row_sets(d, o, gram)
                keys.append(key)
                docs.append(doc[i + row])
            h, doc = np.concatenate(keys), np.concatenate(docs)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            count = np.diff(np.append(new, len(s)))
            head = order[new]
            columns: list[list] = [[], [], []]
            by_doc = np.argsort(head)  # ids then rise within a bucket, and pack well
            head, local = head[by_doc], count[by_doc]
            for b, at in dealt((h[head] % U64(buckets)).astype(np.int64)):
                for x, y in zip(columns, (b, 0, pack(h[head[at]], doc[head[at]], local[at].astype(np.uint32))), strict=True):
                    x.append(y)
            again = np.sort(order[np.repeat(count > 1, count)])
            for b, at in dealt((h[again] % U64(buckets)).astype(np.int64)):
                for x, y in zip(columns, (b, 1, pack(h[again[at]], doc[again[at]])), strict=True):
                    x.append(y)
            yield _rows(names, columns, kinds)

    return run


def _frequencies(buckets: int) -> Callable:
    """Count columns, after the shuffle: tell each group of documents the columns that others have too, and how common they are
    (eighths of a power of two)."""
    names, kinds = ["part", "payload"], [pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def answers() -> pa.RecordBatch:
            part, key, level = (np.concatenate(x) for x in zip(*held, strict=True))
            columns: list[list] = [[], []]
            for p, at in dealt(part):
                columns[0].append(p)
                columns[1].append(pack(key[at], level[at]))
            return _rows(names, columns, kinds)

        def tell(h: np.ndarray, doc: np.ndarray, level: np.ndarray) -> int:
            held.append((_part(doc, buckets), _key(h, doc), level))
            return len(h)

        def settle(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
            h, doc, count = (np.concatenate(x) for x in zip(*(unpack(v, np.uint64, np.int64, np.uint32) for v in values), strict=True))
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            entries = np.diff(np.append(new, len(s)))
            total = np.add.reduceat(count[order].astype(np.int64), new)
            level = np.minimum(255, np.floor(np.log2(total) * 8)).astype(np.uint8)
            which = order[np.repeat(entries > 1, entries)]
            # a single entry of several documents is told by its own kind 1
            n = tell(h[which], doc[which], np.repeat(level, entries)[np.repeat(entries > 1, entries)])
            several = total > 1
            return s[new][several], level[several], n

        bucket, first, known = None, [], None
        for b, kind, value in _stream(batches):
            if b != bucket:
                if known is None and first:
                    size += settle(first)[2]
                bucket, first, known = b, [], None
            if kind == 0:
                first.append(value)
                continue
            if known is None:
                known = settle(first)
                size += known[2]
            h, doc = unpack(value, np.uint64, np.int64)
            size += tell(h, doc, known[1][np.searchsorted(known[0], h)])
            if size > 2_000_000:
                yield answers()
                held, size = [], 0
        if known is None and first:
            settle(first)
        if held:
            yield answers()

    return run


_ROW = "doc long, copies array<long>, n long, low long, high long, prefix array<long>, shared binary"


def _matrix(gram: int, percent: int) -> Callable:
    """Rows of the matrix, one for each set of the group: its smallest id, all of its ids, size, digest of the set, and, if the bound
    leaves columns that propose, these and all shared columns. Empty sets, and those of rows without an id, have a row each."""

    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        thrifty()
        release()
        doc = _ids(docs["doc_id"])
        got = [unpack(v, np.uint64, np.uint8) for v in told["payload"].to_pylist()]
        keys, levels = (np.concatenate([np.zeros(0, kind), *(g[k] for g in got)]) for k, kind in ((0, np.uint64), (1, np.uint8)))
        order = np.argsort(keys, kind="stable")
        keys, levels = keys[order], levels[order]
        total = len(doc)
        n, low, high = (np.zeros(total, np.int64) for _ in range(3))
        prefix: list = [None] * total
        shared: list = [None] * total
        for i, j, d, o in chunks(*buffers(docs["text"])):
            row, h = row_sets(d, o, gram)
            first = np.searchsorted(row, np.arange(j - i + 1))
            n[i:j] = np.diff(first)
            for out, salt in ((low, 0x9E3779B97F4A7C15), (high, 0xC2B2AE3D27D4EB4F)):
                sums = np.append(U64(0), np.cumsum(mix(h ^ U64(salt)), dtype=np.uint64))
                out[i:j] = (sums[first[1:]] - sums[first[:-1]]).view(np.int64)
            level = np.zeros(len(h), np.uint8)
            if len(keys):
                k = _key(h, doc[i + row])
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                hit = keys[at] == k
                level[hit] = levels[at[hit]]
            common = level > 0
            count = np.append(0, np.cumsum(common))[first]
            own = np.diff(count)
            size = np.diff(first)
            proposing = size - (percent * size + 99) // 100 + 1 - (size - own)
            for r in np.flatnonzero((proposing > 0) & (own > 0)):
                if doc[i + r] == _NO_ID:
                    continue
                part = slice(first[r], first[r + 1])
                x, lv = h[part][common[part]], level[part][common[part]]
                rare = np.lexsort((x, lv))[: proposing[r]]
                prefix[i + r] = x[rare].view(np.int64)
                shared[i + r] = x.tobytes()
        alone = (n == 0) | (doc == _NO_ID)
        order = np.lexsort((doc, np.where(alone, np.arange(total), -1), high, low, n))
        same = np.zeros(total, bool)
        same[1:] = ~alone[order][1:] & ~alone[order][:-1]
        for x in (n, low, high):
            same[1:] &= x[order][1:] == x[order][:-1]
        head = np.flatnonzero(~same)
        one = order[head]
        copies = pa.ListArray.from_arrays(pa.array(np.append(head, total), pa.int32()), docs["doc_id"].combine_chunks().take(pa.array(order)))
        columns = {"doc": docs["doc_id"].combine_chunks().take(pa.array(one)), "copies": copies, "n": pa.array(n[one]), "low": pa.array(low[one]), "high": pa.array(high[one])}
        return pa.table(columns | {"prefix": pa.array([prefix[k] for k in one], pa.list_(pa.int64())), "shared": pa.array([shared[k] for k in one], pa.binary())})

    return run


def _least_overlap(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """What rows of these sizes must have in common to link."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def _overlaps(percent: int) -> Callable:
    """Multiply the rows of the pairs block by block of columns. The counts add up; a pair leaves as soon as what the
    blocks to come hold of its rows cannot lift its count to the bound that the sizes give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            a_id, b_id = (t[c].to_numpy() for c in ("a", "b"))
            bound = _least_overlap(t["n_a"].to_numpy(), t["n_b"].to_numpy(), percent)
            side = [buffers(t[c]) for c in ("shared_a", "shared_b")]
            col = [data.view(U64) for data, _ in side]
            pair = [np.repeat(np.arange(len(a_id)), np.diff(ends) // 8) for _, ends in side]
            block = [(c >> U64(64 - _BLOCK_BITS)).astype(np.int8) for c in col]
            rest = [np.diff(ends) // 8 for _, ends in side]
            count, alive = np.zeros(len(a_id), np.int64), np.ones(len(a_id), bool)
            for k in range(1 << _BLOCK_BITS):
                here = [np.flatnonzero((b == k) & alive[p]) for b, p in zip(block, pair, strict=True)]
                # rows are sorted, so (pair, column) rises on both sides
                key = [(pair[s][at].astype(U64) << U64(40)) | (col[s][at] << U64(_BLOCK_BITS) >> U64(24)) for s, at in enumerate(here)]
                own, other = col[0][here[0]], col[1][here[1]]
                if len(own) and len(other):
                    at = np.searchsorted(key[0], key[1])
                    hit = np.zeros(len(other), bool)
                    for near in (0, 1):  # keys are shortened, so the whole column is compared, and the next one
                        x = np.minimum(at + near, len(own) - 1)
                        hit |= (own[x] == other) & (pair[0][here[0]][x] == pair[1][here[1]])
                    count += np.bincount(pair[1][here[1]][hit], minlength=len(count))
                for s in (0, 1):
                    rest[s] -= np.bincount(pair[s][here[s]], minlength=len(count))
                alive &= count + np.minimum(rest[0], rest[1]) >= bound
            yield pa.RecordBatch.from_arrays([pa.array(a_id[alive]), pa.array(b_id[alive])], names=["a", "b"])

    return run


def _degrees(percent: int) -> Callable:
    """Of the rows of two blocks of a component (or of one with itself): how many of the other block's each links with.
    The product of the blocks is added up over blocks of the columns that both have."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        thrifty()
        release()
        block, n = t["block"].to_numpy(), t["n"].to_numpy()
        sides = [np.flatnonzero(block == key[k].as_py()) for k in (1, 2)]
        data, offsets = buffers(t["shared"])
        row = np.repeat(np.arange(len(n)), np.diff(offsets) // 8)
        name, at = np.unique(data.view(U64), return_inverse=True)
        entries = []
        for side in sides:
            place = np.full(len(n), -1, np.int64)
            place[side] = np.arange(len(side))
            mine = place[row] >= 0
            entries.append((place[row[mine]], at[mine]))
        both = np.logical_and(*(np.bincount(c, minlength=len(name)) > 0 for _, c in entries))
        number = np.cumsum(both) - 1
        sparse = []
        for r, c in entries:
            r, c = r[both[c]], number[c[both[c]]]
            order = np.argsort(c, kind="stable")
            sparse.append((r[order], c[order]))
        common = np.zeros((len(sides[0]), len(sides[1])), np.float32)
        for lo in range(0, int(both.sum()), _DENSE):
            dense = []
            for (r, c), side in zip(sparse, sides, strict=True):
                part = slice(*np.searchsorted(c, [lo, lo + _DENSE]))
                m = np.zeros((len(side), _DENSE), np.float32)
                m[r[part], c[part] - lo] = 1
                dense.append(m)
            common += dense[0] @ dense[1].T
        link = common >= _least_overlap(n[sides[0]][:, None], n[sides[1]][None, :], percent)
        link &= sides[0][:, None] != sides[1][None, :]
        degree = np.zeros(len(n), np.int64)
        degree[sides[0]] = link.sum(axis=1)
        if key[1] != key[2]:
            degree[sides[1]] = link.sum(axis=0)
        return pa.table({"node": t["node"], "n_links": pa.array(degree)})

    return run


def degrees(groups: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(node, n_links): the links of every row of the components."""
    mine = groups.join(rows.select("node", F.length("shared").alias("__bytes")), "node")
    sizes = mine.groupBy("component").agg(F.count(F.lit(1)).alias("__size"), F.sum("__bytes").alias("__bytes")).where("__size > 1")
    placed = groups.join(sizes, "component")
    pairs = placed.where("__size = 2").select("node", F.lit(1).cast("long").alias("n_links"))
    blocks = F.ceil(F.greatest(F.col("__size") / BLOCK, F.col("__bytes") / BLOCK_BYTES))
    block = placed.where("__size > 2").select("node", "component", blocks.alias("__blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block"))
    cells = block.join(rows.select("node", "n", "shared"), "node").withColumn("__other", F.explode(F.expr("sequence(0L, __blocks - 1)")))
    cells = cells.select("component", F.least("block", "__other").alias("low"), F.greatest("block", "__other").alias("high"), "node", "n", "shared", "block")
    found = cells.groupBy("component", "low", "high").applyInArrow(_degrees(percent), "node long, n_links long")
    return found.groupBy("node").agg(F.sum("n_links").alias("n_links")).unionByName(pairs)


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, class_id (smallest id of the same set) and n_links
    (verified links of the class with other classes)."""
    space = Workspace(df.sparkSession, "jaccard")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = buckets or groups_of(docs)
    counted = docs.mapInArrow(_columns(gram, buckets), "bucket int, kind int, payload binary").repartition(tasks_of(buckets), "bucket").sortWithinPartitions("bucket", "kind")
    told = space.save(counted.mapInArrow(_frequencies(buckets), "part int, payload binary"))
    grouped = docs.select(part_column(F.col("doc_id"), buckets).alias("part"), "doc_id", "text")
    matrix = space.save(together(grouped, told, buckets).applyInArrow(_matrix(gram, percent), _ROW))

    real = matrix.where("n > 0 AND doc IS NOT NULL")
    classes = space.save(real.groupBy("low", "high", "n").agg(F.min("doc").alias("class_id")))
    # of equal sets only the smallest id's row; its group has kept it, as the smallest of all is so there too
    rows = space.save(matrix.where("shared IS NOT NULL").join(classes, ["low", "high", "n"]).where("doc = class_id").select(F.col("doc").alias("node"), "n", "prefix", "shared"))
    own = F.col("n") - F.length("shared") / 8  # columns of no other row, the rarest: they come before all that propose
    keys = rows.select(F.posexplode("prefix").alias("place", "col"), "node", F.col("n").alias("size"), own.cast("long").alias("own"))
    # up to its first common column a pair has nothing in common, so there the rest of each row bounds the overlap
    keys = keys.select("col", "node", "size", (F.col("size") - F.col("own") - F.col("place")).alias("room"), (-F.col("own")).alias("weight"))
    several = keys.groupBy("col").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("col")
    keys = space.save(keys.join(several, "col", "left_semi"))

    def verify(pairs: DataFrame) -> DataFrame:
        side = {s: rows.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("shared").alias(f"shared_{s}")) for s in "ab"}
        return pairs.join(side["b"], "b").join(side["a"], "a").select("a", "b", "n_a", "n_b", "shared_a", "shared_b").mapInArrow(_overlaps(percent), "a long, b long")

    groups, _ = linked(space, keys, verify, percent)
    degree = degrees(groups, rows, percent)
    found = space.save(classes.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").join(degree.withColumnRenamed("node", "class_id"), "class_id", "left"))
    real = matrix.where("n > 0 AND doc IS NOT NULL").select("copies", "n", "low", "high").join(found, ["low", "high", "n"], "left")
    none = F.lit(None).cast("long")
    alone = matrix.where("n = 0 OR doc IS NULL").select("copies", "n", *(none.alias(c) for c in ("component", "class_id", "n_links")))
    out = real.select(*alone.columns).unionByName(alone).select(F.explode("copies").alias("doc"), "n", "component", "class_id", "n_links")
    own = F.when(F.col("doc").isNull(), F.lit(None)).otherwise(F.coalesce("component", "class_id", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own.cast("long").alias("component_id"), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
#: No SQL that could run on whole tables; the tests use brute force.
ORACLES: dict[str, str] = {}
