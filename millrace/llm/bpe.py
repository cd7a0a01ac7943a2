"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pieces by the vocabulary's pattern. The distinct pieces of a batch lie end to end
as one array of symbols with links to the neighbours, and an index maps the rank of each adjacent
pair to all its positions. Active ranks are applied in ascending order, each at all its positions at
once: the two symbols become one, the pairs on either side are looked up anew, and their positions
enter the lists of their ranks. A merge can only make pairs of later rank, since a symbol is made
before any merge that uses it; that order is checked when the vocabulary is read.

Decoding goes from the ids alone: their bytes are joined and read as UTF-8. Special strings of the
vocabulary in a text become their ids, as the tokenizers library has it by default.

Only a file of kind byte-level BPE without normaliser is accepted. Its path is a parameter; the file is read where the
session runs and its merges reach the executors with the function (about 1 MB, fixed by the vocabulary).

Defined cases: null text counts as empty and gives no ids; very long texts are handled whole, the
vectors of a batch being bounded by its own size; of places of one rank the leftmost is merged first, which settles ties; ids take no part, so that null and repeated ones
pass; repeated rows give equal results; an empty table
gives an empty result; further columns are kept by ``encode`` and ignored by the query.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .arrowmap import gathered
from .kernel import ragged

#: The published pre-tokenizer pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts encoded at once, in characters.
BATCH_CHARS = 12_000_000


def _byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges by rank over token ids, the bytes of every token, and the special strings."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if not plain or odd or spec["normalizer"]:
            raise ValueError("a plain byte-level BPE vocabulary without normaliser is needed")
        letters, ids = _byte_letters(), model["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token) if token not in self.special else token.encode()
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        made = {int(t): r for r, t in enumerate(self.merged)}
        if any(made.get(int(x), -1) >= r for r, p in enumerate(zip(left, right, strict=True)) for x in p):
            raise ValueError("a merge uses a symbol that a later one makes")
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.left, self.right = left, right

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it is none."""
        k = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.order[at], -1)

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of ids of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        if not n:
            return sym, lengths
        piece, _ = ragged(lengths)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True))
        nxt[last] = n  # n: none
        prv[np.append(0, last[:-1] + 1)] = n
        sym = np.append(sym, -1)
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions into the index."""
            at = at[nxt[at] < n]
            r = self.rank(sym[at], sym[nxt[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, part in zip(r[np.append(0, cut)].tolist(), np.split(at, cut), strict=True):
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(active, k)

        enter(np.flatnonzero(np.append(piece[1:] == piece[:-1], False)))
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (sym[at] == a)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # of overlapping pairs every second one, from the left
                at = np.unique(at)
                follows = np.append(False, nxt[at[:-1]] == at[1:])
                begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            alive[gone] = False
            sym[at] = self.merged[r]
            nxt[at] = after
            inner = after < n
            prv[after[inner]] = at[inner]
            before = prv[at]
            before = before[before < n]
            enter(np.concatenate([before, at]))
        ids = sym[:n][alive]
        return ids, np.bincount(piece[alive], minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        cut, known, of_piece, counts = _pattern().findall, {}, [], []
        special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        for text in texts:
            parts = special.split(text) if special and any(s in text for s in self.special) else [text]
            n = 0
            for part in parts:
                # a special string is a piece of its own, told from ordinary text by its key
                found = [(part,)] if part in self.special else cut(part)
                of_piece.extend([known.setdefault(p, len(known)) for p in found])
                n += len(found)
            counts.append(n)
        names = list(known)
        plain = [b"" if isinstance(p, tuple) else p.encode() for p in names]
        ids, size = self.pieces(plain)
        if any(isinstance(p, tuple) for p in names):
            begin = np.cumsum(size) - size
            parts = [np.array([self.special[p[0]]]) if isinstance(p, tuple) else ids[b : b + s] for p, b, s in zip(names, begin, size, strict=True)]
            ids, size = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(size) - size
        pieces = np.array(of_piece, np.int64)
        item, place = ragged(size[pieces])
        out = ids[begin[pieces][item] + place].astype("<u4")
        ends = np.append(0, np.cumsum(size[pieces]))
        of_text = np.append(0, np.cumsum(counts)).astype(np.int64)
        return out, np.diff(ends[of_text])

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


@lru_cache(4)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def _columns(spec: str, text: pa.Array, what: str) -> Iterator[tuple[int, int, list[pa.Array]]]:
    v = _vocabulary(spec)
    texts = [t or "" for t in text.to_pylist()]
    for i, j in _runs(texts):
        ids, n = v.encode(texts[i:j])
        ends = np.append(0, np.cumsum(n))
        parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if what == "ids":
            yield i, j, [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))]
        else:
            yield i, j, [
                pa.array(n, pa.int64()),
                pa.array([hashlib.sha256(p.tobytes()).hexdigest() for p in parts]),
                pa.array([hashlib.sha256(v.decode(p).encode()).hexdigest() for p in parts]),
            ]


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the token ids of its text as array<int>. ``vocabulary``: path of the tokenizers file."""
    spec = open(vocabulary, encoding="utf-8").read()
    if ids_col in df.columns:
        raise ValueError(f"the table has a column {ids_col}; name another")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            for i, j, (ids,) in _columns(spec, t[text_col].combine_chunks(), "ids"):
                part = t.slice(i, j - i).combine_chunks()
                yield from part.append_column(ids_col, ids).to_batches()

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with its ids read back as text in ``text_col`` (in place of a column of that name); null ids give null."""
    spec = open(vocabulary, encoding="utf-8").read()
    kept = [f for f in df.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(spec)
        for b in batches:
            ids = b[ids_col]
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            texts = [v.decode(flat[x:y]) if ok else None for x, y, ok in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), text_col])

    return df.mapInArrow(run, StructType([*kept, StructField(text_col, StringType())]))


def digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    spec = open(vocabulary, encoding="utf-8").read()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            doc = t["doc_id"].combine_chunks()
            for i, j, columns in _columns(spec, t["text"].combine_chunks(), "digests"):
                yield pa.RecordBatch.from_arrays([doc.slice(i, j - i), *columns], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary or default_vocabulary())


QUERIES = {"op10_bpe": op10_bpe}
#: No SQL: the tests compare with the tokenizers library.
ORACLES: dict[str, str] = {}
