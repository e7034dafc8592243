"""Corpus encoding with a byte-level BPE (problem 7).

Each Arrow batch is cut into pretokens; the distinct pretokens not seen before by this worker are grouped by length
into padded matrices, and all rows of a matrix merge together: every round looks up the rank of each adjacent pair in
an open-addressing hash table, merges each row's leftmost pair of minimum rank, and closes the gap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: Fixed: how this public vocabulary cuts text before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
CACHE = 400_000
LONGEST_CACHED = 64


@dataclass
class Vocabulary:
    """Byte ids, and the merge table as a hash table of `slots` (a power of two) with linear probing."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray

    def lookup(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the pair has no merge."""
        mask = np.uint64(len(self.keys) - 1)
        at = _slot(key, len(self.keys))
        found = np.full(key.shape, -1, np.int64)
        open_ = np.arange(key.size)
        while open_.size:
            here = self.keys[at[open_]]
            hit = here == key[open_]
            found[open_[hit]] = at[open_[hit]].astype(np.int64)
            open_ = open_[~hit & (here != EMPTY)]
            at[open_] = (at[open_] + np.uint64(1)) & mask
        return found


EMPTY = np.uint64(2**64 - 1)


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (slots.bit_length() - 1))


def load(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Vocabulary:
    """Read `<folder>/<name>.json` (vocabulary and merges in the byte-to-character notation)."""
    model = json.loads(Path(folder, f"{name}.json").read_text(encoding="utf-8"))["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.uint64)
    slots = 1 << (4 * len(pairs)).bit_length()
    keys = np.full(slots, EMPTY)
    ranks = np.full(slots, NONE, np.int32)
    merged = np.zeros(slots, np.int32)
    at, todo = _slot(key, slots), np.arange(len(pairs))
    target = np.array([vocab[a + b] for a, b in pairs], np.int32)
    while todo.size:
        free = todo[keys[at[todo]] == EMPTY]
        place, first = np.unique(at[free], return_index=True)
        won = free[first]
        keys[place], ranks[place], merged[place] = key[won], won, target[won]
        todo = np.setdiff1d(todo, won, assume_unique=True)
        at[todo] = (at[todo] + (keys[at[todo]] != EMPTY)) & np.uint64(slots - 1)
    return Vocabulary(np.array([vocab[char[b]] for b in range(256)], np.int32), keys, ranks, merged)


def merge_rows(ids: np.ndarray, vocab: Vocabulary) -> list[np.ndarray]:
    """Merge every row of a matrix padded with -1 until no pair is left; equal pairs of one row merge in one round.

    Merges made of a new token always rank after the merge that made it, so doing all of a row's disjoint occurrences
    of its best pair at once gives what merging only the leftmost one and looking again would give.
    """
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(ids)
    live = np.arange(len(ids))
    while live.size:
        left, right = ids[:, :-1], ids[:, 1:]
        ok = right >= 0
        slot = np.full(left.shape, -1, np.int64)
        slot[ok] = vocab.lookup((left[ok].astype(np.uint64) << np.uint64(32)) | right[ok].astype(np.uint64))
        rank = np.where(slot >= 0, vocab.ranks[slot], NONE)
        best = rank.min(axis=1, initial=NONE)
        done = best == NONE
        if done.any():
            for r in np.flatnonzero(done):
                row = ids[r]
                out[live[r]] = row[row >= 0].copy()
            keep = ~done
            ids, live, slot, rank, best = ids[keep], live[keep], slot[keep], rank[keep], best[keep]
            if not live.size:
                break
        take = rank == best[:, None]
        # of a run of overlapping occurrences (aaa) every second one is taken, from the left
        width = take.shape[1]
        starts = np.where(take & ~np.pad(take, ((0, 0), (1, 0)))[:, :-1], np.arange(width), 0)
        take &= (np.arange(width) - np.maximum.accumulate(starts, axis=1)) % 2 == 0
        r, c = np.nonzero(take)
        ids[r, c] = vocab.merged[slot[r, c]]
        ids[r, c + 1] = -2
        order = np.argsort(ids < 0, axis=1, kind="stable")
        ids = np.take_along_axis(np.where(ids < 0, -1, ids), order, axis=1)
        longest = int((ids >= 0).sum(axis=1).max())
        ids = np.ascontiguousarray(ids[:, :longest])
    return out


def encode_pretokens(tokens: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each pretoken; lengths that round up to the same width share a matrix."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    width = np.where(sizes <= 16, (sizes + 1) // 2 * 2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(tokens)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        step = max(1, 2_000_000 // max(int(w), 1))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            ids = np.full((len(part), int(w)), -1, np.int32)
            flat = vocab.byte_ids[np.frombuffer(b"".join(tokens[i] for i in part), np.uint8)]
            ids[np.arange(int(w)) < sizes[part][:, None]] = flat
            for i, got in zip(part, merge_rows(ids, vocab), strict=True):
                out[i] = got
    return out


class Encoder:
    """Encodes batches of texts; remembers short pretokens, up to a fixed number."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.cut = vocab, regex.compile(PRETOKEN).findall
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        ids = encode_pretokens([t.encode("utf-8", "replace") for t in new], self.vocab)
        base = len(self.offsets) - 1
        self.index.update(zip(new, range(base, base + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, *ids])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])

    def lengths_and_ids(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Token count of each text, and the ids of all texts one after another."""
        cut = self.cut
        parts = [cut(t) if t else [] for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = [t for p in parts for t in p]
        if len(self.index) > CACHE or len(self.flat) > 8 * CACHE:
            self._reset()
        new = set(flat) - self.index.keys()
        if new:
            self._learn(list(new))
        where = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        size = self.offsets[where + 1] - self.offsets[where]
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = np.concatenate([[0], np.cumsum(n)])
        lengths = ends[bounds[1:]] - ends[bounds[:-1]]
        got = None
        if ids:
            got = self.flat[np.repeat(self.offsets[where] - ends[:-1], size) + np.arange(ends[-1])]
        for t in [t for t in new if len(t) > LONGEST_CACHED]:
            del self.index[t]
        return lengths, got


def _batches(texts: pa.ChunkedArray | pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about `most` characters, so that one batch of long texts stays small."""
    start, size, run = 0, 0, []
    for t in texts.to_pylist():
        run.append(t)
        size += len(t or "")
        if size > most:
            yield start, run
            start, size, run = start + len(run), 0, []
    if run:
        yield start, run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, ids: bool = True) -> DataFrame:
    """`key` with `ids:array<int>`, or with `n_tokens:int` if `ids` is false.

    Null and empty texts have an empty list (0 tokens); strings of special tokens are ordinary text; every row gives
    one row, repeated keys included; an empty table gives an empty table; other columns are not read. The vocabulary
    (about 3 MB, a fixed size) goes to the workers as a broadcast variable.
    """
    spark = df.sparkSession
    vocab = spark.sparkContext.broadcast(load(name, folder))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value)
        for b in batches:
            keys, column = b.column(0), b.column(1)
            for start, texts in _batches(column):
                lengths, flat = encoder.lengths_and_ids(texts, ids)
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                else:
                    made = pa.array(lengths.astype(np.int32))
                yield pa.RecordBatch.from_arrays([keys.slice(start, len(texts)), made], [key, "ids" if ids else "n_tokens"])

    made = "ids array<int>" if ids else "n_tokens int"
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {made}")
