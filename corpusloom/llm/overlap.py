"""The same or nearly the same records across splits (problem 1).

Texts are folded to bare letters and digits (case, accents, punctuation, spacing and look-alike forms set aside). Two texts
are a case if of each at least OVERLAP lies in runs of MEASURED letters that the other has. Equal texts are one class, and
only classes are compared. Every pair of classes that meets the threshold comes out:

* Each run of MEASURED letters has an anchor, the ANCHOR letters in it with the least hash. A run that two texts share has
  the same anchor in both, so letters of a text none of whose runs' anchors the other text has cannot be shared.
* The anchors of the evaluation texts make an index of blocks. For each training text the anchors are looked up that few
  texts of a block have: those which at least SEARCHED of its letters depend on. What a pair shares of these letters
  bounds its overlap from above: first by a sum over the anchors, then by the letters themselves, then by all anchors
  of both texts. Only pairs of which a bound is under OVERLAP are dropped.
* The pairs left are measured on the texts, by runs that begin at every letter.

Class pairs are expanded to record pairs at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.viet import fold, fold_table
from corpusloom.session import stored

#: Names of the evaluation splits and of the training split, the defaults.
EVALUATION = ("validation", "test", "eval_100")
TRAINING = "train"
#: Letters that cut a chunk and are its digest.
WINDOW = 10
#: Letters of a run in the measure (about four words), and the least overlap fraction of both texts of a case:
#: four fifths less what runs of five words lose.
MEASURED, OVERLAP = 16, 0.68
#: Letters of an anchor, and the runs of a stretch at most, so that a byte holds them.
ANCHOR, LONGEST = 13, 255
#: The share of a text's letters whose anchors are looked up in the index; more than 1 - OVERLAP. It decides on speed alone.
SEARCHED = 0.46
#: Evaluation texts (numbered in 16 bits) and anchors of a block of the index, and anchors of training texts held at once.
BLOCK_TEXTS, BLOCK_ANCHORS, HELD_ANCHORS = 60_000, 13_500_000, 4_000_000
#: Matches of anchors that are counted at once, and letters of training texts that are prepared at once.
STEP, PART = 1_000_000, 150_000
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, .. of each of the ranges, one range after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Chunker:
    """Digests, anchors and chunks of many texts at once."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = 1 << (n - 1).bit_length()
            one = np.full(size, _BASE, np.uint64)
            back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            one[0] = back[0] = 1
            self.powers, self.inverse = np.multiply.accumulate(one), np.multiply.accumulate(back)

    def _folded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds of the texts among all their letters, running sums of these, digest of each text)."""
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        codes = fold_table()[raw]
        kept = codes != 0
        total = np.concatenate([[0], np.cumsum(kept)])
        bounds = np.concatenate([[0], total[ends]])
        codes = _mix(codes[kept].astype(np.uint64))
        size = len(codes)
        self._grow(size + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.powers[:size], dtype=np.uint64)])
        whole = _mix((sums[bounds[1:]] - sums[bounds[:-1]]) * self.inverse[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)
        return bounds, sums, whole

    def anchors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest of each text, stretches of each text, anchor and length of each stretch).

        A stretch are the MEASURED letters' runs, one from each letter on, with one anchor; its length is their number,
        LONGEST at most: more runs make several stretches.
        Anchors are 32 bits of a hash. A text of fewer letters than MEASURED has no stretch.
        """
        bounds, sums, whole = self._folded(texts)
        n, size = np.diff(bounds), len(sums) - 1
        if size < MEASURED:
            return whole, np.zeros(len(n), np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        least = (_mix((sums[ANCHOR:] - sums[:-ANCHOR]) * self.inverse[: size - ANCHOR + 1]) >> np.uint64(32)).astype(np.uint32)
        wide, span = MEASURED - ANCHOR + 1, 1
        while span < wide:
            step = min(span, wide - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        runs = np.maximum(n - MEASURED + 1, 0)
        inside = np.ones(size, bool)
        inside[_ranges(bounds[1:] - (n - runs), n - runs)] = False
        least = least[inside[: len(least)]]
        owner = np.repeat(np.arange(len(n)), runs)
        at = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])[: len(least)])
        parts = -(-np.diff(np.append(at, len(least))) // LONGEST)
        at = np.repeat(at, parts) + LONGEST * _ranges(np.zeros(len(at), np.int64), parts)
        return whole, np.bincount(owner[at], minlength=len(n)), least[at], np.diff(np.append(at, len(least))).astype(np.uint8)

    def __call__(self, texts: list[str], chunks: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(letters of each text, digest of each text, chunks of each text, digest and length of each chunk).

        A text is cut where the hash of the last WINDOW letters is below a bound that leaves about `chunks` chunks; of two
        texts, the shorter is cut wherever the longer is in what they share. Without `chunks` there are none.
        """
        bounds, sums, whole = self._folded(texts)
        n, size = np.diff(bounds), len(sums) - 1
        if chunks is None:
            return n, whole, np.zeros(len(n), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        # the digest of the letters up to each one, WINDOW of them or, near the text's start, fewer
        stop = np.arange(1, size + 1)
        start = np.maximum(stop - WINDOW, np.repeat(bounds[:-1], n))
        digest = _mix((sums[1:] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))
        bound = np.minimum(chunks / np.maximum(n, 1), 0.5) * 2.0**32
        cutting = (_mix(digest + np.uint64(WINDOW)) >> np.uint64(32) < np.repeat(bound.astype(np.uint64), n)) & (stop - start == WINDOW)
        cutting[bounds[1:][n > 0] - 1] = True
        at = np.flatnonzero(cutting)
        counts = np.diff(np.searchsorted(at, bounds, side="left"))
        before = np.concatenate([[-1], at[:-1]])[: len(at)]
        length = at - np.maximum(before, np.repeat(bounds[:-1], counts) - 1)
        return n, whole, counts, digest[at].view(np.int64), length.astype(np.int32)


def _runs(texts: list[str], most: int = 250_000) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def identified(df: DataFrame, text: str) -> DataFrame:
    """The other columns of `df` with text_id (digest of the folded text), made in place, without a shuffle.

    Texts without letters or digits, and null ones, give no row.
    """
    others = [c for c in df.columns if c != text]
    types = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in others)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()
        for b in batches:
            texts = [t or "" for t in b.column(len(others)).to_pylist()]
            for part in _runs(texts):
                n, whole, *_ = chunker(texts[part], None)
                columns = [c.slice(part.start, part.stop - part.start) for c in b.columns[: len(others)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(whole)], [*others, "text_id"]).filter(pa.array(n > 0))

    return df.select(*others, text).mapInArrow(of, f"{types}text_id long")


class Texts:
    """Texts by their anchors: id of each, where its stretches begin, anchor (v) and length (w) of each stretch."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.ids, self.v, self.w = ids, v, w
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        upto = np.concatenate([[0], np.cumsum(w, dtype=np.int32)])
        first = upto[self.starts[:-1]]
        self.n = upto[self.starts[1:]] - first + MEASURED - 1
        # the letters from begins on, w and MEASURED - 1 of them, are in runs of the stretch
        self.begins = (upto[:-1] - np.repeat(first, counts)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.ids)

    @cached_property
    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(the distinct anchors in ascending order, the number of each stretch's among them)."""
        order = np.argsort(self.v)
        v = self.v[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])[: len(v)]
        number = np.empty(len(v), np.int32)
        number[order] = np.cumsum(new, dtype=np.int32) - 1
        return v[new], number


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """The distinct texts of the first columns of a partition that have a stretch."""
    chunker, seen = Chunker(), set()
    for b in batches:
        texts = [t or "" for t in b.column(0).to_pylist()]
        for part in _runs(texts):
            ids, counts, v, w = chunker.anchors(texts[part])
            new = np.zeros(len(ids), bool)
            for i, k in enumerate(ids.tolist()):
                if counts[i] and k not in seen:
                    seen.add(k)
                    new[i] = True
            kept = np.repeat(new, counts)
            yield Texts(ids[new], counts[new], v[kept], w[kept])


def _joined(parts: list[Texts]) -> Texts:
    return Texts(*(np.concatenate([f(t) for t in parts]) for f in (lambda t: t.ids, lambda t: np.diff(t.starts), lambda t: t.v, lambda t: t.w)))


def index(rows: DataFrame) -> DataFrame:
    """(ids, counts, v, w: arrays in bytes): blocks of the distinct texts of the column document, by their anchors.

    Texts come together by their digest, in blocks of at most BLOCK_TEXTS texts and about BLOCK_ANCHORS anchors.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _anchored(batches):
            lists = [pa.array([x[i:j].tobytes() for i, j in zip(t.starts[:-1].tolist(), t.starts[1:].tolist(), strict=True)], pa.binary()) for x in (t.v, t.w)]
            yield pa.RecordBatch.from_arrays([pa.array(t.ids), *lists], ["text_id", "v", "w"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bytes, bytes]] = {}
        size, seen = 0, set()

        def block() -> pa.RecordBatch:
            counts = np.array([len(v) // 4 for v, _ in held.values()], np.int32)
            columns = [np.array(list(held), np.int64).tobytes(), counts.tobytes(), b"".join(v for v, _ in held.values()), b"".join(w for _, w in held.values())]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["ids", "counts", "v", "w"])

        for b in batches:
            for k, v, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k in seen:
                    continue
                seen.add(k)
                held[k] = v, w
                size += len(v) // 4
                if len(held) >= BLOCK_TEXTS or size >= BLOCK_ANCHORS:
                    yield block()
                    held, size = {}, 0
        if held:
            yield block()

    made = stored(rows.select("document").mapInArrow(of, "text_id long, v binary, w binary"))
    texts, anchors = made.agg(F.count("*"), F.coalesce(F.sum(F.length("v")), F.lit(0))).first()
    blocks = max(1, -(-10 * texts // (9 * BLOCK_TEXTS)), -(-10 * anchors // (36 * BLOCK_ANCHORS)))
    return made.repartition(blocks, "text_id").mapInArrow(gathered, "ids binary, counts binary, v binary, w binary")


class Block(Texts):
    """Texts of the index with the texts of each anchor."""

    def __init__(self, ids: bytes, counts: bytes, v: bytes, w: bytes):
        many, v_ = np.frombuffer(counts, np.int32), np.frombuffer(v, np.uint32)
        pair = v_.astype(np.uint64)
        pair <<= np.uint64(16)
        pair |= np.repeat(np.arange(len(many), dtype=np.uint16), many)
        pair.sort()
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
        self.having = pair.astype(np.uint16)
        pair >>= np.uint64(16)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        self.anchor, self.first, self.many = pair[first].astype(np.uint32), first, np.diff(np.append(first, len(pair)))
        del pair
        super().__init__(np.frombuffer(ids, np.int64), many, v_, np.frombuffer(w, np.uint8))

    def found(self, t: Texts) -> Iterator[tuple[int, np.ndarray]]:
        """(text of t, the texts here that may overlap with it)."""
        anchors, number = t.anchors
        place = np.minimum(np.searchsorted(self.anchor, anchors), len(self.anchor) - 1)
        many = np.where(self.anchor[place] == anchors, self.many[place], 0).astype(np.int32)
        place = self.first[place]
        start = 0
        for stop in (np.flatnonzero(np.diff(np.cumsum(t.n) // PART, append=-1)) + 1).tolist():
            own = number[t.starts[start] : t.starts[stop]]
            yield from self._found(t, start, stop, place[own], many[own])
            start = stop

    def _found(self, t: Texts, start: int, stop: int, place: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The same for the texts start, start + 1, .. before stop of t, whose anchors the texts place, place + 1, .. of `having` have, `many` each."""
        own = slice(t.starts[start], t.starts[stop])
        w, n, counts = t.w[own], t.n[start:stop], np.diff(t.starts[start : stop + 1])
        # a letter is told by its commonest anchor; letters whose anchors are all among the looked up ones are the searched
        ends = np.cumsum(n, dtype=np.int64)
        inside = np.ones(ends[-1], bool)
        inside[_ranges(ends - (MEASURED - 1), np.full(len(n), MEASURED - 1))] = False
        common = np.zeros(ends[-1], np.int32)
        common[inside] = np.repeat(many, w)
        span = 1
        while span < MEASURED:
            step = min(span, MEASURED - span)
            common[step:] = np.maximum(common[step:], common[:-step])
            span += step
        rank = np.minimum((SEARCHED * n).astype(np.int64), n - 1)
        most = np.array([np.partition(common[e - m : e], r)[r] for e, m, r in zip(ends.tolist(), n.tolist(), rank.tolist(), strict=True)], np.int32)
        upto = np.concatenate([[0], np.cumsum(common <= np.repeat(most, n))])
        need = upto[ends] - upto[ends - n] - (1 - OVERLAP) * n - 1e-6
        begins = t.begins[own] + np.repeat(ends - n, counts)
        first, last = upto[begins], upto[begins + w + (MEASURED - 1)]
        used = np.flatnonzero((many > 0) & (many <= np.repeat(most, counts)) & (last > first))
        bounds = np.searchsorted(used, t.starts[start : stop + 1] - t.starts[start]).tolist()
        first, last, many, place = first[used], last[used], many[used], place[used]
        begin, end = place.tolist(), (place + many).tolist()
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            some = slice(bounds[i], bounds[i + 1])
            hit = self._of(need[i], first[some], last[some], begin[some], end[some], many[some])
            hit = hit[self.ids[hit] != t.ids[start + i]]
            own = slice(t.starts[start + i], t.starts[start + i + 1])
            for few in _steps(self.starts[hit + 1] - self.starts[hit]):
                left = self._theirs(t.v[own], hit[few])
                left = self._whole(int(n[i]), t.begins[own], t.w[own], t.v[own], left) if len(left) else left
                if len(left):
                    yield start + i, left

    def _of(self, need: float, start: np.ndarray, stop: np.ndarray, begin: list[int], end: list[int], many: np.ndarray) -> np.ndarray:
        """The texts that have at least `need` of the searched letters of a text by its looked up anchors.

        An anchor tells the searched letters from start to stop; the texts begin, begin + 1, .. before end of `having` have it.
        """
        weight, steps, sums = (stop - start).astype(float), list(_steps(many)), 0.0
        for some in steps:
            texts = np.concatenate([self.having[i:j] for i, j in zip(begin[some], end[some], strict=True)]).astype(np.intp)
            sums = sums + np.bincount(texts, np.repeat(weight[some], many[some]), len(self))
        near = sums >= need
        left, kind, bits = [], *((np.uint32, 16) if len(many) < 1 << 16 else (np.uint64, 32))
        for some in steps:
            if len(steps) > 1:
                texts = np.concatenate([self.having[i:j] for i, j in zip(begin[some], end[some], strict=True)]).astype(np.intp)
            at = np.flatnonzero(near.take(texts))
            left.append(texts.take(at).astype(kind) << kind(bits) | np.repeat(np.arange(some.start, some.stop, dtype=kind), many[some]).take(at))
        key = np.concatenate(left) if len(left) > 1 else left[0]
        key.sort()
        number = (key & kind((1 << bits) - 1)).astype(np.intp)
        texts = (key >> kind(bits)).astype(np.intp)
        first = _firsts(texts)
        if not len(first):
            return first
        letters = _union(start.take(number), stop.take(number), first)
        return texts[first[np.add.reduceat(letters, first) >= need]]

    def _theirs(self, v: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Those of the texts `hit` of which their anchors, by 16 bits of each, do not say that they have less than OVERLAP in a text of anchors v."""
        low = np.zeros(1 << 16, bool)
        low[v.astype(np.uint16)] = True
        first = self.starts[hit]
        size = self.starts[hit + 1] - first
        own = [slice(i, j) for i, j in zip(first.tolist(), (first + size).tolist(), strict=True)]
        shown = low.take(np.concatenate([self.v[x] for x in own]).astype(np.uint16))
        bounds = np.concatenate([[0], np.cumsum(size)])
        many = np.add.reduceat(shown, bounds[:-1], dtype=np.intp)
        at = np.flatnonzero(shown)
        begins = np.concatenate([self.begins[x] for x in own]).take(at)
        ends = begins + np.concatenate([self.w[x] for x in own]).take(at)
        ends += MEASURED - 1
        some = np.flatnonzero(many)
        first = (np.cumsum(many) - many)[some]
        letters = np.add.reduceat(_union(begins, ends, first), first) if len(some) else first
        return hit[some[letters >= OVERLAP * self.n[hit[some]] - 1e-6]]

    def _whole(self, n: int, begins: np.ndarray, w: np.ndarray, v: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Those of the texts `hit` of which all anchors do not say that one of the two has less than OVERLAP of the other."""
        anchors, number = np.unique(v, return_inverse=True)
        size = self.starts[hit + 1] - self.starts[hit]
        at = _ranges(self.starts[hit], size)
        low = np.zeros(1 << 16, bool)  # tells most of those that are not among the text's, before they are looked for
        low[anchors.astype(np.uint16)] = True
        shown = np.flatnonzero(low[self.v[at].astype(np.uint16)])
        at, pair = at[shown], np.repeat(np.arange(len(hit)), size)[shown]
        place = np.minimum(np.searchsorted(anchors, self.v[at]), len(anchors) - 1)
        same = np.flatnonzero(anchors[place] == self.v[at])
        at, pair, place = at[same], pair[same], place[same]
        letters = np.bincount(pair, _union(self.begins[at], self.begins[at] + self.w[at] + (MEASURED - 1), _firsts(pair)), len(hit))
        kept = np.flatnonzero(letters >= OVERLAP * self.n[hit] - 1e-6)
        row = np.full(len(hit), -1)
        row[kept] = np.arange(len(kept))
        theirs = np.zeros((len(kept), len(anchors)), bool)
        own = row[pair] >= 0
        theirs[row[pair[own]], place[own]] = True
        pair, stretch = np.nonzero(theirs[:, number])
        letters = np.bincount(pair, _union(begins[stretch], (begins + w + (MEASURED - 1))[stretch], _firsts(pair)), len(kept))
        return hit[kept[letters >= OVERLAP * n - 1e-6]]


def _steps(size: np.ndarray) -> Iterator[slice]:
    """Slices of about STEP in sum."""
    ends = np.flatnonzero(np.diff(np.cumsum(size) // STEP, append=-1))
    start = 0
    for stop in (ends + 1).tolist():
        yield slice(start, stop)
        start = stop


def _firsts(group: np.ndarray) -> np.ndarray:
    """Where each group begins in an ascending list of groups that are not negative."""
    return np.flatnonzero(np.diff(group, prepend=-1))


def _union(start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What each interval adds to those before it in its group; groups begin at `first`, and in a group starts and stops ascend."""
    letters = stop - start
    common = np.maximum(stop[:-1] - start[1:], 0)
    common[first[1:] - 1] = 0
    letters[1:] -= common
    return letters


def _blocks(files: list[str]) -> Iterator[Block]:
    for f in files:
        system, path = FileSystem.from_uri(f)
        with system.open_input_file(path) as source:
            for b in pq.ParquetFile(source).iter_batches(1, columns=["ids", "counts", "v", "w"]):
                yield Block(*(c[0].as_buffer() for c in b.columns))


def candidates(rows: DataFrame, indexed: DataFrame) -> DataFrame:
    """(a, b): text_ids of the column document and of the stored index that may overlap; all that do are among them.

    Texts are compared where they are read, with one block of the index after another, for HELD_ANCHORS anchors at once.
    """
    files = indexed.inputFiles()

    def compared(t: Texts) -> Iterator[pa.RecordBatch]:
        for block in _blocks(files):
            for i, hit in block.found(t):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), t.ids[i])), pa.array(block.ids[hit])], ["a", "b"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Texts] = []
        for t in _anchored(batches):
            held.append(t)
            if sum(len(x.v) for x in held) >= HELD_ANCHORS:
                yield from compared(_joined(held))
                held = []
        if held:
            yield from compared(_joined(held))

    return rows.select("document").mapInArrow(of, "a long, b long").distinct()


class Measure:
    """The overlap of two texts in chunks of MEASURED letters, cut at every letter."""

    def __init__(self) -> None:
        self.chunker = Chunker()
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, key: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The digests of the MEASURED letters from each letter on (of the whole text if it is shorter), and these sorted."""
        if key not in self.held:
            if len(self.held) > 3000:
                self.held.clear()
            codes = _mix(fold(text).astype(np.uint64))
            self.chunker._grow(len(codes) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.chunker.powers[: len(codes)], dtype=np.uint64)])
            start = max(len(codes) - MEASURED, 0) + 1
            made = (sums[-start:] - sums[:start]) * self.chunker.inverse[:start]
            self.held[key] = made, np.sort(made)
        return self.held[key]

    def __call__(self, a: int, x: str, b: int, y: str) -> tuple[float, float]:
        """(share of x in y, share of y in x); the second is 0 where the first says already that it is no case."""
        own, own_sorted = self.windows(a, x)
        other, other_sorted = self.windows(b, y)
        first = _covered(_among(own, other_sorted))
        return first, _covered(_among(other, own_sorted)) if first >= OVERLAP else 0.0


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _covered(shared: np.ndarray) -> float:
    """The share of a text's letters in windows that are shared."""
    at = np.flatnonzero(shared)
    if not len(at):
        return 0.0
    return float((MEASURED + np.minimum(np.diff(at), MEASURED).sum()) / (len(shared) + MEASURED - 1))


def measured(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b, overlap_a, overlap_b): the shares of the two texts of each pair that lie in shared chunks.

    `documents` has text_id and document of the classes in `pairs`.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = Measure()
        for f in frames:
            out = [measure(*r) for r in zip(f.a, f.document_a, f.b, f.document_b, strict=True)]
            yield pd.DataFrame({"a": f.a, "b": f.b, "overlap_a": [p for p, _ in out], "overlap_b": [q for _, q in out]})

    left = documents.select(F.col("text_id").alias("a"), F.col("document").alias("document_a"))
    right = documents.select(F.col("text_id").alias("b"), F.col("document").alias("document_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.mapInPandas(of, "a long, b long, overlap_a double, overlap_b double")


def overlaps(records: DataFrame, evaluation: tuple[str, ...] = EVALUATION, training: str = TRAINING) -> tuple[DataFrame, DataFrame]:
    """(members, class pairs) of a table with row_id, document, split and source.

    members: row_id, split, source, text_id of each row of a split with a non-blank document; with the class pairs they
    say all, without a pair of rows each. Class pairs: a (text_id in training), b (text_id in an evaluation split),
    overlap_a, overlap_b; a = b where the folded texts are equal. Rows of other splits or without one, null and blank
    documents are in neither; repeated rows are members each; an empty table gives empty results; other columns are
    not read.
    """
    rows = records.select("row_id", "split", "source", "document").where(F.col("split").isin(training, *evaluation) & F.col("document").isNotNull())
    side = F.when(F.col("split") == training, 1).otherwise(2)
    members = stored(identified(rows, "document"))
    pairs = stored(candidates(rows.where(side == 1), stored(index(rows.where(side == 2)))))
    classes = members.groupBy("text_id").agg(F.min("row_id").alias("row_id"), F.bit_or(side).alias("sides"))
    used = pairs.select(F.explode(F.array("a", "b")).alias("text_id")).distinct()
    documents = stored(records.select("row_id", "document").join(classes.join(used, "text_id").select("row_id", "text_id"), "row_id").select("text_id", "document"))
    near = measured(pairs, documents).where((F.col("overlap_a") >= OVERLAP) & (F.col("overlap_b") >= OVERLAP))
    same = classes.where("sides = 3").select(F.col("text_id").alias("a"), F.col("text_id").alias("b"), F.lit(1.0).alias("overlap_a"), F.lit(1.0).alias("overlap_b"))
    return members, stored(near.unionByName(same))


def record_pairs(members: DataFrame, pairs: DataFrame, training: str = TRAINING) -> DataFrame:
    """All pairs of a training and an evaluation row whose classes are paired, with splits, sources and overlaps."""
    train = members.where(F.col("split") == training).select(F.col("row_id").alias("train_row"), F.col("source").alias("train_source"), F.col("text_id").alias("a"))
    other = members.where(F.col("split") != training).select(F.col("row_id").alias("eval_row"), "split", "source", F.col("text_id").alias("b"))
    return pairs.join(train, "a").join(other, "b").select("train_row", "eval_row", "split", "source", "train_source", "overlap_a", "overlap_b")


def report(members: DataFrame, pairs: DataFrame, training: str = TRAINING) -> DataFrame:
    """Per evaluation split and source: rows, rows that overlap with training, pairs, and pairs of equal texts.

    Counted by class, without expanding the pairs.
    """
    train = members.where(F.col("split") == training).groupBy(F.col("text_id").alias("a")).agg(F.count("*").alias("copies"))
    linked = pairs.join(train, "a").groupBy(F.col("b").alias("text_id")).agg(
        F.sum("copies").alias("pairs"), F.sum(F.when(F.col("a") == F.col("b"), F.col("copies")).otherwise(0)).alias("equal")
    )
    rows = members.where(F.col("split") != training).join(linked, "text_id", "left")
    return rows.groupBy("split", "source").agg(
        F.count("*").alias("rows"), F.count("pairs").alias("overlapping_rows"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("equal"), F.lit(0)).alias("equal_pairs")
    )
