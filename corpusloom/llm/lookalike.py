"""One form for texts that look the same (problem 3).

Strings and code points that look alike are joined by union-find, transitively: letters of other scripts, full-width
and styled forms, letters with separate accents in any order, special spaces, invisible signs (alike to nothing), and
letters that mixed-script words of the corpus show to stand for another. Each class' most frequent member in the corpus
represents it. An Aho-Corasick automaton of all other members rewrites texts greedily, longest match first; what stands
in its own context (foreign words in their own script, emoji sequences) stays.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.viet import ACCENTED, LETTERS, LOOKS, syllable

#: Fixed: spaces that are not the plain one, and signs that show nothing.
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, 0xFEFF, 0xFFA0]
STYLED = [*range(0x2102, 0x2135), *range(0x2160, 0x2180), *range(0x1D400, 0x1D800)]
LEARNED_WORDS, LEARNED_SHARE = 3, 0.8
#: Votes that a partition holds before it hands them on.
HELD_VOTES = 200_000


class Classes:
    """Union-find over strings and code points (strings of length one)."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def rewrites(self, count: dict[str, int]) -> dict[str, str]:
        """Member -> its class' most frequent member, of the own letters if any occurs; of equal ones the lowest string."""
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        out = {}
        for members in groups.values():
            best = min(members, key=lambda x: (not _own(x, count), -count.get(x, 0), len(x), x))
            out.update((x, best) for x in members if x != best)
        return out


def _own(x: str, count: dict[str, int]) -> bool:
    """Whether it is of the corpus' own letters; garbled texts may hold more of a foreign one."""
    return x == "" or ((x.isascii() or x in ACCENTED) and count.get(x, 0) > 0)


def spellings(letter: str) -> Iterator[str]:
    """The letter with its accents separate, some or all, in any order."""
    full = unicodedata.normalize("NFD", letter)
    base, marks = full[0], full[1:]
    twins = {"̀": "̀", "́": "́"}
    for order in itertools.permutations(marks):
        for k in range(len(order) + 1):
            head = unicodedata.normalize("NFC", base + "".join(order[:k]))
            for tail in itertools.product(*[(m, twins[m]) if m in twins else (m,) for m in order[k:]]):
                yield head + "".join(tail)


def classes(count: dict[str, int], learned: dict[str, str]) -> dict[str, str]:
    """The rewrites for a corpus with these code point counts and learned look-alikes."""
    c = Classes()
    for other, latin in (LOOKS | learned).items():
        c.union(other, latin)
    for cp in range(0xFF01, 0xFF5F):
        c.union(chr(cp), chr(cp - 0xFEE0))
    for cp in STYLED:
        flat = unicodedata.normalize("NFKC", chr(cp))
        if len(flat) == 1 and flat.isascii() and flat.isalnum():
            c.union(chr(cp), flat)
    for cp in SPACES:
        c.union(chr(cp), " ")
    for cp in INVISIBLE:
        c.union(chr(cp), "")
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        for s in spellings(chr(cp)):
            if s != chr(cp):
                c.union(s, chr(cp))
    # separate accents: the composed letter is what texts hold; a spelling's own count is that of its rarest mark
    weight = dict(count)
    weight[""] = sum(count.values()) + 1
    return c.rewrites(weight)


def _mixes(word: str) -> str | None:
    """The one letter foreign to an otherwise Latin word, if there is one."""
    odd = {ch for ch in word if ch.isalpha() and ch not in LETTERS and not ch.isascii()}
    return odd.pop() if len(odd) == 1 and any(ch in LETTERS or ch.isascii() and ch.isalpha() for ch in word) else None


def stats(df: DataFrame, names: list[str]) -> DataFrame:
    """(kind, what, letter, n): code point counts, and in how many distinct words an unknown letter stands for a letter.

    Letter "" counts all distinct words with the unknown letter. Words are made distinct per partition first, then over
    the corpus; the result has at most one row per code point and letter.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "what", "letter", "word", "n"]
        points = np.zeros(0x110000, np.int64)
        votes: set[tuple[str, str, str]] = set()
        for f in frames:
            for n in names:
                text = "".join(t for t in f[n] if t)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                if len(codes):
                    points[: int(codes.max()) + 1] += np.bincount(codes)
                for t in f[n]:
                    if not t or t.isascii() or not FOREIGN.search(t) or not UNKNOWN.search(t):
                        continue
                    for w in UNKNOWN_WORD.findall(t):
                        odd = _mixes(w)
                        if odd and odd not in LOOKS:
                            votes.add((odd, "", w.lower()))
                            for letter in "abcdđeghiklmnopqrstuvxy":
                                fixed = unicodedata.normalize("NFC", w.replace(odd, letter))
                                if syllable(fixed):
                                    votes.add((odd, letter, fixed.lower()))
            if len(votes) > HELD_VOTES:  # those that come again are made one by the shuffle
                yield pd.DataFrame([("vote", *v, 0) for v in votes], columns=columns)
                votes.clear()
        used = np.flatnonzero(points)
        out = [("count", chr(cp), "", "", int(points[cp])) for cp in used if not 0xD800 <= cp < 0xE000]
        out += [("vote", *v, 0) for v in votes]
        yield pd.DataFrame(out, columns=columns)

    made = df.select(*names).mapInPandas(of, "kind string, what string, letter string, word string, n long")
    distinct = made.groupBy("kind", "what", "letter", "word").agg(F.sum("n").alias("n"))
    return distinct.groupBy("kind", "what", "letter").agg(F.sum(F.when(F.col("kind") == "vote", 1).otherwise(F.col("n"))).alias("n"))


#: Anything beyond the Latin blocks and general signs.
FOREIGN = re.compile("[\u0250-\u02ff\u0370-\u1dff\u2c00-\u2dff\u3040-\uabff\U00010300-\U0001efff]")
#: A letter that neither Latin nor any fixed look-alike accounts for, next to a Latin letter.
UNKNOWN = re.compile(r"[A-Za-z][^\W\d_A-Za-zÀ-ɏḀ-ỿ]|[^\W\d_A-Za-zÀ-ɏḀ-ỿ][A-Za-z]")
UNKNOWN_WORD = re.compile(r"[^\W\d_]{2,8}")


def learn(df: DataFrame, names: list[str]) -> dict[str, str]:
    """The corpus' rewrites. To the driver come counts by code point and letter, at most 24 x 1.1 million, in fact thousands."""
    rows = stats(df, names).collect()
    count = {r.what: r.n for r in rows if r.kind == "count"}
    votes: dict[str, Counter[str]] = {}
    for r in rows:
        if r.kind == "vote":
            votes.setdefault(r.what, Counter())[r.letter] = r.n
    learned = {}
    for odd, c in votes.items():
        total = c.pop("", 0)
        if c and unicodedata.category(odd)[0] == "L" and not _cjk(odd):
            letter, n = min(c.items(), key=lambda x: (-x[1], x[0]))
            if n >= LEARNED_WORDS and n >= LEARNED_SHARE * total and sum(m == n for m in c.values()) == 1:
                learned[odd] = letter
    return classes(count, learned)


def _cjk(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "가" <= c <= "힯" or "豈" <= c <= "﫿" or "\U00020000" <= c <= "\U0003ffff"


def _emoji(c: str) -> bool:
    return c >= "\U0001f000" or "☀" <= c <= "➿" or "︀" <= c <= "️"


def _joined_script(c: str) -> bool:
    return "؀" <= c <= "෿"


def _latin(c: str) -> bool:
    return c.isascii() and c.isalpha() or "À" <= c <= "ɏ" or "Ḁ" <= c <= "ỿ"


def _class(chars: set[str]) -> re.Pattern[str]:
    """A character class in as few ranges as possible."""
    codes = np.array(sorted(map(ord, chars)))
    cuts = np.flatnonzero(np.diff(codes) > 1)
    bounds = zip(codes[np.r_[0, cuts + 1]], codes[np.r_[cuts, len(codes) - 1]], strict=True)
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in bounds) + "]")


class Rewriter:
    """The automaton of all rewrites, and the contexts in which a match stays as it is."""

    def __init__(self, rewrites: dict[str, str]):
        self.rewrites = {a: b for a, b in rewrites.items() if a and not a.isascii()}
        self.automaton = ahocorasick.Automaton()
        for a, b in self.rewrites.items():
            self.automaton.add_word(a, (len(a), b))
        if self.rewrites:
            self.automaton.make_automaton()
        singles = {a for a in self.rewrites if len(a) == 1}
        marks = {a[1] for a in self.rewrites if len(a) > 1}
        self.any = _class(singles | marks) if singles | marks else None

    def __call__(self, text: str) -> str:
        if self.any is None or not self.any.search(text):
            return text
        out, at = [], 0
        for end, (n, to) in self.automaton.iter_long(text):
            start = end - n + 1
            if start >= at and self.applies(text, start, end + 1, to):
                out += [text[at:start], to]
                at = end + 1
        if not out:
            return text
        made = "".join(out) + text[at:]
        # marks that follow a letter just rewritten, or stood behind an invisible sign, can be joined now
        return self(made) if made != text and self.any.search(made) else made

    def applies(self, text: str, start: int, end: int, to: str) -> bool:
        c = text[start]
        before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
        if end - start > 1:
            return True
        if to == "":
            return not (_emoji(before) or _emoji(after) or (_joined_script(before) and _joined_script(after)))
        if to == " ":
            return not (_cjk(before) or _cjk(after))
        if "！" <= c <= "～":
            return not (_cjk(before) or _cjk(after) or "　" <= before <= "ヿ" or "　" <= after <= "ヿ")
        return self._in_latin(text, start)

    def _in_latin(self, text: str, at: int) -> bool:
        """Whether the word is Latin but for look-alikes, or all look-alikes amid Latin words."""
        lo, hi = at, at
        part = lambda c: c.isalpha() or "̀" <= c <= "ͯ" or c in self.rewrites and self.rewrites[c] == ""
        while lo and part(text[lo - 1]):
            lo -= 1
        while hi < len(text) and part(text[hi]):
            hi += 1
        word = text[lo:hi]
        if any(_latin(c) and c not in LOOKS for c in word):
            return True
        mapped = unicodedata.normalize("NFC", "".join(self.rewrites.get(c, c) for c in word))
        if len(mapped) < 2 or not all(_latin(c) for c in mapped):
            return False
        around = [*text[max(0, lo - 12) : lo].split()[-1:], *text[hi : hi + 12].split()[:1]]
        letters = [c for w in around for c in w if c.isalpha()]
        return bool(letters) and all(_latin(c) or c in self.rewrites for c in letters) and syllable(mapped) and any(_latin(c) and c not in LOOKS for c in letters)


def canonical(df: DataFrame, row: str = "row_id", names: tuple[str, ...] = ("document", "summary"), rewrites: dict[str, str] | None = None) -> DataFrame:
    """row, field, canonical of each field whose text changes; fields not listed are in canonical form already.

    Null and empty fields give no row; repeated rows one each; of an empty table nothing comes out. Rewriting a
    canonical text again changes nothing. Other columns are not read.
    """
    names = list(names)
    rewrites = learn(df, names) if rewrites is None else rewrites
    shared = df.sparkSession.sparkContext.broadcast(rewrites)
    kind = df.schema[row].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = Rewriter(shared.value)
        for f in frames:
            out = [(r, n, made) for n in names for r, t in zip(f[row], f[n], strict=True) if t and not t.isascii() and (made := rewrite(t)) != t]
            yield pd.DataFrame(out, columns=[row, "field", "canonical"])

    return df.select(row, *names).mapInPandas(of, f"`{row}` {kind}, field string, canonical string")
