"""Text garbled by a wrong decoding (problem 2).

Sentences with ill-formed words are joined with clean sentences on what neither a wrong decoding nor a font encoding
touches: their ASCII consonants and digits, everything non-ASCII stripped. Words of such twins are aligned character
by character; each alignment of one clean letter votes for a unit (garbled run -> letter), and for every chain of
codecs that would turn the letter into that run. A chain is also confirmed by making well-formed syllables of several
of the corpus' ill-formed words (readings that swallow ASCII letters leave no twin sentence). Tables of font
encodings are confirmed in the same way. Chains and units with enough votes are the learned mappings. They are applied to every record with ill-formed words: a word is
garbled if a mapping makes a well-formed syllable of it.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.viet import ACCENTED, LETTERS, LOOKS, TONES, beginning, syllable
from corpusloom.session import cut

#: Hypotheses that alignments may confirm: UTF-8 bytes read as one of these; a second name means read wrongly twice.
CHAINS = [(c,) for c in ("cp1252", "latin-1", "cp437", "cp850", "cp1251", "gb18030", "mac_roman", "cp1258", "cp1250", "iso8859-2", "cp1254", "iso8859-15", "big5", "shift_jis", "cp866", "koi8-r", "cp1253", "cp874", "mac_cyrillic", "cp1255", "cp1256", "cp949", "cp852")]
CHAINS += [(a, b) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1")]
#: A chain needs alignments of so many different letters, a unit so many alignments.
CHAIN_LETTERS, UNIT_VOTES = 3, 2
#: Or it needs to make so many different words of ill-formed ones.
CHAIN_WORDS = 6
#: As many, with signs of their own, confirm a font's table.
TABLE_WORDS = 4
LOST = "�"
EDGE = "\"'«»“”‘’„‚…–—‹›·•!#$%&()*+,-./:;<=>?@[]^_`{|}~ \t\r\n"
_ASCII_GAPS = re.compile(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
_GAPS = re.compile(r"[\x00-\x40\x5b-\x60\x7b-\x7f\xa0\u2000-\u200a\u202f\u3000]+")
_SENTENCE = re.compile(r"[.;:\n]+")
_DROPPED = bytes(sorted(set(range(128)) - set(b"bcdfghjklmnpqrstvwxz0123456789")))
LEAST_KEY = 12


@functools.lru_cache(maxsize=300_000)
def ill_formed(word: str) -> bool:
    """Whether a word with non-ASCII characters has a part that is no well-formed syllable, whatever its forms."""
    core = word.strip(EDGE)
    if core.isascii():
        return False
    return "Ã\xa0" in word or any(not p.isascii() and not (_cased(p) and (syllable(p) or syllable(plain(p)))) for p in _GAPS.split(core))


def _cased(part: str) -> bool:
    """Lower, upper or title case: a capital inside a word is a sign of a wrong reading."""
    return part.islower() or part.isupper() or part[1:].islower() or not part[1:]


def _wide(c: str) -> str:
    """The plain form of a full-width or styled letter; not of superscripts and fractions, which garbled runs hold."""
    return unicodedata.normalize("NFKC", c) if "！" <= c <= "～" or "\U0001d400" <= c <= "\U0001d7ff" else c


def plain(part: str) -> str:
    """The part without invisible signs, look-alike letters and separate accents, which are no wrong decoding."""
    letters = unicodedata.normalize("NFD", "".join(LOOKS.get(c, c) for c in map(_wide, part) if unicodedata.category(c) != "Cf"))
    runs = re.findall(r"[^\u0300-\u036f][\u0300-\u036f]*|[\u0300-\u036f]+", letters)
    return unicodedata.normalize("NFC", "".join(r[0] + "".join(sorted(r[1:], key=lambda c: c in TONES)) for r in runs))


def suspects(text: str) -> list[str]:
    """The ill-formed words of a text; only ASCII white space separates words, as garbled runs hold other kinds."""
    return [w for w in set(text.replace("\n", " ").replace("\t", " ").split(" ")) if not w.isascii() and ill_formed(w)]


@functools.cache
def _bytes_of(codec: str) -> dict[str, int] | None:
    """Character -> byte of a single-byte codec, undefined bytes as C1 controls; None for multi-byte ones."""
    try:
        return {bytes([b]).decode(codec, "strict") if _defined(b, codec) else chr(b): b for b in range(256)}
    except UnicodeDecodeError:
        return None


def _defined(b: int, codec: str) -> bool:
    try:
        return len(bytes([b]).decode(codec)) == 1
    except UnicodeDecodeError:
        if codec in ("gb18030", "big5", "shift_jis", "cp949"):
            raise
        return False


def _encode(text: str, codec: str) -> bytes | None:
    table = _bytes_of(codec)
    if table is None:
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    try:
        return bytes([table[c] if c in table else ord(c) if "\x80" <= c <= "\x9f" else table[c] for c in text])
    except KeyError:
        return None


@functools.lru_cache(maxsize=300_000)
def undo(text: str, chain: tuple[str, ...]) -> str | None:
    """What `text` was before the chain's wrong readings, None where it can't be their result."""
    for codec in reversed(chain):
        raw = _encode(text, codec)
        if raw is None:
            return None
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    return text


def key(sentence: str) -> bytes:
    """ASCII consonants and digits; accents, vowels and whatever a wrong reading makes of them are stripped."""
    return sentence.lower().encode("ascii", "ignore").translate(None, _DROPPED)


def align(garbled: str, clean: str) -> Iterator[tuple[str, str]]:
    """(garbled run, clean run) of words that differ, without their common ends."""
    a, b = garbled.strip(" ").split(" "), clean.strip(" ").split(" ")
    if len(a) != len(b):
        return
    for g, c in zip(a, b, strict=True):
        if g == c or key(g) != key(c):
            continue
        n = 0
        while n < min(len(g), len(c)) and g[n] == c[n]:
            n += 1
        m = 0
        while m < min(len(g), len(c)) - n and g[-1 - m] == c[-1 - m]:
            m += 1
        run, letters = g[n : len(g) - m], c[n : len(c) - m]
        if run and letters and not run.isascii():
            yield run, letters


class Mapping:
    """The learned chains and units."""

    def __init__(self, chains: list[tuple[str, ...]], units: dict[str, list[str]]):
        self.chains, self.units = chains, units
        self.longest = max(map(len, units), default=0)
        self.seen: dict[str, str | None] = {}

    def word(self, word: str) -> str | None:
        """The word that a mapping makes well-formed, None if none does."""
        if word not in self.seen:
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[word] = self._word(word)
        return self.seen[word]

    def by_chain(self, word: str) -> str | None:
        for chain in self.chains:
            got = undo(word, chain)
            if got and got != word and _clean(got):
                return got
        return None

    def _word(self, word: str) -> str | None:
        if (got := self.by_chain(word)) is not None:
            return got
        core = word.strip("\"'!()*,-./:;<>?[]{}")
        got = self._reading(core)
        return word.replace(core, got, 1) if got else None

    def _reading(self, core: str) -> str | None:
        """The reading of `core` by units that is well-formed; letters of ordinary text may stay.

        The longest units and their most voted letters come first, characters that stay last. Only readings whose last part a syllable may begin with are followed, and each such end at a place once, so a
        word of any length is read in full.
        """
        states, seen = [(0, "", "")], set()
        while states:
            at, text, last = states.pop()
            if at == len(core):
                if text != core and len(text) > 1 and _clean(text):
                    return text
                continue
            options = [(1, core[at])] if core[at].isascii() or core[at] in LETTERS else []
            options += [(n, letter) for n in range(1, min(self.longest, len(core) - at) + 1) for letter in reversed(self.units.get(core[at : at + n], ()))]
            for n, letter in options:
                gap = letter.isascii() and not letter.isalpha()
                if letter.isdigit() or gap and last and not syllable(last) or not gap and not beginning(last + letter):
                    continue
                made = text + letter
                state = (at + n, "" if gap else last + letter, made.isascii(), made == core[: at + n])
                if state not in seen:
                    seen.add(state)
                    states.append((at + n, made, state[1]))
        return None


def _clean(text: str) -> bool:
    """Well-formed with an accented letter, all of it."""
    core = text.strip(EDGE)
    parts = [p for p in _ASCII_GAPS.split(core) if p]
    return any(not p.isascii() for p in parts) and all(syllable(p) for p in parts) and not any(c.isdigit() for c in core)


def lost(word: str) -> bool:
    """Whether a replacement character stands inside or at a word's letters."""
    return LOST in word and any(c.isalpha() for c in word)


def scanned(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    """One pass over all texts, without a shuffle: (k, garbled, sentence) and (row, field, text) rows.

    The former are the distinct sentences of each partition with enough consonants, by a hash of their key; the latter
    the fields with at least one ill-formed word, in which `sentence` is null.
    """
    kind = df.schema[row].dataType.simpleString()
    columns = ["k", "garbled", "sentence", row, "field", "text"]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for f in frames:
            out: list[tuple] = []
            for n in names:
                for r, t in zip(f[row], f[n], strict=True):
                    if not t or t.isascii():
                        continue
                    bad = set(suspects(t))
                    if bad:
                        out.append((None, None, None, r, n, t))
                    if len(seen) > 500_000:
                        seen.clear()
                    for s in _SENTENCE.split(t):
                        if s in seen or s.isascii():
                            continue
                        seen.add(s)
                        k = key(s)
                        if len(k) >= LEAST_KEY:
                            out.append((k, bool(bad) and bool(suspects(s)), s.strip(" "), None, None, None))
            yield pd.DataFrame(out, columns=columns, dtype=object)

    made = df.select(row, *names).mapInPandas(of, f"k binary, garbled boolean, sentence string, `{row}` {kind}, field string, text string")
    return made.withColumn("k", F.xxhash64("k"))


def votes(pairs: DataFrame) -> DataFrame:
    """(run, letters, n): how often twins' alignments say that a run stands for letters."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter[tuple[str, str]] = Counter()
        for f in frames:
            for g, c in zip(f["garbled_sentence"], f["sentence"], strict=True):
                count.update(align(g, c))
            if len(count) > 100_000:
                yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["run", "letters", "n"])
                count.clear()
        yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["run", "letters", "n"])

    made = pairs.select("garbled_sentence", "sentence").mapInPandas(of, "run string, letters string, n long")
    return made.groupBy("run", "letters").agg(F.sum("n").alias("n"))


def _wrong(run: str, letter: str) -> bool:
    """Not merely the letter with separate accents, invisible signs or characters of the same look."""
    flat = lambda t: sorted(LOOKS.get(c, c) for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c)[0] in "LM")
    return flat(run) != flat(letter)


def vote_evidence(voted: DataFrame) -> DataFrame:
    """(kind, key, letters, n) of all votes: the units with their votes, and of how many different letters each chain has votes.

    Chains are tried on the workers; the driver gets one row a chain, and the units, which are the learned model.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for run, clean, n in zip(f["run"], f["letters"], f["n"], strict=True):
                out += [("chain", str(i), clean, 1) for i, chain in enumerate(CHAINS) if undo(run, chain) == clean]
                if len(clean) == 1 and clean in ACCENTED and n >= UNIT_VOTES and len(run) <= 8 and LOST not in run and _wrong(run, clean):
                    out.append(("unit", run, clean, n))
            yield pd.DataFrame(out, columns=["kind", "key", "letters", "n"])

    made = voted.mapInPandas(of, "kind string, key string, letters string, n long").groupBy("kind", "key", "letters").agg(F.max("n").alias("n"))
    unit = F.col("kind") == "unit"
    return made.groupBy("kind", "key", F.when(unit, F.col("letters")).alias("letters")).agg(F.sum(F.when(unit, F.col("n")).otherwise(1)).alias("n"))


def word_evidence(words: DataFrame) -> DataFrame:
    """(kind, key, n) of all ill-formed words: how many different well-formed ones each chain and each font's table makes of them."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [Mapping([], {k: [v] for k, v in t.items()}) for t in TABLES]
        for f in frames:
            out: set[tuple[str, int, str]] = set()
            for w in f["word"]:
                out.update(("chain", i, got) for i, c in enumerate(CHAINS) if (got := undo(w, c)) and got != w and _clean(got))
                if _telling(w):
                    out.update(("table", i, got) for i, t in enumerate(tables) if (got := t.word(w)))
            yield pd.DataFrame(list(out), columns=["kind", "key", "got"])

    made = words.select("word").mapInPandas(of, "kind string, key int, got string")
    return made.distinct().groupBy("kind", "key").agg(F.count("*").alias("n"))


def mapping(letters: dict[int, int], rows: list[tuple[str, str, int]], words: dict[tuple[str, int], int]) -> Mapping:
    """Chains and units from what the twins' votes and the ill-formed words say of each hypothesis."""
    numbers = sorted((i for i in range(len(CHAINS)) if letters.get(i, 0) >= CHAIN_LETTERS), key=lambda i: -letters[i])
    numbers += [i for i in range(len(CHAINS)) if i not in numbers and words.get(("chain", i), 0) >= CHAIN_WORDS]
    units: dict[str, Counter[str]] = {}
    for run, clean, n in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        units.setdefault(run, Counter())[clean] += n
    kept = {r: [c for c, n in cs.most_common(4) if n * 8 >= max(cs.values())] for r, cs in units.items()}
    for i, table in enumerate(TABLES):
        if words.get(("table", i), 0) >= TABLE_WORDS:
            for run, letter in table.items():
                kept.setdefault(run, [])
                kept[run] += [letter] * (letter not in kept[run])
    return Mapping([CHAINS[i] for i in numbers], kept)


def ill_words(found: DataFrame) -> DataFrame:
    """The distinct ill-formed words of garbled sentences, made distinct per partition first."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: set[str] = set()
        for f in frames:
            for s in f["sentence"]:
                held.update(suspects(s))
            if len(held) > 200_000 or sum(map(len, held)) > 20_000_000:
                yield pd.DataFrame({"word": list(held)}, dtype=object)
                held.clear()
        yield pd.DataFrame({"word": list(held)}, dtype=object)

    return found.select("sentence").mapInPandas(of, "word string").distinct()


def learn(found: DataFrame) -> Mapping:
    """Join garbled sentences with clean twins, align them, and keep the best supported mappings.

    Of each key one clean twin is enough. All votes and all ill-formed words count, on the workers; to the driver come
    the units with UNIT_VOTES votes and a count for each chain and table.
    """
    clean = found.where("not garbled").groupBy("k").agg(F.min("sentence").alias("sentence"))
    garbled = found.where("garbled").select("k", F.col("sentence").alias("garbled_sentence")).distinct()
    rows = vote_evidence(votes(garbled.join(clean, "k"))).collect()
    words = word_evidence(ill_words(found.where("garbled"))).collect()
    return mapping({int(r.key): r.n for r in rows if r.kind == "chain"}, [(r.key, r.letters, r.n) for r in rows if r.kind == "unit"], {(r.kind, r.key): r.n for r in words})


def _tcvn3() -> dict[str, str]:
    """The letters of a single-byte font encoding of Vietnamese, as its bytes look in Latin-1."""
    rows = "aµ¶·¸¹ ă»¼½¾Æ âÇÈÉÊË eÌÎÏÐÑ êÒÓÔÕÖ i×ØÜÝÞ oßáâãä ôåæçèé ơêëìíî uïñòóô ưõö÷øù yúûüýþ"
    table = dict(zip("¨©ª«¬\xad®¡¢£¤¥¦§", "ăâêôơưđĂÂÊÔƠƯĐ", strict=True))
    for row in rows.split():
        for sign, tone in zip(row[1:], "̣̀̉̃́", strict=True):
            table[sign] = unicodedata.normalize("NFC", row[0] + tone)
    return table


def _vni() -> dict[str, str]:
    """A font encoding that writes a vowel and a sign for its accents, by rule."""
    tones = "̣̀̉̃́"
    signs = {"plain": "øûõùï", "^": "àåãáä", "(": "èúüéë"}
    table = {"ñ": "đ", "ô": "ơ", "ö": "ư", "ì": "ì", "æ": "ỉ", "ó": "ĩ", "í": "í", "ò": "ị", "î": "ỵ"}
    for base, letter, kind in [("a", "a", "plain"), ("e", "e", "plain"), ("o", "o", "plain"), ("u", "u", "plain"), ("y", "y", "plain"), ("ô", "ơ", "plain"), ("ö", "ư", "plain"), ("a", "â", "^"), ("e", "ê", "^"), ("o", "ô", "^"), ("a", "ă", "(")]:
        table |= {base + sign: unicodedata.normalize("NFC", letter + tone) for sign, tone in zip(signs[kind], tones, strict=True)}
    table |= {"aâ": "â", "eâ": "ê", "oâ": "ô", "aê": "ă"}
    return table | {k.upper(): v.upper() for k, v in table.items()} | {k[0].upper() + k[1:]: v.upper() for k, v in table.items()}


#: Tables of font encodings, hypotheses like the chains: units of those that enough words confirm join the learned ones.
TABLES = (_tcvn3(), _vni())


def _telling(word: str) -> bool:
    """Whether a word has a character that is neither ASCII nor a letter of the orthography."""
    return any(c > "\x7f" and c not in ACCENTED for c in word.strip(EDGE))


def repair(text: str, m: Mapping) -> tuple[int, int, str]:
    """Number of garbled words restored, of words that are lost, and the text with the former restored.

    Foreign words may happen to fit a unit: without any word that a chain restores they count only if they are at least
    half of the ill-formed ones, if with the well-formed accented words they are three tenths of all, as in Vietnamese,
    and if they are two or more where they are made of the orthography's own letters alone.
    """
    gone = 0
    memo: dict[str, str] = {}
    words = suspects(text)
    for w in words:
        if lost(w):
            gone += 1
        elif (got := m.word(w)) is not None:
            memo[w] = got
    if memo and not gone and not any(map(m.by_chain, memo)):
        every = [w for w in set(text.replace("\n", " ").split(" ")) if any(map(str.isalpha, w))]
        accented = sum(not w.isascii() for w in every) - len(words) + len(memo)
        if 2 * len(memo) < len(words) or 10 * accented < 3 * len(every) or not any(map(_telling, memo)) and len(memo) < 2:
            memo = {}
    if not memo:
        return 0, gone, text
    if any(map(_telling, memo)):
        # the field is garbled: words that are no syllables come back too, where a chain makes plain letters of them
        for w in words:
            if w not in memo and not lost(w):
                for chain in m.chains:
                    got = undo(w, chain)
                    if got and got != w and all(c.isascii() or c in ACCENTED or c in EDGE for c in got):
                        memo[w] = got
                        break
    return len(memo), gone, re.sub(r"[^ \n\t]+", lambda x: memo.get(x[0], x[0]), text)


def restore(df: DataFrame, row: str = "row_id", names: tuple[str, ...] = ("document", "summary")) -> DataFrame:
    """row, field, restored, n_garbled, n_lost, complete, of every field with garbled words.

    `restored` has the original words where a mapping gives them; `complete` says that no lost or ill-formed word is
    left. Null, empty and clean fields give no row; repeated rows give one each; old flags are not read; without any
    clean twin only lost characters are found; an empty table gives no row.
    """
    found = cut(scanned(df, row, list(names)))
    m = learn(found.where(F.col("sentence").isNotNull()).select("k", "garbled", "sentence"))
    shared = df.sparkSession.sparkContext.broadcast((m.chains, m.units))
    kind = df.schema[row].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Mapping(*shared.value)
        for f in frames:
            out = []
            for r, n, t in zip(f[row], f["field"], f["text"], strict=True):
                fixed, gone, text = repair(t, m)
                if fixed or gone:
                    out.append((r, n, text, fixed, gone, not gone and not suspects(text)))
            yield pd.DataFrame(out, columns=[row, "field", "restored", "n_garbled", "n_lost", "complete"])

    texts = found.where(F.col("sentence").isNull()).select(row, "field", "text")
    return texts.mapInPandas(of, f"`{row}` {kind}, field string, restored string, n_garbled int, n_lost int, complete boolean")
