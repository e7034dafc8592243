"""What several operators need to know about Vietnamese writing: letters, well-formed syllables, folding to base letters."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

#: Fixed values of the orthography: plain letters, tone marks, onsets, nuclei, codas and closed rimes (no coda follows).
VOWELS = "aăâeêioôơuưy"
TONES = "̣̀́̃̉"
ONSETS = "b c ch d đ g gh gi h k kh l m n ng ngh nh p ph qu r s t th tr v x".split()
NUCLEI = "a ă â e ê i o ô ơ u ư y ia iê yê ua uô ưa ươ oa oă oe oo uê uy uâ uơ uya uyê".split()
CODAS = "c ch m n ng nh p t".split()
CLOSED = "ai ao au ay âu ây eo êu ia iu oi ôi ơi ui ưi ưu iêu yêu oai oay oao oeo uây uôi ươi ươu uyu uao".split()

LETTERS = frozenset(
    unicodedata.normalize("NFC", form + tone) for v in VOWELS for form in (v, v.upper()) for tone in ("", *TONES)
) | frozenset("bcdđghklmnpqrstvxBCDĐGHKLMNPQRSTVX")
ACCENTED = frozenset(c for c in LETTERS if c > "\x7f")
_SYLLABLE = re.compile(f"(?:{'|'.join(sorted(ONSETS, key=len, reverse=True))})?(?:(?:{'|'.join(sorted(CLOSED, key=len, reverse=True))})|(?:{'|'.join(sorted(NUCLEI, key=len, reverse=True))})({'|'.join(sorted(CODAS, key=len, reverse=True))})?)")
_GLIDED = re.compile(r"gi(?:n|m|t|p|c|ch|ng|nh)?$")


@functools.lru_cache(maxsize=200_000)
def syllable(word: str) -> bool:
    """Whether `word` is a well-formed syllable: known onset and rime, one tone at most, closed syllables sharp or heavy."""
    word = word.lower()
    if not 0 < len(word) <= 7 or not set(word) <= LETTERS:
        return False
    parts = unicodedata.normalize("NFD", word)
    tone = [c for c in parts if c in TONES]
    if len(tone) > 1:
        return False
    bare = unicodedata.normalize("NFC", "".join(c for c in parts if c not in TONES))
    if _GLIDED.fullmatch(bare):
        coda = bare[2:]
    else:
        m = _SYLLABLE.fullmatch(bare)
        if not m:
            return False
        coda = m[1] or ""
    return coda not in ("c", "ch", "p", "t") or (bool(tone) and tone[0] in "̣́")


@functools.cache
def _beginnings() -> frozenset[str]:
    """What a well-formed syllable may begin with, without tones."""
    rimes = [*CLOSED, *(n + c for n in NUCLEI for c in ("", *CODAS))]
    whole = [o + r for o in ("", *ONSETS) for r in rimes] + ["gi" + c for c in CODAS]
    return frozenset(w[:k] for w in whole for k in range(len(w) + 1))


@functools.lru_cache(maxsize=200_000)
def beginning(text: str) -> bool:
    """Whether a well-formed syllable may begin with `text`."""
    if len(text) > 7:
        return False
    parts = unicodedata.normalize("NFD", text.lower())
    bare = unicodedata.normalize("NFC", "".join(c for c in parts if c not in TONES))
    return bare in _beginnings() and sum(c in TONES for c in parts) <= 1


#: Fixed: letters of other scripts that look like Latin ones (or like đ), by the Latin letter they stand for.
ALIKE = {
    "a": "аαɑ", "b": "Ьƅ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιıӏɩ", "j": "јϳ", "k": "кκᴋ", "l": "ⅼ", "m": "мᴍ", "n": "ոпռ",
    "o": "оοօσ০ഠ", "p": "рρ", "q": "ԛզ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτᴛ", "u": "υսцᴜ", "v": "νѵᴠ", "w": "ԝωաᴡ", "x": "хχ", "y": "уγүყ", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "ᎠᗞⅮ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚKᏦ", "L": "ᏞⅬ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡᏢ", "Q": "Ԛ", "R": "ᎡᏒ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥУ", "Z": "ΖᏃ", "đ": "ðɖ", "Đ": "ÐƉ",
}
LOOKS = {c: latin for latin, others in ALIKE.items() for c in others if c != latin}


@functools.cache
def fold_table() -> np.ndarray:
    """Code point -> code point of its bare lower-case letter or digit, 0 for everything else (marks, spaces, signs)."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x20000):
        c = chr(cp)
        c = LOOKS.get(c, c)
        kind = unicodedata.category(c)
        if kind[0] not in "LN":
            continue
        base = unicodedata.normalize("NFKD", c)[0].lower()
        base = LOOKS.get(base, base)
        base = {"đ": "d", "ð": "d", "ı": "i", "ł": "l", "ø": "o"}.get(base, base)[0]
        if base.isalnum():
            table[cp] = ord(base)
    table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
    return table


def fold(text: str) -> np.ndarray:
    """The text's bare letters and digits as code points; case, accents, spacing, punctuation and look-alikes are gone."""
    codes = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return codes[codes != 0]
