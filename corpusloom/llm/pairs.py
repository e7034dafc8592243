"""Broken prompt and response pairs (problem 4).

A response is aligned with its prompt by token shingles and longest common subsequences (copies of the article or of
the question), and with refusal templates (refusals). Its language is judged by the vocabulary of all prompts of the
same kind, accents set aside; a break-off by open quotes and brackets, by dangling marks, and by how often its last two
words end a sentence anywhere in the table. The types are tested in the order empty, refusal, copy, language, break-off.
Words of many texts are cut and hashed at once in arrays; one pass over the table counts the words of the prompts and
the ends of sentences together.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.overlap import Chunker, _mix, _runs
from corpusloom.llm.viet import ACCENTED, fold_table
from corpusloom.session import cut

EMPTY, TRUNCATED, REFUSAL, COPIED, LANGUAGE = "empty_summary", "truncated_summary", "refusal", "copied_document", "other_language"
#: Parameters: shingle length and least share of a copy, of a template's alignment, of known words, and the vocabulary's size.
SHINGLE, COPY, TEMPLATE, KNOWN, VOCABULARY = 3, 0.85, 0.8, 0.45, 20_000
#: A last pair of words that ends a sentence less often than this, or if never seen a last word, is a break-off.
PAIR_ENDS, WORD_ENDS = 0.02, 0.02
#: A sentence up to so many words is an opening, after which a refusal may still follow.
OPENING = 6

#: What stands for an empty answer, and the words of labels that announce one.
FILLERS = "n/a, na, null, none, nil, nan, undefined, empty, trống, rỗng, không có, không có nội dung, không, tbd, todo, no summary, no answer, no response, xxx".split(", ")
LABELS = "tóm tắt, bản tóm tắt, bản tóm tắt như sau, tóm tắt như sau, tóm tắt nội dung, nội dung chính, nội dung, ý chính, trả lời, câu trả lời, đáp án, kết quả, summary, the summary, here is the summary, here is a summary, answer, response, output, result, main point, main points, tl dr, tldr, title, tiêu đề".split(", ")

#: How refusals are worded, by language.
REFUSALS = """
tôi không thể tóm tắt nội dung này
tôi không thể tóm tắt văn bản này
tôi không thể hỗ trợ yêu cầu như vậy
tôi không thể giúp bạn việc này
tôi không thể trả lời câu hỏi này
tôi không thể thực hiện yêu cầu này
tôi không thể cung cấp bản tóm tắt
tôi không đủ thông tin để viết tóm tắt
tôi không có đủ thông tin để trả lời
tôi không có khả năng đọc văn bản đính kèm
tôi không được phép xử lý đoạn văn này
tôi không thấy văn bản nào để tóm tắt
tôi không biết câu trả lời
tôi xin từ chối trả lời
tôi từ chối trả lời
mình chưa thể đưa ra bản tóm tắt cho văn bản trên
yêu cầu này nằm ngoài phạm vi tôi được làm
yêu cầu này vi phạm chính sách
i m sorry but i can t help with that
i can t help with that
i cannot help with this request
i cannot summarise this content
i can not summarize this text
i won t be able to provide a summary here
i am unable to process this text
i am not able to summarise this text
i don t have enough information to answer
unfortunately no article was supplied so i can t answer
this request goes against my guidelines
i must decline to answer
i cannot comply with this request
je suis désolé mais je ne peux pas résumer ce texte
je ne peux pas répondre à cette demande
je ne peux pas vous aider
lo siento pero no puedo resumir este texto
no puedo ayudar con esa solicitud
es tut mir leid aber ich kann diesen text nicht zusammenfassen
ich kann dabei nicht helfen
maaf saya tidak dapat meringkas teks ini
maaf saya tidak bisa membantu permintaan ini
извините я не могу помочь с этим
к сожалению я не могу обобщить этот текст
я не могу ответить на этот запрос
"""
#: The same for scripts without spaces; such a string in the first sentence is a refusal.
REFUSAL_STRINGS = "抱歉 我无法 我不能 无法提供 无法总结 对不起 很遗憾 申し訳 できません 죄송합니다".split()

OPEN, CLOSE = "([{“‘«", ")]}”’»"
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|```[A-Za-z]*|[*_#`~|]+")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|\n+")
_LIST_MARK = re.compile(r"(?:^|\n)\s*(?:\d{1,2}[.)]|[-*•+])\s*$")
_QUESTION_ENDS = re.compile(r"(?<=[.!?])\s+|\s*\n")
_INVISIBLE = re.compile("[" + "".join(map(chr, (c for c in range(0x20000) if unicodedata.category(chr(c)) == "Cf"))) + "]")
_DOTS = re.compile(r"\s*(?:…|\.{3,})[\"'”’»)\]}*`_]*$")
_ENDS = re.compile(r"[.!?…。！？][\"'”’»)\]}*`_]*$")


#: Scripts written without spaces between words: each character is a word.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)]
#: Classes of characters that are no part of words: marks that end a sentence, that may close after it, spaces, line ends.
_END, _CLOSER, _SPACE, _LINE = 1, 2, 3, 4


@functools.cache
def _alone() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for a, b in UNSPACED:
        table[a : b + 1] = True
    return table


@functools.cache
def _bare_table() -> np.ndarray:
    """Code point -> its bare lower-case letter or digit, 0 for accents and invisible signs, a space for all else."""
    table = fold_table().copy()
    for cp in np.flatnonzero(table[:0x20000] == 0).tolist():
        table[cp] = 0 if unicodedata.category(chr(cp)) in ("Mn", "Mc", "Me", "Cf") else 32
    table[0x323B0:] = 32
    return table


@functools.cache
def _inside() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.frombuffer(bytes(chr(cp).isalnum() for cp in range(0x110000)), bool)


@functools.cache
def _class() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for marks, kind in ((".!?…。！？", _END), ("\"'”’»)]}*`_", _CLOSER), (" \t\r\x0b\x0c\xa0", _SPACE), ("\n", _LINE)):
        table[[ord(c) for c in marks]] = kind
    table[[*range(0x2000, 0x200B), 0x202F, 0x3000]] = _SPACE
    return table


@functools.cache
def _accented() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in ACCENTED]] = True
    return table


@dataclass
class Words:
    """The words of several texts: hash and text of each, and whether it holds a digit; places in the joined code points."""

    codes: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    digit: np.ndarray
    bounds: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Where the words of each text begin, and the number of all words."""
        return np.searchsorted(self.text, np.arange(len(self.bounds)))


_CHUNKER = Chunker()


def _words(codes: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Words:
    """Runs of `inside` characters within each text, characters of unspaced scripts one by one."""
    alone = _alone()[codes] & inside
    edge = np.zeros(len(codes) + 1, bool)
    edge[bounds] = True
    begins = inside & (alone | edge[:-1] | ~np.concatenate([[False], inside[:-1]]) | np.concatenate([[False], alone[:-1]]))
    start = np.flatnonzero(begins)
    ends = inside & (alone | edge[1:] | ~np.concatenate([inside[1:], [False]]) | np.concatenate([alone[1:], [False]]))
    stop = np.flatnonzero(ends) + 1
    _CHUNKER._grow(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64)) * _CHUNKER.powers[: len(codes)], dtype=np.uint64)])
    hashed = _mix((sums[stop] - sums[start]) * _CHUNKER.inverse[start] + (stop - start).astype(np.uint64)).view(np.int64)
    digits = np.concatenate([[0], np.cumsum((codes >= 48) & (codes < 58))])
    return Words(codes, start, stop, np.searchsorted(bounds, start, side="right") - 1, hashed, digits[stop] > digits[start], bounds)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def bare_words(texts: list[str]) -> Words:
    """Lower-case words without accents and look-alike letters."""
    codes, bounds = _joined(texts)
    codes = _bare_table()[codes]
    kept = np.concatenate([[0], np.cumsum(codes != 0)])
    codes = codes[codes != 0]
    return _words(codes, kept[bounds], codes != 32)


def exact_words(texts: list[str]) -> Words:
    """Lower-case words, composed."""
    codes, bounds = _joined([unicodedata.normalize("NFC", t).lower() for t in texts])
    return _words(codes, bounds, _inside()[codes])


def words(text: str) -> list[str]:
    """Lower-case words, composed."""
    return _WORD.findall(unicodedata.normalize("NFC", text).lower())


class _Bare(dict):
    """Code point -> what `bare_words` makes of it, with spaces around characters that are words; filled as it is asked."""

    def __missing__(self, cp: int) -> str:
        to = int(_bare_table()[cp])
        self[cp] = made = "" if to == 0 else f" {chr(to)} " if _alone()[to] else chr(to)
        return made


_BARE = _Bare()


def bare(text: str) -> list[str]:
    """Lower-case words without accents and look-alike letters: `bare_words` of one short text."""
    return text.translate(_BARE).split()


_REFUSALS = [bare(t) for t in REFUSALS.strip().split("\n")]
_OF_WORD: dict[str, list[int]] = {}
for _i, _t in enumerate(_REFUSALS):
    for _x in _t:
        _OF_WORD.setdefault(_x, []).append(_i)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        match = row & at.get(y, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + SHINGLE]) for i in range(len(tokens) - SHINGLE + 1)}


#: An answer with more words than any filler or label, and without mark-up, is not empty.
_LABEL_WORDS = max(len(words(t)) for t in (*FILLERS, *LABELS))


def empty(response: str) -> bool:
    """Nothing but space, signs, mark-up, a filler or a label."""
    if "<" not in response and "`" not in response and response.count(" ") > 4 * _LABEL_WORDS and len(words(response)) > _LABEL_WORDS:
        return False
    shown = "".join(c for c in _TAG.sub(" ", response) if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t")
    tokens = words(shown)
    if not tokens:
        return True
    flat = " ".join(tokens)
    label = flat in LABELS and (shown.strip()[-1:] in ":：-" or len(tokens) <= 2 or "*" in response or "#" in response)
    return label or shown.strip(" \n\t.\"'()[]<>{}-").lower() in FILLERS


def refusal(response: str) -> bool:
    """Whether a sentence aligns with a refusal template and holds little else; only short openings may stand before it."""
    for sentence in _SENTENCE.split(response.strip()):
        if not sentence.strip():
            continue
        if any(s in sentence for s in REFUSAL_STRINGS):
            return True
        tokens = bare(sentence)
        votes: dict[int, int] = {}
        have = set(tokens)
        for x in have & _OF_WORD.keys():
            for i in _OF_WORD[x]:
                votes[i] = votes.get(i, 0) + 1
        for i, n in votes.items():
            t = _REFUSALS[i]
            if n >= TEMPLATE * len(t) and len(tokens) <= 2.5 * len(t) + 4 and lcs(t, tokens) >= TEMPLATE * len(t):
                return True
        if len(tokens) > OPENING:
            return False
    return False


def copied(prompt: str, text: list[str], answer: list[str]) -> bool:
    """Whether the response holds COPY of the article, or is the question; `text` and `answer` are their bare words."""
    if len(answer) < 3:
        return False
    if "?" in prompt:
        for q in _QUESTION_ENDS.split(prompt):
            if not q.endswith("?"):
                continue
            for form in (q, q.split(":", 1)[-1]) if ":" in q else (q,):
                asked = bare(form)
                if len(asked) >= 3 and len(answer) <= 1.6 * len(asked) + 3 and lcs(asked, answer) >= 0.9 * len(asked):
                    return True
    if len(answer) < 0.4 * len(text):
        return False
    have = shingles(answer)
    for article in articles(prompt):
        tokens = bare(article)
        if len(tokens) < 8 or len(tokens) < 0.5 * len(text):
            continue
        own = shingles(tokens)
        inside = len(own & have) / max(len(own), 1)
        if inside >= COPY or (inside >= 0.6 and lcs(tokens, answer) >= 0.9 * len(tokens)):
            return True
    return False


def articles(prompt: str) -> Iterator[str]:
    """The prompt, and what is left of it without an instruction before or a question around."""
    yield prompt
    body = prompt.strip()
    lines = body.split("\n")
    if len(lines) > 1 and lines[-1].rstrip().endswith("?"):
        body = "\n".join(lines[:-1])
        yield body
    if len(lines) > 1:
        yield "\n".join(body.split("\n")[1:])
    at = body.find(":", 0, 200)
    if at > 0:
        yield body[at + 1 :]
        again = body.find(":", at + 1, at + 250)
        if again > 0:
            yield body[again + 1 :]
    *rest, last = re.split(r"(?<=[.!?])\s+", body)
    if last.rstrip().endswith("?") and rest:
        yield " ".join(rest)


def vietnamese(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text, as lower-case code points, is written with the letters of Vietnamese."""
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
    return count(_accented()[codes]) > 0.04 * np.maximum(count(_inside()[codes] & ((codes < 48) | (codes > 57))), 1)


def foreign(w: Words, known: np.ndarray) -> np.ndarray:
    """Whether fewer than KNOWN of the words of each text are of the prompts' language (`known`: whether each word is)."""
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])
    every = count(~w.digit)
    return (every > 0) & (count(known & ~w.digit) < KNOWN * every)


def broken(response: str) -> tuple[bool | None, str, str]:
    """(broken off or not or None if only its last words can tell, the last two words)."""
    shown = _INVISIBLE.sub("", response).rstrip()
    if _LIST_MARK.search(shown) and "\n" in shown:
        return True, "", ""
    body = re.sub(r"(?m)(^|\s)\(?[0-9a-zA-Z]{1,2}\)", " ", shown)
    for a, b in zip(OPEN, CLOSE, strict=True):
        if body.count(a) > body.count(b) and body.rfind(a) > body.rfind(b):
            return True, "", ""
    if body.count('"') % 2 and body.rfind('"') > body.rfind("\n"):
        return True, "", ""
    dots = _DOTS.search(shown)
    tail = shown[: dots.start()].rstrip() if dots else shown
    if _ENDS.search(tail) and not dots:
        return False, "", ""
    if re.search(r"[,:;–—(\-\[“\"«/&=+]$", tail):
        return True, "", ""
    last = words(tail)[-2:]
    return None, last[0] if len(last) > 1 else "", last[-1] if last else ""


def sentence_ends(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each word ends a sentence, whether it stands in a sentence that has an end, the sentence's number).

    A word ends a sentence if an end mark follows and then, behind closing marks, a space, a line's or the text's end.
    A line's end cuts sentences too; what has no end says nothing about ends.
    """
    kind = _class()[w.codes]
    size = len(kind)
    at = np.arange(size)
    stops = (kind == _SPACE) | (kind == _LINE)
    edge = np.zeros(size + 1, bool)
    edge[w.bounds] = True
    # the first space, line end or text end at or after each place
    free = np.where(np.append(stops, True) | edge, np.arange(size + 1), size)
    after = np.minimum.accumulate(free[::-1])[::-1]
    # the last character before each place that is no closing mark
    solid = np.maximum.accumulate(np.where(kind != _CLOSER, at, -1)) if size else at
    # the first line or text end at or after each place
    line = np.minimum.accumulate(np.where(np.append(kind == _LINE, True) | edge, np.arange(size + 1), size)[::-1])[::-1]
    n = len(w.start)
    following = np.append(w.start[1:], size)
    gap = np.where(edge[w.stop], w.stop, after[w.stop])  # a text's end right behind the word
    mark = solid[np.maximum(gap - 1, 0)] if size else gap
    ends = (gap <= following) & (gap > w.stop) & (mark >= w.stop) & (kind[np.minimum(mark, max(size - 1, 0))] == _END)
    cuts = ends | (line[w.stop] <= following)
    if n:
        cuts[-1] = True
        cuts[:-1] |= w.text[1:] != w.text[:-1]
    segment = np.cumsum(np.concatenate([[0], cuts[:-1]])) if n else np.zeros(0, np.int64)
    return ends, ends[cuts][segment] if n else ends, segment


def counted(df: DataFrame) -> DataFrame:
    """(kind, w1, w2, ends, n) from one pass over all texts.

    Kind 0 and 1: how often the word w2 occurs in the prompts of other languages and of Vietnamese, accents set aside.
    Kind 2: how often the words w1 and w2 (with w1 0, w2 alone) stand together and end a sentence. Words are hashes;
    they are counted in each batch before the shuffle.
    """
    columns = [c for c in ("document", "reference_summary", "summary") if c in df.columns]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def summed(kind: np.ndarray, w1: np.ndarray, w2: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
            rows = pd.DataFrame({"kind": kind.astype(np.int8), "w1": w1, "w2": w2, "ends": ends.astype(np.int64), "n": 1})
            return rows.groupby(["kind", "w1", "w2"], sort=False, as_index=False).sum()

        for f in frames:
            for c in columns:
                texts = [t for t in f[c] if t]
                for part in _runs(texts):
                    given = [unicodedata.normalize("NFC", t).lower() for t in texts[part]]
                    codes, bounds = _joined(given)
                    w = _words(codes, bounds, _inside()[codes])
                    ends, inside, segment = sentence_ends(w)
                    zero = np.zeros(len(w.hash), np.int64)
                    yield summed(zero[inside] + 2, zero[inside], w.hash[inside], ends[inside])
                    pair = np.flatnonzero(inside[1:] & (segment[1:] == segment[:-1])) + 1
                    yield summed(zero[pair] + 2, w.hash[pair - 1], w.hash[pair], ends[pair])
                    if c == "document":
                        kind = vietnamese(codes, bounds)
                        b = bare_words(given)
                        use = ~b.digit & (b.stop - b.start <= 24)
                        none = np.zeros(int(use.sum()), np.int64)
                        yield summed(kind[b.text[use]].astype(np.int64), none, b.hash[use], none)

    made = df.select(*columns).mapInPandas(of, "kind byte, w1 long, w2 long, ends long, n long")
    return made.groupBy("kind", "w1", "w2").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the most frequent words of Vietnamese and of other prompts; VOCABULARY of each at most."""
    top = lambda kind: np.sort(np.array([r.w2 for r in counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "w2").limit(VOCABULARY).select("w2").collect()], np.int64))
    return top(1), top(0)


def defects(df: DataFrame) -> DataFrame:
    """row_id, defect_type of each defective pair of row_id, document, summary (and reference_summary if there).

    A null, empty or blank response is an empty_summary; a null or empty prompt copies and languages can't be told by,
    the other types are. Repeated rows give one row each. An empty table gives no row; other columns are not read.
    """
    counts = cut(counted(df))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(counts))
    kind = df.schema["row_id"].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, other = shared.value
        for f in frames:
            prompts, responses = f["document"].fillna("").to_list(), f["summary"].fillna("").to_list()
            for part in _runs([p + r for p, r in zip(prompts, responses, strict=True)]):
                yield pd.DataFrame(_judged(f["row_id"][part].to_list(), prompts[part], responses[part], own, other), columns=["row_id", "defect_type", "w1", "w2"])

    judged = cut(df.select("row_id", "document", "summary").mapInPandas(of, f"row_id {kind}, defect_type string, w1 long, w2 long"))
    known = counts.where("kind = 2")
    asked = judged.where("defect_type is null")
    pair = known.select("w1", "w2", F.col("ends").alias("pair_ends"), F.col("n").alias("pair_n"))
    word = known.where("w1 = 0").select("w2", F.col("ends").alias("word_ends"), F.col("n").alias("word_n"))
    told = asked.join(pair, ["w1", "w2"], "left").join(word, "w2", "left")
    off = (
        F.when(F.col("word_n").isNull(), True)
        .when(F.col("pair_n").isNull() | (F.col("w1") == 0), F.col("word_ends") < WORD_ENDS * F.col("word_n"))
        .otherwise((F.col("pair_ends") < PAIR_ENDS * F.col("pair_n")) & ((F.col("pair_n") >= 5) | (F.col("word_ends") < WORD_ENDS * F.col("word_n"))))
    )
    broke = told.where(off).select("row_id", F.lit(TRUNCATED).alias("defect_type"))
    return judged.where("defect_type is not null").select("row_id", "defect_type").unionByName(broke)


def _judged(rows: list, prompts: list[str], responses: list[str], own: np.ndarray, other: np.ndarray) -> list[tuple]:
    """(row, defect or None, last two words' hashes) of the pairs that are defective, or that only their last words can tell."""
    lower = [t.lower() for t in prompts]
    kinds = vietnamese(*_joined([unicodedata.normalize("NFC", t) for t in lower]))
    p, r = bare_words(prompts), bare_words(responses)
    known = np.where(kinds[r.text], np.isin(r.hash, own), np.isin(r.hash, other)) if len(r.hash) else np.zeros(0, bool)
    strange = foreign(r, known)
    flat = [x.codes.tobytes().decode("utf-32-le", "surrogatepass") for x in (p, r)]
    p_first, r_first = p.first, r.first
    listed = lambda x, text, first, i: [text[a:b] for a, b in zip(x.start[first[i] : first[i + 1]].tolist(), x.stop[first[i] : first[i + 1]].tolist(), strict=True)]
    out, asked = [], []
    for i, (row, prompt, response) in enumerate(zip(rows, prompts, responses, strict=True)):
        if empty(response):
            out.append((row, EMPTY, 0, 0))
        elif refusal(response):
            out.append((row, REFUSAL, 0, 0))
        elif prompt and (10 * (r_first[i + 1] - r_first[i]) >= 4 * (p_first[i + 1] - p_first[i]) or "?" in prompt) and copied(prompt, listed(p, flat[0], p_first, i), listed(r, flat[1], r_first, i)):
            out.append((row, COPIED, 0, 0))
        elif prompt and strange[i]:
            out.append((row, LANGUAGE, 0, 0))
        else:
            told, w1, w2 = broken(response)
            if told:
                out.append((row, TRUNCATED, 0, 0))
            elif told is None:
                asked.append((row, w1, w2))
    if asked:
        w = exact_words([f"{w1} {w2}" for _, w1, w2 in asked])
        first = w.first
        for i, (row, w1, _) in enumerate(asked):
            hashes = w.hash[first[i] : first[i + 1]].tolist()
            out.append((row, None, hashes[-2] if w1 and len(hashes) > 1 else 0, hashes[-1] if hashes else 0))
    return out
