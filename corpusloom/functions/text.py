"""Text functions: built-in Column expressions wherever Spark has them; Arrow UDFs for Unicode forms and subsequences."""

from __future__ import annotations

import difflib
import hashlib
import json
import struct
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: white space as Unicode defines it for splitting; one pattern that Java and RE2 read alike.
SPACE = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed: ends of sentences; the plain full stop is not one of them.
SENTENCE_END = r"[\n。！？!?；;]"
#: Fixed: signs of UTF-8 read as Latin letters, as a pattern and as substrings; two detectors, kept apart.
MOJIBAKE_PATTERN = "(?:Ã[\u0080-¿]|[áÁ][º»]|Ä[\u0080-\u009f]|Æ[\u0080-¿])"
MOJIBAKE_PARTS = ["Ã¡", "Ã ", "Ã£", "Ã©", "Ã¨", "Ã\xad", "Ã³", "Ã²", "Ãº", "Ã¹", "Ä‘", "áº", "á»"]


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def split(x: Column) -> Column:
    """Words between white space; none for null or blank."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(split(x))


def tokens(x: Column) -> Column:
    """Lower-case words after compatibility normalisation (a column made before: an Arrow UDF can't stand in lambdas)."""
    return split(F.lower(nfkc(x)))


def tokens_folded(x: Column) -> Column:
    """Case-folded words without normalisation: the other tokeniser."""
    return split(casefold(x))


def collapse(x: Column) -> Column:
    """Runs of spaces and tabs are one space, lines are stripped, line breaks stay."""
    lines = F.split(F.regexp_replace(x, r"[ \t]+", " "), "\n")
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def unsegment(x: Column) -> Column:
    """Joined syllables apart again (under-score to space), with the spaces before and after punctuation repaired."""
    spaced = F.regexp_replace(x, "_", " ")
    closed = F.regexp_replace(spaced, r"\s+([,.!?;:)\]}»”…])", "$1")
    return collapse(F.regexp_replace(closed, r"([(\[{«“])\s+", "$1"))


def blocks(x: Column) -> Column:
    """Stripped parts between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(x, r"\n[ \t\r\f\x0B]*\n"), strip), lambda b: b != "")


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), SENTENCE_END), strip), lambda s: s != "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, repeats included, joined by a sign no word holds; none if there are fewer words."""
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), "\x01"))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def distinct_n(words: Column, n: int) -> Column:
    """Share of different n-grams of a word array; 0 without any. For several n of long texts use ngram_profile."""
    g = ngrams(words, n)
    return F.coalesce(F.try_divide(F.size(F.array_distinct(g)).cast("double"), F.size(g)), F.lit(0.0))


def repetition_rate(words: Column, n: int = 3) -> Column:
    """1 - distinct_n; 0 without any n-gram."""
    return F.when(F.size(words) >= n, 1.0 - distinct_n(words, n)).otherwise(0.0)


def _repetition(text: str | None, words: int, n: int, repeats: int) -> tuple[bool, bool]:
    w = (text or "").split()
    if len(w) < words:
        return False, False
    grams = Counter(zip(*(w[i:] for i in range(n)), strict=False))
    broken = max(grams.values()) >= repeats
    folded = [x.casefold() for x in w]
    total = len(w) - n + 1
    different = len(set(zip(*(folded[i:] for i in range(n)), strict=False)))
    return broken, broken or 1.0 - different / total >= 0.25


def repetition(x: Column, words: int = 32, n: int = 3, repeats: int = 8) -> Column:
    """(degenerate, repetition) of a text of at least `words` words.

    degenerate: some n-gram occurs `repeats` times, case counts. repetition: that, or a quarter of the n-grams, case
    ignored, are repeats. An Arrow UDF: lambdas over a text's n-grams would evaluate its split once per n-gram.
    """

    @F.pandas_udf("degenerate boolean, repetition boolean")
    def of(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_repetition(t, words, n, repeats) for t in s], columns=["degenerate", "repetition"])

    return of(x)


def mojibake_by_pattern(x: Column) -> Column:
    return F.coalesce(x.rlike(MOJIBAKE_PATTERN), F.lit(False))


def mojibake_by_parts(x: Column) -> Column:
    found = x.contains("�")
    for part in MOJIBAKE_PARTS:
        found = found | x.contains(part)
    return F.coalesce(found, F.lit(False))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, bit-parallel: one big-integer step per element of b."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        match = row & at.get(y, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length of two arrays; null if either is null."""
    return pd.Series([None if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def overlap_scores(shared: Column, hyp: Column, ref: Column) -> Column:
    """(p, r, f) of a shared count against both sizes, 0 where a side is empty."""
    p = F.coalesce(F.try_divide(shared.cast("double"), hyp), F.lit(0.0))
    r = F.coalesce(F.try_divide(shared.cast("double"), ref), F.lit(0.0))
    return F.struct(p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f"))


@F.pandas_udf(T.StructType([T.StructField(f"n{n}", T.IntegerType()) for n in range(1, 5)]))
def shared_ngrams(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Multiset intersections of two word arrays' n-grams for n = 1..4: the least of both counts, summed.

    An Arrow UDF with hash tables: lambdas would compare every n-gram with every other.
    """
    out = []
    for h, r in zip(hyp, ref, strict=True):
        h, r = list(h) if h is not None else [], list(r) if r is not None else []
        out.append([sum((_counted(h, n) & _counted(r, n)).values()) for n in range(1, 5)])
    return pd.DataFrame(out, columns=["n1", "n2", "n3", "n4"], dtype="int32")


def _counted(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n)), strict=False))


@F.pandas_udf(T.StructType([T.StructField("words", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("distinct_1", "distinct_2", "repetition_3", "repetition_4")]]))
def ngram_profile(words: pd.Series) -> pd.DataFrame:
    """Number of words, shares of different 1- and 2-grams, and of repeated 3- and 4-grams of word arrays; 0 without any."""
    out = []
    for w in words:
        w = list(w) if w is not None else []
        share = [len(_counted(w, n)) / (len(w) - n + 1) if len(w) >= n else None for n in range(1, 5)]
        out.append((len(w), share[0] or 0.0, share[1] or 0.0, 0.0 if share[2] is None else 1 - share[2], 0.0 if share[3] is None else 1 - share[3]))
    return pd.DataFrame(out, columns=["words", "distinct_1", "distinct_2", "repetition_3", "repetition_4"]).astype({"words": "int32"})


def rouge_n(hyp: Column, ref: Column, n: int, shared: Column | None = None) -> Column:
    """(p, r, f); `shared` is the column of shared_ngrams, if made before."""
    size = lambda w: F.greatest(F.size(w) - (n - 1), F.lit(0))
    return overlap_scores((shared_ngrams(hyp, ref) if shared is None else shared)[f"n{n}"], size(hyp), size(ref))


def rouge_f(hyp: Column, ref: Column, n: int, shared: Column | None = None) -> Column:
    """The F1 of ROUGE-N alone: twice what is shared over both sizes, 0 where a side has no n-gram."""
    size = F.size(hyp) + F.size(ref) - 2 * (n - 1)
    both = (shared_ngrams(hyp, ref) if shared is None else shared)[f"n{n}"].cast("double")
    return F.when((F.size(hyp) >= n) & (F.size(ref) >= n), 2 * both / size).otherwise(0.0)


def rouge_l(hyp: Column, ref: Column) -> Column:
    return overlap_scores(lcs(hyp, ref), F.size(hyp), F.size(ref))


def rouge_lsum(hyp: Column, ref: Column) -> Column:
    """ROUGE-L over sentences instead of words."""
    return rouge_l(sentences(hyp), sentences(ref))


def bleu(hyp: Column, ref: Column, most: int = 4, shared: Column | None = None) -> Column:
    """bleu1..: geometric means of n-gram precisions, never below 1e-9, times the brevity penalty; 0 if a side is empty."""
    h, r = F.size(hyp), F.size(ref)
    shared = shared_ngrams(hyp, ref) if shared is None else shared
    brevity = F.when(h < r, F.exp(1.0 - r / h)).otherwise(1.0)
    logs = [F.ln(F.greatest(F.coalesce(F.try_divide(shared[f"n{n}"].cast("double"), F.greatest(h - (n - 1), F.lit(0))), F.lit(0.0)), F.lit(1e-9))) for n in range(1, most + 1)]
    total, fields = F.lit(0.0), []
    for n, x in enumerate(logs, 1):
        total = total + x
        fields.append(F.when((h > 0) & (r > 0), F.round(brevity * F.exp(total / n), 4)).otherwise(0.0).alias(f"bleu{n}"))
    return F.struct(*fields)


def semantic(hyp: Column, ref: Column, h: Column, r: Column, words_lcs: Column, sentences_lcs: Column) -> Column:
    """The 17 scores of a text against its reference: ROUGE-1/2/L/Lsum, BLEU-1..4, length ratio.

    h and r are the texts' tokens; the two LCS lengths, of tokens and of sentences, are columns made before, as Arrow
    UDFs can't stand inside lambdas.
    """
    shared = shared_ngrams(h, r)
    parts = {"rouge1": rouge_n(h, r, 1, shared), "rouge2": rouge_n(h, r, 2, shared), "rougeL": overlap_scores(words_lcs, F.size(h), F.size(r)), "rougeLsum": overlap_scores(sentences_lcs, F.size(sentences(hyp)), F.size(sentences(ref)))}
    scores = [F.round(s[k], 4).alias(f"{name}_{k}") for name, s in parts.items() for k in "prf"]
    b = bleu(h, r, 4, shared)
    return F.struct(*scores, *[b[f"bleu{n}"].alias(f"bleu{n}") for n in range(1, 5)], F.round(F.coalesce(F.try_divide(F.size(h).cast("double"), F.size(r)), F.lit(0.0)), 4).alias("length_ratio"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity of two texts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def code_output(x: Column) -> Column:
    """Without fence lines and trailing spaces."""
    lines = F.filter(F.split(x, "\n"), lambda line: ~F.ltrim(line).startswith("```"))
    return F.rtrim(F.array_join(F.transform(lines, lambda line: F.rtrim(line)), "\n"))


def preview(x: Column, most: int) -> Column:
    """One line of at most `most` characters; line breaks show, and `...` stands for the rest."""
    line = F.regexp_replace(x, "\n", "⏎")
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("...")))


def file_stem(x: Column) -> Column:
    """An id as a file name: everything but letters, digits, dot, dash and under-score is an under-score."""
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_")


def template(prompt: str, x: Column, mark: str = "{document}") -> Column:
    """The prompt with the text in place of the mark; a text that holds a chat mark-up stays as it is."""
    head, _, tail = prompt.partition(mark)
    return F.when(x.rlike(r"<\|im_start\|>|<\|start_header_id\|>|\[INST\]"), x).otherwise(F.concat(F.lit(head), x, F.lit(tail)))


def hash_score(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between, in hex: an order that depends on nothing else."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


@F.pandas_udf(T.StringType())
def canonical_json_hash(s: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text with sorted keys and no spaces; NaN and infinite numbers are refused."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    def of(t: str) -> str:
        value = json.loads(t, parse_constant=refuse)
        return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()

    return s.map(of, na_action="ignore")


def token_ids_hash(ids: Column, prefix: bytes = b"") -> Column:
    """SHA-256 of a version prefix, the count as 8 bytes and each id as 4 bytes, high byte first; an id beyond 32 bits fails."""

    @F.pandas_udf(T.StringType())
    def of(s: pd.Series) -> pd.Series:
        def one(x: list[int]) -> str:
            values = [int(i) for i in x]
            if any(not 0 <= i <= 0xFFFFFFFF for i in values):
                raise ValueError("token ids must fit 32 bits without a sign")
            return hashlib.sha256(prefix + struct.pack(f">Q{len(values)}I", len(values), *values)).hexdigest()

        return s.map(one, na_action="ignore")

    return of(ids)


def decoded(x: Column) -> Column:
    """Decoded text for comparing: compatibility form, white space runs as one space, stripped."""
    return strip(F.regexp_replace(nfkc(x), f"{SPACE}+", " "))


def rouge_folded(hyp: Column, ref: Column, n: int) -> Column:
    """(p, r, f) of ROUGE-N on case-folded tokens; a side with fewer than n tokens gives 0, not null."""
    return rouge_n(tokens_folded(hyp), tokens_folded(ref), n)


def utc_iso(ts: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with its offset, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
