"""Personal information in free text, by anchor expansion (problem 9).

One pass of an Aho-Corasick automaton finds anchors: at-signs and their spelled forms, dialling prefixes, cues of
identity numbers, words of addresses, surnames and phrases that introduce names. A local parser per kind expands each
anchor to the left and right and validates the boundaries. Where spans overlap the more specific type wins.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

EMAIL, PHONE, ID, ADDRESS, NAME = "email", "phone", "id_number", "address", "person_name"
#: Which type keeps its span where two overlap, the first first.
ORDER = (EMAIL, ID, ADDRESS, PHONE, NAME)
PLACEHOLDERS = {EMAIL: "[EMAIL]", PHONE: "[PHONE]", ID: "[ID_NUMBER]", ADDRESS: "[ADDRESS]", NAME: "[PERSON_NAME]"}


class Span(NamedTuple):
    start: int
    end: int
    kind: str


#: Cue words by kind. Surnames in SURE_SURNAMES need no cue before them; the others do.
AT_SIGNS = ["@", "＠", "(at)", "[at]", "{at}", " at ", " a còng ", " a cong ", " a móc ", "(a còng)", "[a còng]"]
DIAL = ["+", "0084", "(+84", "(84", "(0", "84", "01", "02", "03", "05", "07", "08", "09", "0 ", "0.", "0-", "o3", "o5", "o7", "o9", "không ", "khong ", "zero ", "oh "]
ID_CUES = ["cccd", "căn cước", "can cuoc", "cmnd", "cmtnd", "chứng minh nhân dân", "chung minh nhan dan", "chứng minh thư", "định danh cá nhân", "dinh danh ca nhan", "mã định danh", "hộ chiếu", "ho chieu", "passport", "ssn", "social security", " id ", " id:", " id no", "số id", "identity card", "national id", "citizen"]
PLACE_CUES = ["tại ", "tai ", "ở ", "đến ", "den ", "về ", "ve ", "địa chỉ", "dia chi", "trú ", "số ", "so ", "sn ", "căn hộ ", "can ho ", ";", "to ", "at ", "is ", "address", "nhà ", '"dia_chi": "', "- ", "ngụ ", "giao "]
SURE_SURNAMES = "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý Đoàn Đào Đinh Trịnh Tống Khổng Mạc Chử Trương Lương Quách".split()
OTHER_SURNAMES = "Mai Cao Lâm Hà Thái Châu La Văn Vương Tô Tạ Kiều Thạch Triệu Phùng Nghiêm Doãn Ninh Diệp Lưu Hứa An Bạch Chu Đàm Đồng Giang Hạ Khuất Khúc Lại Lục Mã Nông Ôn Quan Sơn Tăng Thân Thi Tiêu Tôn Từ Ung Vi Viên Bế Cù Đậu Đường".split()
TITLES = "ông bà anh chị cô chú bác em cháu thầy mr mrs ms miss dr".split()
NAME_CUES = ["liên hệ:", "lien he:", "tác giả:", "tac gia:", "họ và tên:", "ho va ten:", "họ tên:", "ho ten:", "chủ tài khoản", "chu tai khoan", "ghi tên", "ghi ten", '"ten": "', '"name": "', "ảnh:", "anh:", "phân công", "phan cong", "con gái", "con trai", "vợ", "chồng", "người ký:", "ký tên", "tên:", "name:", "contact:", "photo by", "lists", "said", "signed by", "written by", "author:", "dear", "tên là", "đại diện:", "kính gửi", "người nhận:", "người gửi:"]
STREETS = "Street|St\\.|Road|Rd\\.?|Lane|Ln\\.?|Avenue|Ave\\.?|Drive|Dr\\.|Court|Ct\\.|Place|Pl\\.|Way|Square|Sq\\.|Boulevard|Blvd\\.?|Terrace|Close|Crescent|Row"
#: Words after which a surname starts the name of a street, school, firm or place, not of a person.
NOT_PERSONS = set(
    "đường duong phố pho ngõ ngo hẻm hem kiệt kiet ngách ngach trường truong ty viện vien tỉnh tinh huyện huyen xã xa phường phuong trấn tran vùng vung cư cu "
    "thôn thon quận quan chợ cho cầu cau hãng hang xưởng xuong quỹ quy hội hoi tòa toa p. tp. q. h. tx. tt. street road school company công"
    .split()
)
#: Words right before a number that is no telephone number.
NOT_PHONES = "mã vận đơn, vận đơn, ma van don, mã, hợp đồng, hop dong, isbn, biển số, biển, lô hàng, lô, hóa đơn, đơn hàng, tổng đài, tong dai, order, invoice, parcel, tracking, contract, serial, hotline, tọa độ, tài khoản số, số tài khoản, account".split(", ")
_NOT_PHONE = re.compile(rf"\b(?:{'|'.join(NOT_PHONES)})(?:\W|số|so|no|number|là|is)*$")
DIGIT_WORDS = {w: d for d, ws in enumerate("không khong zero oh|một mot one|hai two|ba three|bốn bon tư four|năm nam lăm five|sáu sau six|bảy bay bẩy seven|tám tam eight|chín chin nine".split("|")) for w in ws.split()}

_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_])?$")
_DOT = r"(?:\.|．|\s*[(\[{](?:dot|chấm|cham|\.)[)\]}]\s*|\s+(?:chấm|cham|dot|DOT)\s+)"
_DOMAIN = re.compile(rf"\s*([A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*{_DOT}([A-Za-z]{{2,24}}))(?![A-Za-z0-9@])")
_SPELLED_DOT = re.compile(r"[(\[{]|chấm|cham|\bdot\b", re.I)
_EXTENSION = re.compile(r"[\s,]*\(?(?:máy lẻ|may le|ext\.?|nội bộ|số lẻ|x)\s*[.:]?\s*\d{1,5}\)?", re.I)
_ID_LINK = re.compile(r"(?:\s*(?:nhân dân|công dân|cá nhân|gắn chíp|cong dan|nhan dan|card|no\.?|number|num\.?|số|so|là|la|is|of|thư|#|:|=|\"|\(|-))*\s*", re.I)
_ID_VALUE = re.compile(r"(?:\d{3}-\d{2}-\d{4}|[A-Z]\s?\d(?:[ .\-]?\d){6,7}|\d(?:[ .\-–]?\d){8}(?:(?:[ .\-–]?\d){3})?)(?![\w])")

_CAP = r"[^\W\d_a-zàáâãèéêìíòóôõùúýăđĩũơưạ-ỹ][^\W\d_]*"
_WORDS = rf"{_CAP}(?:[ \-]{_CAP}){{0,3}}"
_UNIT = r"(?:phường|phuong|P\.|xã|xa|X\.|thị trấn|thi tran|TT\.|thị xã|thi xa|TX\.|quận|quan|Q\.|huyện|huyen|H\.|thành phố|thanh pho|TP\.|Tp\.|tỉnh|tinh|T\.|thôn|thon|ấp|ap|bản|xóm|xom|tổ|to|khu phố|khu pho|KP\.?|đội|khóm|khu|đường|duong|phố|pho|ngõ|ngo|hẻm|hem)"
_UNIT = rf"(?:{_UNIT}|{_UNIT.replace('(?:', '(?i:', 1)})"
_NUMBER = r"\d{1,5}[A-Za-z]?(?:[/\-]\d{1,4}[A-Za-z]?)*"
_PART = rf"(?:,? *[,\-] *(?:{_UNIT} *(?:{_WORDS}|\d{{1,3}}\w?)|(?:tòa|toa|tầng|tang|block|lô|Tòa) *\w+|{_WORDS}))"
_ALLEY = r"(?:,? +(?:ngõ|ngo|hẻm|hem|kiệt|kiet|ngách|ngach|Ngõ|Hẻm|Kiệt|Ngách) +\d+\w*(?:/\d+\w*)*)"
_LEAD = r"(?:(?:số nhà|so nha|nhà số|nha so|số|so|SN|Số nhà|Số|SỐ|căn hộ số|căn hộ|can ho|Căn hộ) +)"
_STREET = r"(?: +(?:đường|duong|phố|pho|Đường|Phố|ĐƯỜNG|đ\.|Đ\.))"
_ADDRESS = re.compile(
    rf"(?:{_LEAD}{_NUMBER}(?:,? *(?:tòa|toa|Tòa|block|chung cư) +\w+)?, *{_NUMBER}{_ALLEY}?{_STREET}? +{_WORDS}{_PART}{{0,5}}"
    rf"|{_LEAD}?{_NUMBER}{_ALLEY}*{_STREET} +{_WORDS}{_PART}{{0,5}}"
    rf"|{_LEAD}?{_NUMBER}{_ALLEY}+ +{_WORDS}{_PART}{{0,5}}"
    rf"|{_LEAD}{_NUMBER}{_PART}{{2,6}}"
    rf"|{_LEAD}?{_NUMBER} +{_WORDS}{_PART}{{2,5}})"
)
_EN_STREET = re.compile(rf"\d{{1,5}}[A-Z]? +(?:{_CAP} +){{1,3}}(?:{STREETS})(?![\w])(?:,? *(?:Apt|Flat|Unit|Suite|Apartment|No)\.? *\w+)?(?:, *{_WORDS})?")
_EN_NAME = re.compile(rf"{_CAP}(?: [A-Z]\.)?(?: {_CAP}(?:-{_CAP})?){{1,2}}")
_EN_LIVES = re.compile(rf"({_CAP}(?: [A-Z]\.)?(?: {_CAP}(?:-{_CAP})?){{1,2}})(?=, who | said\b|, aged )")


def _flat(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not "̀" <= c <= "ͯ").replace("đ", "d").replace("Đ", "D")


def _lower(text: str) -> str:
    """Lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _build() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[str, int]]] = {}
    for kind, cues in ((EMAIL, AT_SIGNS), (PHONE, DIAL), (ID, ID_CUES), (ADDRESS, PLACE_CUES), ("cue", NAME_CUES), ("cue", [f"{t} " for t in TITLES] + [f"{t}. " for t in ("mr", "mrs", "ms", "dr")]), ("lives", [", who ", " said"])):
        for c in cues:
            kinds.setdefault(c, []).append((kind, len(c)))
    for s in SURE_SURNAMES:
        kinds.setdefault(s.lower() + " ", []).append(("surname", len(s) + 1))
        if not s.isascii():
            kinds.setdefault(_flat(s).lower() + " ", []).append(("flat", len(s) + 1))
    for c, k in kinds.items():
        a.add_word(c, tuple(k))
    a.make_automaton()
    return a


_AUTOMATON = None


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _build()
    return _AUTOMATON


def _match(pattern: re.Pattern[str], text: str, at: int, reach: int) -> re.Match[str] | None:
    """The pattern's match at `at`; a match that ends near the reach's end is sought again with twice the reach."""
    while (m := pattern.match(text, at, at + reach)) and at + reach < len(text) and m.end() > at + reach - 32:
        reach *= 2
    return m


def find_email(text: str, start: int, end: int, reach: int = 80) -> Span | None:
    """The address around an at-sign at text[start:end]; a local part that fills the reach is sought again with twice the reach."""
    sign = text[start:end]
    left = text[max(0, start - reach) : start]
    if sign in "@＠" or sign[0] in "([{":
        spaces = len(left) - len(left.rstrip(" "))
        left = left.rstrip(" ") if spaces <= 2 else ""
        strict = spaces > 0
    else:
        strict = True
    local, domain = _LOCAL.search(left), _match(_DOMAIN, text, end, 160)
    if not local or not domain:
        return None
    if start > reach and not left[: local.start()].strip("._%+-"):
        return find_email(text, start, end, 2 * reach)
    if sign.strip().lower() == "at" and not (sign.strip() == "AT" or _SPELLED_DOT.search(domain[1])):
        return None
    if strict and local[0].isalpha() and len(local[0]) < 2:
        return None
    at = max(0, start - reach) + local.start()
    return Span(at, domain.end(1), EMAIL)


def find_phone(text: str, low: str, start: int) -> Span | None:
    """The number whose dialling prefix begins at `start`."""
    before = text[start - 1] if start else " "
    if before.isalnum() or before in "/=#_&%$€" or (before in "-.,–:+" and start > 1 and (text[start - 2].isalnum() and before != ":")):
        return None
    if low[start] in "kzo" and low[start + 1 : start + 2].isalpha():
        return _spelled(text, low, start)
    digits, at, last, gap = "", start, start, 0
    abroad = text[start] == "+" and not text[start + 1 : start + 4].strip().startswith("84")
    while at < len(text):
        c = text[at]
        if c.isdecimal():
            digits += str(unicodedata.decimal(c))
        elif c in "lIO" and digits and (at + 1 == len(text) or not text[at + 1].isalpha() or text[at + 1] in "lIO") and not (text[at - 1].isalpha() and text[at - 1] not in "lIO"):
            digits += "0" if c == "O" else "1"
        elif c in " .-–—()+ " and gap < 4:
            gap += 1
            at += 1
            continue
        else:
            break
        gap = 0
        at += 1
        last = at
        full = not abroad and _full(digits)
        if full and (at == len(text) or not (text[at].isdecimal() or text[at] in "lIO" and not text[at + 1 : at + 2].isalpha())):
            break
        if len(digits) > 15:
            return None
    if not (9 <= len(digits) <= 15 if abroad else _full(digits)) or (last < len(text) and (text[last].isalnum() or text[last] in "/_@")):
        return None
    if text[last : last + 2].strip() and text[last] in ".-,:" and text[last + 1 : last + 2].isdecimal():
        return None
    if _NOT_PHONE.search(low, max(0, start - 26), start):
        return None
    if text[last : last + 1] == ")" and "(" in text[start:last] and text.count("(", start, last) > text.count(")", start, last):
        last += 1
    more = _EXTENSION.match(text, last)
    return Span(start, more.end() if more else last, PHONE)


def _full(digits: str) -> bool:
    if digits.startswith("0084"):
        digits = digits[2:]
    if digits.startswith("84") and len(digits) in (11, 12):
        rest = digits[2:]
        rest = rest[1:] if rest.startswith("0") else rest
        return len(rest) == 9 and rest[0] in "235789" or len(rest) == 10 and rest[0] == "2"
    if digits.startswith("0") and len(digits) == 10:
        return digits[1] in "356789" or digits[1:3] == "12"
    return len(digits) == 11 and digits[:2] in ("02", "01")


_LETTERS = re.compile(r"[^\W\d_]+")


def _spelled(text: str, low: str, start: int) -> Span | None:
    at, n, last = start, 0, start
    for m in _LETTERS.finditer(low, start):
        if m[0] not in DIGIT_WORDS or low[at : m.start()].strip(" -,."):
            break
        n, at = n + 1, m.end()
        last = at
        if n == 11:
            break
    return Span(start, last, PHONE) if n in (10, 11) and DIGIT_WORDS[low[start:last].split()[0]] == 0 else None


def find_id(text: str, end: int) -> Span | None:
    """The identity number that follows a cue ending at `end`."""
    link = _match(_ID_LINK, text, end, 40)
    value = _ID_VALUE.match(text, link.end() if link else end)
    return Span(value.start(), value.end(), ID) if value else None


def find_address(text: str, end: int) -> Span | None:
    """The address that begins right after, or with, a cue ending at `end`."""
    at = end
    while at < len(text) and text[at] in " :\"'( ":
        at += 1
    if at < len(text) and (text[at].isdecimal() or text[at] in "sScCnN"):
        m = _match(_ADDRESS, text, at, 220)
        english = _match(_EN_STREET, text, at, 160)
        if english and (not m or english.end() >= m.end()):
            m = english
        if m:
            return Span(m.start(), m.end(), ADDRESS)
    return None


_NAME = re.compile(rf"{_CAP}(?: {_CAP}){{1,4}}")


def find_name(text: str, start: int, sure: bool) -> Span | None:
    """The Vietnamese name that begins at `start`; unless `sure`, what stands before must not say it is a street or firm."""
    m = _match(_NAME, text, start, 60)
    if not m:
        return None
    words = m[0].split(" ")
    upper = words[0].isupper() and len(words[0]) > 1
    kept = [words[0]]
    for w in words[1:]:
        if (w.isupper() and len(w) > 1) != upper and not (len(w) == 1 and w.isupper()):
            break
        kept.append(w)
    if len(kept) < 2:
        return None
    end = start + len(" ".join(kept))
    if not sure:
        if start and (text[start - 1].isalnum() or text[start - 1] in "-_/@"):
            return None
        before = text[max(0, start - 24) : start].split("\n")[-1]
        last = before.split()[-1:] if before[-1:] == " " else []
        if last:
            word = last[0].strip("\"'(").lower()
            if word in NOT_PERSONS or word[-1:].isdecimal():
                return None
            if last[0][:1].isupper() and last[0][-1:].isalpha() and word not in TITLES:
                return None
    return Span(start, end, NAME)


def find_flat_name(text: str, start: int) -> Span | None:
    """A name without accents, which needs a field's or quotation's boundary before it or a telling word after it."""
    s = find_name(text, start, False)
    if s is None or not text[s.start : s.end].isascii():
        return None
    before, after = text[max(0, start - 3) : start], text[s.end : s.end + 9]
    opened = not before.strip(" ") or before[-1] in ";\n\"|\t" or before.endswith(('", ', "”, ", ". ", ": "))
    closed = after[:1] in (";", "|", "\t") or after.startswith((" kể", " ke ", " cho biết", " nói", " - 0", " - +", " - (", " (", ", số", ", C"))
    return s if opened and closed or after.startswith((" kể", " cho biết")) else None


def _cue_name(text: str, at: int, word: str) -> list[Span]:
    """Names after a cue: one, or several joined by commas and 'và'."""
    out = []
    while True:
        while at < len(text) and text[at] in " :\"' -":
            at += 1
        if word.strip() not in TITLES and (m := re.compile(rf"(?:{'|'.join(TITLES)})\.? ", re.I).match(text, at)):
            at = m.end()
        first = re.compile(_CAP).match(text, at)
        if not first:
            return out
        known = _flat(first[0]).lower() in _SURNAMES
        span = find_name(text, at, True) if known else None
        if span is None and not known and word.strip(" .:") in ("contact", "photo by", "lists", "said", "signed by", "written by", "author", "mr", "mrs", "ms", "miss", "dr", "dear", "name", '"name": "'):
            m = _match(_EN_NAME, text, at, 60)
            span = Span(m.start(), m.end(), NAME) if m else None
        if span is None:
            return out
        out.append(span)
        m = re.compile(r"(?:, | và | and |, và )(?=[^\W\d_a-z])").match(text, span.end)
        if not m or not (f := re.compile(_CAP).match(text, m.end())) or (_flat(f[0]).lower() not in _SURNAMES):
            return out
        at = m.end()


_SURNAMES = {_flat(s).lower() for s in SURE_SURNAMES + OTHER_SURNAMES}


def spans(text: str) -> list[Span]:
    """The items of a text in order, without overlaps."""
    low = _lower(text)
    found: list[Span] = []
    phone_until = 0
    for last, kinds in _automaton().iter(low):
        for kind, n in kinds:
            end = last + 1
            start = end - n
            if kind == "cue":
                if start and text[start - 1].isalnum():
                    continue
                found += _cue_name(text, end, low[start:end])
            elif kind == "surname":
                if text[start].isupper() and (s := find_name(text, start, False)):
                    found.append(s)
            elif kind == "flat":
                if text[start].isupper() and (s := find_flat_name(text, start)):
                    found.append(s)
            elif kind == ADDRESS:
                if start and low[start].isalpha() and text[start - 1].isalnum():
                    continue
                own = low[start:end].strip() in ("số", "so", "sn", "căn hộ", "can ho", "nhà")
                s = find_address(text, start if own else end)
                if s is None and own:
                    s = find_address(text, end)
                if s:
                    found.append(s)
            elif kind == PHONE:
                if start >= phone_until and (s := find_phone(text, low, start)):
                    found.append(s)
                    phone_until = s.end
            elif kind == ID:
                if (start == 0 or not text[start].isalnum() or not text[start - 1].isalnum()) and (s := find_id(text, end)):
                    found.append(s)
            elif kind == EMAIL:
                if s := find_email(text, start, end):
                    found.append(s)
            elif kind == "lives":
                m = None
                for m in _EN_LIVES.finditer(text, max(0, start - 50), end + 2):
                    pass
                if m and m.end() == start:
                    found.append(Span(m.start(1), m.end(1), NAME))
    # a line or field that begins with a number (lists, forms)
    for m in re.finditer(r"(?m)^(?=\d)", text):
        if s := find_address(text, m.start()):
            found.append(s)
    return _resolve(found)


def _resolve(found: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(set(found), key=lambda s: (ORDER.index(s.kind), s.start - s.end, s.start)):
        if all(s.end <= o.start or s.start >= o.end for o in out):
            out.append(s)
    return sorted(out)


def redact(text: str, items: list[Span]) -> str:
    """The text with a placeholder for each item."""
    out, at = [], 0
    for s in items:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join(out) + text[at:]


def items(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pii_type, nth, start, length, value of every item; nth counts a type's items of one text from 1.

    start counts characters from 0. Null, empty and blank texts have no item; a repeated key has the items of each of
    its rows; an empty table gives no row; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t in zip(f[key], f[text], strict=True):
                if not t:
                    continue
                count: dict[str, int] = {}
                for s in spans(t):
                    count[s.kind] = count.get(s.kind, 0) + 1
                    out.append((k, s.kind, count[s.kind], s.start, s.end - s.start, t[s.start : s.end]))
            yield pd.DataFrame(out, columns=[key, "pii_type", "nth", "start", "length", "value"])

    return df.select(key, text).mapInPandas(of, f"`{key}` {kind}, pii_type string, nth int, start int, length int, value string")


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, redacted: each text with typed placeholders; a null text stays null."""
    kind = df.schema[key].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "redacted": [redact(t, spans(t)) if t else t for t in f[text]]})

    return df.select(key, text).mapInPandas(of, f"`{key}` {kind}, redacted string")
