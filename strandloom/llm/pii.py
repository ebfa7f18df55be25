"""Operator 2, personal data: offset-preserving deobfuscation.

The base patterns are matched on the text itself. The method then runs transducers over the text that write a normalised
copy and, for each written character, the source range it stands for: homoglyphs (full-width forms, other scripts'
digits and look-alike letters), invisible characters, spelled digits and at/dot disguises. The same patterns run over
the copy, and a match maps back to source characters. A mapped span is added when it touches no base span of its kind.

Every matcher is linear in the text's length: an e-mail is found from its @ sign outwards, a digit run is tried once.

A bare disguise ("name at host dot name") may have any number of names of any length, a run of digit words any length.

Nulls: a null text is empty and has no spans; texts of any length are searched whole; ids may be null or repeated. Each row is judged by itself, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.llm.common import field, per_row

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterable[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            yield first, m.end()
        # What stands before a failed @ can't belong to a later local part.
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the four base patterns, by start, then kind."""
    out: list[Span] = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _DIGITS.sub("", m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m.group())) <= 15]
    return sorted(out)


#: Letters of other scripts that look like ASCII ones, in the order of the string below them.
_LOOKS = str.maketrans("аеорсухіјѕԁɡһνοαρτкмвнАЕОРСХІЈЅВНКМТΑΒΕΗΙΚΜΝΟΡΤΧΥΖ∙․。", "aeopcyxijsdghvoaptkmbhAEOPCXIJSBHKMTABEHIKMNOPTXYZ...")
_INVISIBLE = frozenset("­​‌‍⁠﻿")
_DASHES = frozenset("‐‑‒–—−")
#: Digits as words in English, German, French and Spanish.
_NUMBERS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "(?:" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + ")"
_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_AT = re.compile(rf"\s{{0,3}}{_OPEN}(?:at|@|arroba|chez){_CLOSE}\s{{0,3}}", re.I)
_DOT = re.compile(rf"\s{{0,3}}{_OPEN}(?:dot|\.|punkt|point|punto){_CLOSE}\s{{0,3}}", re.I)
#: Bare words only as a whole disguise: name at host dot name (dot name ...), whose last name is no digit word.
_BARE_AT = re.compile(" at (?=[a-z0-9-])", re.I)
_BARE_HOST = re.compile(r"[a-z0-9-]+(?:(?:\.| dot )[a-z0-9-]+)*+", re.I)
_BARE_END = re.compile(rf" dot (?!{_NUMBER}\Z)[a-z]{{2,24}}\Z", re.I)
_BARE_DOT = re.compile(" dot ", re.I)
#: Spelled digits: a run of four or more digit words, with what may stand between and before.
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]+)?{_NUMBER}(?:[ ,-]{{1,2}}(?:(?:dot|point|punkt|punto)[ -]+)?(?:{_NUMBER}|[0-9]{{1,4}})(?!\w)){{3,}}+", re.I)
_PIECE = re.compile(rf"plus|dot|point|punkt|punto|{_NUMBER}|[0-9]+", re.I)
_ODD = re.compile(r"[^\x00-\x7FÀ-ſ]")
#: What every match of _AT, _DOT and _bare holds.
_HINT = re.compile(rf"{_OPEN}(?:at|@|arroba|chez|dot|\.|punkt|point|punto){_CLOSE}| dot ", re.I)


class Mapped:
    """A text and, for each of its characters, the source range that it stands for."""

    def __init__(self, text: str, starts: list[int], ends: list[int]):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def edit(self, edits: Iterable[tuple[int, int, str]]) -> Mapped:
        """Replaces ranges (in order, apart): each new character stands for the whole range."""
        parts, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[done:a], new]
            starts += self.starts[done:a] + [self.starts[a]] * len(new)
            ends += self.ends[done:a] + [self.ends[b - 1]] * len(new)
            done = b
        if not parts:
            return self
        return Mapped("".join([*parts, self.text[done:]]), starts + self.starts[done:], ends + self.ends[done:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _plain(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in _DASHES:
        return "-"
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if c.isdigit() and unicodedata.digit(c, None) is not None and unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    return c.translate(_LOOKS)


def _homoglyphs(m: Mapped) -> Mapped:
    return m.edit((x.start(), x.end(), p) for x in _ODD.finditer(m.text) if (p := _plain(x.group())) != x.group())


def _bare(text: str) -> Iterable[tuple[int, int, int]]:
    """Start, place of " at " and end of each bare disguise: outwards from " at ", so in linear time."""
    done = 0
    for x in _BARE_AT.finditer(text):
        host = _BARE_HOST.match(text, x.end())
        if not _BARE_END.search(text, max(host.start(), host.end() - 29), host.end()):
            continue
        first = x.start()
        while True:
            at = first
            while at > done and text[at - 1] in _LOCAL and text[at - 1] != ".":
                at -= 1
            if at == first:
                first = None if first == x.start() else first
                break
            first = at
            if at - 1 > done and text[at - 1] == "." and text[at - 2] in _LOCAL and text[at - 2] != ".":
                first = at - 1
            elif at - 5 > done and text[at - 5 : at].lower() == " dot " and text[at - 6] in _LOCAL and text[at - 6] != ".":
                first = at - 5
            else:
                break
        if first is not None:
            yield first, x.start(), host.end()
            done = host.end()


def _disguises(m: Mapped) -> Mapped:
    m = m.edit((x.start(), x.end(), "@") for x in _AT.finditer(m.text))
    m = m.edit((x.start(), x.end(), ".") for x in _DOT.finditer(m.text))
    edits: list[tuple[int, int, str]] = []
    for first, at, end in _bare(m.text):
        edits += sorted([(at, at + 4, "@"), *((d.start(), d.end(), ".") for d in _BARE_DOT.finditer(m.text, first, end))])
    return m.edit(edits)


def _spelled(m: Mapped) -> Mapped:
    def edits():
        for x in _SPELLED.finditer(m.text):
            end = None
            for p in _PIECE.finditer(m.text, x.start(), x.end()):
                w = p.group().lower()
                new = "+" if w == "plus" else "." if w in ("dot", "point", "punkt", "punto") else _NUMBERS.get(w, w)
                # What stands between two digits goes; the piece that follows takes it in.
                yield (p.start() if end is None else end), p.end(), new
                end = p.end()

    return m.edit(edits())


def hinted(text: str) -> bool:
    """Whether a transducer can change text. Where none matches the text itself, none has anything to work on."""
    return bool((not text.isascii() and _ODD.search(text)) or _HINT.search(text) or _SPELLED.search(text))


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the method's."""
    base = base_spans(text)
    if not hinted(text):
        return base, base
    m = _spelled(_disguises(_homoglyphs(Mapped.of(text))))
    if m.text == text:
        return base, base
    more = []
    for a, k, b in base_spans(m.text):
        first, end = m.source(a, b)
        if not any(k == y and first < z and x < end for x, y, z in base):
            more.append((first, k, end))
    return base, sorted([*base, *more])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(b: pa.RecordBatch) -> list:
    out: list[list] = [[], [], [], [], [], []]
    for text in b.column("text").to_pylist():
        base, spans = all_spans(text or "")
        kinds = [k for _, k, _ in base]
        row = [*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
        for column, value in zip(out, row, strict=True):
            column.append(value)
    return out


def pii_table(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256, spans."""
    return per_row(docs.select("doc_id", "text"), ["doc_id"], [*(field(f"n_{k}", "long") for k in KINDS), field("base_sha256", "string"), field("spans", "string")], _find)


def redacted(text: str) -> str:
    """text with each group of overlapping spans replaced by the name of its first span's kind."""
    parts, done = [], 0
    merged: list[list[int]] = []
    for a, k, b in all_spans(text)[1]:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        parts += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = b
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, and n_chars of the new text where that column is given."""
    own = [c for c in docs.columns if c != "text"]

    def of(b: pa.RecordBatch) -> list:
        return [[None if t is None else redacted(t) for t in b.column("text").to_pylist()]]

    from pyspark.sql import functions as F

    df = per_row(docs, own, [field("text", "string")], of)
    if "n_chars" in own:
        df = df.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)
