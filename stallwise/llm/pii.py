"""Personal data: detection in the plain text and, after offset-preserving normalisation, in disguised text.

A normalised text is a string with, for each of its characters, the range of source characters it came from. Three
transducers rewrite it in turn: lookalikes (homoglyphs, full-width forms, digits of other scripts; invisible characters go),
spelled digits ("five five five"), and at/dot disguises ("jo [at] mail dot com"). The identifiers' patterns then run over the
normalised text, and what they find is mapped back to source characters. What the plain text already shows stays as it is;
a span found only after normalisation is added if it overlaps none of its kind.

Defined results: a null text is empty and has no spans; repeated rows are searched alike. Matches that fail a check (a part of an
address above 255, Luhn's sum, too few digits) are dropped and not tried again from within.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from stallwise.llm import common

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits starts, so that long runs are read once
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# Letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ѡ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
#: Characters that show nothing.
INVISIBLE = "­​‌‍‎‏⁠﻿"
#: Blocks that hold lookalikes, digits of other scripts and compatibility forms.
ODD = re.compile(
    "[­ıɡͰ-ϿЀ-ԯ٠-٩۰-۹०-९​-‏‐-–․⁠⁰-ₙ"
    "−①-⓿。﹐-﹯﻿！-･\U0001d400-\U0001d7ff\U0001f100-\U0001f10a]"
)
# Digits by name.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5",
    "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5",
    "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NAMES = "|".join(sorted(SPELLED, key=lambda w: (-len(w), w)))
_DIGIT = rf"(?:(?:{_NAMES})\b|[0-9]+)"
#: A run of at least four digits or numbers; ``NAMED`` of them must be by name, the first of these after at most as many figures as the
#: longest identifier has.
NAMED, LONGEST = 3, 19
#: What a name of a digit stands between in ``SPELLED_RUN``: the ends of a run of word characters.
WORD = re.compile(r"\w+")
#: Parts between dots beyond the first: a mailbox has 64 characters at most, a domain 253, a part of one with its dot two or more.
LOCAL_PARTS, DOMAIN_PARTS = 31, 126
SPELLED_RUN = re.compile(
    rf"(?i)(?<!\w)(?:plus[ ]|\+[ ]?)?(?=(?:[0-9]+[ .,-]+){{0,{LONGEST}}}(?:{_NAMES})\b){_DIGIT}(?:[ .,-]{{1,3}}{_DIGIT}){{3,}}(?!\w)"
)
SPELLED_PART = re.compile(rf"(?i)plus[ ]|\+[ ]?|(?:{_NAMES})\b|[0-9]+")
_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_DOT = rf"(?:\s{{0,3}}{_OPEN}(?:dot|\.){_CLOSE}\s{{0,3}}|\s{{1,3}}dot\s{{1,3}}|\.)"
_AT = rf"(?:\s{{0,3}}{_OPEN}(?:at|@){_CLOSE}\s{{0,3}}|\s{{1,3}}(?:at|@)\s{{1,3}}|@)"
#: Every form of ``_DOT`` and ``_AT`` that is rewritten; a bare "at" only counts beside a disguised dot.
CUE = re.compile(r"\b[dD][oO][tT]\b|\s@\s|[\[({<]\s{0,3}(?:[aA][tT]|[dD][oO][tT]|@|\.)\s{0,3}[\])}>]")
ADDRESS = re.compile(
    rf"(?i)(?<![\w.%+-])[a-z0-9][a-z0-9_%+-]{{0,63}}(?:{_DOT}[a-z0-9_%+-]{{1,63}}){{0,{LOCAL_PARTS}}}(?P<at>{_AT})"
    rf"[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{2,63}}){{1,{DOMAIN_PARTS}}}"
)
NUMBERS = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")
DOT_PART = re.compile(_DOT, re.I)


@dataclass
class Normalised:
    """A text with the source range of each character."""

    text: str
    starts: list[int]
    ends: list[int]

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Normalised:
        """Replace ranges by other text; every new character stands for the whole range."""
        if not edits:
            return self
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        return Normalised(
            "".join([*parts, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:]
        )


def _plain(ch: str) -> str:
    if ch in INVISIBLE:
        return ""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    digit = unicodedata.digit(ch, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", ch)
    return folded if folded.isascii() else ch


def lookalikes(t: Normalised) -> Normalised:
    return t.rewritten([(m.start(), m.end(), new) for m in ODD.finditer(t.text) if (new := _plain(m.group())) != m.group()])


def spelled_digits(t: Normalised) -> Normalised:
    edits = []
    for m in SPELLED_RUN.finditer(t.text):
        parts = [p.group().lower() for p in SPELLED_PART.finditer(m.group())]
        if sum(p in SPELLED for p in parts) < NAMED:
            continue
        new = "".join("+" if p[0] in "p+" else SPELLED.get(p, p) for p in parts)
        edits.append((m.start(), m.end(), new))
    return t.rewritten(edits)


def at_and_dot(t: Normalised) -> Normalised:
    """Disguised signs, only within what reads as an address of mail or of a machine."""
    if not CUE.search(t.text):
        return t
    edits = []
    for m in ADDRESS.finditer(t.text):
        at = m.span("at")
        signs = [(p.start(), p.end(), ".") for p in DOT_PART.finditer(t.text, m.start(), m.end()) if not at[0] <= p.start() < at[1]]
        bare = m.group("at").strip().lower() == "at"
        if bare and all(t.text[a:b] == "." for a, b, _ in signs if a > at[0]):
            continue  # "look at example.com" is no disguise
        edits += sorted([*signs, (*at, "@")])
    taken = [e[0] for e in edits]
    for m in NUMBERS.finditer(t.text):
        i = bisect_right(taken, m.end())
        if not i or taken[i - 1] < m.start():
            edits += [(p.start(), p.end(), ".") for p in DOT_PART.finditer(t.text, m.start(), m.end())]
    return t.rewritten(sorted(e for e in edits if t.text[e[0] : e[1]] != e[2]))


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of a mail address; each run before an @ is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return not (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def detected(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, as the text stands."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(emails(text))
    if DIGITS.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        out["card"] = [m.span() for m in CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def has_spelled(text: str) -> bool:
    """Whether the text holds enough names of digits for a run."""
    return sum(map(SPELLED.__contains__, WORD.findall(text.lower()))) >= NAMED


def normalised(text: str) -> Normalised | None:
    """The text behind disguises, or None if there are none."""
    odd = not text.isascii() and ODD.search(text)
    # lookalikes may hide the other cues, so they are looked for first
    t = Normalised(text, list(range(len(text))), list(range(1, len(text) + 1))) if odd else None
    t = lookalikes(t) if odd else None
    seen = t.text if odd else text
    spelled, cued = has_spelled(seen), CUE.search(seen)
    if not (odd or spelled or cued):
        return None
    t = t or Normalised(text, list(range(len(text))), list(range(1, len(text) + 1)))
    if spelled:
        t = spelled_digits(t)
    t = at_and_dot(t)
    return None if t.text == text else t


def spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain spans, all spans) of a text, both by kind and start."""
    text = text or ""
    plain = detected(text)
    every = {k: list(v) for k, v in plain.items()}
    t = normalised(text)
    if t is not None:
        for kind, found in detected(t.text).items():
            for a, b in (t.source(s) for s in found):
                if all(b <= c or d <= a for c, d in every[kind]):
                    every[kind].append((a, b))
            every[kind].sort()
    return plain, every


def listed(by_kind: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in by_kind[k])


def redacted(text: str, by_kind: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans go together, named by the first."""
    parts, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, found in by_kind.items() for a, b in found):
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def find(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Every row with the counts and the digest of the plain spans, how many the method added, and the list of all."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS, "added")]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def work():
        def on_batch(batch: pa.RecordBatch) -> tuple:
            rows = []
            for t in common.column(batch, text):
                plain, every = spans(t)
                n = [len(plain[k]) for k in KINDS]
                rows.append((*n, sum(map(len, every.values())) - sum(n), hashlib.sha256(listed(plain).encode()).hexdigest(), listed(every)))
            return [list(c) for c in zip(*rows)], None

        return on_batch

    return common.appended(docs, fields, work)


def redact(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Every row with its text redacted and, where the column is there, its length brought up to date; null texts stay null."""
    counted = n_chars is not None and n_chars in docs.columns
    fields = [T.StructField(text, T.StringType())]
    fields += [T.StructField(n_chars, docs.schema[n_chars].dataType)] if counted else []
    order = docs.columns

    def work():
        def on_batch(batch: pa.RecordBatch) -> tuple:
            old = common.column(batch, text)
            new = [None if t is None else redacted(t, spans(t)[1]) for t in old]
            if not counted:
                return [new], None
            sizes = common.column(batch, n_chars)
            return [new, [s if a is None or a == b else len(b) for a, b, s in zip(old, new, sizes)]], None

        return on_batch

    return common.appended(docs, fields, work).select(*order)
