"""Personal data in texts, in plain form and behind disguises, with offsets in the source.

Plain identifiers are found first.  Then transducers rewrite the text and keep, for each
character they write, the range of source characters that it stands for: lookalike characters
become ASCII and invisible ones go, at and dot disguises become ``@`` and ``.``, spelled digits
become digits.  What the same detectors find in the rewritten text is mapped back to the source;
it is added where it touches no plain identifier of its kind, or is an address that holds all of those
that it touches and more (a disguise inside its user), so plain ones always stay, and what is masked
is their union.

Disguised addresses have a user of 64 characters at most and hosts of at most nine labels of 63,
the limits of real addresses, and up to three spaces at each sign; digits mixed with letters that look
like them are read up to 19 in a group and nine groups.  Plain identifiers have no such bounds.

Offsets count code points and ends are exclusive; a byte that is no UTF-8 counts as one and stays.  Null texts count as empty and have no spans;
any length of text is read whole, in time linear in its length; equal rows get equal results; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_strings

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# Letters and signs that look like ASCII ones, and the words for digits.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅаеорсухіјѕһԁԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι∙•․‧。‐‑‒–—−٭∗",
        "ABEKMHOPCTYXIJSaeopcyxijshdqwgABEZHIKMNOPTYXoavi.....------**",
        strict=True,
    )
)
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "oh": "0", "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿᠎]")
ODD = re.compile("[^\u0000-\u009f¡-¬®-ɏ]")
WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
ONE = rf"(?:(?:{WORD})\b|[0-9]+)"
#: Digits in a row, in words or not, with a plus before or dots between.
SPELLED = re.compile(rf"(?:\bplus[ -]+)?\b{ONE}(?:(?:[ ,-]{{1,3}}|[ ]?(?:\.|\bdot\b|\bpoint\b|\bpunkt\b|\bpunto\b)[ ]?){ONE}){{1,}}", re.I)
#: Few words beside a dot with a space are the end of a sentence.
LOOSE_DOT = re.compile(r" \.|\. ")
DIGIT_WORD = re.compile(rf"\b(?:{WORD})\b", re.I)
PIECE = re.compile(rf"\b(?:plus|dot|point|punkt|punto)\b|\b(?:{WORD})\b|[0-9]+|\.", re.I)
BRACKET = re.compile(r"[ ]{0,3}[\[({<][ ]{0,3}(at|@|dot|\.|punkt|punto|arroba)[ ]{0,3}[\])}>][ ]{0,3}", re.I)
SPACED = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?P<user>[A-Za-z0-9._%+-]{1,64})(?P<at>[ ]{1,3}(?:at|arroba)[ ]{1,3}|[ ]{0,3}@[ ]{0,3})(?P<host>[A-Za-z0-9-]{1,63}(?:(?:[ ]{1,3}(?:dot|punkt|punto)[ ]{1,3}|[ ]{0,3}\.[ ]{0,3}(?=[a-z]))[A-Za-z0-9-]{1,63}){1,8})", re.I
)
DOT = re.compile(r"[ ]{1,3}(?:dot|punkt|punto)[ ]{1,3}|[ ]{0,3}\.[ ]{0,3}", re.I)
#: Letters among digits that look like them, in runs that are digits for the greater part.
MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl]{2,19}(?:[ .-][0-9OoIl]{1,19}){0,8}(?![A-Za-z0-9])")
LETTER = re.compile("[OoIl]")
HINT = re.compile(r"[\[({<] {0,3}(?:at|dot|@|\.|punkt|punto|arroba) {0,3}[\])}>]| (?:dot|punkt|punto) | @|@ |[0-9][OoIl]|[OoIl][0-9]", re.I)


def emails(text: str):
    """Leftmost, non-overlapping addresses; each at sign is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and LOCAL.match(text[begin - 1]):
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind as written."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(emails(text))
    if DIGITS.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m[0])) <= 15]
    return out


class Tape:
    """A text and, for each of its characters, the source range that it stands for."""

    def __init__(self, text: str, begin=None, end=None):
        self.text = text
        self.begin = range(len(text)) if begin is None else begin
        self.end = range(1, len(text) + 1) if end is None else end

    def rewritten(self, pieces) -> Tape:
        """``pieces``: (begin, end, new text) in order; each new character stands for its piece,
        or, if there are as many as before, for the one in its place."""
        text, begin, end, at = [], [], [], 0
        for b, e, new in pieces:
            text.append(self.text[at:b])
            begin.extend(self.begin[at:b])
            end.extend(self.end[at:b])
            text.append(new)
            if len(new) == e - b:
                begin.extend(self.begin[b:e])
                end.extend(self.end[b:e])
            else:
                begin.extend([self.begin[b]] * len(new))
                end.extend([self.end[e - 1]] * len(new))
            at = e
        if not at:
            return self
        text.append(self.text[at:])
        begin.extend(self.begin[at:])
        end.extend(self.end[at:])
        return Tape("".join(text), begin, end)


def ascii_like(c: str) -> str:
    """The ASCII character that ``c`` looks like, or ``c``."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    if unicodedata.category(c) == "Zs":
        return " "
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() and not folded.isspace() else c


def lookalikes(tape: Tape) -> Tape:
    tape = tape.rewritten((m.start(), m.end(), "") for m in INVISIBLE.finditer(tape.text))
    return tape.rewritten((m.start(), m.end(), new) for m in ODD.finditer(tape.text) if (new := ascii_like(m[0])) != m[0])


def disguises(tape: Tape) -> Tape:
    def sign(m):
        return m.start(), m.end(), "@" if m[1].lower() in ("at", "@", "arroba") else "."

    tape = tape.rewritten(map(sign, BRACKET.finditer(tape.text)))

    def spaced():
        for m in SPACED.finditer(tape.text):
            dots = [(x.start() + m.start("host"), x.end() + m.start("host")) for x in DOT.finditer(m["host"])]
            wordy = m["at"].strip() == "@" or any(tape.text[b:e].strip() != "." for b, e in dots)
            if wordy:
                yield m.start("at"), m.end("at"), "@"
                yield from ((b, e, ".") for b, e in dots)

    return tape.rewritten(spaced())


def spelled(tape: Tape) -> Tape:
    def digits():
        for m in SPELLED.finditer(tape.text):
            n = len(DIGIT_WORD.findall(m[0]))
            if not n or n < 3 and LOOSE_DOT.search(m[0]):
                continue
            at = m.start()
            for x in PIECE.finditer(m[0]):
                b, e = m.start() + x.start(), m.start() + x.end()
                if b > at:
                    yield at, b, ""
                w = x[0].lower()
                yield b, e, "+" if w == "plus" else "." if w in ("dot", "point", "punkt", "punto", ".") else DIGIT_WORDS.get(w, w)
                at = e

    def letters():
        for m in MIXED.finditer(tape.text):
            found = list(LETTER.finditer(m[0]))
            if 0 < len(found) <= len(DIGITS.findall(m[0])):
                yield from ((m.start() + x.start(), m.start() + x.end(), "0" if x[0] in "Oo" else "1") for x in found)

    tape = tape.rewritten(digits())
    return tape.rewritten(letters())


def find(text: str) -> tuple[dict, dict]:
    """Plain spans, and those with what the disguises hid added."""
    base = plain(text)
    odd = ODD.search(text) or INVISIBLE.search(text)
    if not (odd or HINT.search(text) or any(DIGIT_WORD.search(m[0]) for m in SPELLED.finditer(text))):
        return base, base
    tape = spelled(disguises(lookalikes(Tape(text)) if odd else Tape(text)))
    if tape.text == text:
        return base, base
    every = {}
    for kind, spans in plain(tape.text).items():
        have = base[kind]
        more = [(tape.begin[b], tape.end[e - 1]) for b, e in spans]
        i, new = 0, []
        for b, e in more:
            while i < len(have) and have[i][1] <= b:
                i += 1
            held = [h for h in itertools.takewhile(lambda h: h[0] < e, itertools.islice(have, i, None))]  # noqa: B023
            if not held or kind == "email" and (b, e) not in held and all(b <= x and y <= e for x, y in held):
                new.append((b, e))
        every[kind] = sorted(have + new)
    return base, every


def listed(spans: dict) -> str:
    return ",".join(f"{k}:{b}:{e}" for k in KINDS for b, e in spans[k])


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_all long"


def decoded(column: pa.Array):
    """Texts of a column; a byte that is no UTF-8 becomes one lone surrogate."""
    for x in column.cast(pa.binary()):
        yield x.as_py().decode("utf-8", "surrogateescape") if x.is_valid else None


def scan(batches):
    for b in batches:
        rows = []
        for text in decoded(b.column("text")):
            base, every = find(text or "")
            rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), sum(map(len, every.values()))))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *names])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of plain spans, their digest, all spans, their number) for each row."""
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlaps count as one."""
    _, every = find(text)
    spans = sorted((b, -e, k) for k in KINDS for b, e in every[k])
    out, at = [], 0
    for b, e, k in spans:
        if b >= at:
            out += [text[at:b], f"<{k}>"]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def mask(batches):
    for b in batches:
        text = as_strings([None if t is None else masked(t).encode("utf-8", "surrogateescape") for t in decoded(b.column("text"))])
        yield pa.RecordBatch.from_arrays([text if n == "text" else b.column(n) for n in b.schema.names], names=b.schema.names)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers masked in ``text``; all other columns stay."""
    return docs.mapInArrow(mask, docs.schema)
