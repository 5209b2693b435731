"""Personal data, plain and disguised, with spans in the source text.

Plain identifiers are found by their patterns. For disguised ones, transducers
rewrite the text: look-alike and invisible characters, then spelled digits and
disguises of @ and dots. Each rewriting keeps a list of its edits, through which
a span found in the normalised text is mapped back to the source's code points.
Only spans that touch an edit are added; plain ones stay as they are.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ from left to right, found from each @."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind in the order of KINDS, then start; leftmost matches, those that fail a check dropped."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


class Rewritten:
    """A text after edits (start, end, replacement) that are in order and don't overlap, and the way back."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        self.edits, self.marks, parts, at, out = edits, [], [], 0, 0
        for start, end, put in edits:
            parts += [source[at:start], put]
            out += start - at
            self.marks.append((out, out + len(put)))
            out += len(put)
            at = end
        self.text = "".join([*parts, source[at:]])
        self.begins = [a for a, _ in self.marks]
        self.filled, last = [], -1  # for each edit the last one, itself included, that left something
        for k, (a, b) in enumerate(self.marks):
            last = k if b > a else last
            self.filled.append(last)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source's span, and whether it touches an edit."""
        first, last = self._of(start), self._of(end - 1)
        touched = any(a < end and (b > start or a == b and start < a) for a, b in self.marks[max(0, bisect_right(self.begins, start) - 1) : bisect_right(self.begins, end - 1)])
        return first[0], last[1], touched

    def _of(self, i: int) -> tuple[int, int]:
        """The source's range of the character at i."""
        k = bisect_right(self.begins, i) - 1
        if k >= 0 and (own := self.filled[k]) >= 0 and i < self.marks[own][1]:
            return self.edits[own][0], self.edits[own][1]
        shift = self.edits[k][1] - self.marks[k][1] if k >= 0 else 0
        return i + shift, i + shift + 1


def _characters() -> dict[str, str]:
    """Single characters that stand for ASCII ones: by compatibility and digit values, then look-alike letters."""
    wanted = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@.+-_()")
    out = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) in ("Cn", "Cs", "Co"):
            continue
        if len(n := unicodedata.normalize("NFKC", c)) == 1 and n in wanted:
            out[c] = n
        elif (d := unicodedata.decimal(c, None)) is not None:
            out[c] = str(int(d))
    # Letters and marks of other scripts that look like ASCII ones.
    alike = {
        "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ",
        "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уγ", "z": "ᴢ",
        "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
        ".": "․。｡", "-": "‐‑‒–—−", "+": "➕", "": "­᠎​‌‍⁠﻿",
        " ": "              　",
    }
    return out | {c: to for to, many in alike.items() for c in many}


# Digits as words (English, German, French, Spanish).
NUMERALS = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
DIGITS = {word: digit for digit, words in NUMERALS.items() for word in words.split()}
NUMERAL = "|".join(sorted(DIGITS, key=len, reverse=True))
DOT_WORD, AT_WORD = "dot|punkt|punto|point", "at|ät|arroba|chez"
#: Four digits or more of which some are words, with what may stand between.
SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus\s{{0,2}}|\+\s?)?\(?(?:{NUMERAL}|[0-9]+)(?:(?:\s(?:{DOT_WORD})\s|[\s().,-]{{1,3}})(?:{NUMERAL}|[0-9]+)(?!\w)){{3,}}")
SPELLED_PART = re.compile(rf"(?i)(?P<plus>plus\s{{0,2}})|(?P<word>(?<!\w)(?:{NUMERAL})(?!\w))|(?P<dot>\s(?:{DOT_WORD})\s)|(?P<gap>[\s,-]{{1,3}})")
BRACKETED = re.compile(rf"(?i)\s{{0,2}}[\[({{<]\s{{0,2}}(?:(?P<at>{AT_WORD}|@)|(?P<dot>{DOT_WORD}|\.))\s{{0,2}}[\])}}>]\s{{0,2}}")
#: name at host dot tld, with blanks, hyphens or underscores around the words; @ or dots may be plain or not, but one is a word
# Words after which `at` is plain English.
PLAIN_AFTER_AT = "the a an this that these those my our your his her its their each any all some no least most first last home work noon night"
#: in names and hosts, a hyphen or underscore that stands before one of the words belongs to the word
JOINED = r"(?!(?i:at|arroba|dot|punkt|punto|point)[ _-])"
NAME, HOST = rf"[A-Za-z0-9](?:[A-Za-z0-9.%+]|[_-]{JOINED}){{0,63}}", rf"[A-Za-z0-9](?:[A-Za-z0-9]|-{JOINED}){{0,62}}"
WORDY = re.compile(rf"(?<![\w@.])(?:{NAME})(?:(?P<gap>[ _-])(?i:dot|punkt|punto|point)(?P=gap)(?:{NAME})){{0,3}}(?:(?P<sep>[ _-])(?i:at|arroba)[ _-](?!(?i:{PLAIN_AFTER_AT.replace(' ', '|')})(?P=sep))|\s?@\s?)(?:{HOST})(?:(?:[ _-](?i:dot|punkt|punto|point)[ _-])(?:{HOST})){{1,4}}(?!\w)")
WORDY_PART = re.compile(r"[ _-](?i:(?P<dot>dot|punkt|punto|point)|(?P<at>at|arroba))[ _-]|(?P<sign>\s@\s?|@\s)")
CAPITAL = re.compile(r"(?<![\w@.])[a-z0-9._%+-]{1,64}AT[a-z0-9-]{1,63}(?:DOT[a-z0-9-]{1,63}){1,4}(?!\w)")
CAPITAL_PART = re.compile(r"AT|DOT")
SPACED = re.compile(r"(?<=[A-Za-z0-9]) @ (?=[A-Za-z0-9-]{1,63}\.[A-Za-z0-9])")
NUMBER_DOT = re.compile(rf"(?i)(?<=[0-9])\s?(?:{DOT_WORD})\s?(?=[0-9])")
MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl]*[0-9])(?=[0-9]*[OoIl])[0-9OoIl]+(?![A-Za-z0-9])|(?<=[0-9]\.)[OoIl](?![A-Za-z0-9])")


#: To tell the words of a text in lower case: letters and digits, all else as a space.
PLAIN = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
DIGIT_WORDS = frozenset(w.encode() for w in DIGITS)
DOT_WORDS = frozenset(w.encode() for w in DOT_WORD.split("|"))
RUN = re.compile(r"[0-9]+")


def _letters_in_numbers(text: str) -> bool:
    """Whether some digits have a letter next to them, or beyond a dot, that may stand for a digit."""
    for m in RUN.finditer(text):
        a, b = m.span()
        if a and text[a - 1] in "OoIl" or text[b : b + 1] in ("O", "o", "I", "l") or text[b : b + 1] == "." and text[b + 1 : b + 2] in ("O", "o", "I", "l"):
            return True
    return False


def _edits(text: str) -> list[tuple[int, int, str]]:
    """The edits for spelled digits, letters among digits, and disguises of @ and dots.

    The patterns are run only over texts that have the words they need.
    """
    found: list[tuple[int, int, str]] = []
    words = set(text.lower().encode("utf-8", "replace").translate(PLAIN).split())
    for m in SPELLED.finditer(text) if words & DIGIT_WORDS else ():
        parts = list(SPELLED_PART.finditer(text, *m.span()))
        if sum(bool(p["word"]) for p in parts) < 2:
            continue
        for i, p in enumerate(parts):
            if p["word"]:
                found.append((*p.span(), DIGITS[p[0].lower()]))
            elif p["plus"] or p["dot"]:
                found.append((*p.span(), "+" if p["plus"] else "."))
            elif 0 < i < len(parts) - 1 and parts[i - 1]["word"] and parts[i + 1]["word"] and parts[i - 1].end() == p.start() and p.end() == parts[i + 1].start():
                found.append((*p.span(), ""))
    if any(c in text for c in "[({<"):
        found += [(*m.span(), "@" if m["at"] else ".") for m in BRACKETED.finditer(text)]
    if words & DOT_WORDS:
        for m in WORDY.finditer(text):
            found += [(*p.span(), "." if p["dot"] else "@") for p in WORDY_PART.finditer(text, *m.span())]
    if DIGIT.search(text) and any(w in text.lower() for w in DOT_WORD.split("|")):
        found += [(*m.span(), ".") for m in NUMBER_DOT.finditer(text)]
    if "AT" in text and "DOT" in text:
        for m in CAPITAL.finditer(text):
            found += [(*p.span(), "@" if p[0] == "AT" else ".") for p in CAPITAL_PART.finditer(text, *m.span())]
    if " @ " in text:
        found += [(*m.span(), "@") for m in SPACED.finditer(text)]
    if _letters_in_numbers(text):
        for m in MIXED.finditer(text):
            found += [(i, i + 1, "0" if text[i] in "Oo" else "1") for i in range(*m.span()) if text[i] in "OoIl"]
    out: list[tuple[int, int, str]] = []
    for edit in sorted(found):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


@cache
def detector() -> Callable[[str], tuple[list[Span], list[Span]]]:
    """A function from a text to its plain spans and those added by normalising it."""
    table = _characters()

    def characters(text: str) -> list[tuple[int, int, str]]:
        odd = [] if text.isascii() else sorted(table.keys() & set(text))
        return [(*m.span(), table[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, odd)) + "]", text)] if odd else []

    def detect(text: str) -> tuple[list[Span], list[Span]]:
        base = plain_spans(text)
        first = Rewritten(text, characters(text))
        second = Rewritten(first.text, _edits(first.text))
        if not first.edits and not second.edits:
            return base, []
        own = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
        starts = {kind: [a for a, _ in spans] for kind, spans in own.items()}
        added = []
        for kind, start, end in plain_spans(second.text):
            a, b, two = second.back(start, end)
            a, b, one = first.back(a, b)
            # plain spans of a kind do not overlap: only the last that starts by here can hold this one
            k = bisect_right(starts[kind], a) - 1
            if (one or two) and not (k >= 0 and b <= own[kind][k][1]):
                added.append((kind, a, b))
        return base, added

    return detect


def digest(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame) -> DataFrame:
    """docs with `found`: an array of (kind, start, stop, added), by kind then start; code points, stop exclusive.

    `added` tells spans of disguised identifiers from plain ones. Null and empty texts
    have none. Columns of docs pass unchanged; a clashing one is replaced.
    """
    others = [c for c in docs.columns if c != "found"]
    held = docs.select(F.struct(*[c for c in others if c != "text"] or [F.lit(0).alias("_")]).alias("_row"), "text")
    detect = detector()

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("added", pa.bool_())]))
        for batch in batches:
            out = []
            for text in batch.column(1):
                base, added = detect(text.as_py() or "")
                rows = sorted([(KINDS.index(k), a, b, False) for k, a, b in base] + [(KINDS.index(k), a, b, True) for k, a, b in added])
                out.append([{"kind": KINDS[k], "start": a, "stop": b, "added": new} for k, a, b, new in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], ["_row", "text", "found"])

    kind = held.schema["_row"].dataType.simpleString()
    out = held.mapInArrow(searched, f"_row {kind}, text string, found array<struct<kind:string,start:long,stop:long,added:boolean>>")
    return out.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in others], "found")


def mask(docs: DataFrame, put: str = "[{}]") -> DataFrame:
    """docs with every span of find() replaced in `text` by its kind in brackets; overlapping spans are one."""
    found = find(docs)
    others = found.columns
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.format_string(put.replace("{}", "%s"), s["kind"]))).otherwise("")).alias("out"),
        F.greatest(acc["at"], s["stop"]).cast("int").alias("at"),
    )
    spans = F.sort_array(F.transform("found", lambda s: F.struct(s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    return found.select(*[masked.alias(c) if c == "text" else F.col(c) for c in others])
