"""Personal data in texts, also behind disguises, with spans in the source text.

A text passes three transducers, each returning its output and, for every output character, the source
place it stands for: look-alike characters become the ASCII ones they imitate, runs of spelled digits
become digits, and at/dot disguises become ``@`` and ``.``. Identifiers are found in the output and
their spans mapped back, so ``jane (at) example (dot) org`` is reported where it stands in the source.
The identity transducer (the text as it is) gives the base spans; spans of the normalised text are
added where they overlap no base span of their kind.

Cases: a null or empty text has no spans. Rows that repeat are each searched. Any length is searched
whole. An empty table gives no rows. Extra columns are ignored by ``spans`` and kept by ``masked``.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import kept_columns

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where its run of digits begins, and takes whole runs.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){11}")
NOT_DIGITS = re.compile(r"[^0-9]+")

# Letters of other scripts that look like ASCII ones (fixed values).
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
    "−": "-", " ": " ", " ": " ", " ": " ",
}
DIGIT_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
               "eight": "8", "nine": "9"}


def _compatible() -> dict[str, str]:
    """Single characters whose compatibility form is one ASCII character, and digits of every script."""
    table = {}
    for code in range(0xA1, 0x20000):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii() and plain.isprintable() and c not in "ªº¹²³":
            table[c] = plain
        elif unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))
    return table


_TABLE = str.maketrans(_compatible() | LOOK_ALIKES)
_FOREIGN = frozenset(map(chr, _TABLE))
_NAMES = "|".join(DIGIT_NAMES)
# Digits in a row, spelled or written; possessive parts keep every search linear.
_DIGIT = rf"(?:{_NAMES}|[0-9]++)(?![A-Za-z])"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9]){_DIGIT}(?:[\x20,.-]{{1,3}}{_DIGIT})+", re.I)
_ANY_NAME = re.compile(rf"(?<![A-Za-z])(?:{_NAMES})[\x20,.-]{{1,3}}(?:{_NAMES}|[0-9])", re.I)
_ONE_DIGIT = re.compile(rf"{_NAMES}|[0-9]", re.I)
# local part, a disguised @, then a domain; a bare word "at" counts only before a disguised dot.
_LABEL = r"[A-Za-z0-9-]++"
_BRACED_DOT = r"\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?"
_ANY_DOT = rf"(?:\.|{_BRACED_DOT}|\x20+(?:dot|DOT)\x20+)"
_HIDDEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_BRACED_DOT}[A-Za-z0-9_%+-]++)*"
    rf"(?:\x20?[\[({{<]\x20?(?:at|@)\x20?[\])}}>]\x20?{_LABEL}(?:{_ANY_DOT}{_LABEL})+"
    rf"|\x20+at\x20+{_LABEL}(?:{_ANY_DOT}{_LABEL})*(?:{_BRACED_DOT}|\x20+dot\x20+){_LABEL}(?:{_ANY_DOT}{_LABEL})*"
    rf"|@{_LABEL}(?:{_ANY_DOT}{_LABEL})*(?:{_BRACED_DOT}|\x20+dot\x20+){_LABEL}(?:{_ANY_DOT}{_LABEL})*)", re.I)
_HINT = re.compile(r"[\[({<]\x20?(?:at|dot|@|\.)\x20?[\])}>]|\x20dot\x20", re.I)
_AT = re.compile(r"\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20+at\x20+", re.I)
_DOT = re.compile(rf"{_BRACED_DOT}|\x20+dot\x20+", re.I)


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    The part before an @ reaches back to the end of its run or of the match before, so each text is
    passed once however long its words are."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (host := DOMAIN.match(text, at + 1)):
            done = host.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def _is_byte(digits: str) -> bool:
    """At most 255, however many digits there are."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every identifier in a plain text; failing matches are dropped, not retried."""
    found = []
    if "@" in text:
        found += [("email", *span) for span in emails(text)]
    if text.count(".") > 2:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(_is_byte(x) for x in m[0].split("."))]
    if LONG_DIGITS.search(text):
        found += [("card", *m.span()) for m in CARD.finditer(text)
                  if 12 <= len(d := NOT_DIGITS.sub("", m[0])) <= 19 and passes_luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return found


class Mapped:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.start is None else (self.start[start], self.end[end - 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ordered, disjoint spans; each new character stands for all that it replaces."""
        if not edits:
            return
        start = list(range(len(self.text))) if self.start is None else self.start
        end = list(range(1, len(self.text) + 1)) if self.end is None else self.end
        text, s, e, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            s += start[at:a] + [start[a]] * len(new)
            e += end[at:a] + [end[b - 1]] * len(new)
            at = b
        self.text, self.start, self.end = "".join([*text, self.text[at:]]), s + start[at:], e + end[at:]


def _look_alikes(m: Mapped) -> None:
    if not m.text.isascii() and not _FOREIGN.isdisjoint(m.text):
        m.text = m.text.translate(_TABLE)  # one character for one, so places stay


def _spelled_digits(m: Mapped) -> None:
    if not _ANY_NAME.search(m.text):
        return
    edits = []
    for run in _SPELLED.finditer(m.text):
        digits = list(_ONE_DIGIT.finditer(run[0]))
        if sum(len(d[0]) > 1 for d in digits) < 2 or len(digits) < 7:
            continue
        at = run.start()
        for k, d in enumerate(digits):  # the separator goes, so that digits join
            stop = digits[k + 1].start() if k + 1 < len(digits) else d.end()
            edits.append((at + d.start(), at + d.end(), DIGIT_NAMES.get(d[0].lower(), d[0])))
            if stop > d.end():
                edits.append((at + d.end(), at + stop, ""))
    m.rewrite(edits)


def _at_and_dot(m: Mapped) -> None:
    if not _HINT.search(m.text):
        return
    edits = []
    for found in _HIDDEN.finditer(m.text):
        at = found.start()
        marks = [(x.start(), x.end(), "@") for x in _AT.finditer(found[0])][:1]
        marks += [(x.start(), x.end(), ".") for x in _DOT.finditer(found[0])]
        edits += sorted((at + a, at + b, new) for a, b, new in marks)
    m.rewrite(edits)


TRANSDUCERS = (_look_alikes, _spelled_digits, _at_and_dot)


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of one text."""
    if not text:
        return [], []
    base, m = detect(text), Mapped(text)
    for step in TRANSDUCERS:
        step(m)
    if m.text is text or m.text == text:
        return base, []
    starts: dict[str, list[int]] = {k: [a for kind, a, _ in base if kind == k] for k in KINDS}
    ends: dict[str, list[int]] = {k: [b for kind, _, b in base if kind == k] for k in KINDS}
    added = []
    for kind, a, b in detect(m.text):
        s, e = m.source(a, b)
        before = bisect_left(starts[kind], e) - 1  # spans of a kind are disjoint and in order
        if before < 0 or ends[kind][before] <= s:
            added.append((kind, s, e))
    return base, added


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: n for n, k in enumerate(KINDS)}
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            base, added = find(text)
            rows = [(*x, True) for x in base] + [(*x, False) for x in added]
            rows.sort(key=lambda r: (r[1], order[r[0]], r[2]))
            out.append([dict(zip(("kind", "start", "end", "base"), r)) for r in rows])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_SPAN))], ["doc_id", "spans"])


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every document and its spans by start, then kind; ``base`` marks those of the plain text."""
    return kept_columns(docs, "doc_id", "text").mapInArrow(
        _search, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def _masker(at: int):
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                base, added = find(text)
                pieces, at_char = [], 0
                for kind, a, b in reversed(_merged(base + added)):
                    pieces += [text[at_char:a], f"<{kind}>"]
                    at_char = b
                texts.append("".join([*pieces, text[at_char:]]) if pieces else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
    return mask


def _merged(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping spans as one, last first; the earliest span names the kind."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    return out[::-1]


def masked(docs: DataFrame) -> DataFrame:
    """All rows and columns, the text with ``<kind>`` in place of every identifier."""
    return docs.mapInArrow(_masker(docs.columns.index("text")), docs.schema)


def joined(column: str = "spans", only_base: bool = False):
    """kind:start:end of the spans, comma-joined."""
    rows = F.filter(column, lambda s: s["base"]) if only_base else F.col(column)
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
