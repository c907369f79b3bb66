"""Personal data in whole texts, also where it is written in disguise."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.base import chunks, in_arrow, named, worker_state

KINDS = ("email", "ip", "card", "phone")

# Fixed by the contract: the forms of the four kinds. An address is found from its "@".
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every match that holds, in order. Kinds are numbered as in KINDS."""
    found, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                found.append((start, 0, last))
    for m in _IP.finditer(text):
        if all(map(_part_fits, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


# --- transducers: each rewrites a text and keeps, for every character, where it came from ---

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "ԁ": "d", "е": "e", "Е": "E", "һ": "h", "Н": "H",
    "і": "i", "І": "I", "ј": "j", "Ј": "J", "К": "K", "к": "k", "ӏ": "l", "М": "M", "о": "o", "О": "O",
    "р": "p", "Р": "P", "ѕ": "s", "Ѕ": "S", "Т": "T", "у": "y", "У": "Y", "х": "x", "Х": "X", "ԛ": "q",
    "ԝ": "w", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i",
    "ı": "i", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
}
# Characters without width.
HIDDEN = "­​‌‍⁠﻿"
DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}

_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
# At least three digits in a row, written out or not, the first one written out or after "plus".
_SPELLED = re.compile(rf"(?i)(?:\bplus[ -]+|\+[ -]?)?\b{_WORD}(?:(?:[ -]+|[ -]*(?:\.|\bdot\b|\bpoint\b)[ -]*)(?:{_WORD}\b|[0-9]+\b)){{2,}}")
_UNIT = re.compile(rf"(?i)plus|\+|{_WORD}|[0-9]+|\.|dot|point")
_SPELLED_HINT = rf"(?i){_WORD}[ .-]"
_OPEN, _CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_BRACKET_HINT = re.compile(r"(?i)[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]")
_PLAIN_HINT = re.compile(r"(?i) at (?:[a-z0-9-]+\.)+[a-z]{2,}")
_ADDRESS = re.compile(
    rf"(?i)(?P<at>{_OPEN}(?:at|@){_CLOSE})|(?P<dot>{_OPEN}(?:dot|\.){_CLOSE}|(?<=[a-z0-9]) dot (?=[a-z0-9]))"
    # A bare " at ": the domain is disguised too, or the local part looks like one (a letter and a digit, dot or _).
    rf"|(?P<bare>(?<=[a-z0-9]) at (?=[a-z0-9-]+(?: dot |{_OPEN}dot{_CLOSE})[a-z0-9]))"
    r"|(?P<plain> at (?=(?:[a-z0-9-]+\.)+[a-z]{2,}))")
_LOCAL_LIKE = re.compile(r"(?i)(?=\S*[a-z])(?=\S*[0-9._])[a-z0-9._%+-]+$")


def _folds() -> tuple[re.Pattern, dict[str, str]]:
    """Characters that stand for one ASCII character: by compatibility form, as digits, or by look."""
    table = {c: "" for c in HIDDEN}
    for point in (*range(0x80, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(point)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain != c and plain.isascii() and (plain.isalnum() or plain in "@.+-_%()"):
            table[c] = plain
        elif unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))
    table |= LOOKALIKES
    return re.compile("[" + re.escape("".join(table)) + "]+"), table


class Tape:
    """A text under rewriting, with the source span of every character."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace spans (start, end, new); all characters of a new string cover the whole old span."""
        if not changes:
            return
        parts, starts, ends, at = [], [], [], 0
        for start, end, new in changes:
            parts += (self.text[at:start], new)
            starts += [*self.starts[at:start], *[self.starts[start]] * len(new)]
            ends += [*self.ends[at:start], *[self.ends[end - 1]] * len(new)]
            at = end
        parts.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        self.text, self.starts, self.ends = "".join(parts), starts, ends


def _fold_characters(tape: Tape, pattern: re.Pattern, table: dict[str, str]) -> None:
    tape.rewrite([(i, i + 1, table[c]) for m in pattern.finditer(tape.text) for i, c in enumerate(m[0], m.start())])


def _fold_spelled(tape: Tape) -> None:
    changes = []
    for m in _SPELLED.finditer(tape.text):
        # Separators between digits go; each unit keeps its own place.
        at = m.start()
        for u in _UNIT.finditer(tape.text, m.start(), m.end()):
            if u.start() > at:
                changes.append((at, u.start(), ""))
            word = u[0].lower()
            new = DIGIT_WORDS.get(word) or {"plus": "+", "dot": ".", "point": "."}.get(word, word)
            changes.append((u.start(), u.end(), new))
            at = u.end()
    tape.rewrite([c for c in changes if tape.text[c[0]:c[1]] != c[2]])


def _fold_address(tape: Tape) -> None:
    changes = []
    for m in _ADDRESS.finditer(tape.text):
        if m["plain"]:
            begin = max(tape.text.rfind(" ", 0, m.start()), tape.text.rfind("\n", 0, m.start())) + 1
            if not _LOCAL_LIKE.search(tape.text[begin:m.start()]):
                continue
        changes.append((m.start(), m.end(), "." if m["dot"] else "@"))
    tape.rewrite(changes)


def may_spell(texts: pa.Array) -> list[bool]:
    """Whether a text holds a digit's word before a separator."""
    return pc.match_substring_regex(texts.fill_null(""), _SPELLED_HINT).to_pylist()


def disguised(text: str, base: list[tuple[int, int, int]], spelled: bool | None = None) -> list[tuple[int, int, int]]:
    """Spans that only show after normalisation, in source positions; none meets a base span of its kind.

    `spelled` is the text's may_spell, if known.
    """
    pattern, table = worker_state("private_folds", _folds)
    lower = text.lower()
    letters = not text.isascii() and not table.keys().isdisjoint(set(text))
    spelled = letters or (may_spell(pa.array([text]))[0] if spelled is None else spelled)
    address = letters or " dot " in lower or _BRACKET_HINT.search(lower) is not None or _PLAIN_HINT.search(lower) is not None
    if not (letters or spelled or address):
        return []
    tape = Tape(text)
    if letters:
        _fold_characters(tape, pattern, table)
    if spelled:
        _fold_spelled(tape)
    if address:
        _fold_address(tape)
    if tape.text == text:
        return []
    ends = [sorted(e for _, k, e in base if k == kind) for kind in range(len(KINDS))]
    starts = [sorted(s for s, k, _ in base if k == kind) for kind in range(len(KINDS))]
    found = []
    for start, kind, end in detect(tape.text):
        first, last = tape.starts[start], tape.ends[end - 1]
        if text[first:last] == tape.text[start:end]:
            continue
        # base spans of a kind do not overlap: the first that ends behind `first` must start behind `last`
        i = bisect_left(ends[kind], first + 1)
        if i == len(ends[kind]) or starts[kind][i] >= last:
            found.append((first, kind, last))
    return sorted(set(found))


def private_spans(text: str | None, spelled: bool | None = None) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, disguised) of a whole text, by start, then kind."""
    if not text:
        return []
    base = detect(text)
    return sorted([(*x, False) for x in base] + [(*x, True) for x in disguised(text, base, spelled)])


def redact(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    """The text with each span (overlapping ones together) replaced by the name of its first kind."""
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end, _ = spans[i]
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        parts += (text[at:start], f"[{KINDS[kind].upper()}]")
        at = end
    return "".join([*parts, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))


def find_private(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), redacted: bool = False,
                 output: tuple[str, str] = ("spans", "redacted")) -> DataFrame:
    """The kept columns, spans (kind, start, end in code points, disguised) and, if asked, the redacted text.

    Base forms are found in the text itself. Then three transducers normalise it, each
    keeping source positions: look-alike, wide and hidden characters; spelled digits;
    "at" and "dot" in brackets or words. What is found only there is mapped back and
    added, unless it meets a base span of its kind. Spans are ordered by start, then kind.

    NULL and empty texts have no spans; NULL stays NULL; repeated rows are handled alike;
    no documents give no rows. `output` names the added columns.
    """
    # Inside the task columns go by number, so their names may be any.
    names, keep = list(keep), [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, read):
            texts = batch.column(read).to_pylist()
            found = [private_spans(t, spelled) for t, spelled in zip(texts, may_spell(batch.column(read)))]
            spans = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "disguised": d} for s, k, e, d in x] for x in found], SPANS)
            columns = [batch.column(c) for c in keep] + [spans]
            if redacted:
                columns.append(pa.array([redact(t, x) for t, x in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, keep + ["spans", "redacted"][:1 + redacted])

    # A text that is kept anyway is not sent twice.
    read = keep[names.index(text)] if text in names and dict(docs.dtypes)[text] == "string" else "text"
    own = docs.select(*[named(n).alias(c) for n, c in zip(names, keep)], *([named(text).cast("string").alias("text")] if read == "text" else []))
    kinds = dict(own.dtypes)
    schema = [f"{c} {kinds[c]}" for c in keep] + ["spans array<struct<kind:string,start:bigint,end:bigint,disguised:boolean>>"]
    found = own.transform(in_arrow, run, ", ".join(schema + ["redacted string"] * redacted))
    return found.toDF(*names, *output[:1 + redacted])
