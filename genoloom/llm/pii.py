"""Personal data, also where it is disguised, by its place in the source text.

Plain identifiers are found in the text as it is. Then transducers rewrite the
text: look-alike characters become what they look like, invisible ones go,
bracketed or spelled "at" and "dot" become marks and spelled digits become
digits. Each rewrite keeps, for every character it writes, which source
characters it came from; identifiers found in the rewritten text are mapped
back to spans of the source and added.

A rewrite needs evidence, so ordinary prose stays as it is: brackets, a run of
digit words, or for a spelled address an "@", an ending that is hardly a word,
or anything else that prose seldom has about "at" (a dot or digit in the name, a
mail provider, three labels, a word such as "mail" before it). With such
evidence any ending counts, as the plain pattern has no list of them either.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from genoloom.llm.common import need

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# an address can only start where a run of digits starts, which keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones, and what they look like.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ⅼ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "﹒": ".", "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u3000": " ",
}
# Digit words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def lookalikes() -> dict[int, str]:
    """One character for one: homoglyphs, full-width ASCII and decimal digits of any script."""
    table = {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in range(0x0660, 0x1FBFA):
        d = unicodedata.decimal(chr(c), None)
        if d is not None:
            table[c] = str(d)
    return table


TABLE = lookalikes()
_SUSPECT = re.compile("[" + "".join(re.escape(chr(c)) for c in TABLE) + INVISIBLE + "]")
_HIDDEN = re.compile(f"[{INVISIBLE}]+")
_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_ITEM = rf"(?:{_WORD}\b|[0-9]+(?![A-Za-z]))"
#: Four digit words or more in a row, numerals among them; "plus" may lead, "dot" may part them.
_SPELLED = re.compile(rf"\b(?:plus[\s,-]+)?{_WORD}\b(?:[\s,-]+(?:dot[\s,-]+|point[\s,-]+)?{_ITEM}){{3,}}", re.I)
_TWO_WORDS = re.compile(rf"\b{_WORD}[\s,-]+(?:dot[\s,-]+|point[\s,-]+)?(?:{_WORD}\b|[0-9])")
_SPELLED_PART = re.compile(rf"(plus)|(dot|point)|({_WORD})|([0-9]+)|([\s,-]+)", re.I)
_BRACKETED = re.compile(r"[\x20\t]{0,3}[\[({<]\s{0,3}(?:(at|@)|(dot|\.|punkt|punto|point))\s{0,3}[\])}>][\x20\t]{0,3}", re.I)
# Endings that are evidence of a spelled address by themselves; none is a common word.
ENDINGS = frozenset("com org net edu gov mil info biz io ai co app dev xyz uk de fr es nl ch eu ca au nz jp cn br ru pl se dk fi ie pt gr cz mx ar example test".split())
# Common words, which end or begin no address without other evidence.
COMMON = frozenset("a about above after again all also am an and any are as at be because been before being below but by can did do does down each few for from go had has have he her here him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up us very was we were what when where which while who why will with would you your".split())
# Labels of mail providers.
PROVIDERS = frozenset("gmail googlemail hotmail outlook yahoo icloud proton protonmail fastmail zoho yandex gmx aol live msn".split())
_ASKED = re.compile(r"(?:e-?mail|mail|contact|reach|write|address|send|ping)\b[^.!?\n]{0,40}$", re.I)
_AT = re.compile(r"(?<=\s)at(?=\s)|@", re.I)
_BACK = re.compile(r"\s{1,3}tod(?=\s)", re.I)  # "dot", read backwards
_LEFT_GAP = re.compile(r"\s{0,3}")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\s{1,3}dot\s{1,3}|\.)[A-Za-z0-9-]+)+", re.I)
_SPOKEN_DOT = re.compile(r"\s+dot\s+", re.I)


def _local_part(text: str, end: int, least: int) -> int:
    """Where the name before ``end`` begins, spelled dots included; ``end`` if there is none."""
    start = end
    while True:
        at = start
        while at > least and text[at - 1] in LOCAL:
            at -= 1
        if at == start:
            return start if start == end else _skip(text, start, end)
        start = at
        # a spelled dot and blanks before it
        gap = _BACK.match(text[max(least, start - 12) : start][::-1])
        if not gap:
            return start
        blanks = _LEFT_GAP.match(text[max(least, start - gap.end() - 3) : start - gap.end()][::-1]).end()
        if not blanks:
            return start
        before = start - gap.end() - blanks
        if before <= least or text[before - 1] not in LOCAL:
            return start
        start = before


def _skip(text: str, start: int, end: int) -> int:
    """Past a dot that no name stands before."""
    while start < end and not text[start].isalnum():
        start += 1
    return start


def spoken(text: str):
    """(start, end, place of the "@") of spelled addresses that have evidence, in time linear in the text."""
    done = 0
    for m in _AT.finditer(text):
        literal = m[0] == "@"
        name_end = m.start() - _LEFT_GAP.match(text[max(done, m.start() - 3) : m.start()][::-1]).end()
        right = m.end() + _LEFT_GAP.match(text, m.end()).end() - m.end()
        domain = _DOMAIN.match(text, right)
        if domain is None or name_end <= done or m.start() < done:
            continue
        start = _local_part(text, name_end, done)
        if start >= name_end:
            continue
        end = domain.end()
        labels = re.split(r"\s+dot\s+|\.", domain[0], flags=re.I)
        # a sentence may run on after an address
        while len(labels) > 2 and labels[-1].lower() in COMMON:
            labels.pop()
            cut = max(x.start() for x in re.finditer(r"\s+dot\s+|\.", text[right:end], re.I))
            end = right + cut
        name, ending = text[start:name_end], labels[-1].lower()
        spelled = bool(_SPOKEN_DOT.search(text, right, end))
        if not (ending.isalpha() and 2 <= len(ending) <= 24) or literal and not spelled and not _SPOKEN_DOT.search(name) and right == m.end() and name_end == m.start():
            continue
        if not literal:
            asked = _ASKED.search(text[max(0, start - 60) : start]) is not None
            evidence = asked or _SPOKEN_DOT.search(name) or re.search(r"[0-9_.+%]", name) or len(labels) > 2 or labels[0].lower() in PROVIDERS or "mail" in labels[0].lower()
            if not (spelled and (ending in ENDINGS or evidence) or asked) or name.lower() in COMMON and not asked:
                continue
        done = end
        yield start, end, (m.start(), m.end())


_ASKED_AT = re.compile(r"(?:mail|contact|reach|write|address|send|ping)\b[^.!?\n]{0,60}\sat\s+[a-z0-9-]+\.[a-z]")
_DOTTED = re.compile(r"(?<=[0-9])\s+dot\s+(?=[0-9])", re.I)


def emails(text: str):
    """Leftmost matches of the address pattern, in time linear in the text."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of identifiers as they stand, by start, then kind."""
    found = [(a, b, 0) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


class Rewritten:
    """A text and, for each stretch of it, the source characters it stands for."""

    def __init__(self, text: str, starts=None, ends=None) -> None:
        # stretch i begins at at[i] and stands for source src[i]:end[i]; a stretch as long as its source maps character by character
        self.text = text
        self.at, self.src, self.end = ([0], [0], [len(text)]) if starts is None else starts

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replace stretches (start, end, new) of this text, in order and apart."""
        out, at, src, end = [], [], [], []
        size = place = 0

        def copy(a: int, b: int) -> None:
            nonlocal size
            while a < b:
                i = bisect.bisect_right(self.at, a) - 1
                stop = min(b, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
                at.append(size)
                whole = (self.at[i + 1] if i + 1 < len(self.at) else len(self.text)) - self.at[i]
                if whole == self.end[i] - self.src[i]:
                    src.append(self.src[i] + a - self.at[i])
                    end.append(self.src[i] + stop - self.at[i])
                else:
                    src.append(self.src[i])
                    end.append(self.end[i])
                out.append(self.text[a:stop])
                size += stop - a
                a = stop

        for a, b, new in edits:
            copy(place, a)
            if new:
                s, e = self.source(a, b)
                at.append(size)
                src.append(s)
                end.append(e)
                out.append(new)
                size += len(new)
            place = b
        copy(place, len(self.text))
        return Rewritten("".join(out), (at, src, end))

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of characters a to b of this text."""
        def piece(k: int) -> tuple[int, int]:
            i = bisect.bisect_right(self.at, k) - 1
            stop = self.at[i + 1] if i + 1 < len(self.at) else len(self.text)
            if stop - self.at[i] == self.end[i] - self.src[i]:
                return self.src[i] + k - self.at[i], self.src[i] + k - self.at[i] + 1
            return self.src[i], self.end[i]

        return piece(a)[0], piece(b - 1)[1]


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn a run of digit words into digits; blanks between two items go."""
    edits = []
    for p in _SPELLED_PART.finditer(m.string, m.start(), m.end()):
        if p[1]:
            edits.append((p.start(), p.end(), "+"))
        elif p[2]:
            edits.append((p.start(), p.end(), "."))
        elif p[3]:
            edits.append((p.start(), p.end(), DIGIT_WORDS[p[3].lower()]))
        elif p[5]:
            edits.append((p.start(), p.end(), ""))
    return edits


def normalised(text: str) -> Rewritten | None:
    """The text with all disguises undone, or None where nothing looks disguised."""
    odd = not text.isascii() and _SUSPECT.search(text)
    low = text.lower()
    talk = " dot " in low or "\ndot " in low or " dot\n" in low or "@" in low and re.search(r"\s@|@\s", low) or " at " in low and _ASKED_AT.search(low)
    words = _TWO_WORDS.search(low)
    boxed = _BRACKETED.search(text) if any(c in text for c in "[({<") else None
    if not (odd or talk or words or boxed):
        return None
    now = Rewritten(text)
    if odd:
        now = Rewritten(text.translate(TABLE))
        if _HIDDEN.search(text):
            now = now.rewrite([(m.start(), m.end(), "") for m in _HIDDEN.finditer(now.text)])
    now = now.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(now.text)])
    now = now.rewrite([e for m in _SPELLED.finditer(now.text) for e in _spelled(m)])
    edits = []
    for start, end, (a, b) in spoken(now.text):
        text = now.text
        while text[a - 1].isspace():
            a -= 1
        while text[b].isspace():
            b += 1
        edits += [(p.start(), p.end(), ".") for p in _SPOKEN_DOT.finditer(text, start, a)]
        edits.append((a, b, "@"))
        edits += [(p.start(), p.end(), ".") for p in _SPOKEN_DOT.finditer(text, b, end)]
    now = now.rewrite(edits)
    return now.rewrite([(m.start(), m.end(), ".") for m in _DOTTED.finditer(now.text)])


def find(text: str) -> tuple[list, list]:
    """(plain spans, all spans) as (start, end, kind number), by start, then kind."""
    base = plain(text)
    clear = normalised(text)
    if clear is None or clear.text == text:
        return base, base
    more = set()
    for a, b, kind in plain(clear.text):
        s, e = clear.source(a, b)
        if not any(k == kind and x <= s and e <= y for x, y, k in base):
            more.add((s, e, kind))
    return base, sorted({*base, *more}, key=lambda x: (x[0], x[2], x[1]))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def _find(batches):
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
    schema = pa.schema([(f.split()[0], t) for f, t in zip(FOUND.split(", "), types)])
    for batch in batches:
        out: list = []
        for name, text in zip(batch.column(0), batch.column(1)):
            base, spans = find(text.as_py() or "")
            count = [0, 0, 0, 0]
            for _, _, k in spans:
                count[k] += 1
            out.append((name.as_py(), *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """Identifiers in ``docs`` (doc_id, text): counts by kind, a digest of the plain spans, all spans.

    Spans are code points, end exclusive. A null text is empty and has none;
    null doc_ids and repeated rows come back as they came; an empty table gives
    an empty result. Work is linear in a text's length.
    """
    from pyspark.sql import functions as F

    return need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_find, FOUND)


def op6_deobfuscated_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
