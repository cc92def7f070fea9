"""Operator 7, personal data: offset-preserving deobfuscation.

Identifiers are first found in the text as it stands (the base spans). Then transducers rewrite the text, each
keeping for every character it puts out the source span it stands for: homoglyphs and compatibility forms become
ASCII, invisible characters go, bracketed or spelled ``at`` and ``dot`` become ``@`` and ``.``, and runs of spelled
digits become digits: four parts or more, or fewer beside digits or a plus. The same detectors run over the rewritten text, and what they find is mapped back to source
offsets. An added span that lies inside a base span of its kind is no news and is left out; base spans always stay.

Offsets are code points, ends exclusive. Detectors are linear in the text, whatever it holds.

Defined results: a null or empty text has no spans; repeated rows each get their row; null ids and extra columns are
kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, ship, without

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # an address that doesn't start a run of digits fails with the run
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @, as a pattern that starts with the local part rescans long words."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(doubled)) % 10 == 0


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the identifiers in a text, by start and then by kind as listed."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


#: Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіѕјԁһԛԝАВЕКМНОРСТУХІЅЈоαοιρυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑‒–—−․．＠﹫",
        "aeopcyxisjdhqwABEKMHOPCTYXISJoaoipuvABEZHIKMNOPTYX------..@@",
        strict=True,
    )
)
#: Characters that are not seen.
INVISIBLE = "­​‌‍⁠﻿"
#: The digits 0 to 9 in four languages, with the spoken zero.
SPELLED = {
    w: str(i)
    for names in (
        "oh one two three four five six seven eight nine",
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(names.split())
}
AT, DOT = "at|arroba|arobase|klammeraffe", "dot|punto|punkt|point"


def _letters() -> dict[str, str]:
    """One character for one: homoglyphs, decimal digits of all scripts and compatibility forms of ASCII."""
    out = {}
    for c in (*range(0xA0, 0x3000), *range(0xFF00, 0xFFEF), *range(0x1D400, 0x1D800)):
        ch = chr(c)
        plain = unicodedata.normalize("NFKC", ch)
        if unicodedata.category(ch) == "Nd":
            out[ch] = str(unicodedata.decimal(ch))
        elif len(plain) == 1 and " " <= plain <= "~" and (c == 0xA0 or c >= 0x2000):
            out[ch] = plain
    return out | HOMOGLYPHS | dict.fromkeys(INVISIBLE, "")


LETTERS = _letters()
#: One range for what lies beyond U+FFFF: a set with many such characters is searched one by one.
_ODD = re.compile("[" + "".join(map(re.escape, sorted(c for c in LETTERS if c <= "\uffff"))) + "\U0001d400-\U0001d7ff]")
_BRACKETED = re.compile(rf"(?:[ \t]{{1,3}})?[\[({{<]\s{{0,3}}(?:(@|(?:{AT}))|(\.|(?:{DOT})))\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_BARE_DOT = re.compile(rf"[ \t]{{1,3}}\b(?:{DOT})\b[ \t]{{1,3}}(?=[A-Za-z0-9])", re.I)
_BARE_AT = re.compile(rf"[ \t]{{1,3}}(?:{AT})[ \t]{{1,3}}(?=[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,8}}(?:[ \t]{{1,3}}(?:{DOT})[ \t]{{1,3}}[A-Za-z0-9]|\s{{0,3}}[\[({{<]\s{{0,3}}(?:{DOT}|\.)\s{{0,3}}[\])}}>]))", re.I)
_JOINED = re.compile(r"([-_*])(?:(at)|dot)\1", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:[ \t]{1,3}@[ \t]{0,3}|@[ \t]{1,3})(?=[A-Za-z0-9-]{1,63}\.[A-Za-z0-9])")
_MARKED_WORDS = [f"{c}{w}{c}" for c in "-_*" for w in ("at", "dot")]
_WORD_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_DIGIT_RUN = re.compile(rf"(?:\bplus[ \t]{{1,3}})?\b(?:{_WORD_DIGIT})(?:[ \t,.-]{{1,3}}(?:{_WORD_DIGIT}|[0-9]{{1,4}})){{3,}}\b", re.I)
#: What _DIGIT_RUN leaves: runs of any length, taken if digits or a plus stand next to them, and a spelled plus before digits.
_SHORT_RUN = re.compile(rf"(?:\bplus[ \t]{{1,3}}|\+[ \t]{{0,3}})?\b(?:{_WORD_DIGIT})(?:[ \t,.()-]{{1,3}}(?:{_WORD_DIGIT})\b)*+\b|\bplus[ \t]{{1,3}}(?=[0-9])", re.I)
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][ \t,.()-]{1,3}\Z"), re.compile(r"[ \t,.()-]{1,3}[0-9]")
_DIGIT_PART = re.compile(rf"plus|{_WORD_DIGIT}|[0-9]|[.+]", re.I)
_LETTER_RUN = re.compile(r"[^\W\d_]+")


class Traced:
    """A rewritten text; each of its characters has the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, put) -> bool:
        """Replace each match by what put gives, pairs (string, start and end in the match), or leave it if that is None;
        whether any was replaced."""
        text, starts, ends, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            if (pieces := put(m)) is None:
                continue
            text.append(self.text[last : m.start()])
            starts += self.starts[last : m.start()]
            ends += self.ends[last : m.start()]
            for piece, s, e in pieces:
                text.append(piece)
                starts += [self.starts[m.start() + s]] * len(piece)
                ends += [self.ends[m.start() + e - 1]] * len(piece)
            last = m.end()
        if not last:
            return False
        self.text = "".join([*text, self.text[last:]])
        self.starts, self.ends = starts + self.starts[last:], ends + self.ends[last:]
        return True


def _spelled(m: re.Match):
    for part in _DIGIT_PART.finditer(m.group()):
        word = part.group().lower()
        yield ("+" if word == "plus" else SPELLED.get(word, word)), part.start(), part.end()


def _short(m: re.Match):
    plus = m.group()[0] == "+" or m.group()[:4].lower() == "plus"
    return _spelled(m) if plus or _DIGIT_BEFORE.search(m.string[max(m.start() - 4, 0) : m.start()]) or _DIGIT_AFTER.match(m.string, m.end()) else None


def _whole(by):
    return lambda m: [(by(m), 0, len(m.group()))]


_DOT_WORDS = DOT.split("|")


def deobfuscate(text: str) -> Traced | None:
    """The rewritten text, or None if nothing in it is disguised. Cheap tests say which transducers can apply."""
    low, steps = text.lower(), []
    if not text.isascii() and _ODD.search(text):
        traced = Traced(text)
        traced.rewrite(_ODD, _whole(lambda m: LETTERS.get(m.group(), m.group())))
        low, steps = traced.text.lower(), [traced]
    dotted = any(w in low for w in _DOT_WORDS)
    spelled = not SPELLED.keys().isdisjoint(_LETTER_RUN.findall(low))
    if spelled:
        steps.append((_DIGIT_RUN, _spelled))
    if "plus" in low or (spelled and ("+" in low or _DIGIT.search(low))):
        steps.append((_SHORT_RUN, _short))
    bracket = any(c in low for c in "[({<")
    if dotted or bracket:
        steps += [(_BARE_AT, _whole(lambda m: "@"))] if dotted or "." in low else []
        steps += [(_BRACKETED, _whole(lambda m: "@" if m.group(1) else "."))] if bracket else []
        steps += [(_BARE_DOT, _whole(lambda m: "."))] if dotted else []
    if any(w in low for w in _MARKED_WORDS):
        steps.append((_JOINED, _whole(lambda m: "@" if m.group(2) else ".")))
    if any(w in low for w in (" @", "@ ", "\t@", "@\t")):
        steps.append((_SPACED_AT, _whole(lambda m: "@")))
    if not steps:
        return None
    traced = steps.pop(0) if isinstance(steps[0], Traced) else None
    for pattern, put in steps:
        if traced is None:
            if pattern.search(text) is None:
                continue
            fresh = Traced(text)
            traced = fresh if fresh.rewrite(pattern, put) else None
        else:
            traced.rewrite(pattern, put)
    return traced


def spans(text: str | None) -> list[dict]:
    """All spans of a text: kind, start, end, whether it is a base span, and the identifier as rewritten."""
    if not text:
        return []
    base = find(text)
    out = {(s, KINDS.index(k), e): (True, text[s:e]) for s, k, e in base}
    if traced := deobfuscate(text):
        for s, kind, e in find(traced.text):
            start, end = traced.starts[s], traced.ends[e - 1]
            if not any(k == kind and b <= start and end <= t for b, k, t in base):
                out.setdefault((start, KINDS.index(kind), end), (False, traced.text[s:e]))
    return [{"kind": KINDS[k], "start": s, "end": e, "base": b, "value": v} for (s, k, e), (b, v) in sorted(out.items())]


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,value:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())]))


def find_personal_data(docs: DataFrame, text_col: str = "text", spans_col: str = "__spans") -> DataFrame:
    """docs with the spans of each text."""
    ship(docs.sparkSession)
    docs = without(docs, spans_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([spans(t) for t in batch.column(at).to_pylist()], _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, spans_col])
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{spans_col}` {SPANS}")


def redact(text: str, found: list[dict]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one."""
    out, last = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= last:
            out += [text[last : s["start"]], f"[{s['kind']}]"]
        last = max(last, s["end"])
    return "".join([*out, text[last:]])


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
