"""Personal data with offsets kept: identifiers are found in the text as it is, and once more in a normalised copy in
which homoglyphs, spelled digits and at/dot disguises are undone; spans of the copy are mapped back to the source."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.llm.common import bounded_batches, free_name, pieces

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where a run of digits starts, as it would otherwise fail there too
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the identifiers in ``text``, leftmost and not overlapping in each kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


# Letters of other scripts that look like a Latin letter.
_LOOKALIKE = dict(zip("АВЕЅІЈКМНОРСТХУаеіјорсухѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοενιɡα", "ABESIJKMHOPCTXYaeijopcyxshdqwABEZHIKMNOPTYXoeviga", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"
_DISGUISED = re.compile("[" + "".join(_LOOKALIKE) + _INVISIBLE + "！-～٠-٩۰-۹०-९․。\U0001d7ce-\U0001d7ff]")

# The digits from nought to nine, as four languages spell them.
_SPELLED = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_DIGITS = {w: str(i) for words in _SPELLED.values() for i, w in enumerate(words.split())}
_ANY_DIGIT = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + "|[0-9])"
_DIGITS_ON_END = _ANY_DIGIT[:-1] + "+)"
#: Three digits, or runs of them, or more on end, of which at least two are spelled.
_SPELLED_RUN = re.compile(rf"(?<![^\W_]){_DIGITS_ON_END}(?:[\s,-]{{1,2}}{_DIGITS_ON_END}(?![^\W_])){{2,}}", re.I)
_ONE_DIGIT = re.compile(_ANY_DIGIT, re.I)

_AT_WORDS, _DOT_WORDS = "at|arroba|arobase|klammeraffe", "dot|punkt|punto|point"
_AT_BRACKETS = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_AT_WORDS}|@)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_DOT_BRACKETS = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_DOT_WORDS}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
# Last labels of hosts that a bare "dot" may come before. Other labels need more to be sure.
_LAST = "com|org|net|edu|gov|info|biz|io|dev|app|eu|uk|de|fr|es|it|nl|ch|at|us|ca|au|example"
# Words of prose that are no label where the last label is not one of the listed.
_PROSE = "a|an|and|are|as|at|be|but|by|for|from|if|in|is|it|its|my|no|not|of|off|on|or|our|out|so|that|the|their|then|there|they|this|to|up|was|we|were|when|where|which|with|you|your|der|die|das|des|dem|den|ein|eine|im|ist|mit|und|von|zu|zum|auf|le|la|les|un|une|du|et|est|que|qui|pour|el|los|las|una|con|del|por|para|y|o|e"
_END = r"(?![A-Za-z0-9-])"
_STEP = rf"(?:\s+|_)(?:{_DOT_WORDS})(?:\s+|_)"
_NO_PROSE = rf"(?!(?:{_PROSE}){_END})"
_NAME = r"(?:[A-Za-z]{2,24}|xn--[A-Za-z0-9-]{2,59})"
#: Labels of a disguised host, at most: a look ahead goes no further, so that a long chain of "dot"s takes linear time.
_LABELS = 10
#: A bare "at" counts only between what looks like a name and a host with bare dots and one of the last labels.
_AT_BARE = re.compile(rf"(?<=[A-Za-z0-9])(?:\s+(?:{_AT_WORDS})\s+|_(?:{_AT_WORDS})_)(?=[A-Za-z0-9-]+(?:(?:\s+|_)(?:{_DOT_WORDS})(?:\s+|_)[A-Za-z0-9-]+){{0,{_LABELS}}}?(?:\s+|_)(?:{_DOT_WORDS})(?:\s+|_)(?:{_LAST})(?![A-Za-z0-9-]))", re.I)
_DOT_BARE = re.compile(rf"(?<=[A-Za-z0-9])(?:\s+(?:{_DOT_WORDS})\s+|_(?:{_DOT_WORDS})_)(?=(?:[A-Za-z0-9-]+(?:\s+|_)(?:{_DOT_WORDS})(?:\s+|_)){{0,{_LABELS}}}(?:{_LAST})(?![A-Za-z0-9-]))", re.I)
#: A bare "at" before any last label: between underscores, by a word that means nothing else, or before a host of two
#: dots or more, in which no label is a word of prose.
_AT_SURE = re.compile(rf"(?<=[A-Za-z0-9])(?:(?:\s+(?:arroba|arobase|klammeraffe)\s+|_(?:{_AT_WORDS})_)(?=[A-Za-z0-9-]+(?:{_STEP}[A-Za-z0-9-]+){{0,{_LABELS}}}?{_STEP}{_NO_PROSE}{_NAME}{_END})|\s+at\s+(?={_NO_PROSE}[A-Za-z0-9-]+(?:{_STEP}{_NO_PROSE}[A-Za-z0-9-]+){{1,{_LABELS}}}?{_STEP}{_NO_PROSE}{_NAME}{_END}))", re.I)
#: After an "@" any last label counts, less words of prose where the word before it is not "dot"; a host that has dots
#: by now goes on with "dot" only.
_DOT = r"(?:\s+|_)dot(?:\s+|_)"
_HOST_BARE = re.compile(rf"(?<=@)[A-Za-z0-9-]+(?:(?:\.[A-Za-z0-9-]+)+(?:{_DOT}[A-Za-z0-9-]+)*?{_DOT}|(?:{_STEP}[A-Za-z0-9-]+)*?(?:{_STEP}{_NO_PROSE}|{_DOT})){_NAME}{_END}(?!(?:{_STEP}{_NO_PROSE}|{_DOT}){_NAME}{_END})", re.I)
_STEPS = re.compile(_STEP, re.I)
_DOT_DIGITS = re.compile(rf"(?<=[0-9])\s+(?:{_DOT_WORDS})\s+(?=[0-9])", re.I)
_PLUS = re.compile(r"(?<![^\W_])plus\s+(?=[0-9])", re.I)


class Copy:
    """A text with, for each character, the source range it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, to) -> bool:
        """Replace every match by ``to(match)``; its characters share the source range of the match, digit runs
        character by character where ``to`` gives (character, start, end) triples."""
        out, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            out.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            new = to(m)
            for c, i, j in [(c, a, b) for c in new] if isinstance(new, str) else new:
                out.append(c)
                start.append(self.start[i])
                end.append(self.end[j - 1])
            at = b
        if not at:
            return False
        self.text = "".join(out) + self.text[at:]
        self.start, self.end = start + self.start[at:], end + self.end[at:]
        return True


def _letter(m: re.Match) -> str:
    c = m[0]
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if c in _INVISIBLE:
        return ""
    if c in "․。":
        return "."
    return unicodedata.normalize("NFKC", c) if not c.isdecimal() else str(unicodedata.decimal(c))


def _digits(m: re.Match) -> list[tuple[str, int, int]] | str:
    found = list(_ONE_DIGIT.finditer(m[0]))
    if sum(len(d[0]) > 1 for d in found) < 2:
        return [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0])]
    return [(_DIGITS.get(_folded(d[0]), d[0]), m.start() + d.start(), m.start() + d.end()) for d in found]


def _dotted(m: re.Match) -> list[tuple[str, int, int]]:
    out, at, a = [], 0, m.start()
    for step in _STEPS.finditer(m[0]):
        out += [(c, a + at + i, a + at + i + 1) for i, c in enumerate(m[0][at : step.start()])]
        out.append((".", a + step.start(), a + step.end()))
        at = step.end()
    return out + [(c, a + at + i, a + at + i + 1) for i, c in enumerate(m[0][at:])]


def _folded(text: str) -> str:
    """``text`` in lower case, with the letters that patterns without case take for "i" and "s"."""
    return text.lower() if text.isascii() else text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


def normalised(text: str) -> Copy | None:
    """The copy of ``text`` with all disguises undone; None where there is none."""
    copy, changed = None, False

    def rewrite(pattern, to):
        nonlocal copy, changed
        copy = copy or Copy(text)
        changed |= copy.rewrite(pattern, to)

    if not text.isascii() and _DISGUISED.search(text):
        rewrite(_DISGUISED, _letter)
    # what follows is guarded by necessary conditions only, as a copy costs far more than a search
    low = _folded(copy.text if copy else text)
    if _AT_BRACKETS.search(low):
        rewrite(_AT_BRACKETS, lambda m: "@")
    if _DOT_BRACKETS.search(low):
        rewrite(_DOT_BRACKETS, lambda m: ".")
    if sum(map(low.count, _DIGITS)) >= 2 and _SPELLED_RUN.search(low):
        rewrite(_SPELLED_RUN, _digits)
    dots = any(w in low for w in _DOT_WORDS.split("|"))
    if dots and _DOT_DIGITS.search(copy.text if copy else text):
        rewrite(_DOT_DIGITS, lambda m: ".")
    if "plus" in low and _PLUS.search(copy.text if copy else text):
        rewrite(_PLUS, lambda m: "+")
    if dots:
        if any(w in low for w in _AT_WORDS.split("|")):
            for pattern in (_AT_BARE, _AT_SURE):
                if pattern.search(copy.text if copy else text):
                    rewrite(pattern, lambda m: "@")
        if "@" in (copy.text if copy else text):
            if _DOT_BARE.search(copy.text if copy else text):
                rewrite(_DOT_BARE, lambda m: ".")
            if _HOST_BARE.search(copy.text if copy else text):
                rewrite(_HOST_BARE, _dotted)
    return copy if changed else None


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans of ``text``, and all: base ones, and those of the copy that are none of them. A span of the copy may
    overlap base ones, as where a disguise hides the start of an identifier from the base patterns; one that lies within
    a base span adds nothing and is left out."""
    base = base_spans(text)
    copy = normalised(text)
    if copy is None:
        return base, base
    spans = sorted((copy.start[a], copy.end[b - 1], kind) for a, b, kind in base_spans(copy.text))
    added, at, reach = [], 0, -1  # base spans that start no later, and how far they reach
    for span in spans:
        while at < len(base) and base[at][0] <= span[0]:
            reach = max(reach, base[at][1])
            at += 1
        if span[1] > reach:
            added.append(span)
    return base, sorted(base + added, key=lambda s: (s[0], _ORDER[s[2]]))


_FOUND = "array<struct<start:int,end:int,kind:string,disguised:boolean>>"


def find(docs: DataFrame, text_col: str = "text", spans_as: str = "spans") -> DataFrame:
    """``docs`` with the spans of each whole text, by start, in code points, end exclusive; ``disguised`` tells those
    that only the normalised copy shows. Null and empty texts have none. A column of ``docs`` with the name of the
    spans is replaced; repeated rows stay."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(spans_as)
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField(spans_as, T._parse_datatype_string(_FOUND))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("disguised", pa.bool_())]))

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                out = []
                for text in batch.column(text_col).to_pylist():
                    base, every = all_spans(text or "")
                    own = set(base)
                    out.append([{"start": s[0], "end": s[1], "kind": s[2], "disguised": s not in own} for s in every])
                yield batch.append_column(spans_as, pa.array(out, type=kind))

    return docs.mapInArrow(run, schema)


def listed(spans):
    """A spans column as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each identifier replaced by its kind in angle brackets; where spans overlap, the one that starts
    first goes and the rest of the other with it. Columns stay, whatever their names; null texts stay null."""
    name = free_name(docs, "_spans")
    found = find(docs, text_col, name)
    step = F.aggregate(
        name,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substring(F.col(text_col), s["at"] + 1, x["start"] - s["at"]), F.lit("<"), x["kind"], F.lit(">"))).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col(text_col), s["at"] + 1, F.length(F.col(text_col)))),
    )
    return found.withColumn(text_col, step).select(*docs.columns)
