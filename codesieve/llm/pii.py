"""Personal data, also in disguise, at the offsets of the source text.

Base detectors run on the text itself. Every text goes through transducers, each of which rewrites a text and carries the
source span of every character: character references, homoglyphs and invisible characters, at/dot disguises, spelled digits. Where any of them
changed something the detectors run again on what comes out, and a find that isn't in the source as it is maps back to its source characters.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A run of digits starts a match or none of its digits does, so only its first digit is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """(start, end, kind) of the base kinds, leftmost and non-overlapping per kind; by start, then kind as listed."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Aligned:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, [], []

    def rewrite(self, cuts: Iterator[tuple[int, int, str]]) -> None:
        """cuts: (start, end, what comes there), rising; each new character spans all that it replaces. Spans are made at the first cut."""
        cuts = list(cuts)
        if cuts and not self.end:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, start, end, last = [], [], [], 0
        for a, b, new in cuts:
            text += (self.text[last:a], new)
            start += self.start[last:a]
            end += self.end[last:a]
            if b > a:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            last = b
        if text:
            self.text = "".join(text) + self.text[last:]
            self.start, self.end = start + self.start[last:], end + self.end[last:]


_LOOKS = dict(
    zip(
        "аеорсухіјѕԁһԛԝкмтвнгАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαενικρτυχ",
        "aeopcyxijsdhqwkmtbhrABEKMHOPCTYXIJSABEZHIKMNOPTYXoaevikptyx",
    )
) | {"。": ".", "․": ".", "‧": ".", "·": ".", "∙": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-"}
_HIDDEN = frozenset("​‌‍⁠﻿­᠎")
_ODD = re.compile(r"[^\x00-\x7F]")


@lru_cache(1 << 16)
def look(c: str) -> str:
    """What a character passes for: itself, another one, or nothing."""
    if c.isascii():
        return c
    if c in _HIDDEN:
        return ""
    if c in _LOOKS:
        return _LOOKS[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(int(d))
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and not c.isspace() else " " if c.isspace() and c not in "\x85  " else c


_WORDS = {
    w: str(d)
    for d, words in enumerate(("zero oh null cero zéro", "one eins uno", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf"))
    for w in words.split()
}
_DIGIT_WORD = "|".join(sorted(_WORDS, key=len, reverse=True))
_DASH = "dash|hyphen|minus|bindestrich|strich|tiret|guion"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[ -]+|\+ ?)?(?:{_DIGIT_WORD})(?:(?:[ ,-]+|[ ]+(?:{_DASH})[ ]+)(?:{_DIGIT_WORD}|[0-9]+)|[ ]*(?:[ ](?:dot|point|punkt|punto)[ ]|\.)[ ]*(?:{_DIGIT_WORD}|[0-9]+))+(?![^\W_])", re.I)
_PART = re.compile(rf"(plus|\+)|(dot|point|punkt|punto|\.)|({_DIGIT_WORD})|([0-9]+)|({_DASH})", re.I)
_AT = re.compile(r"\s?[\[({<]\s?(?:at|@|arroba|klammeraffe)\s?[\])}>]\s?", re.I)
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s?", re.I)
_DOTS = r"(?: dot |_dot_|-dot-| \. )"
#: The lookahead takes a domain of at most 253 characters, as many as a name may have, so that it takes linear time.
_SAID = re.compile(rf"(?<=[A-Za-z0-9])(?: at |_at_|-at-|\s@\s)(?=[A-Za-z0-9-][A-Za-z0-9.-]{{0,252}}?{_DOTS}[A-Za-z0-9-])", re.I)
_SAID_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_DOTS}(?=[A-Za-z0-9])|(?<=[0-9]) (?:point|punkt|punto) (?=[0-9])", re.I)
_TOP = r"(?i:com|org|net|edu|gov|io|de|fr|es|uk|eu)\b"
_NAMED = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?: (?i:at) |\s@\s)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:({_TOP})|(?:xn--[a-z0-9-]+|[a-z]{{2,63}}|[A-Z]{{2,63}})(?![A-Za-z0-9-])))")
#: What an address comes after: before it a plain word before ' at ' is a name, unless it is one of _NOBODY.
_CUE = re.compile(r"(?i)(?<![^\W_])(?:e-?mail|mail|mailto|contact|address|kontakt|adresse|correo|courriel)(?:[ ](?:is|ist|est|es|to|an))?[ ]?[:=]?[ ]$")
_NOBODY = frozenset("us me him her them it you all one uns mich mir dich ihn sie euch nous moi lui elle eux vous nos mi ella ellos usted is was are and or the a an us. addresses lists servers".split())
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,12});|%(?:40|2[EeBbDd]|5[Ff])")
#: Groups of a card between dots, slashes or underlines.
_GROUPED = re.compile(r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![0-9._/]*[0-9])")
_SHAPE = re.compile(r"[._%+0-9-]")
_LETTER = re.compile(r"[A-Za-z]")


def _look_cuts(text: str) -> Iterator[Span]:
    for m in _ODD.finditer(text):
        if (new := look(m[0])) != m[0]:
            yield m.start(), m.end(), new


def _spelled_cuts(text: str) -> Iterator[Span]:
    for m in _SPELLED.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start(), "+" if p[1] else "." if p[2] else _WORDS[p[3].casefold()] if p[3] else p[4] or "-") for p in _PART.finditer(m[0])]
        if sum(len(p[2]) for p in parts) >= 4:
            for k, (a, b, new) in enumerate(parts):
                yield a, parts[k + 1][0] if k + 1 < len(parts) else b, new


def _entity_cuts(text: str) -> Iterator[Span]:
    """Character references and percent codes of single printable ASCII characters."""
    for m in _ENTITY.finditer(text):
        new = html.unescape(m[0]) if m[0][0] == "&" else chr(int(m[0][1:], 16))
        if len(new) == 1 and new.isascii() and new.isprintable():
            yield *m.span(), new


def _group_cuts(text: str) -> Iterator[Span]:
    for m in _GROUPED.finditer(text):
        for k in range(m.start(), m.end()):
            if text[k] == m[1]:
                yield k, k + 1, "-"


def _swaps(pattern: re.Pattern, new: str):
    return lambda text: ((m.start(), m.end(), new) for m in pattern.finditer(text))


def _named_cuts(text: str) -> Iterator[Span]:
    """' at ' and ' @ ' before a domain with dots, after what has the shape of a local part; after figures alone before a common domain only."""
    low = 0
    for m in _NAMED.finditer(text):
        start = m.start()
        while start > low and _LOCAL.match(text[start - 1]):
            start -= 1
        local, low = text[start : m.start()], m.end()
        shaped = _SHAPE.search(local) and (_LETTER.search(local) or m[1] and _DIGIT.search(local))
        if shaped or local.isalpha() and local.lower() not in _NOBODY and _CUE.search(text, max(0, start - 24), start):
            yield *m.span(), "@"


# Searching a text for what a pattern can't do without is many times faster than the pattern; each of these is necessary for a cut, so that
# leaving a transducer out where it fails changes nothing, in texts without look-alikes as _look_cuts leaves them (ungated() is for the test of that).

_PLAIN = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 else 32 for c in range(256))
_TOKENS = frozenset(part for w in _WORDS for part in w.encode().translate(_PLAIN).split())
_BETWEEN = frozenset(w.encode() for w in f"dot|point|punkt|punto|{_DASH}".split("|"))


def _may_spell(text: str) -> bool:
    """A digit word, or what its accents leave of it, before another one, figures, or a word between digits."""
    tokens = text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    if _TOKENS.isdisjoint(tokens):
        return False
    return any(t in _TOKENS and (n in _TOKENS or n in _BETWEEN or n[:1].isdigit()) for t, n in zip(tokens, tokens[1:]))


def _any(*marks: str):
    def holds(text: str) -> bool:
        low = text.lower()
        return any(m in low for m in marks)

    return holds


def _gated(need, cuts):
    def gated(text: str) -> Iterator[Span]:
        return cuts(text) if need(text) else iter(())

    gated.cuts = cuts
    return gated


#: In this order. _SAID comes before the dots that it needs to see, and names after the dots that may shape them.
TRANSDUCERS = (
    _gated(_any("&", "%"), _entity_cuts), _gated(lambda text: not text.isascii(), _look_cuts), _gated(_any(*"[({<"), _swaps(_AT, "@")), _gated(_any(*"[({<"), _swaps(_DOT, ".")), _gated(_may_spell, _spelled_cuts),
    _gated(_any(" at ", "_at_", "-at-", "@"), _swaps(_SAID, "@")), _gated(_any(" dot ", "_dot_", "-dot-", " . ", " point ", " punkt ", " punto "), _swaps(_SAID_DOT, ".")), _gated(_any(" at ", "@"), _named_cuts),
    _gated(lambda text: _DIGIT.search(text) is not None, _group_cuts),
)


def ungated() -> tuple:
    return tuple(t.cuts for t in TRANSDUCERS)


def disguised(text: str, base: list[Span], transducers: tuple = ()) -> list[Span]:
    """Spans of the source whose disguise hides an identifier, or a part of it; none that lies within a base span of its kind."""
    a = Aligned(text)
    for t in transducers or TRANSDUCERS:
        a.rewrite(t(a.text))
    if a.text is text:
        return []
    held: dict[str, list[Span]] = {k: [s for s in base if s[2] == k] for k in KINDS}
    found = []
    for start, end, kind in detect(a.text):
        s, e = a.start[start], a.end[end - 1]
        if text[s:e] != a.text[start:end] and not any(x <= s and e <= y for x, y, _ in held[kind]):
            found.append((s, e, kind))
    return found


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind as listed."""
    base = detect(text)
    added = disguised(text, base)
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if added else base


def mask(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind; of spans that overlap the leftmost, then longest, names the place."""
    done, last = [], 0
    for s, e, kind in sorted(found, key=lambda s: (s[0], -s[1])):
        if s >= last:
            done += (text[last:s], f"[{kind}]")
        last = max(last, e)
    return "".join(done) + text[last:]


def joined(found: list[Span]) -> str:
    return ",".join([f"{kind}:{s}:{e}" for s, e, kind in found])


_ROW = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_disguised", pa.int64()), ("n_found", pa.int64()), ("masked", pa.string())])


def _scan(with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = []
        for t in part.column("text").to_pylist():
            base, every = spans(t or "")
            counts = [sum(s[2] == k for s in base) for k in KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), len(every), None if not with_text or t is None else mask(t, every)))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(_ROW)[1:])]], schema=_ROW)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised, n_found, masked) for each row of docs; masked only with_text.

    The n_ of kinds count base spans; n_disguised counts the added ones, n_found all. A null or empty text has no span; repeated rows each get theirs; an
    empty table gives none. All patterns take time in proportion to the text.
    """
    ship(docs.sparkSession)
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    done = rows.mapInArrow(lambda b: _scan(with_text, b), f"doc_id long, {kinds}, base_sha256 string, spans string, n_disguised long, n_found long, masked string")
    return done if with_text else done.drop("masked")
