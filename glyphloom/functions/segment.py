"""Line breaks (UAX #14) and sentence breaks (UAX #29), as functions of one text and as Columns.

Classes come from `regex`'s property names. Line rules work on characters with their marks put away
(LB9), in one pass with a little state; sentence rules likewise (SB5).
"""

from __future__ import annotations

import unicodedata as ud
from functools import cache

import regex
from pyspark.sql import Column

from .text import _text, arrow


@cache
def _values(prop: str) -> dict[str, regex.Pattern]:
    names = regex._regex_core.PROPERTIES[prop][1]
    by_id: dict[int, str] = {}
    for name, i in names.items():
        by_id[i] = min(by_id.get(i, name), name, key=len)
    return {name: regex.compile(rf"\p{{{prop}={name}}}") for name in by_id.values()}


@cache
def value_of(prop: str, x: str) -> str:
    """A character's value of a property, by its short name in capitals (LINEBREAK, SENTENCEBREAK, WORDBREAK,
    GRAPHEMECLUSTERBREAK, INDICCONJUNCTBREAK)."""
    return next(name for name, p in _values(prop).items() if p.match(x))


@cache
def raw_line_class(x: str) -> str:
    return value_of("LINEBREAK", x)


@cache
def line_class(x: str) -> str:
    """The class after LB1."""
    k = raw_line_class(x)
    if k == "SA":
        return "CM" if ud.category(x) in ("Mn", "Mc") else "AL"
    return {"AI": "AL", "SG": "AL", "XX": "AL", "CJ": "NS"}.get(k, k)


@cache
def _east_asian(x: str) -> bool:
    return ud.east_asian_width(x) in "FWH"


@cache
def _future_emoji(x: str) -> bool:
    return bool(regex.match(r"\p{Extended_Pictographic}", x)) and ud.category(x) == "Cn"


_HARD = {"BK", "CR", "LF", "NL"}
_KEEP = _HARD | {"SP", "ZW"}
_ALPHA = {"AL", "HL"}
_HANGUL = {"JL", "JV", "JT", "H2", "H3"}
_OPENS = _HARD | {"OP", "QU", "GL", "SP", "ZW", "sot"}
_ENDS = _HARD | {"SP", "GL", "WJ", "CL", "QU", "CP", "EX", "IS", "SY", "ZW", "eot"}


def line_breaks(s: str) -> list[int]:
    """Places (code points from the start) where a line may or must end; the end is one, the start none."""
    if not s:
        return []
    # units: class and first character of a character and the marks that it takes along (LB9, LB10)
    kind: list[str] = []
    head: list[str] = []
    at: list[int] = []
    joined: list[bool] = []  # the unit ends in a joiner (LB8a)
    for i, x in enumerate(s):
        k = line_class(x)
        if k in ("CM", "ZWJ") and kind and kind[-1] not in _KEEP:
            joined[-1] = k == "ZWJ"
            continue
        kind.append("AL" if k in ("CM", "ZWJ") else k)
        head.append("a" if k in ("CM", "ZWJ") else x)
        at.append(i)
        joined.append(k == "ZWJ")
    n = len(kind)
    numeric = [False] * n  # the unit ends NU (SY | IS)*
    closed = [False] * n  # the unit is the CL or CP of NU (SY | IS)* (CL | CP)
    regional = 0
    out: list[int] = []
    before = "sot"  # class of the last unit that is not a space
    quote = False  # an initial quote after an opening place, then spaces (LB15a)
    for j in range(n):
        b = kind[j]
        numeric[j] = b == "NU" or (b in ("SY", "IS") and j > 0 and numeric[j - 1])
        closed[j] = b in ("CL", "CP") and j > 0 and numeric[j - 1]
        if j:
            if _breaks(kind, head, joined, numeric, closed, j, n, before, quote, regional):
                out.append(at[j])
        regional = regional + 1 if b == "RI" else 0
        if b != "SP":
            quote = b == "QU" and ud.category(head[j]) == "Pi" and (kind[j - 1] if j else "sot") in _OPENS
            before = b
        elif j == 0 or kind[j - 1] in _HARD:
            before, quote = "SP", False
    return [*out, len(s)]


def _breaks(kind: list[str], head: list[str], joined: list[bool], numeric: list[bool], closed: list[bool], j: int, n: int, before: str, quote: bool, regional: int) -> bool:
    """Whether a line may end before unit j (LB4 to LB31)."""
    a, b, x, y = kind[j - 1], kind[j], head[j - 1], head[j]
    if a in _HARD:
        return not (a == "CR" and b == "LF")
    if b in _HARD or b in ("SP", "ZW"):
        return False
    if before == "ZW":
        return True
    if joined[j - 1]:
        return False
    if b == "WJ" or a in ("WJ", "GL") or (b == "GL" and a not in ("SP", "BA", "HY", "HH")):
        return False
    if b in ("CL", "CP", "EX", "SY") or before == "OP" or quote:
        return False
    after = kind[j + 1] if j + 1 < n else "eot"
    if b == "QU" and ud.category(y) == "Pf" and after in _ENDS:
        return False
    if b == "IS":
        return a == "SP" and after == "NU"
    if (before in ("CL", "CP") and b == "NS") or (before == "B2" and b == "B2"):
        return False
    if a == "SP":
        return True
    if (b == "QU" and ud.category(y) != "Pi") or (a == "QU" and ud.category(x) != "Pf"):
        return False
    if b == "QU" and (not _east_asian(x) or after == "eot" or not _east_asian(head[j + 1])):
        return False
    if a == "QU" and (not _east_asian(y) or j == 1 or not _east_asian(head[j - 2])):
        return False
    if a == "CB" or b == "CB":
        return True
    first = kind[j - 2] if j > 1 else "sot"
    if (a in ("HY", "HH") or x == "‐") and b in _ALPHA and first in _HARD | {"sot", "SP", "ZW", "CB", "GL"}:
        return False
    if b in ("BA", "HY", "NS", "HH") or a == "BB":
        return False
    if first == "HL" and (a in ("HY", "HH") or x == "‐") and b != "HL":
        return False
    if (a == "SY" and b == "HL") or b == "IN":
        return False
    if (a in _ALPHA and b == "NU") or (a == "NU" and b in _ALPHA):
        return False
    if (a == "PR" and b in ("ID", "EB", "EM")) or (a in ("ID", "EB", "EM") and b == "PO"):
        return False
    if (a in ("PR", "PO") and b in _ALPHA) or (a in _ALPHA and b in ("PR", "PO")):
        return False
    if b in ("PO", "PR") and (closed[j - 1] or numeric[j - 1]):
        return False
    if a in ("PO", "PR") and (b == "NU" or (b == "OP" and (after == "NU" or (after == "IS" and j + 2 < n and kind[j + 2] == "NU")))):
        return False
    if b == "NU" and (a in ("HY", "IS") or numeric[j - 1]):
        return False
    if (a == "JL" and b in ("JL", "JV", "H2", "H3")) or (a in ("JV", "H2") and b in ("JV", "JT")) or (a in ("JT", "H3") and b == "JT"):
        return False
    if (a in _HANGUL and b == "PO") or (a == "PR" and b in _HANGUL):
        return False
    if a in _ALPHA and b in _ALPHA:
        return False
    syllable = lambda k: kind[k] in ("AK", "AS") or head[k] == "◌"
    if (a == "AP" and syllable(j)) or (syllable(j - 1) and b in ("VF", "VI")):
        return False
    if a == "VI" and j > 1 and syllable(j - 2) and (b == "AK" or y == "◌"):
        return False
    if syllable(j - 1) and syllable(j) and after == "VF":
        return False
    if a == "IS" and b in _ALPHA:
        return False
    if (a in _ALPHA | {"NU"} and b == "OP" and not _east_asian(y)) or (a == "CP" and not _east_asian(x) and b in _ALPHA | {"NU"}):
        return False
    if a == b == "RI":
        return regional % 2 == 0
    return not (b == "EM" and (a == "EB" or _future_emoji(x)))


def lines(c: Column | str) -> Column:
    """The pieces between places where a line may end."""

    def one(s: str) -> list[str]:
        at = [0, *line_breaks(s)]
        return [s[a:b] for a, b in zip(at, at[1:])]  # noqa: B905

    return arrow(one, "array<string>")(_text(c))


@cache
def sentence_class(x: str) -> str:
    return value_of("SENTENCEBREAK", x)


_PARA, _TERM = {"SE", "CR", "LF"}, {"AT", "ST"}


def sentence_breaks(s: str) -> list[int]:
    """Places where a sentence ends, the text's end among them."""
    out: list[int] = []
    kinds = [sentence_class(x) for x in s]
    # a terminator on the way: none, then its class, and how far: 0 itself, 1 closing marks, 2 spaces, 3 a paragraph's end
    term, stage, upper = "", 0, False
    last = last2 = ""  # the classes of the two characters before, marks put away (SB5)
    for i, (x, k) in enumerate(zip(s, kinds, strict=True)):
        if i and k in ("EX", "FO") and last not in _PARA:
            continue
        if i:
            if last == "CR" and k == "LF":
                end = False
            elif last in _PARA:
                end = True
            elif not term:
                end = False
            elif term == "AT" and stage == 0 and (k == "NU" or (k == "UP" and upper)):
                end = False
            elif term == "AT" and _lower_follows(kinds, i):
                end = False
            elif k in _TERM or k == "SC":
                end = False
            elif stage < 2 and k in {"CL", "SP"} | _PARA:
                end = False
            else:
                end = k != "SP" and k not in _PARA
            if end:
                out.append(i)
                term, last, last2 = "", "", ""
        if k in _TERM:
            term, stage, upper = k, 0, last in ("UP", "LO")
        elif term and k == "CL" and stage < 2:
            stage = 1
        elif term and k == "SP" and stage < 3:
            stage = 2
        elif term and k in _PARA:
            stage = 3
        else:
            term = ""
        last2, last = last, k
    return [*out, len(s)] if s else []


def _lower_follows(kinds: list[str], i: int) -> bool:
    """SB8: a lower-case letter comes before any other letter, terminator or paragraph end."""
    while i < len(kinds):
        if kinds[i] == "LO":
            return True
        if kinds[i] in ("LE", "UP", "AT", "ST", "SE", "CR", "LF"):
            return False
        i += 1
    return False


def sentences(c: Column | str) -> Column:
    """The pieces between sentence boundaries."""

    def one(s: str) -> list[str]:
        at = [0, *sentence_breaks(s)]
        return [s[a:b] for a, b in zip(at, at[1:])]  # noqa: B905

    return arrow(one, "array<string>")(_text(c))


def sentence_count(c: Column | str) -> Column:
    """How many pieces there are between sentence boundaries."""
    return arrow(lambda s: len(sentence_breaks(s)), "int")(_text(c))


def line_count(c: Column | str) -> Column:
    """How many pieces there are between places where a line may end."""
    return arrow(lambda s: len(line_breaks(s)), "int")(_text(c))


def property_values(c: Column | str, prop: str) -> Column:
    """Each character's value of a property (see value_of)."""
    if prop not in regex._regex_core.PROPERTIES:
        raise ValueError(prop)
    return arrow(lambda s: [value_of(prop, x) for x in s], "array<string>")(_text(c))
