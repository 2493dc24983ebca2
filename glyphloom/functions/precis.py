"""PRECIS profiles (RFC 8264, 8265): prepared and enforced forms of user names and passwords as Columns."""

from __future__ import annotations

import unicodedata as ud

from pyspark.sql import Column

from . import ucd
from .text import _text, arrow

#: Contextual and exceptional characters of RFC 5892, by what the identifier class does with them.
VALID = "ßς་〇"
INVALID = "ـߺ〮〯〱〲〳〴〵〻"


def width_mapped(s: str) -> str:
    """Fullwidth and halfwidth characters become their plain forms."""
    return "".join(ud.normalize("NFKC", x) if ud.decomposition(x).split(" ")[0] in ("<wide>", "<narrow>") else x for x in s)


def identifier_class(x: str) -> bool:
    if x in VALID:
        return True
    if x in INVALID or ord(x) in ucd.default_ignorable() or 0x1100 <= ord(x) <= 0x11FF:
        return False
    if "!" <= x <= "~":
        return True
    return ud.category(x) in ("Ll", "Lu", "Lo", "Nd", "Lm", "Mn", "Mc") and ud.normalize("NFKC", x) == x


def freeform_class(x: str) -> bool:
    return identifier_class(x) or (ord(x) not in ucd.default_ignorable() and ud.category(x)[0] in "LMNPSZ" and ud.category(x) not in ("Zl", "Zp"))


def bidi_rule(s: str) -> bool:
    """RFC 5893 for text with right-to-left characters."""
    k = [ucd.bidi_class(ord(x)) for x in s]
    if not {"R", "AL", "AN"} & set(k):
        return True
    tail = [x for x in k if x != "NSM"][-1:]
    common = {"EN", "ES", "CS", "ET", "ON", "BN", "NSM"}
    if k[0] in ("R", "AL"):
        return set(k) <= {"R", "AL", "AN"} | common and tail[0] in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(k)
    return k[0] == "L" and set(k) <= {"L"} | common and tail[0] in ("L", "EN")


def enforce_username(s: str, fold: bool = True) -> dict:
    t = width_mapped(s)
    t = ud.normalize("NFC", t.lower() if fold else t)
    error = "empty" if not t else next((f"disallowed U+{ord(x):04X}" for x in t if not identifier_class(x)), None)
    return {"value": None if error else t, "error": error} if error or bidi_rule(t) else {"value": None, "error": "bidi"}


def enforce_opaque(s: str) -> dict:
    t = ud.normalize("NFC", "".join(" " if ud.category(x) == "Zs" else x for x in s))
    error = "empty" if not t else next((f"disallowed U+{ord(x):04X}" for x in t if not freeform_class(x)), None)
    return {"value": None if error else t, "error": error}


RESULT = "struct<value: string, error: string>"


def username(c: Column | str, fold: bool = True) -> Column:
    """UsernameCaseMapped (or, without folding, UsernameCasePreserved): the enforced form or the reason against."""
    return arrow(lambda s: enforce_username(s, fold), RESULT)(_text(c))


def opaque_string(c: Column | str) -> Column:
    """OpaqueString, for passwords."""
    return arrow(enforce_opaque, RESULT)(_text(c))
