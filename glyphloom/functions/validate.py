"""Validators and shapes as Columns: printable text, ASCII identifiers, bounded blobs, emoji sequences,
source code safety, character properties, property names. All but `properties` are pure expressions."""

from __future__ import annotations

import unicodedata as ud

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ucd
from .text import LEVELS, _text, arrow, is_normalized, restriction_level, scripts_of, utf8_error

#: Forbidden characters by class; the first class that has a character is its class.
FORBIDDEN = {
    "bidiOverride": r"[\x{202A}-\x{202E}]", "bidiIsolate": r"[\x{2066}-\x{2069}]", "zeroWidth": r"[\x{200B}-\x{200F}]", "bom": r"\x{FEFF}", "tagCharacter": r"[\x{E0000}-\x{E007F}]",
    "variationSelector": r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]", "hangulFiller": r"[\x{FFA0}\x{3164}]", "softHyphen": r"\x{AD}", "interlinearAnnotation": r"[\x{FFF9}-\x{FFFB}]", "mongolianVowelSeparator": r"\x{180E}",
}
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F]"
IDENTIFIER = r"\A[A-Za-z_][A-Za-z0-9_]*\z"


def _before(t: Column, pattern: str) -> Column:
    """Bytes before a pattern's first match."""
    return F.octet_length(F.regexp_replace(t, f"(?s)(?:{pattern}).*", ""))


def first_forbidden_control(c: Column | str) -> Column:
    """Byte offset of the first control character other than tab and line feed; null without one."""
    t = _text(c)
    return F.when(t.rlike(CONTROL), _before(t, CONTROL))


def first_forbidden(c: Column | str) -> Column:
    """offset (bytes), cp and class of the first forbidden character; null without one."""
    t = _text(c)
    any_ = ucd.quick_class(ucd.default_ignorable() | {0xFEFF, 0x180E, 0xFFF9, 0xFFFA, 0xFFFB})
    hit = F.regexp_extract(t, f"({any_})", 1)
    kind = F.lit("defaultIgnorable")
    for name, pattern in reversed(FORBIDDEN.items()):
        kind = F.when(hit.rlike(pattern), name).otherwise(kind)
    return F.when(t.rlike(any_), F.struct(_before(t, any_).alias("offset"), F.ascii(hit).alias("cp"), kind.alias("class")))


def is_printable(c: Column | str) -> Column:
    """No forbidden control or character, and NFC."""
    return first_forbidden_control(c).isNull() & first_forbidden(c).isNull() & is_normalized(c, "NFC")


def printable_reason(b: Column | str, limit: int) -> Column:
    """Why bytes aren't printable UTF-8 of at most limit bytes: code and offset; null for those that are."""
    b = _text(b)
    bad, t = utf8_error(b), F.try_validate_utf8(b.cast("string"))
    seen = first_forbidden(t)
    reason = lambda code, at: F.struct(F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), at.cast("int").alias("offset"))
    return (
        F.when(F.octet_length(b) > limit, reason("sizeExceeded", F.lit(limit))).when(bad.isNotNull(), reason(F.concat(F.lit("utf8"), bad["kind"]), bad["offset"]))
        .when(first_forbidden_control(t).isNotNull(), reason("forbiddenControl", first_forbidden_control(t))).when(seen.isNotNull(), reason(seen["class"], seen["offset"]))
        .when(~is_normalized(t, "NFC"), reason("notNfcNormalized", F.lit(0)))
    )


def bounded_blob(b: Column | str, limit: int) -> Column:
    """The bytes if they are valid UTF-8 within the limit, else null."""
    return F.when((F.octet_length(_text(b)) <= limit) & F.is_valid_utf8(_text(b)), _text(b))


def is_ascii_identifier(c: Column | str) -> Column:
    return _text(c).rlike(IDENTIFIER)


def identifier_reason(c: Column | str) -> Column:
    """Why a text is no ASCII identifier: code and byte offset; null for one."""
    t = _text(c)
    bad = r"[^A-Za-z0-9_]"
    return F.when(t == "", F.struct(F.lit("identifierEmpty").alias("code"), F.lit(0).alias("offset"))).when(~t.rlike("^[A-Za-z_]"), F.struct(F.lit("nonIdentifierStartByte").alias("code"), F.lit(0).alias("offset"))).when(
        t.rlike(bad), F.struct(F.lit("nonIdentifierContinueByte").alias("code"), _before(t, bad).alias("offset")))


# ---- emoji shapes (UTS #51)

_RI, _TONE = r"[\x{1F1E6}-\x{1F1FF}]", r"[\x{1F3FB}-\x{1F3FF}]"


def is_flag_sequence(c: Column | str) -> Column:
    return _text(c).rlike(rf"\A{_RI}{{2}}\z")


def is_keycap_sequence(c: Column | str) -> Column:
    return _text(c).rlike(r"\A[0-9#*]\x{FE0F}\x{20E3}\z")


def is_modifier_sequence(c: Column | str) -> Column:
    return _text(c).rlike(rf"\A{ucd.quick_class(ucd.members('Emoji_Modifier_Base'))}{_TONE}\z")


def is_tag_sequence(c: Column | str) -> Column:
    return _text(c).rlike(rf"\A{ucd.quick_class(ucd.members('Emoji'))}{_TONE}?\x{{FE0F}}?[\x{{E0020}}-\x{{E007E}}]+\x{{E007F}}\z")


def is_zwj_sequence(c: Column | str) -> Column:
    """Three characters at least, joined by zero width joiners that are neither at an edge nor next to one another."""
    return _text(c).rlike(r"(?s)\A(?!\x{200D})(?=.*\x{200D})(?!.*\x{200D}\x{200D})(?!.*\x{200D}\z).{3,}\z")


def is_emoji_sequence(c: Column | str) -> Column:
    return is_flag_sequence(c) | is_keycap_sequence(c) | is_modifier_sequence(c) | is_tag_sequence(c) | is_zwj_sequence(c)


def is_registered_zwj(c: Column | str) -> Column:
    return _text(c).isin(*sorted(ucd.zwj_sequences()))


# ---- source code, names, properties


def contains_bidi_control(c: Column | str) -> Column:
    return _text(c).rlike(r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]")


def safe_for_code(c: Column | str) -> Column:
    """No bidi control, and a restriction level of HighlyRestrictive or stricter."""
    return ~contains_bidi_control(c) & restriction_level(c).isin(*LEVELS[:3])


def loose_name(c: Column | str) -> Column:
    """A property name for loose matching: lower case, without spaces, low lines and hyphens."""
    return F.regexp_replace(F.lower(_text(c)), r"[ \t\n\r_\-]", "")


PROPERTIES = "array<struct<cp: int, category: string, combining: int, bidi: string, width: string, mirrored: boolean, scripts: array<string>, decomposition: string, numeric: double>>"


def properties(c: Column | str) -> Column:
    """Each character's properties."""

    def one(s: str) -> list[dict]:
        return [
            {"cp": ord(x), "category": ud.category(x), "combining": ud.combining(x), "bidi": ucd.bidi_class(ord(x)), "width": ud.east_asian_width(x), "mirrored": bool(ud.mirrored(x)), "scripts": sorted(scripts_of(x)), "decomposition": ud.decomposition(x) or None, "numeric": ud.numeric(x, None)}
            for x in s
        ]

    return arrow(one, PROPERTIES)(_text(c))
