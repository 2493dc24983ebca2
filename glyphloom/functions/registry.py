"""Registered sequences, orientation, property names, ideograph variants and word fragments as Columns."""

from __future__ import annotations

import unicodedata as ud

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ucd
from .text import _text, arrow

# Strings that published tokenizers hold as single tokens that models handle oddly, in order.
GLITCH_TOKENS = [
    " SolidGoldMagikarp", " StreamerBot", " davidjl", " RandomRedditor", " RandomRedditorWithNo", " attRot", " newcom", " cloneembedreportprint",
    " rawdownload", " rawdownloadcloneembedreportprint", " SpaceEngineers", " externalToEVA", " externalToEVAOnly", " reportprint",
    " embedreportprint", " cloneembedreportprintRAW", " 龍喚士", " TheNitrome", " TheNitromeFan", " GoldMagikarp", " DragonMagazine", " Skydragon",
    " Adinida", " Mechdragon", " iHUD", " PsyNetMessage", " strutConnector", " srfN", " largeDownload", " InstoreAndOnline",
    " BuyableInstoreAndOnline", " Mechdragon", " quickShip", " quickShipAvailable", " oreAndOnline", " petertodd", " disclaim", " inentional",
    " reportedlydeclared",
]
KINDS = ("Basic_Emoji", "RGI_Emoji_Flag_Sequence", "RGI_Emoji_Modifier_Sequence", "RGI_Emoji_Tag_Sequence", "Emoji_Keycap_Sequence")


def contains_glitch_token(c: Column | str) -> Column:
    t = _text(c)
    return F.exists(F.array(*map(F.lit, dict.fromkeys(GLITCH_TOKENS))), lambda x: F.contains(t, x))


# ---- emoji (UTS #51)


def is_registered(c: Column | str, kind: str) -> Column:
    """Whether the whole text is a registered emoji or sequence of a kind (one of KINDS)."""
    return arrow(lambda s: s in ucd.emoji_sequences(kind), "boolean", "sequences")(_text(c))


def is_rgi_emoji(c: Column | str) -> Column:
    """Whether the whole text is recommended for general interchange, of any kind."""
    return arrow(lambda s: s in ucd.zwj_sequences() or any(s in ucd.emoji_sequences(k) for k in KINDS), "boolean", "sequences", "zwj")(_text(c))


@ucd.derived
def presentation_bases(selector: int) -> frozenset[int]:
    """Bases of the registered emoji variation sequences with U+FE0E or U+FE0F: of emoji-variation-sequences.txt
    in the data folder, or else the keycap bases and the emoji that U+FE0F turns from text."""
    if rows := ucd.data_lines("emoji-variation-sequences.txt"):
        return frozenset(int(b, 16) for r in rows for b, vs in [r[0].split()] if int(vs, 16) == selector)
    return frozenset(ord(x[0]) for x in ucd.emoji_sequences("Basic_Emoji") if x.endswith("️")) | frozenset(map(ord, "0123456789#*"))


def unregistered_bases(c: Column | str, selector: int) -> Column:
    """Positions of the characters before a selector (U+FE0E or U+FE0F) that aren't registered with it."""
    vs = f"\\x{{{selector:X}}}"
    rest = F.regexp_replace(_text(c), f"{ucd.quick_class(presentation_bases(selector))}{vs}", "xx")
    return F.filter(F.transform(F.split(rest, ""), lambda x, i: F.when((x == chr(selector)) & (i > 0), i - 1)), lambda x: x.isNotNull())


# ---- variation selector payloads


def selector_bytes(c: Column | str) -> Column:
    """The bytes that variation selectors spell: VS1 to VS256 are 0 to 255, two are a byte, the first shifted by
    four bits; a last one without a pair is left out, and so are Mongolian selectors."""
    found = F.regexp_extract_all(_text(c), F.lit(r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"), F.lit(0))
    value = F.transform(found, lambda x: F.when(F.ascii(x) < 0xE0100, F.ascii(x) - 0xFE00).otherwise(F.ascii(x) - 0xE0100 + 16))
    pairs = F.transform(F.filter(value, lambda x, i: i % 2 == 1), lambda low, i: F.shiftleft(F.get(value, 2 * i), 4).bitwiseOR(low).bitwiseAND(F.lit(255)))
    return F.unhex(F.array_join(F.transform(pairs, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def executable_hint(b: Column | str) -> Column:
    """empty, binary, javascript, shell or ascii, by what bytes start with."""
    b = _text(b)
    t = F.decode(b, "ISO-8859-1")
    return (
        F.when(F.octet_length(b) == 0, "empty").when(t.rlike(r"[^\x20-\x7E\t\n\r]"), "binary")
        .when(t.rlike(r"\A(?:eval\(|Function\(|\(function|javascript:|atob\()"), "javascript").when(t.rlike(r"\A(?:sh -c |bash -c |curl |wget |/bin/sh)"), "shell").otherwise("ascii")
    )


# ---- orientation


@ucd.derived
def orientation_classes() -> dict[str, str]:
    """Vertical_Orientation (UAX #50) by value as patterns of one character: of VerticalOrientation.txt in the data
    folder or of the session's ICU. `upright` is U and Tu, `other` all but R."""
    cps: dict[str, list[int]] = {}
    if rows := ucd.data_lines("VerticalOrientation.txt"):
        for r in rows:
            cps.setdefault(r[1], []).extend(ucd._range(r[0]))
    elif ucd.icu() is None:
        raise LookupError("vertical orientation needs a data folder or a session")
    else:
        cps = {k: [c for a, b in ucd._icu_set(f"[:Vertical_Orientation={k}:]")[0] for c in range(a, b + 1)] for k in ("U", "Tr", "Tu")}
    sets = {k: cps[k] for k in ("U", "Tr", "Tu")} | {"upright": cps["U"] + cps["Tu"], "other": cps["U"] + cps["Tu"] + cps["Tr"]}
    return {k: ucd.quick_class(v) for k, v in sets.items()}


def orientations(c: Column | str) -> Column:
    """Each character's Vertical_Orientation: U, R, Tu or Tr. One test finds the texts that are R throughout."""
    t, k = _text(c), orientation_classes()
    each = F.transform(F.filter(F.split(t, ""), lambda x: x != ""), lambda x: F.when(~x.rlike(k["other"]), "R").when(x.rlike(k["U"]), "U").when(x.rlike(k["Tr"]), "Tr").otherwise("Tu"))
    return F.when(t.rlike(k["other"]), each).when(t.isNotNull(), F.array_repeat(F.lit("R"), F.char_length(t)))


def upright(c: Column | str) -> Column:
    """Whether each character stands upright in vertical text (others are rotated)."""
    return F.transform(orientations(c), lambda v: v.isin("U", "Tu"))


def rotated_count(c: Column | str) -> Column:
    """How many characters don't stand upright, in one pass over the text."""
    return F.char_length(F.regexp_replace(_text(c), orientation_classes()["upright"], ""))


def needs_substitution(c: Column | str) -> Column:
    """Positions of the characters that ask for a vertical glyph."""
    return F.filter(F.transform(orientations(c), lambda v, i: F.when(v.isin("Tu", "Tr"), i)), lambda x: x.isNotNull())


# ---- property names


def property_names(spark: SparkSession, values_of: str | None = None) -> DataFrame:
    """Names of the properties (ordinal, short, long), or of one property's values: a small dimension from the
    session's ICU, to be joined on a loose name."""
    lang = spark.sparkContext._jvm.com.ibm.icu.lang
    short, long = lang.UProperty.NameChoice.SHORT, lang.UProperty.NameChoice.LONG

    def name(f, *args) -> str | None:
        try:
            return f(*args)
        except IllegalArgumentException:  # a number that names nothing
            return None

    if values_of is None:
        ids = [*range(0, 128), *range(0x1000, 0x1040), 0x2000, 0x3000, *range(0x4000, 0x4010), 0x7000]
        rows = [(i, name(lang.UCharacter.getPropertyName, i, short), name(lang.UCharacter.getPropertyName, i, long)) for i in ids]
    else:
        prop = lang.UCharacter.getPropertyEnum(values_of)
        top = lang.UCharacter.getIntPropertyMaxValue(prop)
        rows = [(i, name(lang.UCharacter.getPropertyValueName, prop, i, short), name(lang.UCharacter.getPropertyValueName, prop, i, long)) for i in range(top + 1)]
    return spark.createDataFrame([r for r in rows if r[1] or r[2]], "ordinal int, short string, long string")


# ---- Unihan


@ucd.derived
def unihan(field: str) -> dict[int, str]:
    """A field of the Unihan files in the data folder (Unihan_Variants.txt, Unihan_NumericValues.txt): value by code point."""
    out: dict[int, str] = {}
    for name in ("Unihan_Variants.txt", "Unihan_NumericValues.txt"):
        rows = ucd.data_lines(name)
        if rows is None:
            raise FileNotFoundError(f"the data folder has no {name}")
        for (line,) in (r for r in rows if len(r) == 1):
            cp, own, value = line.split("\t")
            if own == field:
                out[int(cp[2:], 16)] = value
    return out


def variants(c: Column | str, field: str) -> Column:
    """For each character its variants (kSimplifiedVariant, kTraditionalVariant, kSemanticVariant,
    kSpecializedSemanticVariant, kSpoofingVariant, kZVariant) as a text."""
    table = {chr(k): "".join(chr(int(x.split("<")[0][2:], 16)) for x in v.split()) for k, v in unihan(field).items()}
    return arrow(lambda s: [table.get(x, "") for x in s], "array<string>")(_text(c))


def ideograph_numbers(c: Column | str, field: str | None = None) -> Column:
    """For each character its number: of a field (kPrimaryNumeric, kAccountingNumeric, kOtherNumeric), or, without
    one, the number that the character database gives it."""
    table = {chr(k): float(v.split()[0]) for k, v in unihan(field).items()} if field else None
    return arrow(lambda s: [table.get(x) if table is not None else ud.numeric(x, None) for x in s], "array<double>")(_text(c))


# ---- decompositions of single characters


def compatibility_tag(c: Column | str) -> Column:
    """The tag of each character's compatibility mapping (`font`, `wide`, ...); null without one."""
    return arrow(lambda s: [d[1 : d.index(">")] if (d := ud.decomposition(x)).startswith("<") else None for x in s], "array<string>")(_text(c))


def canonical_mapping(c: Column | str) -> Column:
    """Each character's canonical mapping, one step; null without one."""
    return arrow(lambda s: ["".join(chr(int(y, 16)) for y in d.split()) if (d := ud.decomposition(x)) and d[0] != "<" else None for x in s], "array<string>")(_text(c))


def primary_composite(a: Column | str, b: Column | str) -> Column:
    """The character that a starter and the one after it compose to; null if they don't."""
    return arrow(lambda x, y: t if y is not None and len(t := ud.normalize("NFC", x + y)) == 1 and ud.normalize("NFD", t) == ud.normalize("NFD", x + y) else None, "string")(_text(a), _text(b))


def excluded_from_composition(c: Column | str) -> Column:
    """Whether each character is a Full_Composition_Exclusion: it has a canonical mapping and NFC takes it apart."""
    return arrow(lambda s: [bool(d := ud.decomposition(x)) and d[0] != "<" and ud.normalize("NFC", x) != x for x in s], "array<boolean>")(_text(c))
