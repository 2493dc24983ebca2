"""Character properties, built by rule from the platform's Unicode data or read from tables.

No property table is stored here: classes come from `regex` and `unicodedata` by their property
names, derived sets by the formulas of the Unicode standard and annexes. Properties that have no
rule (identifier status, confusables, registered emoji sequences, IDNA mapping, variants) are tables
of one origin: the public UCD files of `use_data_dir`, else the ICU library of the session's JVM,
else (no session) the stated rules, with a warning. Functions that run in Python workers carry the
tables they need (`snapshot`), so a scan has one origin throughout.
"""

from __future__ import annotations

import os
import unicodedata as ud
import warnings
from collections.abc import Callable, Iterable
from functools import cache, wraps
from typing import Any

import regex

LAST = 0x10FFFF
_ALL = [chr(c) for c in range(LAST + 1) if not 0xD800 <= c <= 0xDFFF]
_JOINED = "".join(_ALL)
_data_dir: str | None = os.environ.get("GLYPHLOOM_UCD")
#: Tables by origin and name, and the origin that a worker was given.
_tables: dict[tuple[str, str], Any] = {}
_given: str | None = None
#: The tables' files in a data folder.
FILES = {
    "confusables": "confusables.txt", "identifier": "IdentifierStatus.txt", "zwj": "emoji-zwj-sequences.txt",
    "sequences": "emoji-sequences.txt", "variants": "StandardizedVariants.txt", "idna": "IdnaMappingTable.txt",
}

# The controls of the bidirectional algorithm.
EMBEDDINGS = (0x202A, 0x202B, 0x202D, 0x202E)
POP_EMBEDDING = 0x202C
ISOLATES = (0x2066, 0x2067, 0x2068)
POP_ISOLATE = 0x2069
# UAX #31 recommended scripts.
RECOMMENDED_SCRIPTS = (
    "Common Inherited Arabic Armenian Bengali Bopomofo Cyrillic Devanagari Ethiopic Georgian Greek Gujarati Gurmukhi Hangul Han "
    "Hebrew Hiragana Kannada Katakana Khmer Lao Latin Malayalam Myanmar Oriya Sinhala Tamil Telugu Thaana Thai Tibetan"
).split()
# UTS #39 characters allowed by inclusion rather than by script.
INCLUDED = "'-.:·͵֊׳״۽۾་‐’‧゠・"
# Letters that look like Latin ones, source then target.
LOOKALIKES = dict(zip(
    "аеорсухіјѕԁԛԝһӏАВЕКМНОРСТХЅІЈ"
    "αορνιυΑΒΕΖΗΙΚΜΝΟΡΤΥΧօոսհıɡɑɩǀ∣⁄∕‐‑‒–−",
    "aeopcyxijsdqwhlABEKMHOPCTXSIJ" "aopviuABEZHIKMNOPTYXonuhigailI//-----", strict=True,
))


def use_data_dir(path: str | None) -> None:
    """Take what has no rule from the UCD files in this folder (FILES); None goes back to the session's ICU.
    A table whose file the folder lacks is an error, not another origin's."""
    global _data_dir
    _data_dir = path
    _tables.clear()


def data_lines(name: str) -> list[list[str]] | None:
    """Fields of a UCD file's lines; None where there is no such file."""
    path = _data_dir and os.path.join(_data_dir, name)
    if not path or not os.path.exists(path):
        return None
    with open(path, encoding="utf-8-sig") as f:
        return [[x.strip() for x in line.split("#")[0].split(";")] for line in f if line.split("#")[0].strip()]


def required_lines(name: str) -> list[list[str]]:
    rows = data_lines(name)
    if rows is None:
        raise FileNotFoundError(f"{_data_dir} has no {name}")
    return rows


def icu() -> Any:
    """The ICU classes of the session's JVM; None without a session."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    return context._jvm.com.ibm.icu if context is not None and context._jvm is not None else None


def origin() -> str:
    """Where tables come from: `files:` and a folder, `icu`, or `rules`."""
    return _given or (f"files:{_data_dir}" if _data_dir else "icu" if icu() is not None else "rules")


def derived(f: Callable) -> Callable:
    """A function of tables, kept by arguments for each origin."""
    known: dict = {}

    @wraps(f)
    def run(*args):
        key = (origin(), *args)
        if key not in known:
            known[key] = f(*args)
        return known[key]

    return run


def table(name: str) -> Any:
    """A table of FILES by name."""
    at = origin()
    if (at, name) not in _tables:
        if _given:
            raise RuntimeError(f"this function runs in a worker without its table {name}")
        if at == "rules":
            warnings.warn(f"no Spark session and no data folder: a rule stands in for the table {name}", stacklevel=2)
        _tables[at, name] = _LOADERS[name](at.partition(":")[0])
    return _tables[at, name]


def snapshot(names: Iterable[str]) -> tuple[str, dict[str, Any]]:
    """The named tables and their origin, to be carried to workers."""
    return origin(), {n: table(n) for n in names}


def restore(state: tuple[str, dict[str, Any]]) -> None:
    """Take a snapshot's tables as this process's own. The driver has its tables already."""
    global _given
    if _given is None and icu() is not None:
        return
    at, tables = state
    if _given != at:
        _given = at
    for n, t in tables.items():
        _tables.setdefault((at, n), t)


def _icu_set(pattern: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Ranges and strings of one of ICU's sets."""
    found = icu().text.UnicodeSet(pattern)
    from pyspark import SparkContext

    texts = SparkContext._active_spark_context._jvm.java.lang.String.join("\n", found.strings())
    return [(found.getRangeStart(i), found.getRangeEnd(i)) for i in range(found.getRangeCount())], texts.split("\n") if texts else []


def _icu_map(convert: Callable[[str], str], mark: str) -> dict[str, str]:
    """What ICU turns each character into, for those that change. A mark that nothing turns into parts them."""
    out: dict[str, str] = {}
    for lo in range(0, len(_ALL), 100_000):
        part = [c for c in _ALL[lo : lo + 100_000] if c != mark]
        got = convert(mark.join(part)).split(mark)
        if len(got) != len(part):
            raise ValueError("the mark is not kept")
        out |= {c: x for c, x in zip(part, got, strict=True) if c != x}
    return out


def _text_of(codes: str) -> str:
    return "".join(chr(int(x, 16)) for x in codes.split())


def spans(cps: Iterable[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in cps:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


@cache
def members(prop: str) -> frozenset[int]:
    """Code points with a property as `regex` names it (`Emoji`, `GCB=Extend`, `scx=Latn`)."""
    found: set[int] = set()
    for m in regex.finditer(rf"\p{{{prop}}}+", _JOINED):
        found.update(map(ord, m[0]))
    return frozenset(found)


@cache
def with_bidi(*classes: str) -> frozenset[int]:
    return frozenset().union(*[_by_bidi().get(c, ()) for c in classes])


@cache
def _by_bidi() -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for c in range(LAST + 1):
        if not 0xD800 <= c <= 0xDFFF:
            out.setdefault(bidi_class(c), []).append(c)
    return out


def bidi_class(cp: int) -> str:
    """Bidi_Class, with the default of unassigned code points by block (UAX #9)."""
    if known := ud.bidirectional(chr(cp)):
        return known
    if 0x600 <= cp <= 0x7BF or 0x860 <= cp <= 0x8FF or 0xFB50 <= cp <= 0xFDCF or 0xFDF0 <= cp <= 0xFDFF or 0xFE70 <= cp <= 0xFEFF or 0x10D00 <= cp <= 0x10D3F or 0x10EC0 <= cp <= 0x10EFF or 0x10F30 <= cp <= 0x10F6F or 0x1EC70 <= cp <= 0x1ECBF or 0x1ED00 <= cp <= 0x1ED4F or 0x1EE00 <= cp <= 0x1EEFF:
        return "AL"
    if 0x590 <= cp <= 0x5FF or 0x7C0 <= cp <= 0x85F or 0xFB1D <= cp <= 0xFB4F or 0x10800 <= cp <= 0x10FFF or 0x1E800 <= cp <= 0x1EFFF:
        return "R"
    if 0x20A0 <= cp <= 0x20CF:
        return "ET"
    if cp & 0xFFFE == 0xFFFE or 0xFDD0 <= cp <= 0xFDEF or 0xE0000 <= cp <= 0xE0FFF:
        return "BN"
    return "L"


@cache
def default_ignorable() -> frozenset[int]:
    return members("Default_Ignorable_Code_Point")


def _range(text: str) -> range:
    a, _, b = text.partition("..")
    return range(int(a, 16), int(b or a, 16) + 1)


def _load_identifier(at: str) -> frozenset[int]:
    """UTS #39 Identifier_Status=Allowed; by rule, XID_Continue of recommended scripts that NFKC leaves
    alone, and the included characters."""
    if at == "files":
        return frozenset(c for r in required_lines(FILES["identifier"]) if r[1] == "Allowed" for c in _range(r[0]))
    if at == "icu":
        return frozenset(c for a, b in _icu_set("[:Identifier_Status=Allowed:]")[0] for c in range(a, b + 1))
    scripts = frozenset().union(*[members(f"sc={s}") for s in RECOMMENDED_SCRIPTS])
    return frozenset(c for c in members("XIDC") & scripts if ud.normalize("NFKC", chr(c)) == chr(c) and c not in default_ignorable()) | frozenset(map(ord, INCLUDED))


def _load_confusables(at: str) -> dict[str, str]:
    """UTS #39 prototypes (ICU's are of characters that have no canonical decomposition, as skeletons are
    taken after it); by rule, the compatibility form's letters and LOOKALIKES."""
    if at == "files":
        return {_text_of(r[0]): _text_of(r[1]) for r in required_lines(FILES["confusables"])}
    if at == "icu":
        checker = icu().text.SpoofChecker.Builder().build()
        return {c: x for c, x in _icu_map(checker.getSkeleton, "\n").items() if x and ud.normalize("NFD", c) == c}
    out = {}
    for c in _ALL[0x80:]:
        if c not in LOOKALIKES and ud.decomposition(c).startswith("<") and (t := ud.normalize("NFKD", c)) != c and all(ud.category(x)[0] in "LN" for x in t):
            out[c] = t
    return out | LOOKALIKES | {"β": "ß", "m": "rn", "0": "O", "1": "l", "I": "l", "|": "l", '"': "''", "`": "'", "%": "º/₀"}


def _load_zwj(at: str) -> frozenset[str]:
    """Registered emoji ZWJ sequences; by rule, the professions, genders and families."""
    if at == "files":
        return frozenset(_text_of(r[0]) for r in required_lines(FILES["zwj"]))
    if at == "icu":
        return frozenset(_icu_set("[:RGI_Emoji_ZWJ_Sequence:]")[1])
    tones = ["", *map(chr, range(0x1F3FB, 0x1F400))]
    people, jobs = "\U0001f468\U0001f469\U0001f9d1", "\U0001f33e\U0001f373\U0001f37c\U0001f393\U0001f3a4\U0001f3a8\U0001f3eb\U0001f3ed\U0001f4bb\U0001f4bc\U0001f527\U0001f52c\U0001f680\U0001f692\U0001f9af\U0001f9bc\U0001f9bd\U0001f9b0\U0001f9b1\U0001f9b2\U0001f9b3"
    acts = "⛹\U0001f3c3\U0001f3c4\U0001f3ca\U0001f3cb\U0001f3cc\U0001f46e\U0001f470\U0001f471\U0001f473\U0001f477\U0001f481\U0001f482\U0001f486\U0001f487\U0001f575\U0001f645\U0001f646\U0001f647\U0001f64b\U0001f64d\U0001f64e\U0001f6a3\U0001f6b4\U0001f6b5\U0001f6b6\U0001f926\U0001f935\U0001f937\U0001f938\U0001f939\U0001f93d\U0001f93e\U0001f9b8\U0001f9b9\U0001f9cd\U0001f9ce\U0001f9cf\U0001f9d4\U0001f9d6\U0001f9d7\U0001f9d8\U0001f9d9\U0001f9da\U0001f9db\U0001f9dc\U0001f9dd"
    j = "‍"
    out = {p + t + j + x for p in people for t in tones for x in [*jobs, "⚕️", "⚖️", "✈️"]}
    out |= {a + (t or ("️" if a in "⛹\U0001f3cb\U0001f3cc\U0001f575" else "")) + j + g + "️" for a in acts for t in tones for g in "♀♂"}
    kids = ["\U0001f466", "\U0001f467", "\U0001f466‍\U0001f466", "\U0001f467‍\U0001f466", "\U0001f467‍\U0001f467"]
    adults = ["\U0001f468", "\U0001f469", "\U0001f468‍\U0001f468", "\U0001f468‍\U0001f469", "\U0001f469‍\U0001f469"]
    out |= {a + j + k for a in adults for k in kids}
    out |= {a + j + "❤️" + j + kiss + b for a, b in ("\U0001f468\U0001f468", "\U0001f469\U0001f468", "\U0001f469\U0001f469") for kiss in ("", "\U0001f48b" + j)}
    out |= {"\U0001f3f3️‍\U0001f308", "\U0001f3f3️‍⚧️", "\U0001f3f4‍☠️", "\U0001f415‍\U0001f9ba", "\U0001f408‍⬛", "\U0001f43b‍❄️", "\U0001f441️‍\U0001f5e8️", "❤️‍\U0001f525", "❤️‍\U0001fa79"}
    return frozenset(out)


def _load_sequences(at: str) -> dict[str, frozenset[str]]:
    """Registered emoji sequences by kind: Basic_Emoji, RGI_Emoji_Flag_Sequence, RGI_Emoji_Modifier_Sequence,
    RGI_Emoji_Tag_Sequence, Emoji_Keycap_Sequence; by rule, all that have the kind's form."""
    out: dict[str, set[str]] = {k: set() for k in ("Basic_Emoji", "RGI_Emoji_Flag_Sequence", "RGI_Emoji_Modifier_Sequence", "RGI_Emoji_Tag_Sequence", "Emoji_Keycap_Sequence")}
    if at == "files":
        for r in required_lines(FILES["sequences"]):
            out.setdefault(r[1], set()).update([_text_of(r[0])] if " " in r[0] else map(chr, _range(r[0])))
    elif at == "icu":
        for k in out:
            ranges, texts = _icu_set(f"[:{k}:]")
            out[k] = {chr(c) for a, b in ranges for c in range(a, b + 1)} | set(texts)
    else:
        shown, letters = members("Emoji_Presentation"), [chr(0x1F1E6 + i) for i in range(26)]
        out["Basic_Emoji"] = {chr(c) if c in shown else chr(c) + "\ufe0f" for c in members("Emoji") - members("Emoji_Component")}
        out["RGI_Emoji_Flag_Sequence"] = {a + b for a in letters for b in letters}
        out["RGI_Emoji_Modifier_Sequence"] = {chr(c) + chr(t) for c in members("Emoji_Modifier_Base") for t in range(0x1F3FB, 0x1F400)}
        out["RGI_Emoji_Tag_Sequence"] = {"\U0001f3f4" + "".join(chr(0xE0000 + ord(x)) for x in k) + "\U000e007f" for k in ("gbeng", "gbsct", "gbwls")}
        out["Emoji_Keycap_Sequence"] = {x + "\ufe0f\u20e3" for x in "0123456789#*"}
    return {k: frozenset(v) for k, v in out.items()}


def _load_variants(at: str) -> dict[int, frozenset[int]]:
    """Bases of the standardized variation sequences by selector. ICU has none; the rule: the n-th compatibility
    ideograph of a unified one is its n-th variant; Mongolian letters take any selector."""
    if at == "files":
        found: dict[int, set[int]] = {}
        for r in required_lines(FILES["variants"]):
            base, vs = (int(x, 16) for x in r[0].split())
            found.setdefault(vs, set()).add(base)
        return {k: frozenset(v) for k, v in found.items()}
    out = {vs: set(range(0x1820, 0x1879)) | set(range(0x1880, 0x18AB)) for vs in (0x180B, 0x180C, 0x180D)}
    seen: dict[int, int] = {}
    for c in [*range(0xF900, 0xFADA), *range(0x2F800, 0x2FA1E)]:
        if d := ud.decomposition(chr(c)):
            base = int(d, 16)
            seen[base] = seen.get(base, 0) + 1
            out.setdefault(0xFDFF + seen[base], set()).add(base)
    out[0xFE00] |= set(map(ord, "0∅∩∪≨≩≲≳⊊⊋⊓⊔⊕⊗⊜⋚⋛⨼⨽⪝⪞⪬⪭⫋⫌、。，．！：；？"))
    out[0xFE01] |= set(map(ord, "、。，．！：；？"))
    return {k: frozenset(v) for k, v in out.items()}


def _load_idna(at: str) -> tuple[dict[str, str], list[tuple[int, int]]]:
    """UTS #46 without deviations: what characters are mapped to (ignored ones: nothing), and the ranges of
    disallowed ones; by rule, the folded compatibility form."""
    if at == "files":
        rows = required_lines(FILES["idna"])
        mapped = {chr(c): "" if r[1] == "ignored" else _text_of(r[2]) for r in rows if r[1] in ("mapped", "ignored", "disallowed_STD3_mapped") for c in _range(r[0])}
        return mapped, spans(c for r in rows if r[1] == "disallowed" for c in _range(r[0]))
    if at == "icu":
        kinds = icu().text.Normalizer2.Mode
        got = _icu_map(icu().text.Normalizer2.getInstance(None, "uts46", kinds.COMPOSE).normalize, "\x01")
        # a canonical composite that the table leaves alone comes back composed anew
        bad = [ord(c) for c, x in got.items() if x == "\ufffd"]
        return {c: x for c, x in got.items() if x != "\ufffd"}, spans(sorted([*bad, 0xFFFD]))
    mapped = {}
    for c in _ALL:
        x = "" if ord(c) in default_ignorable() else ud.normalize("NFKC", ud.normalize("NFKC", c).casefold())
        if x != c and c not in "ßς\u200c\u200d":
            mapped[c] = x
    return mapped, spans(c for c in range(0x80, LAST + 1) if ud.category(chr(c)) in ("Cn", "Co", "Cc", "Cs") and chr(c) not in mapped)


_LOADERS = {"identifier": _load_identifier, "confusables": _load_confusables, "zwj": _load_zwj, "sequences": _load_sequences, "variants": _load_variants, "idna": _load_idna}


def allowed_identifier() -> frozenset[int]:
    return table("identifier")


def confusables() -> dict[str, str]:
    return table("confusables")


def zwj_sequences() -> frozenset[str]:
    return table("zwj")


def emoji_sequences(kind: str) -> frozenset[str]:
    return table("sequences")[kind]


def standardized_pairs() -> dict[int, frozenset[int]]:
    return table("variants")


@derived
def zwj_alphabet() -> frozenset[int]:
    return frozenset(ord(c) for s in zwj_sequences() for c in s if c != "\u200d")


def java_class(cps: Iterable[int], negate: bool = False) -> str:
    """A java.util.regex character class of code points. Supplementary ones stand for themselves: only
    then does Java look behind by code points rather than by UTF-16 units."""
    return _ranges_class(spans(sorted(cps)), negate)


def _ranges_class(ranges: list[tuple[int, int]], negate: bool = False) -> str:
    name = lambda c: chr(c) if c > 0xFFFF else f"\\x{{{c:X}}}"
    body = "".join(name(a) + (f"-{name(b)}" if b > a else "") for a, b in ranges)
    return f"[{'^' if negate else ''}{body}]"


def quick_class(cps: Iterable[int], negate: bool = False) -> str:
    """A java.util.regex pattern for one character of a class of many ranges. A Java class tests its ranges
    in turn, so the ranges are parted by block, and a block's are tried only for characters in it."""
    every, parts = spans(sorted(cps)), []
    edges = (0, 0x80, 0x300, 0x590, 0x900, 0x1100, 0x2000, 0x2E80, 0xA000, 0xFB00, 0x10000, 0x1F000, 0xE0000, LAST + 1)
    for a, b in zip(edges, edges[1:]):  # noqa: B905
        if some := [(max(lo, a), min(hi, b - 1)) for lo, hi in every if lo < b and hi >= a]:
            parts.append(f"(?=[\\x{{{a:X}}}-\\x{{{b - 1:X}}}]){_ranges_class(some)}")
    # most text is below the first of them: one test turns its characters away
    body = f"(?:(?=[\\x{{{every[0][0]:X}}}-\\x{{{every[-1][1]:X}}}])(?:{'|'.join(parts)}))" if len(parts) > 1 or len(every) > 8 else _ranges_class(every)
    return f"(?:(?!{body})[\\s\\S])" if negate else body
