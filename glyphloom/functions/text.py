"""Text forms as Columns: normalization, casing, skeletons, scripts, segments, codecs.

Built-in expressions are used where Spark has the semantics; the others are Arrow-batched functions
over Series, each guarded so that plain ASCII rows, which are the same in every form, never leave
the JVM: a guard passes null for them and the result falls back to the text itself.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Callable
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import ucd

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
HANGUL_BASE, L_BASE, V_BASE, T_BASE, V_COUNT, T_COUNT = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28
STREAM_SAFE_LIMIT = 30
#: Characters that a worker holds as Python objects, besides the text at hand.
HELD = 1 << 19


def vectorised(one: Callable, returns: str, *needs: str) -> Callable[..., Column]:
    """An Arrow function of one(value, ...); equal values near each other are computed once. A batch is taken
    apart value by value, and results go back to Arrow as they come: HELD bounds what is held of either. needs
    names the tables of ucd that it reads: they go to the workers with it."""
    kind = to_arrow_type(DataType.fromDDL(returns))
    state = ucd.snapshot(needs) if needs else None

    def run(first: pa.Array, *rest: pa.Array) -> pa.Array:
        if state:
            ucd.restore(state)
        known: dict = {}
        parts, out, held = [], [], 0
        for scalars in zip(first, *rest, strict=True):
            args = tuple(x.as_py() for x in scalars)
            if args[0] is None:
                out.append(None)
                continue
            if args not in known:
                known[args] = one(*args)
            out.append(known[args])
            held += sum(len(x) for x in args if isinstance(x, (str, bytes)))
            if held >= HELD:
                parts.append(pa.array(out, kind))
                known, out, held = {}, [], 0
        return pa.concat_arrays([*parts, pa.array(out, kind)])

    return F.arrow_udf(run, returns)


def arrow(one: Callable, returns: str, *needs: str) -> Callable[..., Column]:
    """A vectorised function of columns or their names."""
    udf = vectorised(one, returns, *needs)
    return lambda *cols: udf(*[F.col(c) if isinstance(c, str) else c for c in cols])


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ascii(c: Column | str) -> Column:
    return ~_text(c).rlike(r"[^\x00-\x7F]")


def unless_ascii(c: Column | str, f: Callable[[Column], Column], plain: Column | None = None) -> Column:
    """f of the texts that aren't ASCII; ASCII ones are as they are, or plain."""
    c = _text(c)
    return F.coalesce(f(F.when(~is_ascii(c), c)), c if plain is None else F.when(c.isNotNull(), plain))


def code_points(c: Column | str) -> Column:
    """array<int> of code points."""
    return F.transform(F.filter(F.split(_text(c), ""), lambda x: x != ""), lambda x: F.ascii(x))


def from_code_points(c: Column | str) -> Column:
    """The text of an array of scalar values."""
    return F.decode(F.unhex(F.array_join(F.transform(_text(c), lambda x: F.lpad(F.hex(x), 8, "0")), "")), "UTF-32")


# ---- normalization (UAX #15)


def normalize(c: Column | str, form: str = "NFC") -> Column:
    if form not in FORMS:
        raise ValueError(form)
    return unless_ascii(c, arrow(lambda s: ud.normalize(form, s), "string"))


def is_normalized(c: Column | str, form: str = "NFC") -> Column:
    return unless_ascii(c, arrow(lambda s: ud.is_normalized(form, s), "boolean"), F.lit(True))


def combining_classes(c: Column | str) -> Column:
    return arrow(lambda s: [ud.combining(x) for x in s], "array<int>")(_text(c))


def decompose_hangul(cp: Column) -> Column:
    """L, V and T of a precomposed syllable as an array of code points; null for others."""
    i = cp - HANGUL_BASE
    n = V_COUNT * T_COUNT
    parts = F.array(L_BASE + F.floor(i / n), V_BASE + F.floor((i % n) / T_COUNT), T_BASE + i % T_COUNT)
    return F.when((i >= 0) & (i < 19 * n), F.filter(parts, lambda x: x != T_BASE))


def compose_hangul(a: Column, b: Column) -> Column:
    """The syllable of L and V, or of LV and T; null for other pairs."""
    lv = (a >= L_BASE) & (a < L_BASE + 19) & (b >= V_BASE) & (b < V_BASE + V_COUNT)
    lvt = (a >= HANGUL_BASE) & (a < HANGUL_BASE + 19 * V_COUNT * T_COUNT) & ((a - HANGUL_BASE) % T_COUNT == 0) & (b > T_BASE) & (b < T_BASE + T_COUNT)
    return F.when(lv, HANGUL_BASE + ((a - L_BASE) * V_COUNT + (b - V_BASE)) * T_COUNT).when(lvt, a + b - T_BASE)


def _runs(s: str) -> list[tuple[int, int]]:
    out, start = [], None
    for i, x in enumerate(s + "a"):
        if ud.combining(x):
            start = i if start is None else start
        elif start is not None:
            out.append((start, i - start))
            start = None
    return out


def nonstarter_runs(c: Column | str) -> Column:
    """array of (start, length) of the runs of characters with a combining class."""
    return arrow(lambda s: [{"start": a, "length": n} for a, n in _runs(s)], "array<struct<start: int, length: int>>")(_text(c))


def is_stream_safe(c: Column | str) -> Column:
    return unless_ascii(c, arrow(lambda s: all(n <= STREAM_SAFE_LIMIT for _, n in _runs(ud.normalize("NFKD", s))), "boolean"), F.lit(True))


def to_stream_safe(c: Column | str) -> Column:
    """A grapheme joiner goes into every run of more than 30 non-starters (UAX #15 D4)."""

    def one(s: str) -> str:
        out, run = [], 0
        for x in s:
            d = ud.normalize("NFKD", x)
            lead = next((i for i, y in enumerate(d) if not ud.combining(y)), len(d))
            if run + lead > STREAM_SAFE_LIMIT:
                out.append("͏")
                run = 0
            tail = next((i for i, y in enumerate(reversed(d)) if not ud.combining(y)), len(d))
            run = run + len(d) if lead == len(d) else tail
            out.append(x)
        return "".join(out)

    return unless_ascii(c, arrow(one, "string"))


# ---- casing


def fold_case(c: Column | str) -> Column:
    """Full case folding (C and F)."""
    return F.coalesce(arrow(str.casefold, "string")(F.when(~is_ascii(c), _text(c))), F.lower(_text(c)))


def to_upper(c: Column | str) -> Column:
    return F.coalesce(arrow(str.upper, "string")(F.when(~is_ascii(c), _text(c))), F.upper(_text(c)))


def to_lower(c: Column | str, locale: str = "") -> Column:
    """Full lower case with final sigma; locale `tr` or `lt` adds its special casing."""
    plain = F.lower(_text(c)) if locale != "tr" else None
    f = arrow(lambda s: lower_in(s, locale), "string")
    return f(_text(c)) if plain is None else F.coalesce(f(F.when(~is_ascii(c), _text(c))), plain)


def lower_in(s: str, locale: str) -> str:
    if locale == "tr":
        s = regex.sub("I([\\p{M}--[̇]&&[^\\p{ccc=230}\\p{ccc=0}]]*)̇", "i\\1", s, flags=regex.V1)
        s = s.replace("İ", "i").replace("I", "ı")
    if locale == "lt":
        s = s.replace("Ì", "i̇̀").replace("Í", "i̇́").replace("Ĩ", "i̇̃")
        s = regex.sub("([IJĮ])(?=\\p{Mn}*[\\p{ccc=230}])", lambda m: m[1].lower() + "̇", s)
    return s.lower()


def to_title(c: Column | str) -> Column:
    """Title case at UAX #29 word starts."""

    def one(s: str) -> str:
        return "".join(w[:1].title() + w[1:].lower() for w in regex.split(r"(?w)\b", s, flags=regex.V1))

    return arrow(one, "string")(_text(c))


# ---- confusables (UTS #39)


def skeleton_of(s: str) -> str:
    table = ucd.confusables()
    s = ud.normalize("NFD", s).casefold()
    return ud.normalize("NFD", "".join(table.get(x, x) for x in s).casefold())


def settled_skeleton_of(s: str) -> str:
    for _ in range(32):
        t = skeleton_of(s)
        if t == s:
            break
        s = t
    return s


def letters_of(s: str) -> str:
    hidden = ucd.default_ignorable()
    return "".join(x for x in settled_skeleton_of(s) if not ud.combining(x) and ord(x) not in hidden)


def skeleton(c: Column | str) -> Column:
    return arrow(skeleton_of, "string", "confusables")(_text(c))


def settled_skeleton(c: Column | str) -> Column:
    """The skeleton taken until it stays the same."""
    return arrow(settled_skeleton_of, "string", "confusables")(_text(c))


def letter_skeleton(c: Column | str) -> Column:
    """The settled skeleton without marks and default ignorables."""
    return arrow(letters_of, "string", "confusables")(_text(c))


# ---- scripts and restriction levels (UTS #39)

LEVELS = ("ASCIIOnly", "SingleScript", "HighlyRestrictive", "ModeratelyRestrictive", "MinimallyRestrictive", "Unrestricted")
_CJK = ({"Latn", "Hani", "Hira", "Kana"}, {"Latn", "Hani", "Bopo"}, {"Latn", "Hani", "Hang"})


@cache
def _script_codes() -> dict[str, str]:
    names = regex._regex_core.PROPERTIES["SCRIPT"][1] if hasattr(regex, "_regex_core") else {}
    by_id: dict[int, list[str]] = {}
    for name, i in names.items():
        by_id.setdefault(i, []).append(name)
    return {n: next((x for x in v if len(x) == 4), v[0]).title() for v in by_id.values() for n in v}


@cache
def scripts_of(x: str) -> frozenset[str]:
    """Script_Extensions of a character as four-letter codes; none for Common and Inherited."""
    if x.isascii():
        return frozenset({"Latn"}) if x.isalpha() else frozenset()
    found = {c for c, one in _script_patterns().items() if one.match(x)}
    return frozenset(found - {"Zyyy", "Zinh", "Zzzz", "Qaai"})


@cache
def _script_patterns() -> dict[str, regex.Pattern]:
    codes = {c for c in _script_codes().values() if len(c) == 4}
    return {c: regex.compile(rf"\p{{scx={c}}}") for c in codes}


@cache
def _is_shared(x: str) -> bool:
    return bool(regex.match(r"[\p{sc=Zyyy}\p{sc=Zinh}]", x))


def script_sets(s: str) -> list[frozenset[str]]:
    """The scripts of each different character that isn't Common or Inherited."""
    return [scripts_of(x) for x in set(s) if not _is_shared(x)]


def level_of(s: str) -> str:
    if s.isascii():
        return LEVELS[0]
    sets = script_sets(s)
    if not sets or frozenset.intersection(*sets):  # of shared characters only: any script is its own
        return LEVELS[1]
    if covered_cjk(sets):
        return LEVELS[2]
    others = {tuple(sorted(x)) for x in sets if "Latn" not in x}
    if all(sets) and len(others) == 1 and not others & {("Cyrl",), ("Grek",)}:
        return LEVELS[3]
    return LEVELS[4] if all(ord(x) in ucd.allowed_identifier() for x in set(s)) else LEVELS[5]


def covered_cjk(sets: list[frozenset[str]]) -> bool:
    return any(all(x & c for x in sets) for c in _CJK)


def restriction_level(c: Column | str) -> Column:
    return unless_ascii(c, arrow(level_of, "string", "identifier"), F.lit(LEVELS[0]))


def script_union(c: Column | str) -> Column:
    return arrow(lambda s: sorted(frozenset().union(*script_sets(s))), "array<string>")(_text(c))


def has_mixed_numbers(c: Column | str) -> Column:
    """Decimal digits of more than one set."""
    return unless_ascii(c, arrow(lambda s: len({ord(x) - ud.decimal(x) for x in s if ud.category(x) == "Nd"}) > 1, "boolean"), F.lit(False))


def is_identifier(c: Column | str) -> Column:
    """UAX #31 default identifier (XID_Start or low line, then XID_Continue)."""
    return arrow(identifier, "boolean")(_text(c))


def identifier(s: str) -> bool:
    return bool(regex.fullmatch(r"[\p{XIDS}_]\p{XIDC}*", s))


def allowed(s: str) -> bool:
    return identifier(s) and all(ord(x) in ucd.allowed_identifier() for x in s)


def is_allowed_identifier(c: Column | str) -> Column:
    return arrow(allowed, "boolean", "identifier")(_text(c))


# ---- segmentation (UAX #29) and width


#: Latin letters and signs that no rule joins to each other, and those between two of them: graphemes by themselves,
#: one column wide or of ambiguous width.
PLAIN = "[\x20-\x7e\xa1-\xa8\xaa-\xac\xaf-\u02ff]"
_INNER = re.compile(f"(?<={PLAIN}){PLAIN}+(?={PLAIN})")


def graphemes(c: Column | str) -> Column:
    return arrow(lambda s: regex.findall(r"\X", s), "array<string>")(_text(c))


def grapheme_count(c: Column | str) -> Column:
    simple = F.char_length(F.replace(_text(c), F.lit("\r\n"), F.lit("\n")))

    def one(s: str) -> int:
        rest = _INNER.sub("", s)
        return len(s) - len(rest) + len(regex.findall(r"\X", rest))

    return F.coalesce(arrow(one, "int")(F.when(~is_ascii(c), _text(c))), simple)


def words(c: Column | str) -> Column:
    """The pieces between UAX #29 word boundaries."""
    return arrow(lambda s: [w for w in regex.split(r"(?w)\b", s, flags=regex.V1) if w], "array<string>")(_text(c))


def word_count(c: Column | str) -> Column:
    """How many pieces there are between word boundaries."""
    return arrow(lambda s: sum(map(bool, regex.split(r"(?w)\b", s, flags=regex.V1))), "int")(_text(c))


@cache
def character_width(x: str, ambiguous: int = 1) -> int:
    if ud.category(x) in ("Cc", "Mn", "Me") or x in "\u200c\u200d" or "\ufe00" <= x <= "\ufe0f":
        return 0
    return {"F": 2, "W": 2, "A": ambiguous}.get(ud.east_asian_width(x), 1)


_SHOWN = regex.compile(r"[\p{Emoji_Presentation}\p{Extended_Pictographic}\p{Regional_Indicator}\x{FE0F}]".replace(r"\x{FE0F}", "\ufe0f"))


def display_width(c: Column | str, ambiguous: int = 1, clusters: bool = True) -> Column:
    """Columns of a fixed-width terminal. Of graphemes: two for emoji, else the widest character; or, without
    clusters, the sum over characters. Characters of ambiguous width take one or two."""

    def one(s: str) -> int:
        if not clusters:
            return sum(character_width(x, ambiguous) for x in s)
        rest = _INNER.sub("", s)
        inner = len(s) - len(rest)
        if ambiguous != 1:
            inner = sum((n - rest.count(x)) * character_width(x, ambiguous) for x, n in Counter(s).items() if n > rest.count(x))
        seen = Counter(regex.findall(r"\X", rest))
        return inner + sum(n * (2 if _SHOWN.search(g) else max(character_width(x, ambiguous) for x in g)) for g, n in seen.items())

    plain = F.char_length(F.regexp_replace(_text(c), r"[\x00-\x1F\x7F]", ""))
    return F.coalesce(arrow(one, "int")(F.when(~is_ascii(c), _text(c))), plain)


# ---- bytes


def utf8_error(b: Column | str) -> Column:
    """offset and kind of the first ill-formed UTF-8 byte; null for valid bytes, which stay in the JVM."""
    b = _text(b)
    return arrow(first_error, "struct<offset: int, kind: string>")(F.when(~F.is_valid_utf8(b), b))


def first_error(data: bytes) -> dict | None:
    """Overlong and surrogate forms count from their first byte; a cut sequence is an error at the end."""
    need = low = at = value = 0
    for i, byte in enumerate(data):
        if not need:
            if byte < 0x80:
                continue
            if 0xC2 <= byte <= 0xDF:
                need, value, low = 1, byte & 31, 0x80
            elif 0xE0 <= byte <= 0xEF:
                need, value, low = 2, byte & 15, 0x800
            elif 0xF0 <= byte <= 0xF4:
                need, value, low = 3, byte & 7, 0x10000
            else:
                return {"offset": i, "kind": "InvalidStartByte"}
            at = i
        elif byte & 0xC0 != 0x80:
            return {"offset": i, "kind": "InvalidContinuation"}
        else:
            need, value = need - 1, value << 6 | byte & 63
            if not need:
                if value < low:
                    return {"offset": at, "kind": "Overlong"}
                if 0xD800 <= value <= 0xDFFF:
                    return {"offset": i, "kind": "Cesu8"}
                if value > 0x10FFFF:
                    return {"offset": i, "kind": "CodepointBeyondMax"}
    return {"offset": len(data), "kind": "Truncated"} if need else None


def bom(b: Column | str) -> Column:
    """Kind and length of a byte order mark, UTF-32 before UTF-16; null without one."""
    b = _text(b)
    marks = [("UTF-32BE", "0000FEFF"), ("UTF-32LE", "FFFE0000"), ("UTF-8", "EFBBBF"), ("UTF-16BE", "FEFF"), ("UTF-16LE", "FFFE")]
    out = None
    for kind, x in marks:
        hit, value = F.startswith(b, F.unhex(F.lit(x))), F.struct(F.lit(kind).alias("kind"), F.lit(len(x) // 2).alias("length"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def strip_bom(b: Column | str) -> Column:
    return F.substring(_text(b), F.coalesce(bom(b)["length"], F.lit(0)) + 1, F.octet_length(_text(b)))


def decode_strict(b: Column | str, encoding: Column | str) -> Column:
    """text, or error with the byte offset where decoding in the named encoding fails."""

    def one(data: bytes, name: str) -> dict:
        try:
            return {"text": data.decode(name), "offset": None, "error": None}
        except UnicodeDecodeError as e:
            kind = "TruncatedCodeUnit" if e.end == len(data) and "truncated" in e.reason else e.reason
            return {"text": None, "offset": e.start, "error": kind}

    return arrow(one, "struct<text: string, offset: int, error: string>")(_text(b), _text(encoding))


def encode_text(c: Column | str, encoding: str) -> Column:
    """UTF-8, UTF-16BE, UTF-16LE, UTF-32BE or UTF-32LE bytes."""
    c = _text(c)
    if encoding == "UTF-32BE":
        return F.encode(c, "UTF-32")
    if encoding == "UTF-32LE":  # no charset of Spark's: each code point's hex, its bytes turned round
        return F.unhex(F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "(..)(..)(..)(..)", "$4$3$2$1"))
    return F.encode(c, encoding)


def is_noncharacter(cp: Column) -> Column:
    return cp.between(0xFDD0, 0xFDEF) | (cp.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)


# ---- Punycode


def punycode_encode(c: Column | str) -> Column:
    return arrow(lambda s: s.encode("punycode").decode(), "string")(_text(c))


def punycode_decode(c: Column | str) -> Column:
    def one(s: str) -> str | None:
        try:
            return s.encode("ascii").decode("punycode")
        except (UnicodeError, ValueError, OverflowError):
            return None

    return arrow(one, "string")(_text(c))


# ---- order


def collated(c: Column | str, strength: str = "UNICODE") -> Column:
    """The text under ICU root collation, for sorting and grouping (`UNICODE`, `UNICODE_CI`, `UNICODE_AI`)."""
    return F.collate(_text(c), strength)
