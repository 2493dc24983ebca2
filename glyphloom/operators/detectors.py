"""The twenty-seven hazard families as Columns: text in, verdict struct out.

A verdict is struct<kind, sub_threat, positions>: kind `clear` or `hazard`, the first sub-threat in the
family's order of priority, and 0-based code point positions. Families that character classes can
express are pure expressions; each starts with a class test, so that a row without a candidate costs
one regular expression scan and builds nothing. The rest are one Arrow-batched function each, which
gets null for the rows that the test clears. Null text gives a null verdict.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import ucd

VERDICT = "struct<kind: string, sub_threat: string, positions: array<int>>"
#: A noncharacter that marks places inside expressions; the text's own are put away first.
_MARK = "\U0010ffff"
FEW = 256
TAGS, VS, ZWJ = r"[\x{E0000}-\x{E007F}]", r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{180B}-\x{180D}]", "‍"
WIDE = r"[\x{FF01}-\x{FFEF}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
TONES = r"[\x{1F3FB}-\x{1F3FF}]"
# Names that impostors imitate, in order.
TARGETS = (
    "Nethereum ethereum ethers web3 bitcoin uniswap metamask binance coinbase solana react react-dom next vue angular lodash express electron "
    "typescript webpack node-fetch discord.js crypto-js django requests flask numpy pandas tensorflow pytorch matplotlib scipy beautifulsoup4 "
    "pyyaml cryptography serde tokio clap reqwest rand anyhow rails rspec devise nokogiri google amazon microsoft apple github gitlab bitbucket "
    "cloudflare stripe twilio paypal openai anthropic claude chatgpt tesla twitter facebook instagram tiktok telegram discord"
).split()
# Words and phrases that models favour, in order.
FAVOURED = [
    "delve", "delving", "tapestry", "intricate", "nuanced", "moreover", "furthermore", "realm", "elucidate", "showcasing", "underscores",
    "underscored", "pivotal", "bolster", "multifaceted", "testament", "foster", "holistic", "paradigm", "transformative", "spearhead",
    "meticulous", "meticulously", "empower", "empowering", "profound", "profoundly", "compelling", "comprehensive", "crucial", "daunting",
    "robust", "streamline", "enrich", "exemplify", "captivating", "discerning", "mesmerize", "intricately", "imbue", "plays a crucial role",
    "plays a pivotal role", "it is important to note", "it is worth noting", "in conclusion", "in essence", "delve into", "delving into",
    "tapestry of", "realm of",
]


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _none() -> Column:
    return F.array().cast("array<int>")


def verdict(t: Column, *cases: tuple[Column, str | Column | None, Column]) -> Column:
    """The first of (condition, sub-threat, positions) that holds, as a verdict; no sub-threat: clear."""
    clear = F.struct(F.lit("clear").alias("kind"), F.lit(None).cast("string").alias("sub_threat"), _none().alias("positions"))
    found = F.when(t.isNull(), F.lit(None))
    for when, sub, at in cases:
        hit = F.struct(F.lit("hazard").alias("kind"), (F.lit(sub) if isinstance(sub, str) else sub).alias("sub_threat"), at.cast("array<int>").alias("positions")) if sub is not None else clear
        found = found.when(when, hit)
    return found.otherwise(clear)


def first(t: Column, pattern: str) -> Column:
    """Position of a pattern's first match, given that there is one."""
    return F.char_length(F.regexp_replace(t, f"(?s)(?:{pattern}).*", ""))


def every(t: Column, pattern: str) -> Column:
    """Positions of the characters that match a class. Few are summed up from the lengths of what lies between;
    for many, each character is looked at, as an array that grows by one is copied each time."""
    zero = F.struct(F.lit(0).alias("at"), _none().alias("found"))

    def step(a: Column, part: Column) -> Column:
        at = a["at"] + F.char_length(part)
        return F.struct((at + 1).alias("at"), F.concat(a["found"], F.array(at)).alias("found"))

    few = lambda parts: F.aggregate(F.slice(parts, 1, F.size(parts) - 1), zero, step, lambda a: a["found"])
    many = F.filter(F.transform(F.split(t, ""), lambda c, i: F.when(c.rlike(pattern), i)), lambda x: x.isNotNull())
    return once(F.split(t, pattern, -1), lambda parts: F.when(F.size(parts) <= FEW, few(parts)).otherwise(many))


def marked(t: Column, pattern: str) -> Column:
    """Positions of the characters that match a one-character pattern with its surroundings."""
    return every(F.regexp_replace(F.replace(t, F.lit(_MARK), F.lit("x")), pattern, _MARK), _MARK)


def without(t: Column, pattern: str) -> Column:
    """The text with the one-character matches replaced by a plain letter, places kept."""
    return F.regexp_replace(t, pattern, "x")


def one(p: Column) -> Column:
    return F.array(p)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


# ---- covert channels


def tag_block_payload(c: Column | str) -> Column:
    t = _text(c)
    tags = F.regexp_replace(t, r"[^\x{E0000}-\x{E007F}]+", "")
    at, n = every(t, TAGS), F.char_length(tags)
    return verdict(
        t,
        (~t.rlike(TAGS), None, _none()),
        (tags.startswith("\U000e0001") & (n > 1), "LanguageTagRevival", at),
        ((n == F.char_length(t)) & tags.rlike(r"[\x{E0020}-\x{E007E}]"), "DirectAscii", at),
        (n < F.char_length(t), "MixedBlock", at),
        (F.lit(True), "BareTagPresent", at),
    )


def decoded_tags(c: Column | str) -> Column:
    """The ASCII text that tag characters spell."""
    return F.array_join(F.transform(F.regexp_extract_all(_text(c), F.lit(r"[\x{E0020}-\x{E007E}]"), F.lit(0)), lambda x: F.char(F.ascii(x) - 0xE0000)), "")


@ucd.derived
def _registered() -> str:
    # the selector is matched first, as it is rare; then what comes before it
    by_vs = "|".join(f"\\x{{{vs:X}}}(?<={ucd.quick_class(bases)}\\x{{{vs:X}}})" for vs, bases in sorted(ucd.standardized_pairs().items()))
    return f"[\\x{{FE0E}}\\x{{FE0F}}](?<={ucd.quick_class(ucd.members('Emoji'))}[\\x{{FE0E}}\\x{{FE0F}}])|{by_vs}"


def variation_selector_payload(c: Column | str) -> Column:
    t = _text(c)
    rest = without(t, _registered())
    vs = F.regexp_extract_all(rest, F.lit(VS), F.lit(0))
    at = every(rest, VS)
    bytes_ = F.regexp_count(rest, F.lit(r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"))
    found = verdict(
        t,
        (~rest.rlike(VS), None, _none()),
        (t.rlike(_registered()) & (first(t, _registered()) < first(rest, VS)), "EmbeddedAfterRegistered", at),
        ((F.size(vs) >= 4) & (F.size(F.array_distinct(vs)) == 1), "RepeatedBase", at),
        (bytes_ >= 2, "DirectPayload", at),
        (F.lit(True), "IllegalTarget", at),
    )
    return F.when(t.rlike(VS), found).otherwise(verdict(t))


@ucd.derived
def _zero_width(form: Callable = ucd.quick_class) -> str:
    away = {*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0xE0000, 0xE0080), *range(0x202A, 0x202F), *range(0x2066, 0x206A)}
    extra = {*range(0x200B, 0x2010), *range(0x2060, 0x2065), 0x202F, 0xFEFF, *range(0xFFF9, 0xFFFC)}
    return form((ucd.default_ignorable() - away) | extra)


@ucd.derived
def _zwj_in_emoji() -> str:
    letters = ucd.quick_class(ucd.zwj_alphabet())
    return f"{ZWJ}(?<={letters}{ZWJ})(?={letters})"


def zero_width_payload(c: Column | str) -> Column:
    t = _text(c)
    rest = without(t, _zwj_in_emoji())
    n = lambda x: F.regexp_count(t, F.lit(x))
    at = every(rest, _zero_width())
    found = verdict(
        t,
        (~rest.rlike(_zero_width()), None, _none()),
        ((n("￹") != n("￺")) | (n("￺") != n("￻")), "AnnotationMisuse", at),
        (t.contains("⁠"), "WordJoinerInjection", at),
        (n(" ") >= 2, "AIWatermarkNNBSP", at),
        (n("[​‍]") >= 2, "BinaryPayload", at),
        (F.lit(True), "BareZeroWidth", at),
    )
    return F.when(~T.is_ascii(t) & t.rlike(_zero_width()), found).otherwise(verdict(t))


def surrogate_reassembly(c: Column | str) -> Column:
    """Text whose code points all fit a byte is read as bytes; other text is clear."""
    t = _text(c)
    odd = t.rlike(r"\A[\x{00}-\x{FF}]*\z") & ~T.is_ascii(t)
    error = T.utf8_error(F.when(odd, F.encode(t, "ISO-8859-1")))
    return verdict(t, (error.isNotNull(), error["kind"], one(error["offset"])))


def surrogate_reassembly_bytes(b: Column | str) -> Column:
    error = T.utf8_error(_text(b))
    return verdict(_text(b), (error.isNotNull(), error["kind"], one(error["offset"])))


def bidi_control_balance(c: Column | str) -> Column:
    t = _text(c)
    signs = F.regexp_extract_all(t, F.lit(BIDI), F.lit(0))
    zero = F.struct(F.lit(0).alias("e"), F.lit(0).alias("s"), F.lit(0).alias("deep"), _none().alias("lost"))

    def step(a: Column, x: Column) -> Column:
        opens_e, opens_s = x["c"].isin(*ucd.EMBEDDINGS), x["c"].isin(*ucd.ISOLATES)
        pops_e, pops_s = x["c"] == ucd.POP_EMBEDDING, x["c"] == ucd.POP_ISOLATE
        e = a["e"] + F.when(opens_e, 1).when(pops_e & (a["e"] > 0), -1).otherwise(0)
        s = a["s"] + F.when(opens_s, 1).when(pops_s & (a["s"] > 0), -1).otherwise(0)
        lost = (pops_e & (a["e"] == 0)) | (pops_s & (a["s"] == 0))
        return F.struct(e.alias("e"), s.alias("s"), F.greatest(a["deep"], e + s).alias("deep"), F.when(lost, F.concat(a["lost"], F.array(x["i"]))).otherwise(a["lost"]).alias("lost"))

    def finish(a: Column, at: Column) -> Column:
        return F.when(a["deep"] > 125, F.struct(F.lit("DepthExceeded").alias("sub"), at.alias("at"))).when(F.size(a["lost"]) > 0, F.struct(F.lit("OrphanPop").alias("sub"), a["lost"].alias("at"))).when(
            a["e"] > 0, F.struct(F.lit("UnbalancedEmbedding").alias("sub"), at.alias("at"))).when(a["s"] > 0, F.struct(F.lit("UnbalancedIsolate").alias("sub"), at.alias("at")))

    def walk(at: Column) -> Column:
        marks = F.zip_with(signs, at, lambda x, i: F.struct(F.ascii(x).alias("c"), i.alias("i")))
        return F.aggregate(marks, zero, step, lambda a: finish(a, at))

    end = F.when(t.rlike(BIDI), once(every(t, BIDI), walk))
    return once(end, lambda x: verdict(t, (x.isNotNull(), x["sub"], x["at"])))


NONCHARACTERS = "[\\x{FDD0}-\\x{FDEF}" + "".join(f"\\x{{{p:X}FFFE}}\\x{{{p:X}FFFF}}" if p else "\\x{FFFE}\\x{FFFF}" for p in range(17)) + "]"
C0, C1 = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}]", r"[\x{80}-\x{9F}]"


def noncharacter_control(c: Column | str) -> Column:
    t = _text(c)
    # what most text is made of is turned away by one test
    any_ = f"(?![\\t\\n\\r -~\\x{{A0}}-\\x{{FDCF}}])(?:{NONCHARACTERS}|{C0}|{C1})"
    hit, at = F.regexp_extract(t, f"({any_})", 1), one(first(t, any_))
    return verdict(t, (~t.rlike(any_), None, _none()), (hit.rlike(C0), "C0Control", at), (hit.rlike(C1), "C1Control", at), (F.lit(True), "Noncharacter", at))


# ---- identity


@ucd.derived
def _target_letters() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in TARGETS:
        out.setdefault(T.letters_of(name), []).append(name)
    return out


def _hazard(sub: str, at: list[int]) -> dict:
    return {"kind": "hazard", "sub_threat": sub, "positions": at}


CLEAR = {"kind": "clear", "sub_threat": None, "positions": []}


def differs_at(a: str, b: str) -> int | None:
    """First place where two texts differ, or the shorter one's end; null if they are equal."""
    return None if a == b else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905


@ucd.derived
def _leaves_letters(x: str) -> bool:
    return bool(T.letters_of(x))


def homoglyph_of(s: str) -> dict:
    # a skeleton is no shorter than the characters that leave letters in it, so long texts need none
    longest, used = max(map(len, _target_letters())), set(s)
    short = len(s) <= longest or sum(s.count(x) for x in used if _leaves_letters(x)) <= longest
    if short and any(name != s for name in _target_letters().get(T.letters_of(s), ())):
        return _hazard("TargetMatch", [])
    for sub, lo, hi in (("MathAlpha", 0x1D400, 0x1D7FF), ("WidthClass", 0xFF01, 0xFFEF)):
        if found := [s.index(x) for x in used if lo <= ord(x) <= hi]:
            return _hazard(sub, [min(found)])
    nfc = ud.normalize("NFC", s)
    if nfc != s:
        return _hazard("DecompositionSwap", [next((i for i, (x, y) in enumerate(zip(s, nfc)) if x != y), 0)])  # noqa: B905
    level = T.level_of(s)
    if level not in T.LEVELS[1:3] and len(frozenset().union(*T.script_sets(s))) >= 2:
        return _hazard("CrossScriptMix", [])
    return _hazard("RestrictionLow", []) if level in T.LEVELS[4:] else CLEAR


def homoglyph_confusable(c: Column | str) -> Column:
    """Long ASCII text can't be a target's double, so only the rest is looked at."""
    t = _text(c)
    open_ = F.when(~T.is_ascii(t) | (F.char_length(t) <= 4 * max(map(len, TARGETS))), t)
    return F.coalesce(T.arrow(homoglyph_of, VERDICT, "confusables", "identifier")(open_), verdict(t))


def mixed_script_of(s: str) -> dict:
    outside = {x for x in set(s) if ord(x) not in ucd.allowed_identifier()}
    if outside:
        return _hazard("RestrictedStatusCp", [i for i, x in enumerate(s) if x in outside])
    # marks and signs that several scripts share are of none
    own = {x: T.scripts_of(x) for x in set(s) if not T._is_shared(x)}
    has = {k: [i for i, x in enumerate(s) if k in own.get(x, ())] for k in ("Latn", "Cyrl", "Grek")}
    for sub, k in (("LatinCyrillic", "Cyrl"), ("LatinGreek", "Grek")):
        if has["Latn"] and has[k]:
            return _hazard(sub, has[k])
    sets = T.script_sets(s)
    union = frozenset().union(*sets)
    single = not s.isascii() and sets and bool(frozenset.intersection(*sets))
    if len(union) >= 2 and not single and not T.covered_cjk(sets):
        return _hazard("ScriptMixOther", [])
    return _hazard("UnrestrictedLevel", []) if T.level_of(s) == "Unrestricted" else CLEAR


def mixed_script_admissibility(c: Column | str) -> Column:
    t = _text(c)
    ascii_outside = r"[\x{00}-\x{7F}&&[^A-Za-z0-9_'\-.:]]"
    plain = verdict(t, (t.rlike(ascii_outside), "RestrictedStatusCp", every(t, ascii_outside)))
    return F.coalesce(T.arrow(mixed_script_of, VERDICT, "identifier")(F.when(~T.is_ascii(t), t)), plain)


def _is_registered_zwj(t: Column) -> Column:
    # one literal, as a list of more than a thousand is slow to send to the JVM
    known = sorted(ucd.zwj_sequences())
    lines = F.lit("\n".join(["", *known, ""]))
    return t.contains(ZWJ) & (F.char_length(t) <= max(map(len, known))) & ~t.contains("\n") & F.contains(lines, F.concat(F.lit("\n"), t, F.lit("\n")))


def emoji_zwj_integrity(c: Column | str) -> Column:
    t = _text(c)
    others = ucd.quick_class(ucd.zwj_alphabet(), negate=True)
    alien = f"(?s){ZWJ}(?:(?<={others}{ZWJ})(?=.)|(?<=.{ZWJ})(?={others}))"
    tones = F.regexp_count(t, F.lit(TONES))
    found = verdict(
        t,
        ((~t.contains(ZWJ) & (tones <= 1)) | _is_registered_zwj(t), None, _none()),
        (t.contains(ZWJ + ZWJ), "DoubleZWJ", marked(t, f"{ZWJ}(?={ZWJ})")),
        (t.rlike(alien), "NonEmojiInjection", one(first(t, alien))),
        (F.char_length(t) > 16, "OverLength", _none()),
        (tones >= 5, "SkinToneOverflow", _none()),
        (t.contains(ZWJ), "UnregisteredSequence", every(t, ZWJ)),
    )
    return F.when(t.rlike(f"{ZWJ}|{TONES}"), found).otherwise(verdict(t))


def skin_tone_variation_forgery(c: Column | str) -> Column:
    t = _text(c)
    stacked, wrong = f"(?s).(?={TONES}{{2}})", f"{ucd.quick_class(ucd.members('Emoji_Modifier_Base'), negate=True)}(?={TONES})"
    forced = f"{ucd.quick_class(ucd.members('Emoji_Presentation'))}(?=\\x{{FE0E}})"
    at = first(t, stacked)
    found = verdict(
        t,
        (t.rlike(stacked), "StackedSkinTones", F.array(at + 1, at + 2)),
        (t.rlike(wrong), "InvalidSkinToneTarget", one(first(t, wrong) + 1)),
        (t.rlike(forced), "ForcedTextStyle", one(first(t, forced) + 1)),
    )
    return F.when(t.rlike(f"{TONES}|\\x{{FE0E}}"), found).otherwise(verdict(t))


# ---- display


def source_display_divergence(c: Column | str, parts: dict[str, Column] | None = None) -> Column:
    """Which of five families fire; parts takes their verdicts where they are at hand."""
    t = _text(c)
    named = {"tag-block-payload": "TagBlock", "variation-selector-payload": "VariationSelector", "zero-width-payload": "ZeroWidth", "bidi-control-balance": "BidiControl", "homoglyph-confusable": "IdentifierHomoglyph"}
    fired = {sub: (parts or {}).get(slug, FAMILIES[slug](t) if not parts else None)["kind"] == "hazard" for slug, sub in named.items()}
    n = sum(f.cast("int") for f in fired.values())
    return verdict(t, (n > 1, "Compound", _none()), *[(f, sub, _none()) for sub, f in fired.items()])


@ucd.derived
def _extend() -> str:
    return ucd.quick_class(ucd.members("GCB=Extend"))


def filename_disguise(c: Column | str) -> Column:
    t = _text(c)
    ext = F.when(t.contains("."), F.substring_index(t, ".", -1)).otherwise("")
    start = F.char_length(t) - F.char_length(ext)
    dots = F.char_length(t) - F.char_length(F.replace(t, F.lit("."), F.lit("")))
    return verdict(
        t,
        (t.rlike(BIDI), "RloFlip", one(first(t, BIDI))),
        (ext.rlike(WIDE), "WidthClassExt", one(start + first(ext, WIDE))),
        (ext.rlike(_extend()), "CombiningInExt", one(start + first(ext, _extend()))),
        (dots >= 3, "MultipleExtensions", every(t, r"\.")),
    )


@ucd.derived
def _strong() -> tuple[str, str]:
    return ucd.quick_class(ucd.with_bidi("R", "AL")), ucd.quick_class(ucd.with_bidi("L"))


def rtl_injection(c: Column | str) -> Column:
    t = _text(c)
    rtl, ltr = _strong()
    leads = F.regexp_extract(t, f"({ltr}|{rtl})", 1).rlike(rtl)
    longest = F.array_max(F.transform(F.regexp_extract_all(t, F.lit(f"{rtl}{{4,}}"), F.lit(0)), lambda x: F.char_length(x)))
    run = F.char_length(F.regexp_replace(t, F.concat(F.lit(f"(?s){rtl}{{"), longest.cast("string"), F.lit("}.*")), F.lit("")))
    found = verdict(
        t,
        (t.rlike(BIDI), "RloInLTRField", one(first(t, BIDI))),
        (leads, "FieldTakeover", one(first(t, rtl))),
        (longest.isNotNull(), "MixedOverflow", one(run)),
        (t.rlike(rtl), "StrongRTLInLTR", one(first(t, rtl))),
    )
    return F.when(~T.is_ascii(t) & t.rlike(f"{BIDI}|{rtl}"), found).otherwise(verdict(t))


def renderer_divergence(c: Column | str) -> Column:
    t = _text(c)
    rtl, ltr = _strong()
    # four marks first, as they are rare, then that another kind of character comes before them
    mark = ucd.java_class(ucd.members("GCB=Extend"))
    stack = f"{_extend()}{{4}}(?<=(?!{mark})[\\s\\S]{mark}{mark}{mark}{mark})"
    found = verdict(
        t,
        (t.rlike(stack), "CombiningStackOverflow", one(first(t, stack) - 1)),
        (t.rlike(VS), "VariationSelectorVariance", one(first(t, VS))),
        (t.contains(ZWJ) & ~_is_registered_zwj(t), "UnregisteredZwjVariance", one(first(t, ZWJ))),
        (t.rlike(WIDE), "FullwidthVariance", one(first(t, WIDE))),
        (t.rlike(rtl) & t.rlike(ltr), "MixedDirectionVariance", _none()),
    )
    return F.when(~T.is_ascii(t), found).otherwise(verdict(t))


# ---- form


def bomb_of(s: str) -> dict:
    big = {x for x in set(s) if len(ud.normalize("NFKD", x)) > 8}
    if big:
        return _hazard("SingleCpBlowup", [next(i for i, x in enumerate(s) if x in big)])
    if len(ud.normalize("NFKD", s)) * 100 // len(s) > 400:
        return _hazard("NfkdHighExpansion", [])
    return _hazard("NfdHighExpansion", []) if len(ud.normalize("NFD", s)) * 100 // len(s) > 300 else CLEAR


def normalization_bomb(c: Column | str) -> Column:
    return T.unless_ascii(c, T.arrow(bomb_of, VERDICT), verdict(_text(c)))


@ucd.derived
def _nonstarters(*keep: int) -> str:
    return ucd.quick_class(i for i in range(ucd.LAST + 1) if (k := ud.combining(chr(i))) and (not keep or k in keep) and not 0xD800 <= i <= 0xDFFF)


@ucd.derived
def _marks_between() -> str:
    return ucd.java_class(i for i in range(ucd.LAST + 1) if ud.combining(chr(i)) not in (0, 230) and not 0xD800 <= i <= 0xDFFF)


def stream_safe_violation(c: Column | str) -> Column:
    t, over = _text(c), f"{_nonstarters()}{{31,}}"
    return verdict(t, (t.rlike(over), "StreamSafeOverrun", one(first(t, over))))


def locale_case_inversion(c: Column | str) -> Column:
    t, between, above = _text(c), _marks_between(), _nonstarters(230)
    # the hit is the last character of a match: the dot above after an I, however far, else the I itself
    turkish = f"I(?:{between}*+\\x{{307}})?|\\x{{130}}"
    lithuanian = f"[IJ\\x{{12E}}](?={between}*{above})|[\\x{{CC}}\\x{{CD}}\\x{{128}}]"
    return verdict(t, (t.rlike(turkish), "TurkishCaseDivergence", one(first(t, turkish) + F.char_length(F.regexp_extract(t, f"({turkish})", 1)) - 1)), (t.rlike(lithuanian), "LithuanianCaseDivergence", one(first(t, lithuanian))))


@ucd.derived
def _expanding(upper: bool, form: Callable = ucd.quick_class) -> str:
    return form(i for i in range(ucd.LAST + 1) if len(chr(i).upper() if upper else chr(i).lower()) > 1)


def case_expansion_mismatch(c: Column | str) -> Column:
    t = _text(c)
    return verdict(t, *[(t.rlike(k), sub, one(first(t, k))) for k, sub in ((_expanding(True), "UpperExpansion"), (_expanding(False), "LowerExpansion"))])


@ucd.derived
def _width_folds(width: str, form: Callable = ucd.quick_class) -> str:
    eaw = ud.east_asian_width
    return form(i for i in range(ucd.LAST + 1) if not 0xD800 <= i <= 0xDFFF and eaw(chr(i)) == width and eaw(ud.normalize("NFKD", chr(i))[0]) != width)


def width_class_confusion(c: Column | str) -> Column:
    t = _text(c)
    return verdict(t, *[(t.rlike(k), sub, one(first(t, k))) for k, sub in ((_width_folds("F"), "FullwidthFold"), (_width_folds("H"), "HalfwidthFold"))])


def drift_of(s: str) -> dict:
    for form, sub in (("NFC", "NonNfcForm"), ("NFKC", "NonNfkcCompatForm")):
        if (at := differs_at(s, ud.normalize(form, s))) is not None:
            return _hazard(sub, [at])
    return CLEAR


def nfc_idempotence_witness(c: Column | str) -> Column:
    return T.unless_ascii(c, T.arrow(drift_of, VERDICT), verdict(_text(c)))


# ---- boundaries


@ucd.derived
def _status_shifts(form: Callable = ucd.quick_class) -> str:
    ok = ucd.allowed_identifier()
    return form(i for i in range(ucd.LAST + 1) if not 0xD800 <= i <= 0xDFFF and (i in ok) != (ord(ud.normalize("NFKD", chr(i))[0]) in ok))


def identifier_form_drift(c: Column | str) -> Column:
    t = _text(c)
    return verdict(t, (t.rlike(_status_shifts()), "IdentifierStatusShift", one(first(t, _status_shifts()))))


def covert_display_compound(c: Column | str) -> Column:
    t = _text(c)
    rest, at = without(t, _registered()), first(t, BIDI)
    found = verdict(t, (rest.rlike(VS), "BidiPlusUnregisteredVs", F.array(at, first(rest, VS))), (t.rlike(TAGS), "BidiPlusTagBlock", F.array(at, first(t, TAGS))))
    return F.when(t.rlike(BIDI), found).otherwise(verdict(t))


@ucd.derived
def _confusable(form: Callable = ucd.quick_class) -> str:
    return form(map(ord, ucd.confusables()))


def confusable_bidi_compound(c: Column | str) -> Column:
    t = _text(c)
    override, isolate = r"[\x{202A}-\x{202E}]", r"[\x{2066}-\x{2069}]"
    at = first(t, _confusable())
    found = verdict(t, (~t.rlike(_confusable()), None, _none()), (t.rlike(override), "ConfusableInOverride", F.array(at, first(t, override))), (t.rlike(isolate), "ConfusableInIsolate", F.array(at, first(t, isolate))))
    return F.when(t.rlike(BIDI), found).otherwise(verdict(t))


def admission_of(s: str) -> dict:
    return CLEAR if T.allowed(s) == T.allowed(ud.normalize("NFKC", s)) else _hazard("AdmissibilityFormDrift", [])


def admissibility_form_drift(c: Column | str) -> Column:
    return T.unless_ascii(c, T.arrow(admission_of, VERDICT, "identifier"), verdict(_text(c)))


# ---- cryptographic stability


def bip39_canonical(c: Column | str, known: Column | None = None) -> Column:
    """Mnemonic form. known is the array, in order, of the word lists' languages for each word of the
    canonical form (see plans.mnemonics); without it the words aren't looked up."""
    t = _text(c)
    space = "[\\x{20}\\x{3000}]"
    tail = F.regexp_extract(t, f"({space}*)\\z", 1)
    run = f"\\A{space}|{space}(?={space})"
    nfkd = T.unless_ascii(t, T.arrow(lambda s: differs_at(s, ud.normalize("NFKD", s)), "int"), F.lit(None).cast("int"))
    cases = [
        (tail != "", "TrailingWhitespace", one(F.char_length(t) - F.char_length(tail))),
        (t.rlike("[A-Z]"), "MixedCase", one(first(t, "[A-Z]"))),
        (t.rlike(run), "WhitespaceAnomaly", one(first(t, run))),
        (nfkd.isNotNull(), "NonNFKD", one(nfkd)),
    ]
    if known is not None:
        missing = F.array_position(F.transform(known, lambda x: F.size(x)), 0)
        common = F.aggregate(known, F.array().cast("array<string>"), lambda a, x: F.when(F.size(a) > 0, F.array_intersect(a, x)).otherwise(x))
        cases += [(missing > 0, "WordlistMismatch", one(missing - 1)), ((F.size(known) > 0) & (F.size(common) == 0), "LanguageAmbiguous", _none())]
    return verdict(t, *cases)


# What signed formats forbid, as a pattern whose match's place is the violation's.
RFC_RULES = {
    "pgp4880TrailingWhitespace": r"[ \t\n\r]+\z",
    "pgp9580LineEnding": r"(?<!\r)\n|\r(?!\n)",
    "rfc8259ControlChar": r"[\x00-\x1F]",
    "rfc7515JwsBase64Url": r"[^A-Za-z0-9_\-]",
    "rfc6376DkimRelaxed": r"(?<=[ \t])[ \t]",
    "rfc5751SmimeLineEnding": r"(?<!\r)\n|\r(?!\n)",
}


def rfc_violation(c: Column | str, rule: str) -> Column:
    t = _text(c)
    if rule == "rfc8785NfcRequirement":
        return first_non_nfc(t)
    return F.when(t.rlike(RFC_RULES[rule]), first(t, RFC_RULES[rule]))


def first_non_nfc(c: Column | str) -> Column:
    return T.unless_ascii(c, T.arrow(lambda s: differs_at(s, ud.normalize("NFC", s)), "int"), F.lit(None).cast("int"))


def first_difference(a: Column | str, b: Column | str) -> Column:
    """First code point at which two texts differ, or the shorter one's end; null if they are equal."""
    a, b = _text(a), _text(b)
    return F.when(a != b, T.arrow(differs_at, "int")(F.when(a != b, a), b))


def hash_input_stability(c: Column | str, encoding: Column | None = None, server: Column | None = None, written: Column | None = None, rule: str | None = None) -> Column:
    t, cases = _text(c), []
    if encoding is not None:
        cases.append((encoding.isNotNull() & ~F.lower(encoding).isin("utf-8", "utf8"), "EncodingMismatch", one(F.lit(0))))
    if server is not None:
        at = first_difference(t, server)
        cases.append((at.isNotNull(), "WebhookSignatureDrift", one(at)))
    if written is not None:
        at = first_difference(written, t)
        cases.append((at.isNotNull(), "AuditLogReinterpretation", one(at)))
    if rule is not None:
        at = rfc_violation(t, rule)
        cases.append((at.isNotNull(), "SignedMessageRule", one(at)))
    tail, nfc = r"[ \t\n\r]+\z", first_non_nfc(t)
    return verdict(t, *cases, (t.rlike(tail), "TrailingWhitespace", one(first(t, tail))), (nfc.isNotNull(), "NormalizationDrift", one(nfc)))


def hash_stable(c: Column | str) -> Column:
    return F.regexp_replace(T.normalize(c, "NFC"), r"[ \t\n\r]+\z", "")


def evenly_spaced(at: Column, tolerance: int = 0) -> Column:
    """Whether the gaps of a sorted array of places are all within tolerance of the first."""
    gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), at, lambda b, a: b - a)
    return F.coalesce(F.array_max(F.filter(gaps, lambda g: g.isNotNull())) - F.get(gaps, F.lit(0)) <= tolerance, F.lit(True)) & F.coalesce(F.get(gaps, F.lit(0)) - F.array_min(F.filter(gaps, lambda g: g.isNotNull())) <= tolerance, F.lit(True))


def ai_watermark_detectability(c: Column | str, tolerance: int = 0) -> Column:
    t = _text(c)
    emoji = ucd.quick_class(ucd.members("Emoji"))
    vs = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
    alone = lambda k: f"{k}(?<!{emoji}{k})(?!{emoji})"
    hidden = ucd.quick_class(ucd.default_ignorable() - {0x200D, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)})
    every_hidden = ucd.quick_class(ucd.default_ignorable() | {0x202F})
    n = lambda k: F.regexp_count(t, F.lit(k))
    nnbsp, zwsp, lone_vs, lone_zwj, rest = n(" "), n("​"), n(alone(vs)), n(alone(ZWJ)), n(hidden)
    kinds = sum((x > 0).cast("int") for x in (nnbsp, lone_vs, lone_zwj, rest))
    word = F.split(F.lit("\n".join(FAVOURED)), "\n")
    favoured = F.get(F.filter(word, lambda w: F.contains(t, w)), F.lit(0))
    visible = lambda hit: [
        (t.rlike("[‘’“”][^‘’“”]*[‘’“”]") & ~t.rlike("[\"']"), "SmartQuoteAlternation", every(t, "[‘’“”]")),
        (t.rlike("—[^—]*—") & ~t.contains("-"), "EmDashPattern", every(t, "—")),
        (hit.isNotNull(), "StatisticalTokenChoice", one(F.char_length(F.split_part(t, hit, F.lit(1))))),
    ]
    unseen = [
        ((nnbsp >= 3) & evenly_spaced(every(t, " "), tolerance), "Adversarial", every(t, " ")),
        ((zwsp >= 3) & evenly_spaced(every(t, "​"), tolerance), "Gpt5ZwspModulo", every(t, "​")),
        (kinds >= 2, "Unknown", every(t, every_hidden)),
        (nnbsp > 0, "NnbspBoundary", every(t, " ")),
        (lone_vs > 0, "VariationSelectorCarrier", marked(t, alone(vs))),
        (lone_zwj > 0, "ZwjNonEmoji", marked(t, alone(ZWJ))),
    ]
    full = lambda hit: verdict(t, *unseen, *visible(hit), (rest > 0, "DefaultIgnorableCarrier", every(t, hidden)))
    return once(favoured, lambda hit: F.when(~T.is_ascii(t) & t.rlike(every_hidden), full(hit)).otherwise(verdict(t, *visible(hit))))


FAMILIES: dict[str, Callable[..., Column]] = {
    "tag-block-payload": tag_block_payload, "variation-selector-payload": variation_selector_payload, "zero-width-payload": zero_width_payload,
    "surrogate-reassembly": surrogate_reassembly, "bidi-control-balance": bidi_control_balance, "noncharacter-control": noncharacter_control,
    "homoglyph-confusable": homoglyph_confusable, "mixed-script-admissibility": mixed_script_admissibility, "emoji-zwj-integrity": emoji_zwj_integrity,
    "skin-tone-variation-forgery": skin_tone_variation_forgery, "source-display-divergence": source_display_divergence, "filename-disguise": filename_disguise,
    "rtl-injection": rtl_injection, "renderer-divergence": renderer_divergence, "normalization-bomb": normalization_bomb,
    "stream-safe-violation": stream_safe_violation, "locale-case-inversion": locale_case_inversion, "case-expansion-mismatch": case_expansion_mismatch,
    "width-class-confusion": width_class_confusion, "nfc-idempotence-witness": nfc_idempotence_witness, "identifier-form-drift": identifier_form_drift,
    "covert-display-compound": covert_display_compound, "confusable-bidi-compound": confusable_bidi_compound, "admissibility-form-drift": admissibility_form_drift,
    "bip39-canonical": bip39_canonical, "hash-input-stability": hash_input_stability, "ai-watermark-detectability": ai_watermark_detectability,
}
LAYERS = dict(zip(FAMILIES, "CCCCCCIIIIDDDDFFFFFFXXXXKKK", strict=True))


def detect(df: DataFrame, text: str, families: list[str] | None = None, prefix: str = "v_") -> DataFrame:
    """df with a verdict column for each family, named prefix and the family's slug with low lines."""
    chosen = families or list(FAMILIES)
    cols = {s: FAMILIES[s](text) for s in chosen if s != "source-display-divergence"}
    # a column that isn't deterministic is computed once where it stands; otherwise the optimizer would
    # copy a verdict's expression to wherever one of its fields is used
    once = F.rand(0) >= 0 if df.isStreaming else F.monotonically_increasing_id() >= 0
    df = df.withColumns({prefix + s.replace("-", "_"): F.when(once, v) for s, v in cols.items()})
    if "source-display-divergence" in chosen:
        needed = ("tag-block-payload", "variation-selector-payload", "zero-width-payload", "bidi-control-balance", "homoglyph-confusable")
        parts = {s: F.col(prefix + s.replace("-", "_")) if s in cols else FAMILIES[s](text) for s in needed}
        df = df.withColumn(prefix + "source_display_divergence", F.when(once, source_display_divergence(text, parts)))
    return df
