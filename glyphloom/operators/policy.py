"""From verdicts to decisions: findings, reason codes, profiles, levels, actions, composites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .detectors import FAMILIES, LAYERS, _text, detect

# Severities, levels, profiles (level, cryptographic family, quarantine), modes, actions.
SEVERITY = {"clear": 0, "informational": 1, "hazard": 2, "compound": 3}
_RESTRICTIVE = [s for s in FAMILIES if LAYERS[s] != "K" and s != "noncharacter-control"]
_MODERATE_OUT = {"emoji-zwj-integrity", "rtl-injection", "renderer-divergence", "normalization-bomb"}
LEVELS = {
    "restrictive": _RESTRICTIVE,
    "moderate": [s for s in _RESTRICTIVE if s not in _MODERATE_OUT],
    "minimal": ["surrogate-reassembly", "bidi-control-balance", "stream-safe-violation"],
}
CONTEXTS = {"non-crypto": [], "bip39-mnemonic": ["bip39-canonical"], "hash-input": ["hash-input-stability"], "ai-attribution": ["ai-watermark-detectability"]}
PROFILES = {
    "gateway-header": ("restrictive", "non-crypto", False), "domain-name": ("restrictive", "non-crypto", False), "dns-label": ("restrictive", "non-crypto", False),
    "url": ("moderate", "non-crypto", False), "username": ("moderate", "non-crypto", True), "display-name": ("minimal", "non-crypto", True),
    "chat-message": ("minimal", "non-crypto", True), "source-code": ("restrictive", "non-crypto", False), "opaque-secret": ("minimal", "hash-input", False),
    "binary-blob": ("minimal", "non-crypto", False),
}
MODES = ("observe", "warn", "enforce", "strict")
ACTIONS = ("allow", "observe", "rewrite", "quarantine", "reject")
#: The families of the default scan; the others are asked for by name or by `all`.
DEFAULT_SCAN = [
    "tag-block-payload", "variation-selector-payload", "zero-width-payload", "bidi-control-balance", "noncharacter-control", "homoglyph-confusable",
    "mixed-script-admissibility", "emoji-zwj-integrity", "skin-tone-variation-forgery", "stream-safe-violation", "nfc-idempotence-witness",
]
FINDING = "struct<code: string, family: string, severity: int, positions: array<int>, sub_threat: string, detail: string>"


def rejection_set(profile: str) -> list[str]:
    """The families that decide under a profile. Control characters decide at every level."""
    level, context, _ = PROFILES[profile]
    return [*LEVELS[level], *CONTEXTS[context], "noncharacter-control"]


def reason_code(family: str, sub: Column) -> Column:
    # fixed value: the form of a reason code
    return F.concat(F.lit(f"unicode.security.{LAYERS[family]}.{family}."), F.coalesce(sub, F.lit("hazard")))


def finding(family: str, v: Column) -> Column:
    """The finding of a verdict; null for a clear one."""
    return F.when(
        v["kind"] != "clear",
        F.struct(
            reason_code(family, v["sub_threat"]).alias("code"), F.lit(family).alias("family"), F.when(v["kind"] == "compound", 3).otherwise(2).alias("severity"),
            v["positions"].alias("positions"), v["sub_threat"].alias("sub_threat"), F.lit(family).alias("detail"),
        ),
    )


def family_results(df: DataFrame, text: str, out: str = "results") -> DataFrame:
    """df with an array of all families' results in order: family, kind, sub_threat, positions."""
    d = detect(df, text, prefix="__v_")
    cols = {s: F.col("__v_" + s.replace("-", "_")) for s in FAMILIES}
    rows = F.array(*[F.struct(F.lit(s).alias("family"), v["kind"].alias("kind"), v["sub_threat"].alias("sub_threat"), v["positions"].alias("positions")) for s, v in cols.items()])
    return d.withColumn(out, rows).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def select_action(findings: Column, profile: str, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(mode)
    any_ = F.size(findings) > 0
    if mode in ("observe", "warn"):
        return F.when(any_, "observe").otherwise("allow")
    if mode == "strict":
        return F.when(any_, "reject").otherwise("allow")
    blocking = F.exists(findings, lambda f: f["family"].isin(*rejection_set(profile)))
    return F.when(blocking, "quarantine" if PROFILES[profile][2] else "reject").otherwise("allow")


def scan(df: DataFrame, text: str, profile: str = "chat-message", mode: str = "enforce", families: str | list[str] = "default", out: str = "verdict") -> DataFrame:
    """df with a verdict struct: action, profile, mode, findings. families: `default`, `all` or slugs."""
    chosen = {"default": DEFAULT_SCAN, "all": list(FAMILIES)}.get(families, families) if isinstance(families, str) else families
    d = detect(df, text, chosen, "__v_")
    found = F.filter(F.array(*[finding(s, F.col("__v_" + s.replace("-", "_"))) for s in chosen]), lambda f: f.isNotNull())
    d = d.withColumn("__f", found)
    v = F.struct(select_action(F.col("__f"), profile, mode).alias("action"), F.lit(profile).alias("profile"), F.lit(mode).alias("mode"), F.col("__f").alias("findings"))
    return d.withColumn(out, v).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def scan_bytes(df: DataFrame, data: str, encoding: Column | str = "UTF-8", profile: str = "chat-message", mode: str = "enforce", out: str = "verdict") -> DataFrame:
    """Decode strictly, then scan; bytes that don't decode have one finding and are rejected outside observe and warn.
    encoding: UTF-8, UTF-16BE, UTF-16LE, UTF-32BE, UTF-32LE or `bom`, by column or for all rows."""
    enc = F.lit(encoding) if isinstance(encoding, str) else encoding
    mark = T.bom(data)
    name = F.when(enc == "bom", F.coalesce(mark["kind"], F.lit("UTF-8"))).otherwise(enc)
    shift = F.when(enc == "bom", F.coalesce(mark["length"], F.lit(0))).otherwise(0)
    payload = F.when(enc == "bom", T.strip_bom(data)).otherwise(F.col(data))
    d = df.withColumn("__d", T.decode_strict(payload, name)).withColumn("__t", F.col("__d.text")).withColumn("__e", name).withColumn("__n", shift)
    d = scan(d, "__t", profile, mode, out="__verdict")
    utf8 = T.utf8_error(F.when(F.col("__e") == "UTF-8", payload))
    at = F.coalesce(utf8["offset"], F.col("__d.offset")) + F.col("__n")
    slug = F.concat(F.lit("malformed-"), F.lower(F.regexp_extract("__e", r"^UTF-\d+", 0)).alias("x"))
    sub = F.coalesce(utf8["kind"], F.regexp_replace(F.initcap("__d.error"), "[^A-Za-z]", ""))
    bad = F.struct(F.concat(F.lit("unicode.security.C."), slug, F.lit("."), sub).alias("code"), slug.alias("family"), F.lit(2).alias("severity"), F.array(at).cast("array<int>").alias("positions"), sub.alias("sub_threat"), slug.alias("detail"))
    act = "observe" if mode in ("observe", "warn") else "quarantine" if PROFILES[profile][2] and mode == "enforce" else "reject"
    broken = F.struct(F.lit(act).alias("action"), F.lit(profile).alias("profile"), F.lit(mode).alias("mode"), F.array(bad).alias("findings"))
    d = d.withColumn(out, F.when(F.col("__d.error").isNotNull(), broken).otherwise(F.col("__verdict")))
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def admits(v: Column) -> Column:
    return ~v["action"].isin("reject", "quarantine")


def admissible_at(text: Column | str, level: str, context: str = "non-crypto") -> Column:
    """No family of the level or the context fires: a row filter. Only those families are computed."""
    t = _text(text)
    return reduce(lambda a, b: a & b, [FAMILIES[s](t)["kind"] == "clear" for s in [*LEVELS[level], *CONTEXTS[context]]])


def compose(df: DataFrame, keys: list[str], v: str = "verdict") -> DataFrame:
    """One composite verdict for each group: the gravest severity and action, and how often each reason
    occurs (counted before they are gathered, so a group's rows don't meet in one value)."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col(f"{v}.action"))
    codes = df.select(*keys, rank.alias("rank"), F.explode_outer(F.col(f"{v}.findings")).alias("f"))
    by_code = codes.groupBy(*keys, "f.code").agg(F.count("f").alias("n"), F.max("f.severity").alias("severity"), F.max("rank").alias("rank"))
    return by_code.groupBy(*keys).agg(
        F.coalesce(F.max("severity"), F.lit(0)).alias("severity"), F.element_at(F.array(*map(F.lit, ACTIONS)), F.max("rank").cast("int")).alias("action"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("code", "n")))).alias("reasons"),
    )


def metrics(df: DataFrame, v: str = "verdict") -> DataFrame:
    """Counters: one row for each action and each reason code."""
    action = df.groupBy(F.lit("action").alias("metric"), F.col(f"{v}.action").alias("name")).count()
    codes = df.select(F.explode(f"{v}.findings.code").alias("name")).groupBy(F.lit("code").alias("metric"), "name").count()
    return action.unionByName(codes)


def hazard_rollup(df: DataFrame, v: str = "verdict") -> DataFrame:
    """Findings by layer, family and sub-threat, with subtotals (null: all)."""
    f = df.select(F.explode(f"{v}.findings").alias("f"))
    return f.select(F.split_part("f.code", F.lit("."), F.lit(3)).alias("layer"), "f.family", "f.sub_threat").rollup("layer", "family", "sub_threat").count()


def spans(text: Column | str, positions: Column) -> Column:
    """For code point positions of a text: start and end byte, line and column (from 1)."""
    t = _text(text)
    head = lambda p: F.substring(t, F.lit(1), p)

    def place(p: Column) -> Column:
        start = F.octet_length(head(p))
        return F.struct(
            p.alias("cp_offset"), start.cast("long").alias("start_byte"), (start + F.octet_length(F.substring(t, p + 1, F.lit(1)))).cast("long").alias("end_byte"),
            (F.regexp_count(head(p), F.lit("\n")) + 1).alias("line"), (F.char_length(F.substring_index(head(p), "\n", -1)) + 1).alias("column"),
        )

    return F.transform(positions, place)


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """The small tables: profiles, levels (level, family), families (ordinal, family, layer)."""
    if name == "profiles":
        rows, schema = [(p, *v) for p, v in PROFILES.items()], "profile string, level string, context string, quarantine boolean"
    elif name == "levels":
        rows, schema = [(lv, f) for lv, fs in LEVELS.items() for f in fs], "level string, family string"
    else:
        rows, schema = [(i, f, LAYERS[f]) for i, f in enumerate(FAMILIES)], "ordinal int, family string, layer string"
    return spark.createDataFrame(rows, schema)
