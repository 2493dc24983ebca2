"""Operator 5, secret scans: fixed patterns, and a guess-cost search over credential contexts.

The base patterns find assignments, access keys and long hex runs. The method looks at what stands
after a credential word and `:`, `=` or `=>`, and finds the cheapest way to guess it: a dynamic
program over segmentations into words, dates, years, repeats, keyboard walks, sequences and brute-force
spans, in powers of ten. Words come from a ranked dictionary, whose file is a parameter. Values over the limit are secrets; base spans stay whatever they cost.

Regex prefilters run on Arrow columns, so only texts with a candidate reach Python's matcher.

Defined cases: a null or empty text has no span; spans of one text may overlap across kinds;
repeated rows are scanned one by one; extra columns are ignored (scan) or kept (redact). The search takes
time linear in a value's length and the memory of a few characters beside the text itself.
"""

from __future__ import annotations

import base64
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Credential words with wider spelling, and a value up to a space, quote, comma, semicolon or bracket.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|(?:api|access|private|client)[ _-]?(?:key|secret|token)|bearer)["']?\x20*(?:=>|[:=])\x20*["']?([^\s"',;<>(){}\[\]]{6,})""", re.I | re.A)
PREFILTER = (
    r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    r"AKIA[A-Z0-9]{16}",
    r"[0-9a-f]{24}",
    r"""(?i)(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|(?:api|access|private|client)[ _-]?(?:key|secret|token)|bearer)["']?\x20*(?:=>|[:=])""",
)
#: A value that takes at least ten to this power guesses is a secret.
LIMIT = 8.0
#: Words that people use in passwords, commonest first; they come before those of a dictionary.
WORDS = (
    "password qwerty letmein welcome monkey dragon master admin login princess sunshine football iloveyou baseball shadow superman "
    "michael trustno secret summer winter spring autumn hello freedom whatever ninja mustang access batman passw0rd root user guest test "
    "changeme default example love god pass money happy angel orange purple flower cookie pepper ginger tiger cheese computer internet "
    "server system manager office company home family house dog cat blue red green black white star moon sun king queen"
).split()
#: The default dictionary: a public vocabulary's ranks, of which the pieces of 3 to 16 lower-case letters count.
DICTIONARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Rows of keys, the first three key by key below each other; a row's shift is its first key's place.
LAYOUTS = (
    ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"),
    ("^1234567890", "qwertzuiop", "asdfghjkl", "yxcvbnm,.-"),
    ("&1234567890", "azertyuiop", "qsdfghjklm", "wxcvbn,;:!"),
)
SHIFTS = (0.0, 1.5, 1.75, 2.25)
_SHIFTED = str.maketrans("!@#$%^&*()_+{}|:<>?~", "1234567890-=[]\\;,./`")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?[01]?\d[-/.]?[0-3]?\d|[0-3]?\d[-/.]?[01]?\d[-/.]?(?:19|20)\d\d", re.A)
_YEAR = re.compile(r"(?:19|20)\d\d", re.A)
_LEET = str.maketrans("0134578@$!", "oleastbasi")
#: A segment's kind is one of six: word, date, repeat, walk, sequence, brute force.
_KIND = math.log10(6)
_DATES, _YEARS = math.log10(365 * 120 * 8), math.log10(120)
#: Units of a repeat have this many characters at most.
PERIODS = 8
#: Walks start at a key of a layout and take a direction out of about 4.6 at each turn.
_START, _TURN = math.log10(47 * len(LAYOUTS)), math.log10(4.6)
_SEQUENCE = math.log10(2 * 36)


@cache
def dictionary(path: str | None = DICTIONARY) -> dict[str, float]:
    """log10 of the guesses that each word takes: twice its rank."""
    words = list(WORDS)
    if path:
        with open(path, "rb") as f:
            ranks = sorted((int(r), base64.b64decode(w)) for w, r in map(bytes.split, f))
        words += [w for _, b in ranks if 3 <= len(w := b.decode("latin-1").strip(" ")) <= 16 and w.isascii() and w.isalpha() and w.islower()]
    out: dict[str, float] = {}
    for w in words:
        out.setdefault(w, math.log10(2 * (len(out) + 1)))
    return out


@cache
def _endings(path: str | None) -> frozenset[str]:
    return frozenset(w[-3:] for w in dictionary(path))


@cache
def steps(layout: int) -> dict[str, int]:
    """The direction, 1 to 6, from a key to each of its neighbours, by the two keys."""
    at = {k: (y, SHIFTS[y] + x) for y, row in enumerate(LAYOUTS[layout]) for x, k in enumerate(row)}
    out = {}
    for a, (y, x) in at.items():
        for b, (v, u) in at.items():
            if (y == v and abs(x - u) == 1) or (abs(y - v) == 1 and abs(x - u) < 1):
                out[a + b] = 2 * (v - y) + (1 if u > x else 2) + 2
    return out


def lowered(value: str) -> str:
    """Lower case, character by character."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(c if len(c.lower()) != 1 else c.lower() for c in value)


class _Run:
    """A stretch whose spans all cost a constant, a part that their start settles, and the logarithm of their
    length. An older start that is no dearer than a newer one at some end is so at all later ends, as
    logarithms flatten; so only starts that are cheaper than all older ones are kept."""

    __slots__ = ("starts",)

    def __init__(self) -> None:
        self.starts: list[tuple[int, float]] = []

    def least(self, end: int) -> float:
        if not self.starts:
            return math.inf
        kept, low = [], math.inf
        for i, b in self.starts:
            c = b + math.log10(end - i)
            if c < low:
                low = c
                kept.append((i, b))
        self.starts = kept
        return low


def guess_cost(value: str, limit: float = math.inf, path: str | None = DICTIONARY) -> float:
    """log10 of the guesses that the cheapest segmentation takes: the sum over its segments of log10 of the
    segment's guesses and of the number of kinds. Every span of these forms is offered:

    word      in the dictionary, in any case (0.3 more unless lower) or with digits and signs for letters (1 more)
    date      four-digit year, month and day in either order; or a year alone
    repeat    a unit of up to eight characters, twice or more (one character: three times), the last one perhaps
              in part: ten guesses for each character of the unit, times length / unit
    walk      three keys or more, each next to the one before, on one of three keyboards: a start, a direction
              for each turn, the length
    sequence  three characters or more, one code point up, or down, each
    brute     anything, at ten guesses a character

    The cost is exact below limit; once no way to go on is cheaper than limit, what the cheapest takes so far is
    returned. Memory is that of a few characters, whatever the value's length."""
    words, endings = dictionary(path), _endings(path)
    low, n = lowered(value), len(value)
    plain, keys = low.translate(_LEET), low.translate(_SHIFTED)
    longest = max(map(len, words), default=0)
    back = max(longest, 10, 2 * PERIODS)  # characters that a new span may reach back
    best, brute = deque([0.0], back + 1), math.inf  # best[-k] is the best that ends k - 1 characters ago
    repeats, same = [_Run() for _ in range(PERIODS)], [0] * PERIODS
    walks, sequences = [[_Run(), 0, 0, 0] for _ in LAYOUTS], {1: [_Run(), 0], -1: [_Run(), 0]}
    tables = [steps(k) for k in range(len(LAYOUTS))]
    for j in range(1, n + 1):
        # best[-k] is still about j - k here
        brute = min(brute, best[-1] + _KIND) + 1.0
        least = brute
        ends = low[max(0, j - 3) : j] in endings or plain[max(0, j - 3) : j] in endings
        for size in range(3, min(longest, j) + 1 if ends else 0):
            i = j - size
            cost = words.get(low[i:j], math.inf)
            if cost < math.inf and value[i:j] != low[i:j]:
                cost += 0.3
            cost = min(cost, words.get(plain[i:j], math.inf) + 1.0)
            if cost < math.inf:
                least = min(least, best[-size] + cost + _KIND)
        if value[j - 1].isdigit():
            for size in range(6, min(10, j) + 1):
                if _DATE.fullmatch(value, j - size, j):
                    least = min(least, best[-size] + _DATES + _KIND)
            if j >= 4 and _YEAR.fullmatch(value, j - 4, j):
                least = min(least, best[-4] + _YEARS + _KIND)
        open_ = math.inf  # the cheapest way to stand inside a run
        for p in range(1, PERIODS + 1):
            if j <= p or value[j - 1] != value[j - 1 - p]:
                if same[p - 1]:
                    same[p - 1], repeats[p - 1] = 0, _Run()
                continue
            same[p - 1] += 1
            size = max(2 * p, 3)
            if same[p - 1] + p >= size:
                repeats[p - 1].starts.append((j - size, best[-size]))
                open_ = min(open_, repeats[p - 1].least(j) + p - math.log10(p) + _KIND)
        if j > 1:
            pair = keys[j - 2 : j]
            for walk, table_ in zip(walks, tables, strict=True):
                way = table_.get(pair, 0)
                if not way:
                    walk[:] = [_Run(), 0, 0, 0]
                    continue
                run, last, length, turns = walk
                before = turns  # turns up to the step before this one
                turns += bool(last) and way != last
                length += 1
                if length >= 2:
                    run.starts.append((j - 3, best[-3] - _TURN * before))
                    open_ = min(open_, run.least(j) + _START + _TURN * (1 + turns) + _KIND)
                walk[:] = [run, way, length, turns]
            step = ord(low[j - 1]) - ord(low[j - 2])
            for way, state in sequences.items():
                if step != way:
                    state[:] = [_Run(), 0]
                    continue
                state[1] += 1
                if state[1] >= 2:
                    state[0].starts.append((j - 3, best[-3]))
                    open_ = min(open_, state[0].least(j) + _SEQUENCE + _KIND)
        least = min(least, open_)
        best.append(least)
        if brute >= limit and open_ >= limit and (so_far := min(brute, open_, *best)) >= limit:
            return so_far
    return best[-1]


def find_spans(text: str, limit: float = LIMIT, words: str | None = DICTIONARY) -> list[tuple[int, int, str]]:
    """start, end, kind of all spans, by start, then kind as in KINDS, then end."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found += [(*m.span(1), "guess") for m in CONTEXT.finditer(text) if guess_cost(m[1], limit, words) >= limit]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(texts: pa.Array) -> np.ndarray:
    """Whether a text can have a span."""
    hit = np.zeros(len(texts), bool)
    for pattern in PREFILTER:
        hit |= pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)
    return hit


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", limit: float = LIMIT, words: str | None = DICTIONARY) -> DataFrame:
    """id, spans: array of (start, end, kind), in code points, end exclusive."""
    d = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            spans: list[list] = [[]] * batch.num_rows
            for i in np.flatnonzero(candidates(batch.column(1))).tolist():
                spans[i] = [{"start": a, "end": b, "kind": k} for a, b, k in find_spans(batch.column(1)[i].as_py(), limit, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["__id", "spans"])

    kind = d.schema["__id"].dataType.simpleString()
    return d.mapInArrow(run, f"__id {kind}, spans array<struct<start: long, end: long, kind: string>>").withColumnRenamed("__id", id_col)


def redact(df: DataFrame, text: str = "text", mark: str = "[REDACTED]", length: str | None = "n_chars", limit: float = LIMIT, words: str | None = DICTIONARY) -> DataFrame:
    """df with each span of its text (overlapping ones as one) replaced by mark; the column length,
    where there is one, becomes the new text's code points in texts that changed."""
    names = df.columns
    at, count = names.index(text), names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(candidates(batch.column(at))).tolist()
            texts = {}
            for i in hit:
                t = batch.column(at)[i].as_py()
                if spans := find_spans(t, limit, words):
                    out, end = [], 0
                    for a, b, _ in sorted(spans):
                        if a >= end:
                            out += [t[end:a], mark]
                        end = max(end, b)
                    texts[i] = "".join([*out, t[end:]])
            if texts:
                cols, where = batch.columns, np.zeros(batch.num_rows, bool)
                where[list(texts)] = True
                new = [texts[i] for i in sorted(texts)]
                cols[at] = pc.replace_with_mask(cols[at], pa.array(where), pa.array(new, cols[at].type))
                if count is not None:
                    cols[count] = pc.replace_with_mask(cols[count], pa.array(where), pa.array([len(t) for t in new], cols[count].type))
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return df.mapInArrow(run, df.schema)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("spans", lambda s: s["kind"] != "guess"))
    return d.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
