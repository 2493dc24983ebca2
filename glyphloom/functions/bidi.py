"""The bidirectional algorithm (UAX #9) for one paragraph, as Columns.

`resolve` gives embedding levels, the visual order and the base level. Text without right-to-left
characters or controls is level 0 in order; the guard keeps it in the JVM.
"""

from __future__ import annotations

import unicodedata as ud
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ucd
from .text import _text, arrow

MAX_DEPTH = 125
RTL = ("R", "AL")
ISOLATES = ("LRI", "RLI", "FSI")
REMOVED = ("LRE", "RLE", "LRO", "RLO", "PDF", "BN")
NEUTRAL = ("B", "S", "WS", "ON", "LRI", "RLI", "FSI", "PDI")


@cache
def kind(x: str) -> str:
    return ucd.bidi_class(ord(x))


@cache
def bracket(x: str) -> tuple[str, str] | None:
    """`o` or `c` and the canonical pair of a bracket: mirrored opening and closing punctuation."""
    if ud.category(x) not in ("Ps", "Pe") or not ud.mirrored(x) or kind(x) != "ON":
        return None
    c = ud.normalize("NFD", x)
    return ("o", c) if ud.category(x) == "Ps" else ("c", c)


@cache
def closing(x: str) -> str | None:
    """The bracket that closes an opening one: the next one of its kind."""
    other = chr(ord(x) + (2 if x in "[{" else 1))
    return ud.normalize("NFD", other) if ud.category(other) == "Pe" else None


def matching(kinds: list[str]) -> dict[int, int]:
    """Isolate initiators and the pops that match them."""
    stack, pairs = [], {}
    for i, k in enumerate(kinds):
        if k in ISOLATES:
            stack.append(i)
        elif k == "PDI" and stack:
            pairs[stack.pop()] = i
    return pairs


def base_level(kinds: list[str], pairs: dict[int, int]) -> int:
    """P2, P3: the first strong character outside isolates decides."""
    i = 0
    while i < len(kinds):
        if kinds[i] in ("L", *RTL):
            return int(kinds[i] != "L")
        i = pairs.get(i, len(kinds)) if kinds[i] in ISOLATES else i + 1
    return 0


def explicit(kinds: list[str], base: int, pairs: dict[int, int]) -> tuple[list[int], list[str]]:
    """X1 to X8: levels by embeddings and isolates, and classes after overrides."""
    levels, out = [base] * len(kinds), list(kinds)
    stack: list[tuple[int, str | None, bool]] = [(base, None, False)]
    lost_isolates = lost_embeddings = open_isolates = 0
    matched = set(pairs.values())
    for i, k in enumerate(kinds):
        level, override, _ = stack[-1]
        if k in ("LRE", "RLE", "LRO", "RLO", *ISOLATES):
            isolate = k in ISOLATES
            if isolate:
                levels[i] = level
                if override:
                    out[i] = override
            if k == "FSI":
                end = pairs.get(i, len(kinds))
                inner = kinds[i + 1 : end]
                right = base_level(inner, matching(inner)) == 1
            else:
                right = k[0] == "R"
            deeper = (level + 1) | 1 if right else (level + 2) & ~1
            if deeper <= MAX_DEPTH and not lost_isolates and not lost_embeddings:
                open_isolates += isolate
                stack.append((deeper, {"LRO": "L", "RLO": "R"}.get(k), isolate))
            elif isolate:
                lost_isolates += 1
            elif not lost_isolates:
                lost_embeddings += 1
            if not isolate:
                levels[i] = level
        elif k == "PDI":
            if lost_isolates:
                lost_isolates -= 1
            elif i in matched and open_isolates:
                lost_embeddings = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                open_isolates -= 1
            levels[i] = stack[-1][0]
            if stack[-1][1]:
                out[i] = stack[-1][1]
        elif k == "PDF":
            levels[i] = level
            if lost_isolates:
                pass
            elif lost_embeddings:
                lost_embeddings -= 1
            elif not stack[-1][2] and len(stack) > 1:
                stack.pop()
        elif k == "B":
            levels[i] = base
        else:
            levels[i] = level
            if override and k != "BN":
                out[i] = override
    return levels, out


def sequences(kinds: list[str], levels: list[int], pairs: dict[int, int]) -> list[list[int]]:
    """X10: isolating run sequences, of the places that X9 leaves."""
    left = [i for i, k in enumerate(kinds) if k not in REMOVED]
    runs: list[list[int]] = []
    for i in left:
        if runs and levels[runs[-1][-1]] == levels[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    starts = {r[0]: r for r in runs}
    ends, out = set(pairs.values()), []
    for r in runs:
        if kinds[r[0]] == "PDI" and r[0] in ends:
            continue
        seq = list(r)
        while kinds[seq[-1]] in ISOLATES and pairs.get(seq[-1]) in starts:
            seq += starts[pairs[seq[-1]]]
        out.append(seq)
    return out


def weak_and_neutral(text: str, seq: list[int], classes: list[str], before: str, after: str, level: int) -> None:
    """W1 to W7 and N0 to N2 over one sequence; classes change in place."""
    c = [classes[i] for i in seq]
    n = len(c)
    original = list(c)
    for i in range(n):  # W1
        if c[i] == "NSM":
            prev = c[i - 1] if i else before
            c[i] = "ON" if prev in (*ISOLATES, "PDI") else prev
    strong = before
    for i in range(n):  # W2, W3 (the latter after all of W2 by keeping AL as it is until then)
        if c[i] in ("L", "R", "AL"):
            strong = c[i]
        elif c[i] == "EN" and strong == "AL":
            c[i] = "AN"
    c = ["R" if k == "AL" else k for k in c]
    for i in range(1, n - 1):  # W4
        if c[i] == "ES" and c[i - 1] == c[i + 1] == "EN" or c[i] == "CS" and c[i - 1] == c[i + 1] and c[i - 1] in ("EN", "AN"):
            c[i] = c[i - 1]
    i = 0
    while i < n:  # W5
        if c[i] == "ET":
            j = i
            while j < n and c[j] == "ET":
                j += 1
            if (i and c[i - 1] == "EN") or (j < n and c[j] == "EN"):
                c[i:j] = ["EN"] * (j - i)
            i = j
        else:
            i += 1
    c = ["ON" if k in ("ES", "ET", "CS") else k for k in c]  # W6
    strong = before
    for i in range(n):  # W7
        if c[i] in ("L", "R"):
            strong = c[i]
        elif c[i] == "EN" and strong == "L":
            c[i] = "L"
    own = "R" if level % 2 else "L"
    as_strong = lambda k: "R" if k in ("R", "EN", "AN") else k if k == "L" else None
    stack, found = [], []
    for i in range(n):  # N0
        b = bracket(text[seq[i]]) if c[i] == "ON" else None
        if not b:
            continue
        if b[0] == "o":
            if len(stack) == 63:
                break
            stack.append((i, closing(b[1])))
        else:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == b[1]), None)
            if at is not None:
                found.append((stack[at][0], i))
                del stack[at:]
    for a, b in sorted(found):
        inside = {as_strong(k) for k in c[a + 1 : b]} - {None}
        if own in inside:
            new = own
        elif inside:
            context = next((s for k in reversed(c[:a]) if (s := as_strong(k))), as_strong(before) or own)
            new = context if context != own else own
        else:
            continue
        for p in (a, b):
            c[p] = new
            q = p + 1
            while q < n and original[q] == "NSM":
                c[q] = new
                q += 1
    i = 0
    while i < n:  # N1, N2
        if c[i] in NEUTRAL:
            j = i
            while j < n and c[j] in NEUTRAL:
                j += 1
            lead = as_strong(c[i - 1]) if i else before
            trail = as_strong(c[j]) if j < n else after
            c[i:j] = [lead if lead == trail else own] * (j - i)
            i = j
        else:
            i += 1
    for place, k in zip(seq, c, strict=True):
        classes[place] = k


def levels_of(text: str, base: int | None = None) -> tuple[list[int], int]:
    """Each character's level after I2 and L1, and the paragraph's; characters that X9 removes take the
    level of what comes before them."""
    kinds = [kind(x) for x in text]
    pairs = matching(kinds)
    base = base_level(kinds, pairs) if base is None else base
    levels, classes = explicit(kinds, base, pairs)
    seqs = sequences(kinds, levels, pairs)
    left = [i for i, k in enumerate(kinds) if k not in REMOVED]
    at = {p: i for i, p in enumerate(left)}
    for seq in seqs:
        level, i, j = levels[seq[0]], at[seq[0]], at[seq[-1]]
        prev = levels[left[i - 1]] if i else base
        last_open = kinds[seq[-1]] in ISOLATES and seq[-1] not in pairs
        following = base if last_open or j + 1 == len(left) else levels[left[j + 1]]
        side = lambda a: "R" if a % 2 else "L"
        weak_and_neutral(text, seq, classes, side(max(level, prev)), side(max(level, following)), level)
    for i in left:
        k = classes[i]
        if levels[i] % 2 == 0:
            levels[i] += {"R": 1, "AN": 2, "EN": 2}.get(k, 0)
        else:
            levels[i] += int(k in ("L", "EN", "AN"))
    for i, k in enumerate(kinds):
        if k in REMOVED:
            levels[i] = levels[i - 1] if i else base
    trailing = True
    for i in range(len(kinds) - 1, -1, -1):  # L1
        if kinds[i] in ("B", "S"):
            levels[i], trailing = base, True
        elif kinds[i] in ("WS", *ISOLATES, "PDI", *REMOVED):
            if trailing:
                levels[i] = base
        else:
            trailing = False
    return levels, base


def visual_order(levels: list[int]) -> list[int]:
    """L2: places from left to right."""
    order = list(range(len(levels)))
    for level in range(max(levels, default=0), 0, -1):
        i = 0
        while i < len(order):
            if levels[order[i]] >= level:
                j = i
                while j < len(order) and levels[order[j]] >= level:
                    j += 1
                order[i:j] = order[i:j][::-1]
                i = j
            else:
                i += 1
    return order


def _shown(s: str, order: list[int]) -> str:
    return "".join(s[i] for i in order if kind(s[i]) not in REMOVED)


def _whole(s: str) -> dict:
    levels, base = levels_of(s)
    order = visual_order(levels)
    return {"base": base, "levels": levels, "order": order, "visual": _shown(s, order)}


@ucd.derived
def _odd() -> str:
    return ucd.quick_class(ucd.with_bidi("R", "AL", "AN", "RLE", "LRE", "RLO", "LRO", "PDF", "RLI", "LRI", "FSI", "PDI", "BN"))


def visual(c: Column | str) -> Column:
    """The text in visual order alone."""
    t = _text(c)
    return F.coalesce(arrow(lambda s: _shown(s, visual_order(levels_of(s)[0])), "string")(F.when(t.rlike(_odd()), t)), t)


def resolve(c: Column | str) -> Column:
    """struct of base level, levels, visual order of places, and the text in visual order."""
    t = _text(c)
    schema = "struct<base: int, levels: array<int>, order: array<int>, visual: string>"
    places = F.when(F.char_length(t) > 0, F.sequence(F.lit(0), F.char_length(t) - 1)).otherwise(F.array().cast("array<int>"))
    plain = F.struct(F.lit(0).alias("base"), F.transform(places, lambda x: F.lit(0)).alias("levels"), places.alias("order"), t.alias("visual"))
    return F.coalesce(arrow(_whole, schema)(F.when(t.rlike(_odd()), t)), F.when(t.isNotNull(), plain))
