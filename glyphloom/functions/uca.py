"""Sort keys of the Unicode Collation Algorithm (UTS #10) as binary Columns, which order by plain comparison.

Weights come from an allkeys.txt in `ucd.use_data_dir`; characters that it lacks, and all of them without it, get
implicit weights by code point, as the standard derives them for ideographs and unassigned ones. For the
root order without a file, `text.collated` uses the platform's.
"""

from __future__ import annotations

import os
import re
import unicodedata as ud
from functools import cache

from pyspark.sql import Column

from . import ucd
from .text import _text, arrow

_ELEMENT = re.compile(r"\[([.*])([0-9A-F]+)\.([0-9A-F]+)\.([0-9A-F]+)\]")
Element = tuple[int, int, int, bool]


@cache
def elements(path: str | None) -> tuple[dict[str, tuple[Element, ...]], int]:
    """Elements by character sequence, and the longest sequence."""
    table: dict[str, tuple[Element, ...]] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                head, _, tail = line.partition(";")
                if tail and not head.startswith(("#", "@")):
                    table["".join(chr(int(x, 16)) for x in head.split())] = tuple((int(p, 16), int(s, 16), int(t, 16), k == "*") for k, p, s, t in _ELEMENT.findall(tail))
    return table, max(map(len, table), default=1)


def implicit(cp: int) -> tuple[Element, ...]:
    """Two elements from the code point: core ideographs before others, before unassigned characters."""
    if cp in ucd.members("Unified_Ideograph"):
        base = 0xFB40 if 0x4E00 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF else 0xFB80
    else:
        base = 0xFBC0
    return ((base + (cp >> 15), 0x20, 2, False), (cp & 0x7FFF | 0x8000, 0, 0, False))


def elements_of(s: str, path: str | None) -> list[Element]:
    """Longest matches in the table, over unblocked marks too (S2.1)."""
    table, longest = elements(path)
    left, out = list(ud.normalize("NFD", s)), []
    while left:
        n = next((k for k in range(min(longest, len(left)), 0, -1) if "".join(left[:k]) in table), 0)
        if not n:
            out += implicit(ord(left.pop(0)))
            continue
        found, i, last = "".join(left[:n]), n, 0
        while i < len(left) and (k := ud.combining(left[i])):
            if last < k and found + left[i] in table:
                found += left.pop(i)
            else:
                last, i = k, i + 1
        out += table[found]
        del left[:n]
    return out


def sort_key(s: str, variable: str = "shifted", path: str | None = None) -> bytes:
    """`non-ignorable`: punctuation has its weights; `blanked`: it has none; `shifted`: they make a fourth level."""
    levels: list[list[int]] = [[], [], [], []]
    after_variable = False
    for p, second, third, is_variable in elements_of(s, path):
        fourth = 0xFFFF
        if variable != "non-ignorable":
            if is_variable or (after_variable and not p):
                fourth, p, second, third, after_variable = (p if is_variable else 0), 0, 0, 0, True
            else:
                after_variable = False
        for level, w in zip(levels, (p, second, third, fourth if variable == "shifted" else 0), strict=True):
            if w:
                level.append(w)
    return b"\0\0".join(b"".join(w.to_bytes(2) for w in level) for level in levels)


def collation_key(c: Column | str, variable: str = "shifted") -> Column:
    path = ucd._data_dir and os.path.join(ucd._data_dir, "allkeys.txt")
    return arrow(lambda s: sort_key(s, variable, path), "binary")(_text(c))
