"""Regular expressions: named-group patterns brought to the Java dialect, and many groups from one match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x01"  # separates captured groups inside one replaced string

_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<(\w+)>|\(\?P=(\w+)\)|(\()(?!\?)|.", re.S)


def to_java(pattern: str, flags: str = "sU") -> tuple[str, dict[str, int]]:
    """Pattern with `(?P<name>…)` groups -> (Java pattern with numbered groups, name -> group number)."""
    re.compile(pattern)
    names: dict[str, int] = {}
    out, count = [], 0
    for m in _TOKEN.finditer(pattern):
        token = m.group(0)
        if m.group(1):
            count += 1
            names[m.group(1)] = count
            token = "("
        elif m.group(2):
            token = f"\\{names[m.group(2)]}"
        elif m.group(3):
            count += 1
        elif token == r"\Z":
            token = r"\z"
        elif token.startswith("[") and len(token) > 1:
            body = token[1:-1]
            token = "[" + re.sub(r"(?<!\\)(\[|&&)", r"\\\1", body) + "]"
        out.append(token)
    return (f"(?{flags})" if flags else "") + "".join(out), names


def group_count(java_pattern: str) -> int:
    return sum(1 for m in _TOKEN.finditer(java_pattern) if m.group(3))


def capture(col: Column, pattern: str, groups: int | None = None) -> Column:
    """Every group of an anchored pattern (`^…$`) as an array, from a single match; NULL where it does not match.

    The groups travel in one replaced string cut at an unused control character. The rare line that holds that
    character itself is matched group by group instead.
    """
    n = group_count(pattern) if groups is None else groups
    joined = F.regexp_replace(col, pattern, "".join(f"{MARK}${i}" for i in range(1, n + 1)))
    fast = F.when(joined.startswith(MARK), F.slice(F.split(joined, MARK, -1), 2, n))
    slow = F.when(col.rlike(pattern), F.array(*[F.regexp_extract(col, pattern, i) for i in range(1, n + 1)]))
    return F.when(F.contains(col, F.lit(MARK)), slow).otherwise(fast)


def search(col: Column, pattern: str, groups: int | None = None) -> Column:
    """As `capture`, for a pattern that may match anywhere in the text (first match wins)."""
    n = group_count(pattern) if groups is None else groups
    m = re.match(r"\(\?[a-zA-Z]+\)", pattern)
    flags, body = (m.group(0), pattern[m.end():]) if m else ("(?s)", pattern)
    if "s" not in flags:
        flags = flags[:-1] + "s)"
    return capture(col, f"{flags}^.*?(?:{body}).*$", n)
