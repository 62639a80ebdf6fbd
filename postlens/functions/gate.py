"""Necessary literals of a pattern: a cheap test that spares most texts the pattern itself.

Any text that matches holds at least one of the literals, so `contains` on them, in lower case,
can stand before the pattern without changing a result.
"""

from __future__ import annotations

from functools import lru_cache
from re import _parser as parser  # the standard library's own pattern parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals shorter than this hardly filter; longer lists cost what they spare.
SHORTEST, MOST = 2, 48


def _weight(literals: frozenset[str] | None) -> tuple:
    if not literals:
        return (0, 0)
    return (min(map(len, literals)), -len(literals))


def _needed(items) -> frozenset[str] | None:
    """The best set of literals of which a match of this sequence holds one; None if there is none."""
    best: frozenset[str] | None = None
    runs: set[str] = {""}

    def settle() -> None:
        nonlocal best, runs
        found = frozenset(runs)
        if "" not in found and _weight(found) > _weight(best):
            best = found
        runs = {""}

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            c = chr(arg).lower()
            if ord(c) < 128:
                runs = {r + c for r in runs}
                continue
            settle()
        elif name == "IN" and len(arg) <= 3 and all(str(o) == "LITERAL" and a < 128 for o, a in arg):
            runs = {r + chr(a).lower() for r in runs for _, a in arg}
            if len(runs) > 16:
                settle()
        elif name == "AT":
            continue
        else:
            settle()
            inner = None
            if name == "SUBPATTERN":
                inner = _needed(arg[3])
            elif name == "BRANCH":
                parts = [_needed(x) for x in arg[1]]
                if all(parts):
                    inner = frozenset().union(*parts)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                inner = _needed(arg[2])
            if inner and _weight(inner) > _weight(best):
                best = inner
    settle()
    return best


@lru_cache(maxsize=None)
def literals(pattern: str) -> tuple[str, ...]:
    found = _needed(parser.parse(pattern.replace(r"\z", r"\Z")))
    if not found or min(map(len, found)) < SHORTEST:
        return ()
    kept = [x for x in found if not any(y != x and y in x for y in found)]
    return tuple(sorted(kept)) if len(kept) <= MOST else ()


def hit(text: Column, pattern: str, lower: Column | None = None) -> Column:
    """text rlike pattern, behind the gate where lower (text in lower case) is given."""
    found = text.rlike(pattern)
    needed = literals(pattern) if lower is not None else ()
    if not needed:
        return found
    gate = F.contains(lower, F.lit(needed[0]))
    for x in needed[1:]:
        gate = gate | F.contains(lower, F.lit(x))
    return F.when(gate, found).otherwise(False)


