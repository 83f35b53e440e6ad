"""What a text must hold for a pattern to match in it: plain strings that are looked for before the pattern is tried.

Most patterns match in few texts.  Each has strings of which any match holds one;
looking for these in the lower-cased text is many times faster than the pattern,
which is then tried on the texts that hold one.
"""

from __future__ import annotations

from functools import cache, reduce
from re import _constants as c
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter strings than this tell too little.
LEAST = 2


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set whose shortest string is longer (beyond five characters it doesn't matter), then the smaller one."""
    if not a or not b:
        return a or b
    worth = lambda s: (min(5, min(map(len, s))), -len(s))
    return max(a, b, key=worth)


def _needed(items) -> frozenset[str] | None:
    """Strings of which a match of these items in a row holds one, null if nothing is sure."""
    best, run = None, ""
    for kind, value in [*items, (None, None)]:
        if kind is c.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if len(run) >= LEAST:
            best = _better(best, frozenset([run]))
        run, own = "", None
        if kind is c.SUBPATTERN:
            own = _needed(value[3])
        elif kind is c.BRANCH:
            ways = [_needed(way) for way in value[1]]
            own = frozenset().union(*ways) if all(ways) else None
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT) and value[0] > 0:
            own = _needed(value[2])
        best = _better(best, own)
    return best


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which any match of a pattern holds one; none if the pattern tells nothing."""
    found = _needed(_parser.parse(pattern)) or frozenset()
    return tuple(sorted(x for x in found if not any(y in x for y in found - {x})))


def may_match(low: Column, pattern: str) -> Column:
    """Whether a lower-cased text holds what a match of the pattern needs."""
    strings = needed(pattern)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in strings)) if strings else F.lit(True)


def has(text: Column, low: Column, pattern: str, flags: str = "") -> Column:
    """text.rlike(pattern), tried only where ``low``, the lower-cased text, may match."""
    return may_match(low, pattern) & text.rlike(flags + pattern)
