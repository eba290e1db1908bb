"""Required literals: what a text must hold for a pattern to match at all, derived from the pattern itself.

Every pattern gives clauses; a match holds at least one literal of each clause. Literals are sought in the folded text
by plain substring search, and the pattern is tried only on texts that hold all its clauses, so a pattern is seldom
run where it does not match. Folding makes equal what a case-insensitive Unicode pattern takes as equal to an ASCII
letter. A pattern that says nothing about its literals (or that only Java can read) is tried on every text.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from re import _parser as syntax  # the standard library's reading of patterns: (operation, argument) pairs

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iU)"
#: The other characters that match an ASCII letter when case is ignored, and that letter.
FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
_JAVA_ONLY = re.compile(r"&&|\[[^\]]*\[")


def fold(text: Column) -> Column:
    """The text in which literals are sought."""
    return F.lower(F.translate(text, "".join(FOLDED), "".join(FOLDED.values())))


@cache
def clauses(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of lower-case literals, the most telling first; every match has one of each set."""
    if _JAVA_ONLY.search(pattern):
        return ()
    try:
        found = _clauses(syntax.parse(pattern))
    except re.error:
        return ()
    return tuple(sorted({tuple(sorted(c)) for c in found}, key=lambda c: (-min(map(len, c)), len(c), c)))


def _clauses(parsed) -> list[set[str]]:
    out, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        if name == "AT":  # takes no characters, so the run goes on
            continue
        if run:
            out.append({run})
            run = ""
        if name == "SUBPATTERN":
            out += _clauses(arg[3])
        elif name == "ATOMIC_GROUP":
            out += _clauses(arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            out += _clauses(arg[2])
        elif name == "BRANCH":
            ways = [_clauses(way) for way in arg[1]]
            if all(ways):
                out.append(set().union(*(max(way, key=lambda c: min(map(len, c))) for way in ways)))
        elif name == "IN" and all(str(kind) == "LITERAL" and value < 128 for kind, value in arg):
            out.append({chr(value).lower() for _, value in arg})
    return out


def may_match(folded: Column, pattern: str) -> Column:
    """Whether a folded text holds what the pattern requires."""
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (folded.contains(x) for x in clause)) for clause in clauses(pattern)), F.lit(True))


def matches(text: Column, folded: Column, pattern: str) -> Column:
    """text.rlike of the pattern without regard to case, run only where its literals are."""
    return F.when(may_match(folded, pattern), text.rlike(FLAGS + pattern)).otherwise(False)
