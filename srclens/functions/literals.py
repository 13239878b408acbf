"""Texts that every match of a pattern holds: they rule a pattern out before it is run."""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as op
from re import _parser

#: Shorter texts say too little.
SHORTEST = 2


def _best(options: list[frozenset[str]]) -> frozenset[str] | None:
    """Of several sets, one text of each of which is needed, the one whose shortest text is longest; of ties the smaller."""
    good = [o for o in options if o]
    return max(good, key=lambda o: (min(map(len, o)), -len(o))) if good else None


def _needed(parsed) -> frozenset[str] | None:
    options: list[frozenset[str]] = []
    run = ""
    for kind, value in [*parsed, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            options.append(frozenset([run]))
            run = ""
        if kind is op.SUBPATTERN:
            found = _needed(value[-1])
        elif kind is op.ATOMIC_GROUP:
            found = _needed(value)
        elif kind is op.BRANCH:
            each = [_needed(x) for x in value[1]]
            found = frozenset().union(*each) if all(each) else None
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            found = _needed(value[2])
        else:
            found = None
        if found:
            options.append(found)
    return _best(options)


@lru_cache(None)
def required(pattern: str) -> tuple[str, ...]:
    """Texts in lower case, one of which stands in whatever the pattern matches; none if nothing can be said.

    Letters whose lower and upper case are not one character each are left out, as engines fold them in different ways.
    """
    try:
        found = _needed(_parser.parse(pattern))
    except (re.error, RecursionError):  # a syntax of the other engine
        return ()
    if not found or min(map(len, found)) < SHORTEST or not all(x.isascii() for x in found):
        return ()
    return tuple(sorted(found))
