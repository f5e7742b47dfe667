"""Boolean trigram queries derived from regular expressions.

Every match of a pattern contains certain literal strings. ``trigram_query`` walks the parsed
pattern, keeps the finite set of strings that the current stretch can spell, and turns each
finished stretch into "one of these strings", that is an OR of ANDs of trigrams. Stretches of
under three characters say nothing. The query is over lower-cased text, so that it also holds
for patterns that ignore case.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

#: More alternatives than this for one stretch are not worth spelling out.
MOST_STRINGS = 64

Query = list[frozenset[str]]  # OR of ANDs; an empty AND is always true


def _and(a: Query, b: Query) -> Query:
    return _absorb([x | y for x in a for y in b])


def _absorb(query: Query) -> Query:
    """Drop each AND that asks for all that another one asks for and more."""
    out: Query = []
    for x in sorted(set(query), key=lambda q: (len(q), sorted(q))):
        if not any(y <= x for y in out):
            out.append(x)
    return out


def _of_strings(strings: set[str]) -> Query:
    return _absorb([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


TRUE: Query = [frozenset()]


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < MOST_STRINGS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """The finite set of strings that the pattern can spell, or None, and what its matches need."""
    run: set[str] = {""}
    need, finite = TRUE, True

    def cut() -> None:
        nonlocal run, need, finite
        need, run, finite = _and(need, _of_strings(run)), {""}, False

    def add(strings: set[str] | None) -> None:
        nonlocal run
        if strings is None or len(strings) * len(run) > MOST_STRINGS:
            cut()
        else:
            run = {a + b for a in run for b in strings}

    for op, arg in parsed:
        if op is sre.LITERAL:
            add({chr(arg).lower()})
        elif op is sre.IN:
            add(_class(arg))
        elif op is sre.AT:
            continue
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[-1])
            if strings is None:
                cut()
                need = _and(need, inner)
            else:
                add(strings)
        elif op is sre.BRANCH:
            sides = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in sides) and sum(len(s) for s, _ in sides) <= MOST_STRINGS:
                add(set().union(*[s for s, _ in sides]))
            else:
                cut()
                either: Query = []
                for s, inner in sides:
                    either += inner if s is None else _of_strings(s)
                need = _and(need, _absorb(either))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = arg
            strings, inner = _walk(body)
            if strings is not None and most != sre.MAXREPEAT and most <= 1:
                add(strings | ({""} if least == 0 else set()))
            else:
                cut()
                if least:
                    need = _and(need, inner if strings is None else _of_strings(strings))
        else:
            cut()
    if finite and len(run) <= MOST_STRINGS:
        return run, need
    return None, _and(need, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """OR of ANDs of lower-case trigrams that any text with a match must satisfy; ``TRUE`` if none are mandatory."""
    strings, need = _walk(_parser.parse(pattern, re.IGNORECASE))
    return need if strings is None else _and(need, _of_strings(strings))


def satisfied(query: Query, grams: set[str]) -> bool:
    return any(x <= grams for x in query)
