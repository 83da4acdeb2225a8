"""Boolean trigram queries that every match of a regular expression must satisfy.

After the idea of a trigram index for code search: walk the parsed expression, keep the small set of strings that a part
can be, and turn strings of three or more characters into a conjunction of their trigrams; alternatives become a
disjunction, repetitions that may be empty ask for nothing. Queries are over lower-cased text (A to Z only).

A query is a list of conjunctions, each a frozenset of trigrams (a disjunction of conjunctions); None means that every
text has to be looked at.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from itertools import product

#: More strings than this aren't told apart.
MOST = 64

Query = list[frozenset[str]] | None


def _lower(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least([x | y for x, y in product(a, b)]) if len(a) * len(b) <= MOST else min(a, b, key=len)


def _least(q: list[frozenset[str]]) -> list[frozenset[str]]:
    q = list(dict.fromkeys(q))
    return [x for x in q if not any(y < x for y in q)]


def _of_strings(strings: set[str]) -> Query:
    """What a text has to hold if it holds one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(_lower(arg))
        elif op is C.RANGE and arg[1] - arg[0] < 16:
            out |= {_lower(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def _walk(parts) -> tuple[set[str] | None, Query]:
    """Every string the parts can be (None: too many to tell), and what else a match needs."""
    exact: set[str] = {""}
    need: Query = None
    whole = True

    def close() -> None:
        nonlocal need, exact
        need = _and(need, _of_strings(exact))
        exact = {""}

    for op, arg in parts:
        strings: set[str] | None
        query: Query = None
        if op is C.LITERAL:
            strings = {_lower(arg)}
        elif op is C.IN:
            strings = _class(arg)
        elif op is C.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is C.BRANCH:
            got = [_walk(b) for b in arg[1]]
            strings = set().union(*(s for s, _ in got)) if all(s is not None for s, _ in got) else None
            if strings is None:
                each = [_of_strings(s) if s is not None else q for s, q in got]
                query = _least([x for q in each for x in q]) if all(q is not None for q in each) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            s, q = _walk(inner)
            if (low, high) == (0, 1) and s is not None:
                strings = s | {""}
            elif low >= 1 and low == high and s is not None and len(s) ** low <= MOST:
                strings = {"".join(x) for x in product(sorted(s), repeat=low)}
            else:
                strings, query = None, (q if low >= 1 and s is None else None)
                if low >= 1 and s is not None and len(s) ** low <= MOST:
                    query = _of_strings({"".join(x) for x in product(sorted(s), repeat=low)})
        elif op is C.AT:
            strings = {""}
        else:
            strings = None
        if strings is not None and len(exact) * len(strings) <= MOST:
            exact = {a + b for a, b in product(exact, strings)}
            continue
        whole = False
        close()
        if strings is not None:
            exact = set(strings)
        need = _and(need, query)
    if whole:
        return exact, None
    close()
    return None, need


def query(pattern: str) -> Query:
    """The query of a pattern in Python's syntax; None if it has no mandatory trigram."""
    strings, need = _walk(parser.parse(pattern))
    return _of_strings(strings) if strings is not None else need
