"""The Boolean trigram query that every match of a regular expression must satisfy.

A query is a set of clauses, one of which must hold; a clause is a set of trigrams that must all occur.
The empty clause holds always: such an expression has no mandatory trigrams. Texts and trigrams are
lower-cased (A-Z only), so upper and lower case need not be told apart.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

Query = frozenset  # of frozensets of trigrams
ANY: Query = frozenset([frozenset()])
MAX_STRINGS = 16   # exact strings followed through alternatives; beyond it a part counts as unknown
MAX_CLAUSES = 64


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _grams(text: str) -> frozenset:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _both(a: Query, b: Query) -> Query:
    out = _least(frozenset(x | y for x in a for y in b))
    return out if len(out) <= MAX_CLAUSES else min(a, b, key=len)


def _least(query: Query) -> Query:
    """Without clauses that imply another one."""
    return frozenset(c for c in query if not any(d < c for d in query))


def trigram_query(pattern: str) -> Query:
    return _least(_close(*_walk(parser.parse(pattern))))


def _close(strings: frozenset | None, query: Query) -> Query:
    """What ``query`` and one of ``strings`` (None: unknown) demand together."""
    if strings is None:
        return query
    return _both(query, frozenset(_grams(s) for s in strings))


def _walk(items) -> tuple[frozenset | None, Query]:
    """The exact strings a sequence can match (None: too many) and what else it demands.

    Strings are carried on as long as the parts are exact, so that trigrams across parts count.
    """
    query, run, exact = ANY, frozenset([""]), True
    for kind, value in items:
        strings, demand = _one(kind, value)
        query = _both(query, demand)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            continue
        query, exact = _close(run, query), False
        run = strings if strings is not None else frozenset([""])
    return (run, query) if exact else (None, _close(run, query))


def _one(kind, value) -> tuple[frozenset | None, Query]:
    nothing = frozenset([""])
    if kind is op.LITERAL:
        return frozenset([_lower(chr(value))]), ANY
    if kind is op.IN:
        if all(k is op.LITERAL for k, _ in value) and len(value) <= MAX_STRINGS:
            return frozenset(_lower(chr(v)) for _, v in value), ANY
        return None, ANY
    if kind is op.AT:
        return nothing, ANY
    if kind in (op.ASSERT, op.ASSERT_NOT):
        return nothing, ANY
    if kind is op.SUBPATTERN:
        return _walk(value[-1])
    if kind is op.BRANCH:
        parts = [_walk(p) for p in value[1]]
        if all(s is not None for s, _ in parts):
            every = frozenset().union(*[s for s, _ in parts])
            if len(every) <= MAX_STRINGS and all(q == ANY for _, q in parts):
                return every, ANY
        return None, _least(frozenset().union(*[_close(s, q) for s, q in parts]))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        strings, demand = _walk(inner)
        if least == 0:
            if most == 1 and strings is not None and demand == ANY:
                return strings | nothing, ANY
            return None, ANY
        if strings is not None and least == most and len(strings) ** least <= MAX_STRINGS:
            out = nothing
            for _ in range(least):
                out = frozenset(a + b for a in out for b in strings)
            return out, demand
        return None, _close(strings, demand)
    return None, ANY
