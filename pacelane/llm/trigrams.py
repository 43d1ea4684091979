"""Boolean trigram conditions that every match of a regular expression fulfils.

A condition is a list of clauses, any of which must hold; a clause is a set of trigrams that must all
occur.  ``None`` stands for no condition: the expression has matches without a mandatory trigram.
"""

from __future__ import annotations

from itertools import product
from re import _constants as codes
from re import _parser as parser

Condition = list[frozenset[str]] | None
MOST = 64
"""Alternatives that are followed apart; beyond, a part gives no condition."""


def _all_of(one: Condition, other: Condition) -> Condition:
    if one is None or other is None:
        return one or other
    return _least([a | b for a, b in product(one, other)])


def _any_of(parts: list[Condition]) -> Condition:
    return None if any(p is None for p in parts) else _least([c for p in parts for c in p])


def _least(clauses: list[frozenset[str]]) -> Condition:
    """Without clauses that hold only where another one does."""
    distinct = set(clauses)
    kept = [c for c in distinct if not any(d < c for d in distinct)]
    return sorted(kept, key=sorted) if len(kept) <= MOST else None


def _of_strings(strings: set[str]) -> Condition:
    if any(len(s) < 3 for s in strings):
        return None
    return _least([frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings])


def _class(items) -> set[str] | None:
    out = set()
    for kind, value in items:
        if kind is codes.LITERAL:
            out.add(chr(value))
        elif kind is codes.RANGE and value[1] - value[0] < 8:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, Condition]:
    """All strings of a sequence if they are few, and its condition."""
    exact: set[str] | None = {""}
    condition: Condition = None
    whole = True
    for kind, value in nodes:
        strings, inner = None, None
        if kind is codes.LITERAL:
            strings = {chr(value)}
        elif kind is codes.IN:
            strings = _class(value)
        elif kind is codes.SUBPATTERN:
            strings, inner = _walk(value[3])
        elif kind is codes.BRANCH:
            found = [_walk(branch) for branch in value[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*[s for s, _ in found])
            inner = _any_of([_of_strings(s) if s is not None else c for s, c in found])
        elif kind in (codes.MAX_REPEAT, codes.MIN_REPEAT):
            low, high, body = value
            part, part_condition = _walk(body)
            if part is not None and high <= 4:
                strings = {"".join(t) for n in range(low, high + 1) for t in product(part, repeat=n)}
            elif low:
                inner = _of_strings(part) if part is not None else part_condition
        elif kind is codes.AT or kind in (codes.ASSERT_NOT,):
            strings = {""}
        if strings is not None and len(strings) * len(exact) <= MOST:
            exact = {a + b for a, b in product(exact, strings)}
            continue
        whole = False
        condition = _all_of(condition, _of_strings(exact))
        exact = {""}
        if strings is not None and len(strings) <= MOST:
            exact = strings
        else:
            condition = _all_of(condition, inner)
    if whole:
        return exact, None
    return None, _all_of(condition, _of_strings(exact))


def condition(pattern: str) -> Condition:
    """Condition on the lower-case trigrams of a text for ``pattern`` to match it, in either case."""
    strings, found = _walk(parser.parse(pattern))
    found = _of_strings(strings) if strings is not None else found
    return None if found is None else _least([frozenset(t.lower() for t in clause) for clause in found])
