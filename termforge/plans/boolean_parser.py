"""Boolean query text to a syntax tree.

``AND``, ``OR`` and ``NOT`` (upper case) with precedence OR < AND < NOT and parentheses; every
other token is a term. NOT is a prefix operator, so ``NOT NOT a`` is ``a``. Juxtaposed terms and
unbalanced parentheses are errors; a blank query has no tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Not:
    operand: Node


@dataclass(frozen=True)
class And:
    operands: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    operands: tuple[Node, ...]


Node = Term | Not | And | Or


def parse(query: str) -> Node | None:
    items = re.findall(r"[()]|[^\s()]+", query)
    if not items:
        return None
    at = 0

    def peek() -> str | None:
        return items[at] if at < len(items) else None

    def chain(word: str, kind, below):
        nonlocal at
        parts = [below()]
        while peek() == word:
            at += 1
            parts.append(below())
        return parts[0] if len(parts) == 1 else kind(tuple(parts))

    def unary() -> Node:
        nonlocal at
        item = peek()
        if item is None or item in (")", "AND", "OR"):
            raise QuerySyntaxError(f"operand expected at item {at + 1} of {query!r}")
        at += 1
        if item == "NOT":
            return Not(unary())
        if item == "(":
            inside = either()
            if peek() != ")":
                raise QuerySyntaxError(f"unclosed parenthesis in {query!r}")
            at += 1
            return inside
        return Term(item.lower())

    def both() -> Node:
        return chain("AND", And, unary)

    def either() -> Node:
        return chain("OR", Or, both)

    tree = either()
    if at < len(items):
        raise QuerySyntaxError(f"unexpected {items[at]!r} in {query!r}")
    return tree


def terms(node: Node | None) -> set[str]:
    if node is None:
        return set()
    if isinstance(node, Term):
        return {node.text}
    if isinstance(node, Not):
        return terms(node.operand)
    return set().union(*map(terms, node.operands))


def renamed(node: Node, names: dict[str, str]) -> Node:
    """The tree with terms replaced, where ``names`` has them (by their stems, for instance)."""
    if isinstance(node, Term):
        return Term(names.get(node.text, node.text))
    if isinstance(node, Not):
        return Not(renamed(node.operand, names))
    return type(node)(tuple(renamed(x, names) for x in node.operands))
