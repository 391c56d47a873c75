"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    """Base of all expressions."""


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class JsonLiteral(Node):
    text: str


@dataclass(frozen=True)
class Regex(Node):
    pattern: str


@dataclass(frozen=True)
class Slice(Node):
    """A slice as an argument: (start, stop, step)."""

    parts: tuple


@dataclass(frozen=True)
class Current(Node):
    pass


@dataclass(frozen=True)
class Variable(Node):
    name: str


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple
    spread: bool = False


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Keys:
    """Keys to select: strings and Regex. deep: on all levels; negated: all but these."""

    items: tuple
    negated: bool = False
    deep: bool = False


@dataclass(frozen=True)
class Slots:
    """Positions to select: integers and (start, stop, step) triples."""

    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class Star:
    deep: bool = False


@dataclass(frozen=True)
class Mask:
    condition: Node


@dataclass(frozen=True)
class MakeArray:
    items: tuple


@dataclass(frozen=True)
class MakeObject:
    items: tuple


@dataclass(frozen=True)
class Apply:
    body: Node


@dataclass(frozen=True)
class Chain(Node):
    """An expression and the indexers on it."""

    base: Node
    indexers: tuple


@dataclass(frozen=True)
class Statement:
    expression: Node


@dataclass(frozen=True)
class Assign:
    target: Node
    value: Node


@dataclass(frozen=True)
class Define:
    name: str
    value: Node


@dataclass(frozen=True)
class Loop:
    name: str
    over: Node
    body: tuple = field(default_factory=tuple)


def yields_one(indexer) -> bool:
    """Whether an indexer selects a single thing, which isn't wrapped."""
    if isinstance(indexer, Keys):
        return not indexer.negated and not indexer.deep and len(indexer.items) == 1 and isinstance(indexer.items[0], str)
    if isinstance(indexer, Slots):
        return not indexer.negated and len(indexer.items) == 1 and isinstance(indexer.items[0], int)
    return isinstance(indexer, (Apply, MakeArray, MakeObject))


def mentions_input(node) -> bool:
    """Whether an expression depends on the input."""
    if isinstance(node, Current):
        return True
    if isinstance(node, (tuple, list)):
        return any(map(mentions_input, node))
    if hasattr(node, "__dataclass_fields__"):
        return any(mentions_input(getattr(node, f)) for f in node.__dataclass_fields__)
    return False
