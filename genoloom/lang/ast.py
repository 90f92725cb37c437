"""Syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object  # int, float, str or bool
    at: int = 0


@dataclass(frozen=True)
class Name:
    name: str
    at: int = 0


@dataclass(frozen=True)
class Var:
    name: str
    at: int = 0


@dataclass(frozen=True)
class Star:
    at: int = 0


@dataclass(frozen=True)
class Unary:
    op: str  # "-" or "NOT"
    arg: object
    at: int = 0


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    at: int = 0


@dataclass(frozen=True)
class Field:
    base: object
    name: str
    at: int = 0


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    at: int = 0


@dataclass(frozen=True)
class Source:
    format: str
    path: object  # str or Var
    alias: str | None = None
    at: int = 0


@dataclass(frozen=True)
class Pair:
    """The second input of a set operation."""

    format: str
    path: object
    mode: str
    at: int = 0


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: object
    descending: bool = False


@dataclass
class Query:
    source: Source
    pair: Pair | None = None
    split: bool = False
    select: list[Item] | None = None
    where: object | None = None
    call: str | None = None
    params: list[tuple[str, object, int]] = field(default_factory=list)
    with_at: int | None = None
    annotate: list[tuple[str, object, int]] | None = None
    order: list[Order] | None = None
    limit: object | None = None
    into: Source | None = None
    call_at: int | None = None
