"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field

from quarry.types import EngineType


@dataclass(frozen=True)
class Attribute:
    name: str
    relation: str | None = None

    def __str__(self) -> str:
        return f"{self.relation}.{self.name}" if self.relation else self.name


@dataclass(frozen=True)
class Literal:
    value: int | float | bool | str


@dataclass(frozen=True)
class Aggregate:
    """attribute None is count(*)."""

    func: str
    attribute: Attribute | None


@dataclass(frozen=True)
class Relation:
    table: str
    alias: str


@dataclass(frozen=True)
class Condition:
    left: Attribute
    right: Attribute | Literal


@dataclass(frozen=True)
class OrderKey:
    """key: a position from 1, or an output name."""

    key: int | Attribute
    descending: bool


@dataclass(frozen=True)
class Select:
    """items empty: all columns."""

    items: tuple[Attribute | Aggregate, ...]
    relations: tuple[Relation, ...]
    conditions: tuple[Condition, ...] = ()
    groups: tuple[Attribute, ...] = ()
    order: tuple[OrderKey, ...] = ()


@dataclass(frozen=True)
class SetOperation:
    """op: union, intersect or except."""

    op: str
    all: bool
    left: Select | SetOperation
    right: Select | SetOperation


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, EngineType], ...]
    key: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Copy:
    table: str
    path: str
    header: bool
