"""Errors of the dialect, with the texts users see."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Position:
    line: int
    column: int

    def __str__(self) -> str:
        return f"{self.line}:{self.column}"


class SQLError(Exception):
    pass


class LexError(SQLError):
    def __init__(self, at: Position, message: str):
        super().__init__(f"lex error {at}: {message}")
        self.at = at


class ParseError(SQLError):
    def __init__(self, at: Position, message: str):
        super().__init__(f"parse error {at}: {message}")
        self.at = at


class BindError(SQLError):
    def __init__(self, message: str):
        super().__init__(f"bind error: {message}")


class PlanError(SQLError):
    def __init__(self, message: str):
        super().__init__(f"plan error: {message}")


class CatalogError(Exception):
    """Failures of tables and indexes: names that exist or don't, and keys that aren't unique."""


class DuplicateTable(CatalogError):
    pass


class DuplicateKey(CatalogError):
    pass


class CSVError(CatalogError):
    pass
