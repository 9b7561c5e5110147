"""Engine types, their Spark counterparts, and how stored values are coerced."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, CHAR, DOUBLE, BOOL = "INTEGER", "CHAR", "DOUBLE", "BOOL"
#: Metadata of a stored character column: its width in bytes.
WIDTH = "char_length"


@dataclass(frozen=True)
class EngineType:
    """A type class; ``width`` is a CHAR's length in bytes, None where a table doesn't declare one."""

    kind: str
    width: int | None = None

    def __str__(self) -> str:
        return f"CHAR({self.width})" if self.kind == CHAR and self.width is not None else self.kind

    def matches(self, other: EngineType) -> bool:
        """Equal classes; declared CHAR widths must be equal, an undeclared one fits any."""
        return self.kind == other.kind and (self.kind != CHAR or None in (self.width, other.width) or self.width == other.width)


def engine_type(field: T.StructField) -> EngineType:
    """The class of a Spark column. Types the engine has no class for are only equal to themselves."""
    t = field.dataType
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return EngineType(INTEGER)
    if isinstance(t, T.StringType):
        return EngineType(CHAR, (field.metadata or {}).get(WIDTH))
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return EngineType(DOUBLE)
    if isinstance(t, T.BooleanType):
        return EngineType(BOOL)
    return EngineType(t.simpleString())


def storage_field(name: str, kind: EngineType) -> T.StructField:
    if kind.kind == INTEGER:
        return T.StructField(name, T.IntegerType(), True)
    return T.StructField(name, T.StringType(), True, {WIDTH: kind.width})


def to_integer(text: Column) -> Column:
    """A 32-bit integer from text of an optional sign and digits; anything else, and overflow, is 0."""
    return F.coalesce(F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int")), F.lit(0))


def to_char(text: Column, width: int) -> Column:
    """Text up to its first NUL, cut at ``width`` bytes of UTF-8; a code point cut in two becomes U+FFFD."""
    head = F.encode(F.substring_index(text, "\0", 1), "utf-8")
    return F.make_valid_utf8(F.substring(head, 1, width).cast("string"))


def coerce_value(text: str, kind: EngineType) -> int | str:
    """What coerce stores for one text."""
    if kind.kind == INTEGER:
        n = int(text) if re.fullmatch(r"[+-]?[0-9]{1,4000}", text, re.ASCII) else 0
        return n if -(1 << 31) <= n < 1 << 31 else 0
    return text.partition("\0")[0].encode("utf-8", "replace")[: kind.width].decode("utf-8", "replace")


def coerce(text: Column, kind: EngineType) -> Column:
    return to_integer(text) if kind.kind == INTEGER else to_char(text, kind.width)
