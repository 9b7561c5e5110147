"""Projection, selection, sorting, look-up by key and printing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Attribute = int | str


def unique_names(names: list[str]) -> list[str]:
    """The names, with _2, _3, ... after those that came before."""
    out: list[str] = []
    for name in names:
        k, new = 1, name
        while new in out:
            k += 1
            new = f"{name}_{k}"
        out.append(new)
    return out


def distinct_columns(df: DataFrame) -> DataFrame:
    names = unique_names(df.columns)
    return df if names == df.columns else df.toDF(*names)


def field_of(df: DataFrame, attribute: Attribute) -> T.StructField:
    """The field at a position or of a name, which is matched exactly."""
    if isinstance(attribute, int):
        return df.schema.fields[attribute]
    found = [f for f in df.schema.fields if f.name == attribute]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} attribute {attribute!r}")
    return found[0]


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def column(df: DataFrame, attribute: Attribute) -> Column:
    return F.col(quoted(field_of(df, attribute).name))


def project(df: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """The attributes in the order given; they may repeat, and a repeated name gets a number."""
    df = distinct_columns(df)
    names = [field_of(df, a).name for a in attributes]
    return df.select(*[F.col(quoted(n)).alias(new) for n, new in zip(names, unique_names(names), strict=True)])


@dataclass(frozen=True)
class Comparison:
    """attribute OP constant, or attribute OP another attribute where ``other`` is given. op: eq ne lt le gt ge."""

    attribute: Attribute
    op: str
    value: int | float | bool | str | None = None
    other: Attribute | None = None


def compare(left: Column, op: str, right: Column, floating: bool = False) -> Column:
    """A comparison. Spark takes NaN as equal to itself and above all numbers; with ``floating`` it compares as in IEEE 754."""
    plain = {
        "eq": lambda: left == right, "ne": lambda: left != right, "lt": lambda: left < right,
        "le": lambda: left <= right, "gt": lambda: left > right, "ge": lambda: left >= right,
    }[op]()
    if not floating:
        return plain
    odd = F.isnan(left) | F.isnan(right)
    return plain | odd if op == "ne" else plain & ~odd


def _floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def condition(df: DataFrame, *comparisons: Comparison) -> Column:
    """All comparisons together, for a DataFrame of distinct names."""
    out = F.lit(True)
    for k, c in enumerate(comparisons):
        floating = _floating(field_of(df, c.attribute).dataType) or (c.other is not None and _floating(field_of(df, c.other).dataType))
        own = compare(column(df, c.attribute), c.op, F.lit(c.value) if c.other is None else column(df, c.other), floating)
        out = own if k == 0 else out & own
    return out


def select(df: DataFrame, *comparisons: Comparison) -> DataFrame:
    """Rows for which all comparisons hold."""
    df = distinct_columns(df)
    return df.where(condition(df, *comparisons))


def sort(df: DataFrame, criteria: list[tuple[Attribute, bool]]) -> DataFrame:
    """Rows by (attribute, descending) pairs. Spark spills where memory is short."""
    df = distinct_columns(df)
    return df.orderBy(*[column(df, a).desc() if down else column(df, a).asc() for a, down in criteria])


def index_lookup(table: DataFrame, key: Attribute, value: int | str) -> DataFrame:
    """Rows of the table with this key; the file scan skips row groups by their statistics."""
    return select(table, Comparison(key, "eq", value))


def _printed(name: str, kind: T.DataType) -> Column:
    c = F.col(quoted(name))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def print_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """One text column: each row's values, separated by commas, unquoted."""
    df = distinct_columns(df)
    return df.select(F.concat_ws(",", *[_printed(f.name, f.dataType) for f in df.schema.fields]).alias(name))


def print_text(df: DataFrame) -> str:
    """All rows as text, for shells and tests; rows come partition by partition."""
    return "".join(f"{r[0]}\n" for r in print_lines(df).toLocalIterator())
