"""Inner equi-joins and products. Sides are renamed, so that tables may be joined with themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.basic import Attribute, compare, distinct_columns, field_of, quoted, unique_names


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    left, right = distinct_columns(left), distinct_columns(right)
    names = unique_names(left.columns + right.columns)
    return left.toDF(*[f"l{i}" for i in range(len(left.columns))]), right.toDF(*[f"r{i}" for i in range(len(right.columns))]), names


def _place(df: DataFrame, attribute: Attribute) -> int:
    df = distinct_columns(df)
    return df.columns.index(field_of(df, attribute).name)


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[Attribute, Attribute]]) -> DataFrame:
    """Rows of left and right with equal attributes: left's columns, then right's, keys of both kept."""
    places = [(_place(left, a), _place(right, b)) for a, b in on]
    x, y, names = _sides(left, right)
    condition = F.lit(True)
    for k, (i, j) in enumerate(places):
        floating = isinstance(x.schema[i].dataType, (T.FloatType, T.DoubleType)) or isinstance(y.schema[j].dataType, (T.FloatType, T.DoubleType))
        c = compare(F.col(f"l{i}"), "eq", F.col(f"r{j}"), floating)
        condition = c if k == 0 else condition & c
    return x.join(y, condition, "inner").toDF(*names)


def hash_join(left: DataFrame, right: DataFrame, left_key: Attribute, right_key: Attribute, build: str = "all", sequence: Attribute | None = None) -> DataFrame:
    """An inner join on one attribute of each side.

    build "all": every left row counts. build "last_wins": of left rows with one key only the one
    with the greatest ``sequence`` does, as if later rows overwrote earlier ones. Of rows with that
    sequence too, the one whose columns are greatest in order, compared from the first, wins.
    """
    if build == "last_wins":
        if sequence is None:
            raise ValueError("last_wins needs a sequence attribute")
        left = distinct_columns(left)
        key, order = field_of(left, left_key).name, field_of(left, sequence).name
        row = F.struct(*[F.col(quoted(c)) for c in left.columns])
        last = left.groupBy(F.col(quoted(key)).alias("_key")).agg(F.max(F.struct(F.col(quoted(order)).alias("_at"), row.alias("_row"))).alias("_last"))
        left = last.select(*[F.col("_last")["_row"].getField(c).alias(c) for c in left.columns])
    elif build != "all":
        raise ValueError(f"build {build!r}")
    return equi_join(left, right, [(left_key, right_key)])


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with every right row."""
    x, y, names = _sides(left, right)
    return x.crossJoin(y).toDF(*names)
