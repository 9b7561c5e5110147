"""Set and bag operations by position; names come from the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.operators.basic import distinct_columns
from quarry.types import engine_type


def _aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    left, right = distinct_columns(left), distinct_columns(right)
    if len(left.columns) != len(right.columns):
        raise ValueError(f"different column counts: {len(left.columns)} and {len(right.columns)}")
    for i, (a, b) in enumerate(zip(left.schema.fields, right.schema.fields, strict=True)):
        if not engine_type(a).matches(engine_type(b)):
            raise ValueError(f"incompatible types in column {i + 1}: {engine_type(a)} and {engine_type(b)}")
    return left, right.toDF(*left.columns)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = _aligned(left, right)
    return a.union(b).distinct()


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = _aligned(left, right)
    return a.union(b)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = _aligned(left, right)
    return a.intersect(b)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as on the side that has it less often."""
    a, b = _aligned(left, right)
    return a.intersectAll(b)


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = _aligned(left, right)
    return a.subtract(b)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as the left side has it more often."""
    a, b = _aligned(left, right)
    return a.exceptAll(b)
