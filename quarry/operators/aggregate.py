"""Grouped aggregation; Spark combines before the shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.basic import Attribute, column, distinct_columns, field_of, quoted, unique_names


@dataclass(frozen=True)
class AggregateCall:
    """func: min, max, sum or count; attribute None counts rows; name is the output's."""

    func: str
    attribute: Attribute | None = None
    name: str | None = None


def hash_aggregate(df: DataFrame, keys: list[Attribute], calls: list[AggregateCall]) -> DataFrame:
    """Keys, then aggregates, one row per group.

    Without keys an empty input gives no row. Without calls the distinct keys come out. A sum beyond
    64 bits is an error; sums of doubles are doubles.
    """
    df = distinct_columns(df)
    if not calls:
        return df.select(*[column(df, k) for k in keys]).distinct()
    outputs = []
    for c in calls:
        if c.func not in ("min", "max", "sum", "count"):
            raise ValueError(f"aggregate {c.func!r}")
        if c.attribute is None and c.func != "count":
            raise ValueError(f"{c.func} needs an attribute")
        arg = F.lit(1) if c.attribute is None else column(df, c.attribute)
        label = c.name or (f"{c.func}_{field_of(df, c.attribute).name}" if c.attribute is not None else c.func)
        outputs.append((getattr(F, c.func)(arg), label))
    names = unique_names([field_of(df, k).name for k in keys] + [label for _, label in outputs])
    labels = names[len(keys) :]
    aggregates = [e.alias(n) for (e, _), n in zip(outputs, labels, strict=True)]
    if keys:
        return df.groupBy(*[column(df, k).alias(n) for k, n in zip(keys, names, strict=False)]).agg(*aggregates)
    return df.agg(*aggregates, F.count(F.lit(1)).alias("_rows")).where("_rows > 0").select(*[F.col(quoted(n)) for n in labels])
