"""Bound queries to DataFrames.

Every scanned column is renamed to one name by scan and place, so self-joins and equal names are no
matter. Relations are joined in FROM order, each with all the equalities that link it to those
before; filters stand where they were written. Pushing filters down, ordering joins and choosing
their kind is left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import AggregateCall, compare, except_, except_all, hash_aggregate, intersect, intersect_all, sort, union, union_all
from quarry.operators.basic import unique_names
from quarry.sql.binder import BoundColumn, BoundSelect, BoundSet
from quarry.types import DOUBLE

_SETS = {("union", False): union, ("union", True): union_all, ("intersect", False): intersect, ("intersect", True): intersect_all, ("except", False): except_, ("except", True): except_all}


def _id(c: BoundColumn) -> str:
    return f"r{c.scan}_c{c.place}"


def _equal(c: BoundColumn, other: Column) -> Column:
    return compare(F.col(_id(c)), "eq", other, c.type.kind == DOUBLE)


def lower(query: BoundSelect | BoundSet, table: Callable[[str], DataFrame]) -> DataFrame:
    if isinstance(query, BoundSet):
        return _SETS[query.op, query.all](lower(query.left, table), lower(query.right, table))
    return _select(query, table)


def _select(query: BoundSelect, table: Callable[[str], DataFrame]) -> DataFrame:
    scans = []
    for i, r in enumerate(query.scans):
        df = table(r.table)
        scans.append(df.toDF(*[f"r{i}_c{k}" for k in range(len(df.columns))]))
    waiting = list(query.joins)

    def take(scan: int) -> list[Column]:
        ready = [j for j in waiting if max(j[0].scan, j[1].scan) <= scan]
        for j in ready:
            waiting.remove(j)
        return [compare(F.col(_id(a)), "eq", F.col(_id(b)), DOUBLE in (a.type.kind, b.type.kind)) for a, b in ready]

    df = scans[0]
    for c in take(0):
        df = df.where(c)
    for i, right in enumerate(scans[1:], 1):
        conditions = take(i)
        df = df.join(right, conditions, "inner") if conditions else df.crossJoin(right)
    for column, value in query.filters:
        df = df.where(_equal(column, F.lit(value)))

    names = unique_names(_names(query))
    if query.aggregated:
        df = _aggregate(query, df)
    else:
        df = df.select(*[F.col(_id(c)).alias(f"o{k}") for k, c in enumerate(query.output)])
    if query.order:
        df = sort(df, [(f"o{k}", down) for k, down in query.order])
    return df.toDF(*names)


def _aggregate(query: BoundSelect, df: DataFrame) -> DataFrame:
    keys = list(dict.fromkeys(_id(g) for g in query.groups))
    calls = [AggregateCall(o.func, _id(o.column) if o.column else None, f"o{k}") for k, o in enumerate(query.output) if not isinstance(o, BoundColumn)]
    out = hash_aggregate(df, keys, calls)
    return out.select(*[F.col(_id(o) if isinstance(o, BoundColumn) else f"o{k}").alias(f"o{k}") for k, o in enumerate(query.output)])


def _names(query: BoundSelect) -> list[str]:
    """Output names; a name that several relations give is qualified."""
    plain = [o.name for o in query.output]
    return [f"{query.scans[o.scan].alias}_{o.name}" if isinstance(o, BoundColumn) and plain.count(o.name) > 1 and len(query.scans) > 1 else o.name for o in query.output]
