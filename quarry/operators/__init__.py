"""Relational operators: functions from DataFrames to DataFrames. Attributes are given by position or by name."""

from quarry.operators.aggregate import AggregateCall, hash_aggregate
from quarry.operators.basic import Comparison, compare, index_lookup, print_lines, print_text, project, select, sort
from quarry.operators.joins import cross_product, equi_join, hash_join
from quarry.operators.records import erase, index_scan, resolve, sort_unsigned, table_scan, upsert
from quarry.operators.sets import except_, except_all, intersect, intersect_all, union, union_all

__all__ = [
    "AggregateCall", "Comparison", "compare", "cross_product", "equi_join", "erase", "except_", "except_all", "hash_aggregate", "hash_join", "index_lookup", "index_scan",
    "intersect", "intersect_all", "print_lines", "print_text", "project", "resolve", "select", "sort", "sort_unsigned", "table_scan", "union", "union_all", "upsert",
]
