"""Row addresses, look-up through them, and key-wise changes of a table."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.basic import Attribute, Comparison, column, distinct_columns, field_of, quoted, select

ROW_ID = "_rid"
#: So many addresses are resolved by a filter in the scan.
FEW = 1000


def table_scan(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A Parquet table; with_ids adds each row's address, its file and place in it, as the last column."""
    df = spark.read.parquet(path)
    return df.withColumn(ROW_ID, F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))) if with_ids else df


def index_scan(table: DataFrame, key: Attribute, value: int | str) -> DataFrame:
    """Addresses of the rows with this key, from a table scanned with ids."""
    return select(table, Comparison(key, "eq", value)).select(ROW_ID)


def resolve(addresses: DataFrame, table: DataFrame, few: int = FEW) -> DataFrame:
    """The rows at these addresses, without the addresses; one for each address given.

    Up to ``few`` addresses are fetched first, which only a look-up's key columns are read for, and go
    into the scan as a filter on file and place: files without any of them are not opened. More are joined.
    """
    wanted = addresses.select(F.col(ROW_ID).alias("_wanted"))
    got = wanted.limit(few + 1).collect()
    kept = [F.col(quoted(c)) for c in table.columns if c != ROW_ID]
    if len(got) > few:
        return table.join(wanted, F.col(ROW_ID) == F.col("_wanted")).select(*kept)
    times = Counter((r[0]["file"], r[0]["row"]) for r in got if r[0] is not None)
    by_file: dict[str, list[int]] = {}
    for file, row in times:
        by_file.setdefault(file, []).append(row)
    at_file, at_row = F.col(ROW_ID)["file"], F.col(ROW_ID)["row"]
    hit = reduce(lambda x, y: x | y, ((at_file == f) & at_row.isin(rows) for f, rows in sorted(by_file.items())), F.lit(False))
    found = table.where(at_file.isin(sorted(by_file)) & hit) if by_file else table.limit(0)
    if max(times.values(), default=1) == 1:
        return found.select(*kept)
    often = [(f, r, n) for (f, r), n in times.items() if n > 1]
    again = F.coalesce(*[F.when((at_file == f) & (at_row == r), F.lit(n)) for f, r, n in often], F.lit(1))
    return found.withColumn("_again", F.explode(F.sequence(F.lit(1), again))).select(*kept)


def upsert(table: DataFrame, rows: DataFrame, key: Attribute) -> DataFrame:
    """The table with these rows put in; a row takes the place of those with its key. Keys in rows are unique."""
    table = distinct_columns(table)
    name = field_of(table, key).name
    rows = rows.toDF(*table.columns)
    taken = rows.select(F.col(quoted(name)).alias("_taken"))
    return table.join(taken, F.col(quoted(name)) == F.col("_taken"), "left_anti").unionByName(rows)


def erase(table: DataFrame, keys: DataFrame, key: Attribute) -> DataFrame:
    """The table without the rows whose key is in the first column of keys."""
    table = distinct_columns(table)
    gone = keys.toDF(*[f"_gone{i}" for i in range(len(keys.columns))])
    return table.join(gone, column(table, key) == F.col("_gone0"), "left_anti")


def sort_unsigned(df: DataFrame, attribute: Attribute) -> DataFrame:
    """Ascending by a 64-bit integer read as unsigned: numbers below 0 come after the others."""
    df = distinct_columns(df)
    c = column(df, attribute)
    return df.orderBy(c < 0, c)
