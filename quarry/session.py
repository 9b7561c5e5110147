"""A session: statements of the dialect over native tables and registered DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalog import Catalog, Index, Store, Table
from quarry.operators import Comparison, print_text, upsert
from quarry.operators.basic import condition, quoted
from quarry.sources.csv import read_csv, resolve
from quarry.sql import nodes as N
from quarry.sql.binder import Binder, Columns, literal_mismatch
from quarry.sql.errors import BindError, CSVError, DuplicateKey, DuplicateTable, PlanError
from quarry.sql.lower import lower
from quarry.sql.parser import parse
from quarry.types import coerce, coerce_value, engine_type

#: Rows inserted one by one are held back up to this many, and written before any read of their table.
MOST_PENDING = 1000
#: Key columns with up to so many stored values are read once for repeated INSERTs; longer ones are looked up in the table.
MOST_KEYS = 1_000_000


class Session:
    """``root`` is the folder of the native tables; without it only registered DataFrames can be queried."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.catalog = Catalog(Store(spark, resolve(root))) if root else None
        self.views: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self._pending: dict[str, list[tuple[str, ...]]] = {}
        self._pending_keys: dict[tuple[str, str], set] = {}
        self._stored_keys: dict[tuple[str, str], set | None] = {}

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """Make a DataFrame a relation; a function is called when a query first names it."""
        self.views[name] = df

    def _view(self, name: str) -> DataFrame | None:
        df = self.views.get(name)
        if df is not None and not isinstance(df, DataFrame):
            df = self.views[name] = df()
        return df

    def query(self, text: str) -> DataFrame:
        """The DataFrame of a SELECT statement."""
        tree = parse(text)
        if not isinstance(tree, (N.Select, N.SetOperation)):
            raise PlanError("not a query")
        return self._lowered(tree)

    def execute(self, text: str) -> str:
        """Run one statement; rows as printed, or what was done."""
        tree = parse(text)
        rules = {N.CreateTable: self._create_table, N.CreateIndex: self._create_index, N.DropTable: self._drop, N.Insert: self._insert, N.Copy: self._copy}
        rule = rules.get(type(tree))
        if rule is None:
            return print_text(self._lowered(tree))
        if self.catalog is None:
            raise PlanError("the session has no folder for tables")
        return rule(tree)

    def close(self) -> None:
        for name in list(self._pending):
            self._flush(name)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # Queries

    def _lowered(self, tree: N.Select | N.SetOperation) -> DataFrame:
        return lower(Binder(self._columns).bind(tree), self._frame)

    def _table(self, name: str) -> Table | None:
        return self.catalog.tables.get(name) if self.catalog else None

    def _columns(self, name: str) -> Columns | None:
        if t := self._table(name):
            return t.columns
        df = self._view(name)
        return None if df is None else [(f.name, engine_type(f)) for f in df.schema.fields]

    def _frame(self, name: str) -> DataFrame:
        t = self._table(name)
        if t is None:
            return self._view(name)
        self._flush(name)
        return self._stored(t)

    def _stored(self, t: Table) -> DataFrame:
        if not self.catalog.store.exists(t.folder):
            return self.spark.createDataFrame([], t.schema)
        return self.spark.read.schema(t.schema).parquet(f"{self.catalog.store.root}/{t.folder}")

    # Definitions

    def _create_table(self, tree: N.CreateTable) -> str:
        names = [n for n, _ in tree.columns]
        if tree.name in self.catalog.tables or tree.name in self.views:
            raise DuplicateTable(f"table `{tree.name}` exists")
        if not names or len(set(names)) < len(names):
            raise BindError(f"table `{tree.name}` needs columns of different names")
        for k in tree.key:
            if k not in names:
                raise BindError(f"table `{tree.name}` has no column `{k}`")
        t = Table(tree.name, list(tree.columns), list(tree.key), f"data/{uuid.uuid4().hex}")
        if len(tree.key) == 1:  # keys of several columns are recorded and not enforced
            t.indexes.append(Index(f"pk_{tree.name}", tree.key[0]))
        self.catalog.tables[tree.name] = t
        self.catalog.save()
        return "CREATE TABLE\n"

    def _create_index(self, tree: N.CreateIndex) -> str:
        t = self._table(tree.table)
        if t is None:
            raise BindError(f"no such table `{tree.table}`")
        if tree.column not in [n for n, _ in t.columns]:
            raise BindError(f"table `{tree.table}` has no column `{tree.column}`")
        if self.catalog.index(tree.name):
            raise BindError(f"index `{tree.name}` exists")
        self._check_repeats(self._frame(tree.table), tree.table, tree.column)
        t.indexes.append(Index(tree.name, tree.column))
        self.catalog.save()
        return "CREATE INDEX\n"

    def _drop(self, tree: N.DropTable) -> str:
        t = self._table(tree.name)
        if t is None:
            raise BindError(f"no such table `{tree.name}`")
        del self.catalog.tables[tree.name]
        self._forget(tree.name)
        self.catalog.save()
        self.catalog.store.delete(t.folder)
        return "DROP TABLE\n"

    # Rows

    def _check_repeats(self, df: DataFrame, table: str, column: str) -> None:
        again = df.groupBy(F.col(quoted(column))).count().where("count > 1").take(1)
        if again:
            raise DuplicateKey(f"duplicate key {again[0][0]!r} in column `{column}` of `{table}`")

    def _append(self, t: Table, rows: DataFrame) -> None:
        rows.select(*[F.col(quoted(f.name)) for f in t.schema.fields]).write.mode("append").parquet(f"{self.catalog.store.root}/{t.folder}")

    def _coerced(self, t: Table, rows: DataFrame) -> DataFrame:
        return rows.select(*[coerce(F.col(f"c{i}"), kind).alias(n) for i, (n, kind) in enumerate(t.columns)])

    def _insert(self, tree: N.Insert) -> str:
        t = self._table(tree.table)
        if t is None:
            raise BindError(f"no such table `{tree.table}`")
        if len(tree.values) != len(t.columns):
            raise BindError(f"table `{tree.table}` has {len(t.columns)} columns, got {len(tree.values)} values")
        for v, (name, kind) in zip(tree.values, t.columns, strict=True):
            if wrong := literal_mismatch(v.value, kind, name):
                raise BindError(wrong)
        row = tuple(str(v.value) for v in tree.values)
        if t.indexes:
            self._check_insert(t, row)
        self._pending.setdefault(t.name, []).append(row)
        if len(self._pending[t.name]) >= MOST_PENDING:
            self._flush(t.name)
        return "INSERT 1\n"

    def _check_insert(self, t: Table, row: tuple[str, ...]) -> None:
        values = [coerce_value(x, kind) for x, (_, kind) in zip(row, t.columns, strict=True)]
        for i in t.indexes:
            value, seen = values[t.place(i.column)], self._pending_keys.setdefault((t.name, i.column), set())
            if value in seen or self._has_key(t, i.column, value):
                raise DuplicateKey(f"duplicate key {value!r} in column `{i.column}` of `{t.name}`")
        for i in t.indexes:
            self._pending_keys[t.name, i.column].add(values[t.place(i.column)])

    def _has_key(self, t: Table, column: str, value: int | str) -> bool:
        """Whether a stored row has this key: from the keys read once, or, where they are many, by a look-up in the files."""
        at = t.name, column
        if at not in self._stored_keys:
            rows = self._stored(t).select(F.col(quoted(column))).limit(MOST_KEYS + 1).collect()
            self._stored_keys[at] = {r[0] for r in rows} if len(rows) <= MOST_KEYS else None
        keys = self._stored_keys[at]
        return value in keys if keys is not None else bool(self._stored(t).where(F.col(quoted(column)) == F.lit(value)).take(1))

    def _flush(self, name: str) -> None:
        """Write the rows held back; their keys join those read before."""
        rows, t = self._pending.pop(name, []), self._table(name)
        if rows and t:
            raw = self.spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(len(t.columns))))
            self._append(t, self._coerced(t, raw).coalesce(1))
            for at in [k for k in self._pending_keys if k[0] == name]:
                new, known = self._pending_keys.pop(at), self._stored_keys.get(at)
                if known is not None:
                    known |= new
                    if len(known) > MOST_KEYS:
                        self._stored_keys[at] = None
        else:
            self._forget(name)

    def _forget(self, name: str) -> None:
        """Drop what is held of a table that changes otherwise."""
        self._pending.pop(name, None)
        for held in (self._pending_keys, self._stored_keys):
            for key in [k for k in held if k[0] == name]:
                del held[key]

    # Changes beyond the dialect: the table is written anew and its old files go once the catalog names the new ones

    def erase(self, name: str, *comparisons: Comparison) -> None:
        """Remove the rows for which all comparisons hold."""
        t, rows = self._changed(name)
        self._rewrite(t, rows.where(~condition(rows, *comparisons)))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Put rows in by position; a row takes the place of the one with its key, which must be of one column and unique in rows."""
        t, old = self._changed(name)
        if len(t.key) != 1:
            raise BindError(f"table `{name}` has no key of one column")
        raw = rows.select(*[F.col(quoted(c)).cast("string").alias(f"c{i}") for i, c in enumerate(rows.columns)])
        if len(raw.columns) != len(t.columns):
            raise BindError(f"table `{name}` has {len(t.columns)} columns, got {len(raw.columns)}")
        new = self._coerced(t, raw.na.fill(""))
        self._check_repeats(new, name, t.key[0])
        merged = upsert(old, new, t.key[0])
        for i in t.indexes[1:]:
            self._check_repeats(merged, name, i.column)
        self._rewrite(t, merged)

    def _changed(self, name: str) -> tuple[Table, DataFrame]:
        t = self._table(name)
        if t is None:
            raise BindError(f"no such table `{name}`")
        self._flush(name)
        return t, self._stored(t)

    def _rewrite(self, t: Table, rows: DataFrame) -> None:
        old, new = t.folder, f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.catalog.store.root}/{new}")
        self._forget(t.name)
        t.folder = new
        self.catalog.save()
        self.catalog.store.delete(old)

    def _copy(self, tree: N.Copy) -> str:
        t = self._table(tree.table)
        if t is None:
            raise BindError(f"no such table `{tree.table}`")
        self._flush(t.name)
        rows = self._coerced(t, read_csv(self.spark, tree.path, [n for n, _ in t.columns], tree.header))
        # The whole file is read and checked before the table changes: all of it is loaded, or none.
        try:
            n = rows.count() if not t.indexes else None
            for i in t.indexes:
                self._check_repeats(rows, t.name, i.column)
                met = rows.join(self._stored(t).select(F.col(quoted(i.column)).alias("_key")), F.col(quoted(i.column)) == F.col("_key"), "left_semi").take(1)
                if met:
                    raise DuplicateKey(f"duplicate key {met[0][t.place(i.column)]!r} in column `{i.column}` of `{t.name}`")
            n = rows.count() if n is None else n
            self._append(t, rows)
            self._forget(t.name)
        except DuplicateKey:
            raise
        except Exception as e:
            if "MALFORMED" in str(e).upper():
                raise CSVError(f"{tree.path}: a row does not have {len(t.columns)} cells") from e
            raise
        return f"COPY {n}\n"
