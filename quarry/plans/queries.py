"""Queries over the test tables, one or more for each operator, with DuckDB SQL for their results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import operators as O
from quarry.operators import AggregateCall, Comparison
from quarry.session import Session

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession, sf_dir: str) -> Session:
    out = Session(spark)
    for name in TABLES:
        out.register(name, lambda name=name: table(spark, sf_dir, name))
    return out


def add(name: str, sql: str) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name], SQL[name] = query, sql
        return query

    return put


def add_dialect(name: str, text: str, sql: str | None = None, names: list[str] | None = None) -> None:
    """A query in the engine's own dialect, through lexer, parser, binder and lowering."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = session(spark, sf_dir).query(text)
        return df.toDF(*names) if names else df

    QUERIES[name], SQL[name] = query, sql or text


# Scan, print, projection

add_dialect("scan_star", "select * from nation")
add_dialect("scan_lineitem", "select * from lineitem")
add_dialect("project_subset", "select n_name from nation")


@add("print_rows", "select concat_ws(',', n_nationkey, n_name, n_regionkey) as line from nation")
def _print_rows(spark, sf_dir):
    return O.print_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@add("project_reorder_repeat", "select n_name, n_nationkey, n_name as n_name_2 from nation")
def _project(spark, sf_dir):
    return O.project(table(spark, sf_dir, "nation"), ["n_name", 0, "n_name"])


# Selection: every comparison of every kind

_SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def _add_filter(name: str, base: str, columns: list[str], attribute: str, op: str, value=None, other: str | None = None, literal: str = "") -> None:
    def query(spark, sf_dir):
        df = table(spark, sf_dir, base)
        if attribute == "overdrawn":
            df = df.withColumn("overdrawn", F.col("c_acctbal") < 0)
        return O.project(O.select(df, Comparison(attribute, op, value, other)), columns)

    source = "(select c_custkey, c_acctbal < 0 as overdrawn from customer)" if attribute == "overdrawn" else base
    QUERIES[name], SQL[name] = query, f"select {', '.join(columns)} from {source} where {attribute} {_SIGNS[op]} {other or literal}"


for _op in _SIGNS:
    _add_filter(f"filter_int_{_op}", "part", ["p_partkey", "p_size"], "p_size", _op, 11, literal="11")
    _char = "BUILDING" if _op in ("eq", "ne") else "FURNITURE"
    _add_filter(f"filter_char_{_op}", "customer", ["c_custkey", "c_mktsegment"], "c_mktsegment", _op, _char, literal=f"'{_char}'")
    _double = 45.0 if _op == "ge" else 10.0
    _add_filter(f"filter_double_{_op}", "lineitem", ["l_orderkey", "l_quantity"], "l_quantity", _op, _double, literal=str(_double))
    _bool = _op != "le"
    _add_filter(f"filter_bool_{_op}", "customer", ["c_custkey", "overdrawn"], "overdrawn", _op, _bool if _op != "gt" else False, literal=str(_bool if _op != "gt" else False).lower())
    _add_filter(f"filter_attr_{_op}", "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"], "l_partkey", _op, other="l_suppkey")

add_dialect("filter_same_table", "select l_orderkey, l_linenumber from lineitem a where a.l_partkey = a.l_suppkey")
add_dialect("filter_conjunction", "select o_orderkey from orders where o_orderstatus = 'F' and o_custkey = 7")


@add("index_lookup", "select * from orders where o_orderkey = 7")
def _index_lookup(spark, sf_dir):
    return O.index_lookup(table(spark, sf_dir, "orders"), "o_orderkey", 7)


@add("index_lookup_char", "select * from supplier where s_name = 'Supplier#000000000'")
def _index_lookup_char(spark, sf_dir):
    return O.index_lookup(table(spark, sf_dir, "supplier"), "s_name", "Supplier#000000000")


@add("index_scan_resolve", "select * from orders where o_orderkey = 7")
def _index_scan(spark, sf_dir):
    rows = O.table_scan(spark, f"{sf_dir}/orders.parquet", with_ids=True)
    return O.resolve(O.index_scan(rows, "o_orderkey", 7), rows)


@add("record_upsert", "select n_nationkey, case when n_nationkey < 5 then upper(n_name) || '!' else n_name end as n_name, n_regionkey from nation union all select 99, 'NEW', 1")
def _upsert(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    new = nation.where("n_nationkey < 5").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    return O.upsert(nation, new.union(spark.createDataFrame([(99, "NEW", 1)], "a int, b string, c int")), "n_nationkey")


@add("record_erase", "select * from customer where c_custkey not in (select o_custkey from orders)")
def _erase(spark, sf_dir):
    return O.erase(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_custkey"), "c_custkey")


# Joins

add_dialect("hash_join", "select n_nationkey, n_name, c_custkey, c_nationkey from nation, customer where n_nationkey = c_nationkey")
add_dialect("hash_join_three_way", "select n_name, c_name, o_orderkey from nation, customer, orders where n_nationkey = c_nationkey and c_custkey = o_custkey")
add_dialect("join_residual", "select c_custkey, s_name from customer, supplier where c_nationkey = s_nationkey and c_custkey = s_suppkey")
add_dialect("cross_product", "select r_name, n_name from region, nation")
add_dialect(
    "join_self", "select a.n_name, b.n_name from nation a, nation b where a.n_regionkey = b.n_regionkey",
    "select a.n_name as a_n_name, b.n_name as b_n_name from nation a, nation b where a.n_regionkey = b.n_regionkey",
)
add_dialect(
    "join_char_key", "select a.c_custkey, b.c_custkey from customer a, customer b where a.c_name = b.c_name",
    "select a.c_custkey as a_c_custkey, b.c_custkey as b_c_custkey from customer a, customer b where a.c_name = b.c_name",
)


@add("hash_join_operator", "select n_nationkey, n_name, n_regionkey, s_suppkey, s_name, s_nationkey, s_acctbal from nation join supplier on n_nationkey = s_nationkey")
def _hash_join(spark, sf_dir):
    return O.hash_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), 0, 2)


@add(
    "hash_join_last_wins",
    """with x as (select * from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
    select o_custkey, o_orderkey, c_name from x join customer on o_custkey = c_custkey""",
)
def _last_wins(spark, sf_dir):
    joined = O.hash_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", build="last_wins", sequence="o_orderkey")
    return O.project(joined, ["o_custkey", "o_orderkey", "c_name"])


@add("theta_join", "select r_regionkey, n_nationkey from region, nation where r_regionkey < n_regionkey")
def _theta(spark, sf_dir):
    both = O.cross_product(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"))
    return O.project(O.select(both, Comparison("r_regionkey", "lt", other="n_regionkey")), ["r_regionkey", "n_nationkey"])


# Sorting


def _positions(df: DataFrame) -> DataFrame:
    """The place of each row in a sorted DataFrame, for comparing orders; a report, so one task numbers the rows."""
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("pos", F.row_number().over(Window.orderBy("_at")).cast("int")).drop("_at")


@add("sort_multi_key", "select p_partkey, p_size, cast(row_number() over (order by p_size desc, p_partkey) as integer) as pos from part")
def _sort_multi(spark, sf_dir):
    return _positions(O.sort(O.project(table(spark, sf_dir, "part"), ["p_partkey", "p_size"]), [("p_size", True), ("p_partkey", False)]))


@add("sort_char", "select c_custkey, c_name, cast(row_number() over (order by c_mktsegment, c_custkey desc) as integer) as pos from customer")
def _sort_char(spark, sf_dir):
    df = O.project(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"])
    return O.project(_positions(O.sort(df, [("c_mktsegment", False), ("c_custkey", True)])), ["c_custkey", "c_name", "pos"])


_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@add("sort_external", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem")
def _sort_external(spark, sf_dir):
    return O.sort(O.project(table(spark, sf_dir, "lineitem"), _LINE_KEYS), [("l_partkey", False), ("l_suppkey", True)])


@add(
    "sort_external_order",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(row_number() over (order by l_partkey, l_suppkey desc, l_orderkey, l_linenumber desc) as integer) as pos from lineitem",
)
def _sort_external_order(spark, sf_dir):
    df = O.project(table(spark, sf_dir, "lineitem"), _LINE_KEYS)
    return _positions(O.sort(df, [("l_partkey", False), ("l_suppkey", True), ("l_orderkey", False), ("l_linenumber", True)]))


@add("sort_unsigned", "select x, cast(row_number() over (order by x < 0, x) as integer) as pos from (select p_partkey * case when p_partkey % 2 = 0 then -1 else 1 end as x from part)")
def _sort_unsigned(spark, sf_dir):
    x = F.col("p_partkey") * F.when(F.col("p_partkey") % 2 == 0, -1).otherwise(1)
    return _positions(O.sort_unsigned(table(spark, sf_dir, "part").select(x.alias("x")), "x"))


# Aggregation


@add("agg_global", "select min(c_name) as mn, max(c_name) as mx, cast(sum(c_nationkey) as bigint) as s, count(c_custkey) as n from customer")
def _agg_global(spark, sf_dir):
    calls = [AggregateCall("min", "c_name", "mn"), AggregateCall("max", "c_name", "mx"), AggregateCall("sum", "c_nationkey", "s"), AggregateCall("count", "c_custkey", "n")]
    return O.hash_aggregate(table(spark, sf_dir, "customer"), [], calls)


@add(
    "agg_grouped",
    "select l_returnflag, cast(sum(l_linenumber) as bigint) as s, count(l_orderkey) as n, min(l_shipdate) as mn, max(l_quantity) as mx from lineitem group by l_returnflag",
)
def _agg_grouped(spark, sf_dir):
    calls = [AggregateCall("sum", "l_linenumber", "s"), AggregateCall("count", "l_orderkey", "n"), AggregateCall("min", "l_shipdate", "mn"), AggregateCall("max", "l_quantity", "mx")]
    return O.hash_aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], calls)


@add("agg_multi_key", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by l_returnflag, l_linestatus")
def _agg_multi(spark, sf_dir):
    return O.hash_aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [AggregateCall("count", None, "n")])


@add("agg_distinct_keys", "select distinct l_returnflag, l_linestatus from lineitem")
def _agg_keys(spark, sf_dir):
    return O.hash_aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [])


@add("agg_empty_input", "select count(*) as n, max(l_quantity) as m from lineitem where l_quantity < 0 having count(*) > 0")
def _agg_empty(spark, sf_dir):
    none = O.select(table(spark, sf_dir, "lineitem"), Comparison("l_quantity", "lt", 0.0))
    return O.hash_aggregate(none, [], [AggregateCall("count", None, "n"), AggregateCall("max", "l_quantity", "m")])


# Set operations

for _name, _op in (("union", "union"), ("union_all", "union all"), ("intersect", "intersect"), ("intersect_all", "intersect all"), ("except_all", "except all")):
    _text = f"select c_nationkey from customer {_op} select s_nationkey from supplier"
    add_dialect(f"set_{_name}", _text, _text.replace("c_nationkey", "c_nationkey as k", 1), ["k"])
add_dialect(
    "set_except", "select o_custkey from orders except select c_custkey from customer where c_nationkey = 3",
    "select o_custkey as k from orders except select c_custkey from customer where c_nationkey = 3", ["k"],
)
for _name, _text in (
    ("set_precedence", "select n_nationkey from nation union select c_nationkey from customer intersect select s_nationkey from supplier"),
    ("set_parenthesised", "(select n_nationkey from nation union select c_nationkey from customer) intersect select s_nationkey from supplier"),
):
    add_dialect(_name, _text, _text.replace("n_nationkey", "n_nationkey as k", 1), ["k"])
add_dialect(
    "set_multi_column", "select c_nationkey, c_mktsegment from customer except select c_nationkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'",
    "select c_nationkey as k, c_mktsegment as s from customer except select c_nationkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'", ["k", "s"],
)


# Definitions and loading, in a folder of their own


def _own(spark: SparkSession) -> tuple[Session, str]:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
    root = f"{base.rstrip('/')}/quarry-tables-{uuid.uuid4().hex[:12]}"
    return Session(spark, root), root


@add("sql_copy_roundtrip", "select n_nationkey, n_name, n_regionkey from nation")
def _copy(spark, sf_dir):
    db, root = _own(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(f"{root}/nation.csv")
    db.execute("create table nation (n_nationkey integer, n_name char(25), n_regionkey integer, primary key (n_nationkey))")
    db.execute(f"copy nation from '{root}/nation.csv' csv header")
    return db.query("select * from nation")


@add("sql_ddl_insert_select", "select * from (values (1, 'foo'), (2, 'bar')) t(a, b)")
def _insert(spark, sf_dir):
    db, _ = _own(spark)
    for s in ("create table t (a int, b char(8), primary key (a))", "create index t_b on t (b)", "insert into t values (1, 'foo')", "insert into t values (2, 'bar')"):
        db.execute(s)
    return db.query("select * from t")


@add("sql_erase_upsert", "select n_nationkey, n_name from nation where n_regionkey <> 2 and n_nationkey <> 3 union all select 3, 'THREE'")
def _change(spark, sf_dir):
    db, _ = _own(spark)
    db.execute("create table t (k int, name char(25), region int, primary key (k))")
    db.upsert("t", table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    db.erase("t", Comparison("region", "eq", 2))
    db.upsert("t", spark.createDataFrame([(3, "THREE", 0)], "a int, b string, c int"))
    return db.query("select k, name from t").toDF("n_nationkey", "n_name")


@add("sql_drop_create", "select * from (values (3)) t(b)")
def _drop(spark, sf_dir):
    db, _ = _own(spark)
    for s in ("create table t (a int, primary key (a))", "insert into t values (1)", "drop table t", "create table t (b int)", "insert into t values (3)"):
        db.execute(s)
    return db.query("select * from t")


@add("text_output", "select r_regionkey || ',' || r_name as line, cast(row_number() over (order by r_regionkey desc) - 1 as integer) as pos from region")
def _text_output(spark, sf_dir):
    text = O.print_text(O.sort(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), [(0, True)]))
    return spark.createDataFrame([(x, i) for i, x in enumerate(text.splitlines())], "line string, pos int")


# Grouping and ordering in the dialect

_FLAGSHIP = """select n_name, count(*), min(o_orderkey) from nation, customer, orders
    where n_nationkey = c_nationkey and c_custkey = o_custkey and o_orderstatus = 'F' group by n_name order by n_name"""
_FLAGSHIP_SQL = """select n_name, count(*) as n, min(o_orderkey) as first_order from nation, customer, orders
    where n_nationkey = c_nationkey and c_custkey = o_custkey and o_orderstatus = 'F' group by n_name"""
add_dialect("sql_flagship", _FLAGSHIP, _FLAGSHIP_SQL, ["n_name", "n", "first_order"])


@add("sql_order_by", f"select *, cast(row_number() over (order by n desc, first_order) as integer) as pos from ({_FLAGSHIP_SQL})")
def _order_by(spark, sf_dir):
    text = _FLAGSHIP.replace("order by n_name", "order by 2 desc, 3")
    return _positions(session(spark, sf_dir).query(text).toDF("n_name", "n", "first_order"))
