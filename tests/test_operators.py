"""Operators on the small fixtures: students, grades, two bags of integers."""

import math

import pytest

from quarry import operators as O
from quarry.operators import AggregateCall, Comparison

NAMES = [(24002, "Xenokrates      "), (26120, "Fichte          "), (29555, "Feuerbach       ")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def students(spark):
    return spark.createDataFrame(NAMES, "id long, name string")


@pytest.fixture(scope="module")
def grades(spark):
    return spark.createDataFrame([(24002, 5001, 1), (24002, 5041, 2), (29555, 4630, 2)], "student long, course long, grade long")


@pytest.fixture(scope="module")
def bags(spark):
    make = lambda xs: spark.createDataFrame([(x,) for x in xs], "x long")
    return make([1, 1, 2, 3, 3, 3]), make([2, 4, 4, 3, 3])


@pytest.mark.parametrize(
    "op, value, kept", [("eq", 26120, [1]), ("ne", 26120, [0, 2]), ("lt", 25000, [0]), ("le", 25000, [0]), ("gt", 25000, [1, 2]), ("ge", 25000, [1, 2])]
)
def test_select_integer(students, op, value, kept):
    assert rows(O.select(students, Comparison(0, op, value))) == sorted((NAMES[i] for i in kept), key=str)


def test_select_text_is_exact_about_spaces(students):
    assert rows(O.select(students, Comparison("name", "eq", "Fichte"))) == []
    assert rows(O.select(students, Comparison("name", "eq", "Fichte          "))) == [NAMES[1]]


def test_select_text_compares_bytes(spark):
    df = spark.createDataFrame([("B",), ("a",), ("ab",), ("b",), ("é",)], "s string")
    assert [r[0] for r in O.sort(df, [(0, False)]).collect()] == ["B", "a", "ab", "b", "é"]
    assert rows(O.select(df, Comparison(0, "gt", "a"))) == [("ab",), ("b",), ("é",)]


def test_select_attributes(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (3, 2)], "a long, b long")
    assert rows(O.select(df, Comparison(0, "ge", other=1))) == [(1, 1), (2, 1), (3, 2)]


@pytest.mark.parametrize("op, kept", [("eq", [1.0]), ("ne", [0.0, 2.0, math.nan]), ("lt", [0.0]), ("le", [0.0, 1.0]), ("gt", [2.0]), ("ge", [1.0, 2.0])])
def test_select_double_with_nan(spark, op, kept):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (math.nan,)], "x double")
    assert [str(r[0]) for r in rows(O.select(df, Comparison(0, op, 1.0)))] == [str(x) for x in kept]


@pytest.mark.parametrize("op, kept", [("eq", [True]), ("ne", [False]), ("lt", [False]), ("le", [False, True]), ("gt", []), ("ge", [True])])
def test_select_bool(spark, op, kept):
    df = spark.createDataFrame([(True,), (False,)], "x boolean")
    assert [r[0] for r in rows(O.select(df, Comparison(0, op, True)))] == kept


def test_project_reorders_and_repeats(students):
    out = O.project(students, [1, 0, 1])
    assert out.columns == ["name", "id", "name_2"]
    assert rows(out)[0] == ("Feuerbach       ", 29555, "Feuerbach       ")


def test_sort(grades):
    assert [tuple(r) for r in O.sort(grades, [(0, True), (2, False)]).collect()] == [(29555, 4630, 2), (24002, 5001, 1), (24002, 5041, 2)]


def test_sort_many(spark):
    values = [((i * 2654435761) & 0xFFFF, i) for i in range(500)]
    got = [r[0] for r in O.sort(spark.createDataFrame(values, "k long, v long"), [(0, False)]).collect()]
    assert got == sorted(k for k, _ in values)


def test_hash_join(students, grades):
    out = O.hash_join(students, grades, 0, 0)
    assert out.columns == ["id", "name", "student", "course", "grade"]
    assert rows(out) == [(*NAMES[0], 24002, 5001, 1), (*NAMES[0], 24002, 5041, 2), (*NAMES[2], 29555, 4630, 2)]


def test_hash_join_last_wins(grades, students):
    assert rows(O.project(O.hash_join(grades, students, 0, 0, build="last_wins", sequence=1), [1, 3])) == [(4630, 29555), (5041, 24002)]


def test_last_wins_ties_dont_depend_on_partitions(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 5, "c"), (1, 5, "b"), (1, 4, "z"), (2, None, "x")], "k int, at int, v string")
    right = spark.createDataFrame([(1,), (2,)], "k int")
    for n in (1, 2, 5):
        assert rows(O.project(O.hash_join(left.repartition(n), right, 0, 0, build="last_wins", sequence=1), ["v"])) == [("c",), ("x",)]


def test_resolve(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as k").repartition(4).write.parquet(f"{tmp_path}/t")
    t = O.table_scan(spark, f"{tmp_path}/t", with_ids=True)
    at = O.index_scan(t, "k", 3)
    want = [(i, 3) for i in range(100) if i % 7 == 3]
    got = lambda *args, **more: sorted(map(tuple, O.resolve(*args, **more).collect()))
    assert got(at, t) == got(at, t, few=2) == want
    assert got(at.union(at), t) == got(at.union(at), t, few=2) == sorted(want * 2)
    assert O.resolve(at.limit(0), t).collect() == []
    one = O.resolve(O.index_scan(t, "id", 5), t)
    assert [tuple(r) for r in one.collect()] == [(5, 5)]
    scans = [x for x in one._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert len(scans) == 1 and "file_name" in scans[0].partition("PartitionFilters")[2] + scans[0].partition("DataFilters")[2]


@pytest.mark.parametrize("rows_", [[(i * 7919 % 1000, "w" * 150 + str(i)) for i in range(3000)], [(1, "same")] * 500, [(i, "") for i in range(500, 0, -1)], []])
def test_external_sorts(spark, rows_):
    """Wide rows, equal rows, rows in falling order, none; over partitions as they come."""
    df = spark.createDataFrame(rows_, "k int, v string").repartition(3) if rows_ else spark.createDataFrame([], "k int, v string")
    got = [tuple(r) for r in O.sort(df, [(0, False), (1, True)]).collect()]
    assert got == sorted(sorted(rows_, key=lambda r: r[1], reverse=True), key=lambda r: r[0])


def test_sort_spills(spark):
    """A sorter held to few rows in memory goes through its spill files and gives the same order."""
    key = "spark.sql.windowExec.buffer.spill.threshold"
    spark.conf.set("spark.sql.sortMergeJoinExec.buffer.spill.threshold", "100")
    spark.conf.set(key, "100")
    spark.sparkContext._jsc.sc().conf().set("spark.shuffle.spill.numElementsForceSpillThreshold", "500")
    try:
        df = spark.range(20_000).selectExpr("(id * 7919) % 20011 as k", "repeat('x', 100) as v")
        got = [r.k for r in O.sort(df.repartition(2), [(0, True)]).collect()]
        assert got == sorted(((i * 7919) % 20011 for i in range(20_000)), reverse=True)
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.sortMergeJoinExec.buffer.spill.threshold")
        spark.sparkContext._jsc.sc().conf().remove("spark.shuffle.spill.numElementsForceSpillThreshold")


def test_join_with_itself(students):
    assert O.hash_join(students, students, 0, 0).columns == ["id", "name", "id_2", "name_2"]
    assert O.hash_join(students, students, 0, 0).count() == 3


def test_join_nan_never_matches(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,)], "x double")
    assert rows(O.hash_join(df, df, 0, 0)) == [(1.0, 1.0)]


def test_cross_product(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x long") for xs in ([1, 2], [10, 20, 30]))
    assert rows(O.cross_product(a, b)) == [(x, y) for x in (1, 2) for y in (10, 20, 30)]
    assert O.cross_product(a.where("false"), b).count() == O.cross_product(a, b.where("false")).count() == 0


def test_aggregates(students, grades):
    assert rows(O.hash_aggregate(students, [], [AggregateCall("min", 1), AggregateCall("max", 1)])) == [("Feuerbach       ", "Xenokrates      ")]
    assert rows(O.hash_aggregate(grades, [0], [AggregateCall("sum", 2), AggregateCall("count", 1)])) == [(24002, 3, 2), (29555, 2, 1)]


def test_aggregate_corners(grades):
    empty = grades.where("false")
    assert rows(O.hash_aggregate(empty, [], [AggregateCall("count")])) == []
    assert rows(O.hash_aggregate(empty, [0], [AggregateCall("count")])) == []
    assert rows(O.hash_aggregate(grades, [0], [])) == [(24002,), (29555,)]
    with pytest.raises(ValueError):
        O.hash_aggregate(grades, [], [AggregateCall("avg", 0)])


def test_sum_overflow_is_an_error(spark):
    df = spark.createDataFrame([((1 << 63) - 1,), (1,)], "x long")
    with pytest.raises(Exception, match="(?i)overflow"):
        O.hash_aggregate(df, [], [AggregateCall("sum", 0)]).collect()


@pytest.mark.parametrize(
    "op, expected",
    [
        (O.union, [1, 2, 3, 4]), (O.union_all, [1, 1, 2, 2, 3, 3, 3, 3, 3, 4, 4]), (O.intersect, [2, 3]), (O.intersect_all, [2, 3, 3]),
        (O.except_, [1]), (O.except_all, [1, 1, 3]),
    ],
)
def test_sets(bags, op, expected):
    assert [r[0] for r in rows(op(*bags))] == expected


def test_sets_check_types(bags, students):
    with pytest.raises(ValueError, match="column counts"):
        O.union(bags[0], students)
    with pytest.raises(ValueError, match="incompatible"):
        O.union(bags[0], students.select("name"))


def test_print(spark):
    df = spark.createDataFrame([(1, "a,b", 1.5, True)], "i long, s string, d double, b boolean")
    assert O.print_text(df) == "1,a,b,1.5,true\n"
    assert O.print_text(df.where("false")) == ""


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as other", "id * 3 as third").write.parquet(f"{tmp_path}/t")
    df = O.project(O.index_lookup(spark.read.parquet(f"{tmp_path}/t"), "id", 7), ["other"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan and "third" not in plan
    assert rows(df) == [(14,)]
