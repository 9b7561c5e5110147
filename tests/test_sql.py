"""The dialect: tokens, trees, binding errors, and statements end to end."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.cli import main
from quarry.operators import Comparison
from quarry.session import Session
from quarry.sql import nodes as N
from quarry.sql.errors import BindError, CSVError, DuplicateKey, DuplicateTable, LexError, ParseError
from quarry.sql.lexer import split_statements, tokenize
from quarry.sql.parser import parse
from quarry.types import EngineType, coerce, coerce_value


def kinds(text):
    return [(t.kind, t.value) for t in tokenize(text)][:-1]


def test_tokens():
    assert kinds("SeLeCt Foo, -12 3.5 1e3 'a\\n\\'x' \"b\" != true") == [
        ("keyword", "select"), ("name", "Foo"), ("symbol", ","), ("integer", -12), ("double", 3.5), ("double", 1000.0), ("string", "a\n'x"), ("string", "b"), ("symbol", "!="), ("keyword", "true"),
    ]


def test_positions():
    t = tokenize("select\n  x")[1]
    assert (t.at.line, t.at.column) == (2, 3)


@pytest.mark.parametrize("text, where", [("select 'abc", "1:8"), ("a\n < b", "2:2"), ("#", "1:1")])
def test_lex_errors(text, where):
    with pytest.raises(LexError, match=f"lex error {where}: "):
        tokenize(text)


@pytest.mark.parametrize(
    "text",
    ["select from t", "select a t", "select a from t where a < 3", "select a from t where 3 = a", "select a from t as x y", "create table t (a float)", "create table t (a char(0))", "select a from t; select b from t", "insert into t values (a)", "copy t from x csv", "select a from (select b from t)", ""],
)
def test_parse_errors(text):
    with pytest.raises((ParseError, LexError)):
        parse(text)


def test_set_precedence():
    tree = parse("select a from t union select a from u intersect all select a from v except select a from w;")
    assert (tree.op, tree.left.op, tree.left.right.op, tree.left.right.all) == ("except", "union", "intersect", True)
    tree = parse("(select a from t union select a from u) intersect select a from v")
    assert (tree.op, tree.left.op) == ("intersect", "union")


def test_create_table_tree():
    tree = parse("create table t (a int, primary key (a), b CHAR(8))")
    assert [str(k) for _, k in tree.columns] == ["INTEGER", "CHAR(8)"] and tree.key == ("a",)


def test_split_statements():
    assert split_statements("select 'a;b'; ; drop table t; rest") == (["select 'a;b';", "drop table t;"], "rest")


@pytest.fixture()
def db(spark, tmp_path):
    with Session(spark, f"{tmp_path}/db") as s:
        yield s


@pytest.fixture()
def school(db):
    db.execute("create table studenten (matrnr integer, name char(16), semester integer, primary key (matrnr))")
    db.execute("create table hoeren (matrnr integer, vorlnr integer, primary key (matrnr, vorlnr))")
    for v in ((24002, "Xenokrates      ", 18), (26120, "Fichte          ", 10), (29555, "Feuerbach       ", 2)):
        db.execute(f"insert into studenten values ({v[0]}, '{v[1]}', {v[2]})")
    for a, b in ((24002, 5001), (24002, 5041), (26120, 5022)):
        db.execute(f"insert into hoeren values ({a}, {b})")
    return db


def lines(text):
    return sorted(text.splitlines())


def test_select(school):
    assert lines(school.execute("select * from studenten s")) == ["24002,Xenokrates      ,18", "26120,Fichte          ,10", "29555,Feuerbach       ,2"]
    assert school.execute("select s.name from studenten s where s.matrnr = 26120;") == "Fichte          \n"
    assert lines(school.execute("select s.name, h.vorlnr from studenten s, hoeren h where s.matrnr = h.matrnr")) == ["Fichte          ,5022", "Xenokrates      ,5001", "Xenokrates      ,5041"]
    assert lines(school.execute("select a.matrnr, b.matrnr from studenten a, studenten b where a.semester = b.semester and a.matrnr = a.matrnr")) == ["24002,24002", "26120,26120", "29555,29555"]
    assert len(lines(school.execute("select s.matrnr from studenten s, hoeren h"))) == 9


def test_duplicate_left_keys_all_join(school):
    assert len(lines(school.execute("select h.vorlnr from hoeren h, studenten s where h.matrnr = s.matrnr"))) == 3


def test_group_and_order(school):
    assert school.execute("select matrnr, count(*), max(vorlnr) from hoeren group by matrnr order by 2 desc, matrnr") == "24002,2,5041\n26120,1,5022\n"
    assert school.execute("select count(*) from hoeren where vorlnr = 1") == ""


@pytest.mark.parametrize(
    "text, message",
    [
        ("select * from nope", "unknown relation `nope`"), ("select x.name from studenten s", "unknown relation `x`"), ("select s.nope from studenten s", "has no attribute"),
        ("select nope from studenten", "unknown attribute"), ("select Name from studenten", "unknown attribute"), ("select matrnr from studenten, hoeren", "ambiguous"), ("select * from studenten s, hoeren s", "duplicate relation alias"),
        ("select name from studenten where matrnr = 'x'", "does not match"), ("select name from studenten where name = 3", "does not match"), ("select name from studenten where matrnr = 1.5", "does not match"),
        ("select name from studenten where matrnr = true", "does not match"), ("select * from studenten s, hoeren h where s.name = h.vorlnr", "incompatible types"),
        ("select matrnr, name from studenten union select matrnr from hoeren", "different column counts"), ("select name from studenten union select matrnr from hoeren", "incompatible types"),
        ("insert into nope values (1)", "no such table"), ("insert into hoeren values (1)", "has 2 columns, got 1 values"), ("insert into hoeren values (1, 'x')", "does not match"),
        ("drop table nope", "no such table"), ("create index i on nope (a)", "no such table"), ("create index i on hoeren (nope)", "no column"), ("create index pk_studenten on hoeren (vorlnr)", "exists"),
        ("create table t (a int, primary key (b))", "no column"), ("select name, count(*) from studenten", "neither grouped"), ("select matrnr from studenten order by 2", "no output column"),
    ],
)
def test_bind_errors(school, text, message):
    with pytest.raises(BindError, match=message):
        school.execute(text)


def test_char_widths_must_match(db):
    db.execute("create table a (x char(8))")
    db.execute("create table b (y char(9))")
    with pytest.raises(BindError, match="incompatible"):
        db.execute("select x from a union select y from b")


@pytest.mark.parametrize(
    "op, expected", [("union", "1 2 3 4"), ("union all", "1 2 3 3 3 4"), ("intersect", "3"), ("except", "1 2"), ("except all", "1 2 3"), ("intersect all", "3")]
)
def test_sets(db, op, expected):
    for name, values in (("t", (1, 2, 3, 3)), ("u", (3, 4))):
        db.execute(f"create table {name} (a int)")
        for v in values:
            db.execute(f"insert into {name} values ({v})")
    assert lines(db.execute(f"select a from t {op} select a from u")) == expected.split()


def test_statements_say_what_they_did(db, tmp_path):
    (tmp_path / "t.csv").write_text("1,alice\n2,bob\n3,carol\n")
    assert db.execute("create table t (id int, name char(8))") == "CREATE TABLE\n"
    assert db.execute(f"copy t from '{tmp_path}/t.csv' csv;") == "COPY 3\n"
    assert db.execute("insert into t values (4, 'dave')") == "INSERT 1\n"
    assert db.execute("create index t_id on t (id)") == "CREATE INDEX\n"
    assert lines(db.execute("select * from t")) == ["1,alice", "2,bob", "3,carol", "4,dave"]
    assert db.execute("drop table t") == "DROP TABLE\n"
    db.execute("create table t (id int)")
    assert db.execute("select * from t") == ""
    with pytest.raises(DuplicateTable):
        db.execute("create table t (id int)")


def test_storage_coerces(db, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n99999999999,aé€x\n+7,"x ""y"", z"\n\n 5 ,\n-3,"two\nlines"\nx,ab\n')
    db.execute("create table t (a int, b char(4))")
    assert db.execute(f"copy t from '{tmp_path}/t.csv' csv header") == "COPY 5\n"
    assert sorted(map(tuple, db.query("select * from t").collect())) == [(-3, "two\n"), (0, ""), (0, "ab"), (0, "aé\ufffd"), (7, 'x "y')]


def test_copy_crlf(db, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"1,a\r\n\r\n2,b\r\n")
    db.execute("create table t (a int, b char(4))")
    assert db.execute(f"copy t from '{tmp_path}/t.csv' csv") == "COPY 2\n"
    assert lines(db.execute("select * from t")) == ["1,a", "2,b"]


def test_copy_is_strict_and_whole(db, tmp_path):
    db.execute("create table t (a int, b char(4), primary key (a))")
    for text, error in (("1,a\n2\n", CSVError), ('1,a\n2,"b\n', CSVError), ("1,a\n1,b\n", DuplicateKey), ("1,a,c\n", CSVError)):
        (tmp_path / "t.csv").write_text(text)
        with pytest.raises(error):
            db.execute(f"copy t from '{tmp_path}/t.csv' csv")
    with pytest.raises(CSVError):
        db.execute(f"copy t from '{tmp_path}/nope.csv' csv")
    assert db.execute("select * from t") == ""


def test_keys_are_unique(spark, tmp_path):
    with Session(spark, f"{tmp_path}/db") as db:
        db.execute("create table t (a int, b char(8), primary key (a))")
        db.execute("insert into t values (7, 'dup')")
        with pytest.raises(DuplicateKey):
            db.execute("insert into t values (7, 'x')")
        db.execute("insert into t values (8, 'dup')")
        with pytest.raises(DuplicateKey):
            db.execute("create index idx_b on t (b)")
        assert db.catalog.index("idx_b") is None
    with Session(spark, f"{tmp_path}/db") as db:
        with pytest.raises(DuplicateKey):
            db.execute("insert into t values (7, 'again')")
        assert db.execute("select b from t where a = 8") == "dup\n"
        assert db.execute("select b from t where a = 999") == ""


def test_many_keyed_inserts_are_quick(spark, tmp_path, monkeypatch):
    from quarry import session

    with Session(spark, f"{tmp_path}/db") as db:
        db.execute("create table t (a int, b char(3), primary key (a))")
        db.execute("create index t_b on t (b)")
        start = time.monotonic()
        for i in range(1500):  # written once on the way
            db.execute(f"insert into t values ({i}, '{chr(97 + i % 26)}{chr(97 + i // 26)}')")
        assert time.monotonic() - start < 30
        for text in ("insert into t values (3, 'zzz')", "insert into t values (2000, 'aa ')", "insert into t values (1499, 'zzz')"):
            if "2000" in text:
                db.execute(text)  # cut at three bytes it is another key
            else:
                with pytest.raises(DuplicateKey):
                    db.execute(text)
        assert db.query("select a from t").count() == 1501
        monkeypatch.setattr(session, "MOST_KEYS", 10)
        db._forget("t")
        with pytest.raises(DuplicateKey):
            db.execute("insert into t values (700, 'yyy')")
        db.execute("insert into t values (5000, 'yyy')")
        db.erase("t", Comparison("a", "eq", 700))
        db.execute("insert into t values (700, 'xxx')")


@pytest.mark.parametrize("text", ["7", "+7", "-0", " 5", "99999999999", "-2147483648", "2147483648", "x", "", "٣", "aé€x", "ab\0cd", "😀z", "1" * 50])
def test_values_are_coerced_alike(spark, text):
    for kind in (EngineType("INTEGER"), EngineType("CHAR", 4)):
        stored = spark.createDataFrame([(text,)], "t string").select(coerce(F.col("t"), kind)).first()[0]
        assert stored == coerce_value(text, kind)


def test_composite_key_is_not_enforced(school):
    assert school.execute("insert into hoeren values (24002, 5001)") == "INSERT 1\n"


def test_erase_and_upsert(spark, tmp_path):
    with Session(spark, f"{tmp_path}/db") as db:
        db.execute("create table t (a int, b char(3), primary key (a))")
        for a, b in ((1, "x"), (2, "y"), (3, "y")):
            db.execute(f"insert into t values ({a}, '{b}')")
        db.upsert("t", spark.createDataFrame([(3, "zzzz"), (4, None)], "k long, v string"))
        db.erase("t", Comparison("b", "eq", "y"))
        assert lines(db.execute("select * from t")) == ["1,x", "3,zzz", "4,"]
        with pytest.raises(DuplicateKey):
            db.upsert("t", spark.createDataFrame([(5, "a"), (5, "b")], "k long, v string"))
    with Session(spark, f"{tmp_path}/db") as db:
        assert lines(db.execute("select a from t")) == ["1", "3", "4"]


def test_registered_frames(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(1, 1.5, True)], "a long, d double, b boolean"))
    assert s.execute("select a from t where d = 1.5 and b = true") == "1\n"


def test_cli(spark, tmp_path, capsys):
    db = f"{tmp_path}/db"
    assert main([db, "-c", "create table t (a int); insert into t values (5); select * from t"]) == 0
    assert capsys.readouterr().out == "CREATE TABLE\nINSERT 1\n5\n"
    (tmp_path / "s.sql").write_text("select a from t where a = 5;\nselect nope from t;\n")
    assert main([db, "-f", f"{tmp_path}/s.sql"]) == 1
    got = capsys.readouterr()
    assert got.out == "5\n" and "bind error" in got.err
    assert main([db, "--open-only"]) == 0
