"""The pipeline's stages on test tables, each against what its own input asks for."""

import os

import pytest

import corpus_pipeline as P
from quarry.llm.common import stage, table
from quarry.llm.registry import ORACLE_SQL, QUERIES
from tests.llm.helpers import SPACE, components
from tests.llm.helpers import docs as awkward_docs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, step in P.STAGES:
        before = docs
        docs = stage(step(spark, docs, SF), name)
        seen.append((name, before, docs))
        if name != "encoding":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    text = {n: {r.doc_id: r.text for r in b.collect()} for n, b, _ in seen}
    after = {n: ids(a) for n, _, a in seen}
    assert after["toxicity"] <= text["toxicity"].keys()
    groups = {}
    for i, t in text["exact_dedup"].items():
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    assert after["exact_dedup"] == {min(g) for g in groups.values()}
    near = components(text["near_dedup"], 5, 80)
    assert after["near_dedup"] == {i for i, c in near.items() if i == c}
    assert after["mixing"] <= text["mixing"].keys() and after["encoding"] == after["mixing"]
    last = seen[-1][2].collect()
    assert all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in last) and len(last) == seen[-1][1].count()


def test_run(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "encoding"]
    assert P.run(spark, SF).count() > 0


def test_awkward_tables(spark):
    """Nulls in every column, repeated rows, clashing names, and an empty table, through every stage."""
    more = ["_row", "id", "text2", "n", "kept", "score", "size", "copies", "h", "component"]
    df = awkward_docs(spark).selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(more)])
    for table_ in (df, df.where("false")):
        now = table_
        for name, step in P.STAGES:
            was, now = now, stage(step(spark, now, SF), f"awkward-{name}")
            if name != "encoding":
                assert now.columns == df.columns
        assert now.columns == ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity", "ids"] and now.count() == was.count()
        assert now.where("not parity or not round_trip").count() == 0
        assert bool(now.count()) == bool(table_.count())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_registered_queries_run_whole(spark, name):
    """Each registered query without SQL over a whole table: as many rows as its contract asks for, every key once."""
    got = QUERIES[name](spark, SF).toPandas()
    kind = name.split("_")[0]
    if kind == "op8":
        vectors = table(spark, SF, "embeddings")
        asked = vectors.where("vec_id % 20 = 0 and embedding is not null").count()
        assert got["query_id"].nunique() == asked and set(got.groupby("query_id").size()) == {min(20, vectors.where("embedding is not null").count() - 1)}
        assert (got.sort_values(["query_id", "rank"]).groupby("query_id")["score"].diff().dropna() <= 0).all()
        return
    key, source = ("page_id", "pages") if kind == "op9" else ("doc_id", "documents")
    want = [r[0] for r in table(spark, SF, source).select(key).collect()]
    assert sorted(got[key]) == sorted(want)
    columns = {
        "op1": {"held_out", "score", "predicted"}, "op2": {"size", "source_size", "target", "taken"}, "op3": {"start", "n_tokens", "ids_crc32"}, "op4": {"held_out", "lang_pred", "score"},
        "op9": {"url", "text", "n_chars"}, "op10": {"n_tokens", "ids_crc32", "round_trip", "parity"},
    }[kind]
    assert columns <= set(got.columns)
    if kind == "op10":
        assert got["parity"].all() and got["round_trip"].all()
    if kind == "op3":
        ordered = got.sort_values("doc_id")
        assert (ordered["start"] == ordered["n_tokens"].cumsum() - ordered["n_tokens"]).all()


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.sql(ORACLE_SQL[name]).df()
    told = lambda df: sorted(map(str, df[sorted(want.columns)].itertuples(index=False, name=None)))
    assert told(got) == told(want)
