"""Mixing: targets by water filling, rates by the dual, whole copies near the targets."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.llm.mixing import mix, take_copies
from tests.llm.helpers import WORD, awkward, docs


def brute_targets(rows):
    size = {}
    for _, text, _, source, _ in rows:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        share = {s: 3 * size[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and share[s] > 3 * size[s]}
        if not over:
            return size, share
        capped |= over


def many():
    return [(i, " ".join(["w"] * (1 + (i * i) % 97)), "en", f"s{(i % 7) if i % 3 else 0}", 1) for i in range(600)] + [(1000 + i, "a b", "en", "tiny", 1) for i in range(3)]


@pytest.mark.parametrize("rows", [awkward(), many()], ids=["awkward", "many"])
def test_mix(spark, rows):
    size, target = brute_targets(rows)
    got = mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id] if r.doc_id is not None else "b"
        assert r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
    if len(rows) > 100:
        for s, t in target.items():
            assert abs(taken[s] - t) <= max(2, 0.01 * t), (s, taken[s], t)
    assert sum(target.values()) == pytest.approx(sum(size.values()))


def test_capped_source_is_taken_three_times(spark):
    got = {r.doc_id: r.copies for r in mix(docs(spark, many())).collect()}
    assert [got[1000 + i] for i in range(3)] == [3, 3, 3]


def test_reruns_agree(spark):
    told = lambda parts: sorted(map(tuple, mix(docs(spark, many()).repartition(parts)).collect()))
    assert told(1) == told(7)


def test_parts_change_no_rank(spark, monkeypatch):
    """Every copy is the same, however many parts a class is ranked in."""
    from quarry.llm import mixing

    rows = [(i, "a b c" if i % 5 else "a b", "en", "x" if i % 3 else "y", 1) for i in range(400)]
    told = lambda: sorted(map(tuple, mix(docs(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "TOGETHER", 10_000)
    whole = told()
    for together in (256, 10, 1):
        monkeypatch.setattr(mixing, "TOGETHER", together)
        assert told() == whole


def test_rates_solve_the_dual(spark):
    """Each source's tilt, by bisection on all its documents."""
    from quarry.llm import mixing

    rows = many() + awkward()
    hist = mixing.sizes(docs(spark, rows)).groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = mixing.targets(hist)
    size, target = brute_targets(rows)
    for r in mixing.balance(hist.where("size > 0"), goal).collect():
        own = [n for n in (len(WORD.findall(t or "")) for _, t, _, s, _ in rows if s == r.src) if n]
        mean = max(size[r.src] / sum(1 for x in rows if x[3] == r.src), 1.0)
        if r.lam is None:
            assert target[r.src] == pytest.approx(3 * size[r.src])
            continue
        taken = lambda lam: sum(n * 3 / (1 + 2 * math.exp(-max(min(lam * n / mean, 700), -700))) for n in own)  # noqa: E731, B023
        lo, hi = -1e4, 1e4
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if taken((lo + hi) / 2) < target[r.src] else (lo, (lo + hi) / 2)
        assert r.lam == pytest.approx(lo, abs=1e-6)


def test_a_miss_is_an_error(spark):
    from quarry.llm import mixing

    hist = mixing.sizes(docs(spark, many())).groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"))
    with pytest.raises(RuntimeError, match="miss"):
        mixing.balance(hist, mixing.targets(hist), most=1)


def test_numbered(spark):
    df = spark.range(500).selectExpr("id", "case when id % 50 = 0 then null else cast(id as string) end as x").repartition(7)
    rows = sorted(mixing_numbered(df), key=lambda r: r[1])
    assert [p for _, p in rows] == list(range(500))
    names = [x for x, _ in rows]
    assert names == sorted(names, key=lambda x: (x is None, x or ""))


def mixing_numbered(df):
    from quarry.llm import mixing

    return [(r.x, r.place) for r in mixing.numbered(df, F.col("x").asc_nulls_last()).collect()]


def test_take_copies(spark):
    df = docs(spark, many()).selectExpr("*", "1 as size", "2 as copies", "3 as _id", "4 as `a.b`")
    out = take_copies(df)
    assert out.columns == df.columns
    want = {r.doc_id: r.copies for r in mix(docs(spark, many())).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
    assert mix(docs(spark, [])).count() == 0 and take_copies(docs(spark, [])).count() == 0
    assert mix(docs(spark, [(1, None, None, None, None), (2, "", None, "a", None)])).where("taken = 0").count() == 2
