"""Exact and near deduplication against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import shingles as S
from quarry.llm.components import connected
from quarry.llm.exact_dedup import exact_dedup, grow_directory, keep_first
from quarry.llm.neardup import keep_one, near_dedup
from tests.llm.helpers import DOCS, SPACE, awkward, components, docs, long_text, sha, shingles


def brute_exact(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(SPACE.sub(" ", text or ""), []).append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha(norm)) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_bytes, owner_bytes", [(64 << 20, 64 << 20), (50, 100), (1, 1)])
def test_exact(spark, bucket_bytes, owner_bytes):
    got = exact_dedup(docs(spark), bucket_bytes=bucket_bytes, owner_bytes=owner_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(awkward())


def many_copies():
    return awkward() + [(1000 + i, "one text  in\tmany copies" if i % 3 else f"own {i % 40}", "en", "s", 1) for i in range(500)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_with_hot_hashes_and_chains(spark, monkeypatch, weak):
    """Copies beyond the hot bound, and a hash that many texts share: their bytes decide."""
    from quarry.llm import exact_dedup as E

    monkeypatch.setattr(E, "HOT", 6)
    hash_of = (lambda c: F.shiftleft((F.octet_length(c) % 3).cast("long"), 62)) if weak else F.xxhash64
    got = exact_dedup(docs(spark, many_copies()), bucket_bytes=500, hash_of=hash_of)
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(many_copies())


def test_the_index_gives_the_result(spark):
    """Buckets split, each entry stands in the bucket that the directory names, and rows are found through both."""
    from quarry.llm import exact_dedup as E

    df = docs(spark, many_copies())
    texts = df.select(F.col("doc_id").alias("id"), E.normalise().alias("norm")).withColumn("h", F.xxhash64("norm"))
    prints = texts.select("id", "h", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"))
    index = E.build_index(texts, prints, 500, 2000)
    slots = {r.slot: r.bucket for r in index.directory.collect()}
    assert index.depth > 2 and len(slots) == 1 << index.depth and len(set(slots.values())) > 4
    entries = index.entries.collect()
    assert all(r.bucket == slots[(r.h & (1 << 64) - 1) >> (64 - index.depth)] and r.chain == r.chains == 1 for r in entries)
    index.entries = index.entries.withColumn("bucket", F.col("bucket") + 1)
    assert E.look_up(index, prints, texts).count() < prints.count()


def test_exact_plan_is_native(spark):
    plan = exact_dedup(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_empty_and_extra_columns(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    more = docs(spark).selectExpr("*", "1 as keep_id", "2 as h", "3 as sha", "4 as norm", "5 as bucket", "6 as id", "7 as kept")
    assert sorted(map(tuple, exact_dedup(more).collect()), key=str) == brute_exact(awkward())
    assert keep_first(more).columns == more.columns


def test_keep_first(spark):
    """One row of each group, whatever its id: ids repeated with one text, with several, and null."""
    rows = awkward() + [(10, "another text", "fr", "c", 7), (50, "another text", "fr", "c", 7), (None, "nobody's", "x", "y", 1), (None, "nobody's", None, "z", 2)]
    got = keep_first(docs(spark, rows)).collect()
    norm = lambda t: SPACE.sub(" ", t or "")
    want = {}
    for doc_id, text, *_ in rows:
        want.setdefault(norm(text), []).append(doc_id)
    want = {t: min((i for i in ids if i is not None), default=None) for t, ids in want.items()}
    assert sorted(((norm(r.text), r.doc_id) for r in got), key=str) == sorted(want.items(), key=str)
    assert {tuple(r) for r in got} <= set(rows)
    assert keep_first(docs(spark, [])).count() == 0


def test_directory_splits_and_doubles():
    d = grow_directory({0: 10, 1: 10, 8: 10, 15: 100}, bucket_bytes=25, max_depth=4)
    assert len(d.slots) == 1 << d.depth and d.depth == 4
    assert d.slots == sorted(d.slots) and d.slots[0] == d.slots[1] != d.slots[15]
    for b, own in enumerate(d.depths):
        assert d.slots.count(b) == 1 << (d.depth - own)
    assert grow_directory({}, 1).slots == [0]
    assert grow_directory({3: 5}, 5, 4).depth == 0


def near_rows(n=60):
    rng = random.Random(5)
    rows, k = [], 0
    for family in range(8):
        words = long_text(100 + family, 40 + 30 * family).split()
        for _ in range(n // 8):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                own[rng.randrange(len(own))] = f"w{rng.randrange(9)}"
            rows.append((k, rng.choice([" ", "\n", "  "]).join(own), "en", "s", 1))
            k += 1
    big = long_text(77, 2600).split()
    for edits in (0, 20, 60, 90, 140):
        own = list(big)
        for i in range(edits):
            own[(i * 17) % len(own)] = f"e{i}"
        rows.append((k, " ".join(own), "en", "s", 1))
        k += 1
    return rows


@pytest.mark.parametrize("width, percent", [(4, 80), (5, 80), (1, 80), (3, 90)])
def test_near(spark, width, percent):
    rows = [r for r in awkward() if r[0] is not None] + [(100 + r[0], *r[1:]) for r in near_rows()]
    texts = {r[0]: r[1] for r in rows}
    want = components(texts, width, percent)
    got = near_dedup(docs(spark, rows), width, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(texts[r.doc_id], width)), want[r.doc_id], r.doc_id == want[r.doc_id])


def test_near_corners(spark):
    assert near_dedup(docs(spark, [])).count() == 0
    none = near_dedup(spark.createDataFrame([(None, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None)], DOCS)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in none) == [("1", "1", True), ("None", "1", False)]
    more = docs(spark).selectExpr("*", "1 as id", "2 as n", "3 as bands", "4 as key", "5 as component_id")
    assert keep_one(more).columns == more.columns
    names = spark.createDataFrame([("b", "a b c d e f"), ("a", "a b c d e F"), ("c", None)], "doc_id string, text string")
    assert sorted(map(tuple, near_dedup(names).collect())) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 0, "c", True)]


def test_rows_are_decided_by_their_own_text(spark):
    """Ids that stand for several texts, repeated rows and rows without an id; each row counts for itself."""
    base = long_text(5, 60)
    near = base.replace(base.split()[30], "other", 1)
    rows = [(1, base), (2, near), (2, "a clean text of its own"), (2, "a clean text of its own"), (None, near + " more"), (None, "nobody else says this one"), (3, ""), (3, None), (4, "x")]
    got = [tuple(r) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()]
    want = [(1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (None, 1, False), (None, None, True), (3, 3, True), (3, 3, True), (4, 4, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = keep_one(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n int")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, base, 7), (2, "a clean text of its own", 7), (None, "nobody else says this one", 7), (3, "", 7), (3, None, 7), (4, "x", 7)], key=str)


def test_near_with_hot_keys(spark, monkeypatch):
    """Frequent keys that are broadcast give the same components."""
    from quarry.llm import neardup

    monkeypatch.setattr(neardup, "HOT", 10_000)
    monkeypatch.setattr(neardup, "LEAST_HOT", 3)
    rows = near_rows()
    want = components({r[0]: r[1] for r in rows}, 4, 80)
    assert {r.doc_id: r.component_id for r in near_dedup(docs(spark, rows), 4).collect()} == want


def test_one_family_that_no_leader_links(spark):
    """Variants far from the smallest id but close to each other are still linked."""
    base = long_text(3, 100).split()
    rows = [(0, " ".join(base), "en", "s", 1)]
    for k in range(1, 30):
        own = list(base)
        for i in range(12):
            own[i * 8] = f"x{k % 3}_{i}"
        own[50] = f"y{k}"
        rows.append((k, " ".join(own), "en", "s", 1))
    want = components({r[0]: r[1] for r in rows}, 5, 80)
    assert {r.doc_id: r.component_id for r in near_dedup(docs(spark, rows)).collect()} == want
    assert len(set(want.values())) == 4


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(1000, 900 + i) for i in range(50)]
    texts = {i for e in edges for i in e}
    root = {i: i for i in texts}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root[i] for i in texts if any(i in e and e[0] != e[1] for e in edges)}


def test_hashes_follow_words_not_bytes():
    a, b = S.word_hashes("The  cat\nsat é"), S.word_hashes(" tHE cat SAT\té ")
    assert (a == b).all() and len(a) == 4 and len(set(a.tolist())) == 4
    assert (S.word_hashes("É")[0] != S.word_hashes("é")[0]) and len(S.word_hashes(" \n")) == 0
    assert S.sequence_hash(a) == S.sequence_hash(b) != S.sequence_hash(a[::-1])
    text = long_text(1, 5000)
    w = S.word_hashes(text)
    assert len(np.unique(w)) == len(set(text.split()))
    assert len(S.shingle_set(w, 3)) == len(shingles(text, 3))


def test_odd_sketch_counts_differences():
    rng = np.random.default_rng(0)
    for differ in (0, 5, 40):
        common = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, differ, dtype=np.uint64)])) for _ in (0, 1))
        bits = int(np.unpackbits((S.odd_sketch(a) ^ S.odd_sketch(b)).view(np.uint8)).sum())
        assert bits <= 2 * differ and bits >= 1.6 * differ and bits % 2 == 0
