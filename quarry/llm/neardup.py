"""Near-duplicate documents: banded MinHash candidates, odd-sketch verification, exact confirmation.

1. One pass over the texts gives each document the hash of its word sequence, the size of its
   shingle set, band keys and an odd sketch: its MinHash samples folded into a parity bitmap.
2. Documents with one word sequence collapse to the smallest id; copies are never paired.
3. Documents that share a band key form a bucket. Each member is paired with the bucket's smallest
   id only. Where the XOR of two sketches has more bits than a linked pair can show, the pair is
   dropped; the rest is compared on full shingle sets. Links join documents into components.
4. Buckets that still hold several components pair their members across components, the sketch test
   being part of the join condition. Pairs inside a component change nothing and are left out. So
   every pair of a bucket is decided, and no bucket is expanded into all its pairs. Rows of very
   frequent band keys stay where they are: what they are joined with is broadcast.
5. Components of all links are final.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import shingles as S
from quarry.llm.common import stage, table
from quarry.llm.components import connected

_WORDS = [f"s{i}" for i in range(S.SKETCH_WORDS)]
_SKETCH = ["n", *_WORDS]
#: Standard deviations of sampling that a linked pair's sketches may be off by; and spare bits for its folding.
MARGIN, SPARE = 6.0, 20.0
#: Band keys with more than this part of all rows are broadcast instead of being dealt to one task.
HOT, LEAST_HOT = 4096, 64


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """id, seq1, seq2, n, bands, s0, s1, ... of every row. Without words: n is 0 and bands is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs, sizes, bands, sketches = [], [], [], []
            for i in range(len(b)):
                words = S.word_hashes(b["text"][i].as_py() or "")
                own = S.shingle_set(words, width)
                seqs.append(S.sequence_hash(words))
                sizes.append(len(own))
                bands.append(S.band_keys(S.minima(own)).tolist() if len(own) else [])
                sketches.append(S.odd_sketch(own))
            sk = np.array(sketches, np.int64).reshape(len(sizes), S.SKETCH_WORDS)
            arrays = [b["id"], *[pa.array([s[k] for s in seqs], pa.int64()) for k in (0, 1)], pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(sk[:, k]) for k in range(S.SKETCH_WORDS)], ["id", "seq1", "seq2", "n", "bands", *_WORDS])

    return stage(docs.select("id", "text").mapInArrow(sign, f"id long, seq1 long, seq2 long, n long, bands array<long>, {', '.join(f'{s} long' for s in _WORDS)}"), "signatures")


def near_sketches(a: str, b: str, percent: int) -> Column:
    """Whether two documents (columns prefixed a and b) can have the similarity, by set sizes and sketches.

    The XOR of two sketches has at most as many bits as the samples differ in hashes. Sets that are
    sampled whole differ in (1 - s) / (1 + s) of their sizes' sum at most, which no linked pair
    exceeds. For larger sets the sample of the larger one shares a binomial number of hashes with
    the other's, of which the bound leaves MARGIN deviations; bits that flip twice cancel, so the
    bound on bits is the expected count for so many differing hashes, and SPARE.
    """
    x, y = F.col(f"{a}n").cast("double"), F.col(f"{b}n").cast("double")
    lo, hi, k, s = F.least(x, y), F.greatest(x, y), float(S.SAMPLE), percent / 100
    shared = F.least(s / (1 + s) * (lo + hi) / hi, F.lit(1.0))
    sampled = F.least(lo, F.lit(k)) + k - 2 * k * shared + 2 * MARGIN * F.sqrt(k * shared * (1 - shared))
    differ = F.when(hi <= k, (1 - s) / (1 + s) * (lo + hi)).otherwise(sampled)
    folded = S.SKETCH_BITS / 2 * (1 - F.exp(differ * (-2.0 / S.SKETCH_BITS))) + SPARE
    bits = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in _WORDS))
    return (100 * lo >= percent * hi) & (bits <= F.when(hi <= k, F.floor(differ + 1e-6)).otherwise(F.least(differ, folded)))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union; written."""
    both = pairs.join(_named(texts, "a_"), F.col("a") == F.col("a_id")).join(_named(texts, "b_"), F.col("b") == F.col("b_id"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        size = 0

        def own(doc_id: int, text: pa.Scalar) -> np.ndarray:
            nonlocal size
            if doc_id not in kept:
                if size > 64 << 20:
                    kept.clear()
                    size = 0
                kept[doc_id] = S.shingle_set(S.word_hashes(text.as_py() or ""), width)
                size += kept[doc_id].nbytes + 200
            return kept[doc_id]

        for batch in batches:
            a, b, linked = batch["a"].to_pylist(), batch["b"].to_pylist(), []
            for i in range(len(batch)):
                x, y = own(a[i], batch["a_text"][i]), own(b[i], batch["b_text"][i])
                same = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                linked.append(same > 0 and 100 * same >= percent * (len(x) + len(y) - same))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return stage(both.select("a", "b", "a_text", "b_text").mapInArrow(compare, "a long, b long"), "links")


def _met(rows: DataFrame, keys: DataFrame, bound: int, how: str) -> DataFrame:
    """rows (with key) joined with keys (b_key, k, ...). Keys of more than ``bound`` rows, HOT at most, are broadcast, so that their rows stay where they are."""
    on = F.col("key") == F.col("b_key")
    hot = F.broadcast(keys.where(F.col("k") > bound))
    cold = rows.join(hot, on, "left_anti").join(keys.where(F.col("k") <= bound), on, how)
    return cold.unionByName(rows.join(hot, on, how))


def linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """id, n, component of every row of docs (id, text); ids are different numbers. component is the least id reachable."""
    sig = signatures(docs, width)
    full = sig.where("n > 0")
    groups = stage(full.groupBy("seq1", "seq2").agg(F.min("id").alias("rep")), "sequences")
    first = full.join(_named(groups, "g_"), (F.col("seq1") == F.col("g_seq1")) & (F.col("seq2") == F.col("g_seq2")) & (F.col("id") == F.col("g_rep")))
    reps = stage(first.select("id", "bands", *_SKETCH), "representatives")

    bands = reps.select("id", F.explode("bands").alias("key"))
    buckets = stage(bands.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("key").alias("b_key"), "leader", "k"), "buckets")
    bound = max(LEAST_HOT, (buckets.agg(F.sum("k")).first()[0] or 0) // HOT)
    members = stage(_met(bands, buckets, bound, "inner").select("key", "id", "leader"), "members")
    sketches = reps.select("id", *_SKETCH)
    in_buckets = members.select(F.col("id").alias("m_id")).distinct()
    texts = stage(docs.join(in_buckets, F.col("id") == F.col("m_id"), "left_semi"), "texts")

    star = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    near = star.join(_named(sketches, "a_"), F.col("a") == F.col("a_id")).join(_named(sketches, "b_"), (F.col("b") == F.col("b_id")) & near_sketches("a_", "b_", percent))
    links = confirm(near.select("a", "b"), texts, width, percent)
    found = stage(connected(links), "components")

    placed = members.join(_named(found, "c_"), F.col("id") == F.col("c_node"), "left").select("key", "id", "leader", F.coalesce("c_component", "id").alias("component"))
    placed = stage(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi and k > 2").select(F.col("key").alias("b_key"), "k")
    open_members = _met(placed.where("id <> leader"), stage(mixed, "mixed"), bound, "inner").join(_named(sketches, "k_"), F.col("id") == F.col("k_id"))
    open_members = stage(open_members.select("key", "id", "component", *[F.col(f"k_{s}").alias(s) for s in _SKETCH]), "open")
    # Both sides are plain tables, so that Spark may split a large bucket over tasks.
    on = (F.col("x_key") == F.col("y_key")) & (F.col("x_component") < F.col("y_component")) & near_sketches("x_", "y_", percent)
    cross = _named(open_members, "x_").join(_named(open_members, "y_"), on).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
    more = confirm(stage(cross, "cross"), texts, width, percent)
    if more.take(1):
        edges = links.unionByName(more)
        found = stage(connected(edges), "components")

    rep_of = sig.select("id", "seq1", "seq2", "n").join(_named(groups, "g_"), (F.col("seq1") == F.col("g_seq1")) & (F.col("seq2") == F.col("g_seq2")), "left")
    out = rep_of.withColumn("rep", F.when(F.col("n") > 0, F.col("g_rep")).otherwise(F.col("id"))).join(_named(found, "c_"), F.col("rep") == F.col("c_node"), "left")
    return out.select("id", "n", F.coalesce("c_component", "rep").alias("component"))


ROW = "_quarry_row"


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a different number for each row, and whether it had to be made: else it is doc_id."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").take(1):
        return docs.withColumn(ROW, F.col("doc_id").cast("long")), False
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered"), True


def _decided(rows: DataFrame, made: bool, width: int, percent: int) -> DataFrame:
    """ROW, n, component_id and kept for every row."""
    found = linked(rows.select(F.col(ROW).alias("id"), "text"), width, percent)
    if not made:
        return found.select(F.col("id").alias(ROW), "n", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    own = rows.select(F.col(ROW).alias("_row"), F.col("doc_id").alias("_id"))
    found = found.join(own, F.col("id") == F.col("_row"))
    least = found.groupBy("component").agg(F.min("_id").alias("component_id"), F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("of"), F.col("id").alias("row"))).alias("first"))
    least = least.select(F.col("component").alias("_component"), "component_id", F.col("first.row").alias("_kept"))
    return found.join(least, F.col("component") == F.col("_component")).select(F.col("id").alias(ROW), "n", "component_id", (F.col("id") == F.col("_kept")).alias("kept"))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Words are runs of characters other than white space, A-Z lower-cased. A set holds the different
    shingles of ``width`` words; fewer words make one shingle. Null texts and texts without words
    have an empty set and are linked with nothing. Rows with equal word sequences belong together.
    component_id is the least id of the component's rows (null if none has one); rows with that id are
    marked as kept, those that repeat it too. Rows that repeat an id, have none, or have ids that
    aren't numbers are told apart, each counting for its own text. Only doc_id and text are read. An empty table gives no rows.
    """
    rows, made = _numbered(docs.select("doc_id", "text"))
    found = _decided(rows, made, width, percent)
    if not made:
        return found.select(F.col(ROW).alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept")
    own = rows.select(F.col(ROW).alias("_row"), "doc_id")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.join(own, F.col(ROW) == F.col("_row")).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_dedup keeps, with the columns of docs: one row of each component.

    Rows without words are in no component and stay. Rows that repeat an id are decided each by its
    text; a row without an id goes where another of its component stays. Extra columns come along,
    whatever their names. An empty table gives no rows.
    """
    rows, made = _numbered(docs)
    dropped = _decided(rows, made, width, percent).where("not kept").select(F.col(ROW).alias("_quarry_dropped"))
    return rows.join(dropped, F.col(ROW) == F.col("_quarry_dropped"), "left_anti").select(*docs.columns)


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=4)


OP6_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
g as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) end as grams from w),
s as (select doc_id, len(grams) as n, unnest(grams) as gram from g),
i as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as k from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
l as (select x, y from i where 100 * k >= 80 * (nx + ny - k)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as node, doc_id as seen from g union select r.node, e.y from r join e on r.seen = e.x),
c as (select node, min(seen) as component_id from r group by node)
select g.doc_id, len(g.grams) as n_shingles, c.component_id, g.doc_id = c.component_id as kept from g join c on g.doc_id = c.node
"""
