"""Nearest neighbours by largest inner product: collision-counting hashing with virtual rehashing.

Inner products become distances by one more component: a vector x of a block whose longest vector
has length M gets sqrt(M^2 - |x|^2), a query is scaled to length M and gets 0. Then the largest
inner product is the smallest distance, within each block.

Index: vectors fall into blocks of bounded size by a hash of their id. A block holds, for each of
PROJECTIONS random directions, the projections of its vectors as a sorted array, and each vector's
rank in it; blocks are written as rows of a table in the shared folder. Every vector is indexed.

Search: around the query's projection a window opens in every sorted array; binary search turns it
into a range of ranks, and a vector collides where its rank is in the range. A vector that collides
in at least COLLIDE of the arrays is a candidate. Windows widen by the factor WIDEN (virtual
rehashing: no array is built again) until SHARE of the block, or AT_LEAST times k, are candidates, or all are. Candidates
are verified on the original vectors in double precision. Queries travel in blocks too, and each
block pair returns the best k of each of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stage, table

PROJECTIONS = 128
COLLIDE = 0.5
WIDEN = 1.06
SHARE = 0.18
AT_LEAST = 50
#: Steps in looking for the first width.
LADDER = 1.05
#: The first windows hold this part of the collisions that candidates need, on average.
FIRST = 0.91
#: Components in a block of the index, and in a block of queries.
BLOCK_VALUES, QUERY_VALUES = 1 << 19, 1 << 16
_directions: dict[int, np.ndarray] = {}


def directions(dim: int) -> np.ndarray:
    if dim not in _directions:
        _directions[dim] = np.random.Generator(np.random.PCG64(dim)).standard_normal((PROJECTIONS, dim + 1))
    return _directions[dim]


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def index_block(vectors: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """M, sorted projections, and the vectors' ranks among them, one row for each direction."""
    squares = (vectors * vectors).sum(axis=1)
    longest = float(np.sqrt(squares.max()))
    wide = np.column_stack([vectors, np.sqrt(np.maximum(longest * longest - squares, 0.0))])
    p = directions(vectors.shape[1]) @ wide.T
    order = np.argsort(p, axis=1, kind="stable")
    ranks = np.empty(p.shape, np.int32)
    np.put_along_axis(ranks, order, np.arange(len(vectors), dtype=np.int32)[None], axis=1)
    return longest, np.take_along_axis(p, order, axis=1), ranks


def search_block(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, longest: float, values: np.ndarray, ranks: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its place, ids and scores of the best k), rows with the query's own id left out."""
    n, dim = vectors.shape
    lengths = np.sqrt((queries * queries).sum(axis=1))
    at = directions(dim)[:, :dim] @ (queries * (longest / lengths)[:, None]).T
    enough, need = min(n, max(int(SHARE * n), AT_LEAST * k)), max(1, round(COLLIDE * PROJECTIONS))
    small = np.uint16 if n < 1 << 16 else np.uint32
    ranks = ranks.astype(small)

    def edges(who: np.ndarray, half: float) -> np.ndarray:
        """Ranks where windows begin and end, by direction, side and query."""
        out = np.empty((PROJECTIONS, 2, len(who)), np.int64)
        for j in range(PROJECTIONS):
            out[j, 0] = np.searchsorted(values[j], at[j, who] - half, "left")
            out[j, 1] = np.searchsorted(values[j], at[j, who] + half, "right")
        return out

    few = np.arange(min(len(queries), 16))
    half = 0.1 * longest
    while True:
        e = edges(few, half)
        if (e[:, 1] - e[:, 0]).sum() >= FIRST * need * n * len(few) or half > 64 * longest:
            break
        half *= LADDER
    active = np.arange(len(queries))
    while len(active):
        e, going = edges(active, half), []
        for c, i in enumerate(active):
            begin, width = e[:, 0, c, None].astype(small), (e[:, 1, c, None] - e[:, 0, c, None]).astype(small)
            collides = ranks - begin < width  # unsigned: one comparison tests both ends
            found = np.flatnonzero(collides.view(np.uint8).sum(axis=0, dtype=np.uint8) >= need)
            if len(found) < enough and half <= 64 * longest:
                going.append(c)
                continue
            found = found[ids[found] != own[i]]
            # Sums by row, not a matrix product: equal vectors get equal scores.
            scores = (vectors[found] * queries[i]).sum(axis=1)
            if len(scores) > k:
                found, scores = found[(top := scores >= np.partition(scores, -k)[-k])], scores[top]
            best = np.lexsort((ids[found], -scores))[:k]
            yield i, ids[found[best]], scores[best]
        active, half = active[going], half * WIDEN


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, a row whose id is divisible by ``every``.

    vec_id is a whole number. Nearness is the inner product; equal scores go to the smaller id. Vectors that are null, empty,
    all zero, or hold null or non-finite components take no part, as rows with a null id. Vectors of
    another length than the query's are no candidates of it. Rows with the query's id are not its
    candidates, and a query id that is repeated is asked once, with the first of its vectors in
    array order; other repeated rows are candidates each. Fewer than k candidates are all returned.
    An empty table gives no rows.
    """
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)).where(~bad).where(F.exists(e, lambda x: x != 0))
    good = stage(good.withColumn("dim", F.size("embedding")), "vectors")
    mark = F.xxhash64("vec_id")
    total = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"))
    blocks = stage(total.select(F.col("dim").alias("d"), F.ceil(F.col("n") * F.col("dim") / BLOCK_VALUES).alias("n_blocks"), F.greatest(F.ceil(F.col("q") * F.col("dim") / QUERY_VALUES), F.lit(1)).alias("n_parts")), "lengths")  # a row for each length
    placed = good.join(blocks, F.col("dim") == F.col("d"))

    def pack(t: pa.Table) -> pa.Table:
        dim, block = t["dim"][0].as_py(), t["block"][0].as_py()
        vectors = matrix(t["embedding"], dim)
        longest, values, ranks = index_block(vectors)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int64()), "longest": [longest], "ids": [t["vec_id"].to_numpy().tobytes()], "vectors": [vectors.tobytes()], "values": [values.tobytes()], "ranks": [ranks.tobytes()]})

    def pack_queries(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        return pa.table({"q_dim": pa.array([dim], pa.int32()), "part": pa.array([t["part"][0].as_py()], pa.int64()), "n_blocks": pa.array([t["n_blocks"][0].as_py()], pa.int64()), "own": [t["vec_id"].to_numpy().tobytes()], "asked": [matrix(t["embedding"], dim).tobytes()]})

    rows = placed.select("vec_id", "embedding", "dim", F.pmod(mark, F.col("n_blocks")).alias("block"))
    index = stage(rows.groupBy("dim", "block").applyInArrow(pack, "dim int, block long, longest double, ids binary, vectors binary, values binary, ranks binary"), "collision-index")
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim", "n_blocks", "n_parts").agg(F.min("embedding").alias("embedding"))
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("dim", "n_blocks", "n_parts", "embedding")).alias("x")).select("vec_id", "x.*")
    asked = asked.select("vec_id", "embedding", "dim", "n_blocks", F.pmod(F.shiftright(mark, 20), F.col("n_parts")).alias("part"))
    queries = stage(asked.groupBy("dim", "part").applyInArrow(pack_queries, "q_dim int, part long, n_blocks long, own binary, asked binary"), "queries")
    met = queries.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).drop("n_blocks")
    n = max(1, index.count())  # a partition for each block: blocks move once, and the small query parts to each of them
    pairs = index.repartition(n, "dim", "block").join(met.repartition(n, "q_dim", "q_block").hint("merge"), (F.col("dim") == F.col("q_dim")) & (F.col("block") == F.col("q_block")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                get = lambda c, kind: np.frombuffer(b[c][i].as_py(), kind)  # noqa: B023, E731
                dim, ids, own = b["dim"][i].as_py(), get("ids", np.int64), get("own", np.int64)
                shape = (PROJECTIONS, len(ids))
                out: tuple[list, list, list] = ([], [], [])
                for j, found, scores in search_block(get("asked", float).reshape(-1, dim), own, ids, get("vectors", float).reshape(-1, dim), b["longest"][i].as_py(), get("values", float).reshape(shape), get("ranks", np.int32).reshape(shape), k):
                    out[0].append(np.full(len(found), own[j]))
                    out[1].append(found)
                    out[2].append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))  # k rows of each block
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
