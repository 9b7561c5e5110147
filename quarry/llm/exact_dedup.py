"""Exact deduplication over an extendible-hash index kept in shared files.

Built from DataFrame operations only. The steps:

1. Each text is normalised (runs of white space become one space) and hashed to 64 bits. The byte
   volume under every 16-bit hash prefix is aggregated: at most 65,536 rows, whatever the input.
2. From those volumes the directory is grown as in extendible hashing: while a bucket holds more
   than ``bucket_bytes``, it splits, and where its local depth equals the global depth the
   directory doubles first. A bucket of the greatest depth chains overflow instead of splitting.
   Buckets are key ranges; neighbouring ones go to one owner task. The directory is written.
3. Rows go to the owner that the directory names for their hash. A hash with very many copies is
   combined before, so that its copies travel once per input task.
4. Owners compare the bytes of the texts with one hash, count and take the smallest id of equal ones,
   chain different ones, and write their buckets.
5. Documents look up their bucket in the directory and their hash in the bucket, by a join that Spark
   may split on skew; where the hash has a chain, their bytes are compared with each text in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, stage, table, text_or_empty

MAX_DEPTH = 16
#: Bytes of text that a bucket holds before it splits, and that an owner task takes.
BUCKET_BYTES, OWNER_BYTES = 1 << 20, 32 << 20
#: Copies of one hash that are more than this part of all rows are combined before they are sent to its owner.
HOT = 4096


@dataclass
class Directory:
    """slots[p] is the bucket of the hash prefix p of ``depth`` bits; depths[b] is a bucket's own depth."""

    depth: int
    slots: list[int]
    depths: list[int]


def grow_directory(volume: dict[int, int], bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> Directory:
    """Split overfull buckets until each fits or has max_depth. volume: bytes by prefix of max_depth bits."""
    sums = [[0] * (1 << max_depth)]
    for p, n in volume.items():
        sums[0][p] += n
    for _ in range(max_depth):  # sums[d][p]: bytes under the prefix p of max_depth - d bits
        low = sums[-1]
        sums.append([low[i] + low[i + 1] for i in range(0, len(low), 2)])
    held = lambda depth, prefix: sums[max_depth - depth][prefix]

    slots, buckets, depth, todo = [0], [(0, 0)], 0, [0]
    while todo:
        b = todo.pop()
        own, prefix = buckets[b]
        if held(own, prefix) <= bucket_bytes or own == max_depth:
            continue
        if own == depth:
            slots, depth = [s for s in slots for _ in (0, 1)], depth + 1
        buckets[b] = (own + 1, prefix * 2)
        buckets.append((own + 1, prefix * 2 + 1))
        new, width = len(buckets) - 1, 1 << (depth - own - 1)
        start = (prefix * 2 + 1) * width
        slots[start : start + width] = [new] * width
        todo += [b, new]
    order: dict[int, int] = {}
    for s in slots:  # number the buckets by key range
        order.setdefault(s, len(order))
    depths = [0] * len(order)
    for old, new in order.items():
        depths[new] = buckets[old][0]
    return Directory(depth, [order[s] for s in slots], depths)


def _share_out(directory: Directory, volume: dict[int, int], owner_bytes: int, max_depth: int) -> list[int]:
    """The owner task of each bucket: runs of neighbouring buckets that hold about owner_bytes together."""
    held = [0] * len(directory.depths)
    for p, n in volume.items():
        held[directory.slots[p >> (max_depth - directory.depth)]] += n
    owners, at, full = [], 0, 0
    for n in held:
        if full and full + n > owner_bytes:
            at, full = at + 1, 0
        owners.append(at)
        full += n
    return owners


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)


def normalise(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


@dataclass
class Index:
    """The directory's table (slot, bucket, owner) of a depth, and the entries in their buckets."""

    depth: int
    directory: DataFrame
    entries: DataFrame

    def route(self, rows: DataFrame) -> DataFrame:
        """rows (with h) and the bucket and owner that the directory sends them to; it has 2 ** MAX_DEPTH rows at most."""
        return rows.withColumn("slot", _slot(self.depth)).join(F.broadcast(self.directory), "slot").drop("slot")


def build_index(texts: DataFrame, prints: DataFrame, bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES) -> Index:
    """The written index of texts (id, norm, h): a row per different text, bucket, h, chain, chains, sha, keep_id, group_size, and norm where a hash has several texts."""
    prefix = F.shiftrightunsigned("h", 64 - MAX_DEPTH)
    volume = {r["p"]: r["n"] for r in prints.groupBy(prefix.alias("p")).agg(F.sum(F.col("n_bytes") + 1).alias("n")).collect()}  # 2 ** MAX_DEPTH rows at most
    grown = grow_directory(volume, bucket_bytes)
    owner_of = _share_out(grown, volume, owner_bytes, MAX_DEPTH)
    told = F.split(F.lit(",".join(f"{b}:{owner_of[b]}" for b in grown.slots)), ",")
    rows = prints.sparkSession.range(1).select(F.posexplode(told).alias("slot", "at"))
    directory = stage(rows.select("slot", *[F.split("at", ":")[i].cast("int").alias(c) for i, c in enumerate(("bucket", "owner"))]), "exthash-directory")
    index = Index(grown.depth, directory, directory)

    total = prints.count()
    hot = stage(prints.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max(64, total // HOT)).select(F.col("h").alias("hot_h")), "exthash-hot")  # HOT rows at most
    routed = index.route(texts)
    single = routed.select("owner", "bucket", "h", "norm", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    if hot.take(1):
        on = F.col("h") == F.col("hot_h")
        combined = routed.join(F.broadcast(hot), on, "left_semi").groupBy("owner", "bucket", "h", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        single = single.join(F.broadcast(hot), on, "left_anti").unionByName(combined)
    # From here on all is done where the owner has its key range.
    owned = single.repartitionById(max(owner_of) + 1, F.col("owner"))
    entries = owned.groupBy("owner", "bucket", "h", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    same_hash = Window.partitionBy("owner", "bucket", "h")
    entries = entries.withColumn("chain", F.row_number().over(same_hash.orderBy("norm"))).withColumn("chains", F.count(F.lit(1)).over(same_hash))
    sha, text = F.sha2("norm", 256).alias("sha"), F.when(F.col("chains") > 1, F.col("norm")).alias("norm")
    index.entries = stage(entries.select("bucket", "h", "chain", "chains", "keep_id", "group_size", sha, text), "exthash")
    return index


def look_up(index: Index, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """prints (id, h, sha) with keep_id and group_size. Where a hash has a chain of texts, each row's bytes are compared with them."""
    entry = index.entries.select(F.col("bucket").alias("e_bucket"), F.col("h").alias("e_h"), "chains", "keep_id", "group_size", F.col("sha").alias("e_sha"), F.col("norm").alias("e_norm"))
    place = (F.col("bucket") == F.col("e_bucket")) & (F.col("h") == F.col("e_h"))
    columns = ["id", "h", "sha", "keep_id", "group_size"]
    found = index.route(prints).join(entry.where("chains = 1"), place).select(*columns)
    chained = entry.where("chains > 1")
    if not chained.take(1):
        return found
    compared = index.route(texts).join(chained, place & (F.col("norm") == F.col("e_norm"))).withColumnRenamed("e_sha", "sha")
    return found.unionByName(compared.select(*columns))


def _found(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, owner_bytes: int, hash_of: Callable[[Column], Column]) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), normalise(text_col).alias("norm")).withColumn("h", hash_of(F.col("norm")))
    prints = stage(texts.select("id", "h", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes")), "prints")
    return look_up(build_index(texts, prints, bucket_bytes, owner_bytes), prints.drop("n_bytes"), texts)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after each run of white space is one space; null counts as empty,
    and all empty texts form one group. keep_id is the smallest non-null id of the group (null if it
    has none). A row is kept when its id is keep_id; rows that repeat that id are all marked. An empty
    table gives no rows. Other columns of docs are not read, whatever their names. ``hash_of`` gives the
    64-bit hash of a text; texts that share one are told apart by their bytes.
    """
    found = _found(docs, id_col, text_col, bucket_bytes, owner_bytes, hash_of)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each different text, with the columns of docs: the one with the smallest id.

    Rows are told apart by their text as well as by their id: an id that stands for several texts is
    decided for each. Of rows with the same id and text the one whose hash over all columns is least
    stays; a group without ids keeps one row. Texts are equal as for exact_dedup: null and empty ones
    are one group. Extra columns come along, whatever their names. An empty table gives no rows.
    """
    own = "_quarry_h", "_quarry_sha", "_quarry_row", "_quarry_rank"
    found = _found(docs, "doc_id", "text", BUCKET_BYTES, OWNER_BYTES, F.xxhash64)
    keys = found.where(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("h").alias("_k_h"), F.col("sha").alias("_k_sha"), F.col("id").alias("_k_id")).distinct()
    marked = docs.withColumn(own[0], F.xxhash64(normalise())).withColumn(own[1], F.sha2(normalise(), 256)).withColumn(own[2], F.xxhash64(*docs.columns))
    kept = marked.join(keys, (F.col(own[0]) == F.col("_k_h")) & (F.col(own[1]) == F.col("_k_sha")) & F.col("doc_id").eqNullSafe(F.col("_k_id")), "left_semi")
    rank = F.row_number().over(Window.partitionBy(own[0], own[1], "doc_id").orderBy(own[2]))
    return kept.withColumn(own[3], rank).where(F.col(own[3]) == 1).drop(*own)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""
