"""Mixing sources to target weights by entropy balancing.

Documents get rates w in (0, 3) that stay as close to 1 as the token constraints allow, in the
bounded relative entropy  w log w + (3 - w) log((3 - w) / 2). With one constraint per source s,
``sum of size * w = target``, the dual is convex and splits by source; its solution tilts rates
exponentially in a document's size x (in units of the source's mean size):

    w = 3 exp(lambda_s x) / (2 + exp(lambda_s x))

Newton steps find each lambda_s, kept inside a bracket that every step narrows. They run on the
table of (source, size, count), not on documents; the state of all sources is a written table too,
so nothing grows on the driver.

Rates are then rounded into copies. A document gets the whole part of its rate; the fractions become
extra copies class by class (one source, one size), by falling size: each class gives as many as
bring the words taken so far nearest to those due, so that the last, small classes settle what the
long documents leave. Which members of a class get them is decided by a hash of the id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, stage, table

CAP = 3.0
#: The state of so many sources is broadcast in a Newton step; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Members of a class (one source, one size) that are ranked together; larger ones are ranked in ranges of their hash, with the same result.
TOGETHER = 256


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df, written, with each row's place in this order as ``place``, from 0. Each partition of the sorted rows is numbered by itself, and begins where those before it end."""
    at = F.monotonically_increasing_id()
    rows = stage(df.orderBy(*order).withColumn("part", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_part"))
    first = sizes.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("first"))  # a row for each partition
    return rows.join(F.broadcast(first), "part").withColumn("place", F.col("place") + F.col("first")).drop("part", "first")


def targets(hist: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """src, source_size, mean, target. One row per source; shares are capped at CAP times the source and the rest is shared anew."""
    per = hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    weight = F.element_at(F.lit([float(w) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)
    src = stage(numbered(per, F.col("src").asc_nulls_last()).withColumn("weight", weight).drop("place"), "sources")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    # Newton on the level: every round caps the sources that the level overfills, until none is above.
    level, cap = 0.0, CAP * F.col("source_size")
    rest, weight_sum = float(total), src.agg(F.sum("weight")).first()[0]
    while weight_sum:
        level = rest / weight_sum
        over = F.col("weight") * F.lit(level) >= cap
        row = src.agg(F.sum(F.when(over, cap)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if row["w"] in (None, weight_sum):
            break
        rest, weight_sum = float(total) - row["full"], row["w"]
    target = F.least(F.col("weight") * F.lit(level), cap)
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0))
    return stage(src.select("src", "source_size", "n_docs", mean.alias("mean"), target.alias("target")), "targets")


def rate(lam: Column, x: Column) -> Column:
    """The tilted rate; lam is null where the target is the cap and every document is taken CAP times."""
    eta = F.least(F.greatest(lam * x, F.lit(-700.0)), F.lit(700.0))
    return F.when(lam.isNull(), F.lit(CAP)).otherwise(F.lit(CAP) / (1.0 + (CAP - 1.0) * F.exp(-eta)))


def balance(hist: DataFrame, goal: DataFrame, tolerance: float = 1e-10, most: int = 60) -> DataFrame:
    """src, lam: the dual's solution, by safeguarded Newton steps on aggregates of hist."""
    fixed = F.col("target") >= CAP * F.col("source_size")
    state = goal.select("src", "mean", "target", F.when(fixed, F.lit(None)).otherwise(F.lit(0.0)).cast("double").alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    few = goal.count() <= BROADCAST_SOURCES
    worst = None
    for _ in range(most):
        s = F.broadcast(state) if few else state
        x = F.col("size") / F.col("mean")
        w = rate(F.col("lam"), x)
        tokens = F.col("n") * F.col("size")
        both = hist.withColumnRenamed("src", "_s").join(s.where("lam is not null"), F.col("_s").eqNullSafe(F.col("src")))
        got = both.groupBy("src", "mean", "target", "lam", "lo", "hi").agg(F.sum(tokens * w).alias("a"), F.sum(tokens * x * w * (1 - w / CAP)).alias("b"))
        gap = F.col("a") - F.col("target")
        got = got.withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(gap <= 0, F.col("lam")).otherwise(F.col("lo")))
        step = F.col("lam") - F.when(F.col("b") > 0, gap / F.col("b"))
        inside = (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi"))) & (F.abs(step - F.col("lam")) <= 50.0 + 2 * F.abs(F.col("lam")))
        middle = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 10.0 - F.abs(F.col("hi"))).when(F.col("hi").isNull(), F.col("lo") + 10.0 + F.abs(F.col("lo"))).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        new = F.when(near, F.col("lam")).when(inside, step).otherwise(middle)
        moved = got.select("src", "mean", "target", new.alias("lam"), "lo", "hi", (F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))).alias("err"))
        done = stage(moved, "dual")
        worst = done.agg(F.max("err")).first()[0]
        state = done.drop("err").unionByName(state.where("lam is null"))
        if worst is None or worst <= tolerance:
            break
    if worst is not None and worst > 1e-6:
        raise RuntimeError(f"a source's rates miss its target by a part of {worst} after {most} steps")
    # The last digits depend on the order of summation; without them reruns agree.
    return stage(state.select("src", F.round("lam", 9).alias("lam")), "lambda")


def settle(classes: pd.DataFrame) -> pd.DataFrame:
    """Extra copies of each class of one source; as many rows as the source has different sizes."""
    classes = classes.sort_values("size", ascending=False)
    due, extra = 0.0, []
    for size, n, frac in zip(classes["size"], classes["n"], classes["frac"], strict=True):
        if size == 0:
            extra.append(0)
            continue
        due += n * frac * size
        k = int(min(n, max(0, round(due / size)))) if frac > 0 else 0
        due -= k * size
        extra.append(k)
    out = classes.assign(extra=extra).rename(columns={"src": "c_src", "size": "c_size"})
    return out[["c_src", "c_size", "source_size", "target", "whole", "extra", "parts"]]


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs.

    size: words of the text (null: 0). Sources in code point order, null last, weigh ``weights``,
    repeating; a null source is a source. Documents without words have no tokens to take: taken is 0
    and copies is 1. Repeated rows are rows of their own. An empty table gives no rows.
    """
    all_sizes = stage(sizes(docs), "sizes")
    hist = stage(all_sizes.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
    goal = targets(hist, weights)
    lam = balance(hist.where("size > 0"), goal)
    info = goal.join(lam.withColumnRenamed("src", "_l"), F.col("src").eqNullSafe(F.col("_l"))).drop("_l")
    w = F.round(rate(F.col("lam"), F.col("size") / F.col("mean")), 12)
    classes = (
        hist.withColumnRenamed("src", "_h").join(info, F.col("_h").eqNullSafe(F.col("src"))).drop("_h")
        .withColumn("w", F.when(F.col("size") > 0, w).otherwise(1.0))
        .withColumn("whole", F.floor("w").cast("long"))
        .withColumn("frac", F.col("w") - F.col("whole"))
    )
    parts = F.ceil(F.col("n") / TOGETHER).cast("long")
    classes = classes.select("src", "size", "n", "source_size", "target", "whole", "frac", parts.alias("parts"))
    schema = "c_src string, c_size long, source_size long, target double, whole long, extra long, parts long"
    classes = stage(classes.groupBy("src").applyInPandas(settle, schema), "classes")
    rows = all_sizes.join(classes, F.col("src").eqNullSafe(F.col("c_src")) & (F.col("size") == F.col("c_size")))
    # Parts are ranges of the hash, so that ranks don't depend on how many there are.
    rows = rows.withColumn("mark", F.shiftrightunsigned(F.xxhash64("id"), 11)).withColumn("part", F.floor(F.col("mark") / float(1 << 53) * F.col("parts")))
    rows = rows.select("id", "src", "size", "source_size", "target", "whole", "extra", "parts", "mark", "part")
    counts = rows.where("parts > 1").groupBy("src", "size", "part").agg(F.count(F.lit(1)).alias("k"))
    shift = counts.withColumn("shift", F.coalesce(F.sum("k").over(Window.partitionBy("src", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shift = shift.select(F.col("src").alias("p_src"), F.col("size").alias("p_size"), F.col("part").alias("p_part"), "shift")
    on = F.col("src").eqNullSafe(F.col("p_src")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part"))
    rows = rows.join(shift, on, "left")
    rank = F.row_number().over(Window.partitionBy("src", "size", "part").orderBy("mark", "id")) + F.coalesce("shift", F.lit(0))
    rows = rows.withColumn("r", rank)
    extra = (F.col("r") <= F.col("extra")).cast("long")
    copies = F.least(F.col("whole") + extra, F.lit(int(CAP))).cast("long")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def take_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of docs as often as mix takes them, with the columns of docs.

    Rows without words are taken once; a null source is a source. Rows that repeat an id share its
    copies evenly, rows without an id likewise. Extra columns come along, whatever their names. An
    empty table gives no rows.
    """
    own = "_quarry_id", "_quarry_copies", "_quarry_copy"
    shares = mix(docs, weights).groupBy("doc_id").agg(F.round(F.avg("copies")).cast("int").alias(own[1])).where(F.col(own[1]) > 0).withColumnRenamed("doc_id", own[0])
    taken = docs.join(shares, docs["doc_id"].eqNullSafe(F.col(own[0])))
    return taken.withColumn(own[2], F.explode(F.array_repeat(F.lit(0), F.col(own[1])))).drop(*own)
