"""Toxicity: class-conditional Kneser-Ney models compared by length-normalised log-likelihood.

Two models of word pairs, one of toxic (1) and one of ordinary (0) labelled text, share their backoff
counts. Words are runs of letters and digits, lower-cased. With n_c(v w) the trigram types of class c
that end in v w, and k_c(w) the pair types that end in w (so a passage that stands in many copies
counts once), the shared model is Kneser-Ney's: absolute discounting of both classes' continuation
counts, D_c = t1 / (t1 + 2 t2) from the counts that are 1 and 2, and what the discount frees goes to
the word's part of all documents,

    S(w) = sum_c pi_c (max(k_c(w) - D_c, 0) / K_c + D_c T_c / K_c * A(w))

pi_c being the class's part of the labels it learns from, T_c the number of different words, and A(w)
the documents of the whole corpus that hold w, over the sum of that for all words. A class departs
from the shared counts as far as its own count exceeds, or falls short of, what they lead one to
expect by more than chance and a fair part of it:

    P_c(w) ~ E + d,  E = K_c S(w),  d = sign(k_c - E) max(|k_c - E| - Z sqrt(E + 1) - SLACK E, 0)

So a rare expression is smoothed into the shared counts, where both classes agree, and so is the mix
of subjects and languages by which classes differ a little in most of their common words. A pair is
treated alike: its expectation is n_c(v) S(w | v) P_c(w) / S(w), with S(w | v) the classes' counts
mixed by pi_c (S(w) for a class without v), Z is larger by PAIR_ERRORS, as there are many more pairs,
and without a departure a pair backs off to its last word, as does one that no class has more often
than its least Z. Words of neither class have the shared probability in both models. The sums of
P_c, which differ from 1 by a hundredth or so, are left out, being the same for every word.

A document's figure is log P_1 - log P_0, which sums to the logs of the ratios of pairs and words
that depart (for all others both logarithms are the same number), divided by its words and FIRM more,
which keeps very short texts from being judged by one word. A logistic curve over that figure or over
its logarithm turns it into a probability. Curve and Z are those that fit a quarter of the training
documents, left out of the counts, best.

Class counts and curve are fitted on a bounded sample of labelled rows: at most ``max_docs`` of each
class, those with the smallest hash of their id. A(w) counts all documents. Tables are made by shuffles,
and only entries that depart reach the driver and the workers; of those there are at most twice the
words of the sample. Every document is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import held_out, stage, table
from quarry.llm.shingles import mix, word_hashes

MAX_DOCS = 4000
FIRM = 20
#: Candidates for Z, standard errors that a count may be off by, and the part of its expectation that it may be off by besides.
ERRORS, SLACK = (2.0, 3.0, 4.0), 0.5
PAIR_ERRORS = 2.0
#: Word hashes that a task gathers before it combines them and sends them on.
AT_ONCE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_gaps = re.compile(r"[\W_]+").sub


def hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    return word_hashes(_gaps(" ", text.lower()))


def chain(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hashes of pairs, or of longer runs, from those of their parts."""
    return mix(first * _ODD + then)


def before(words: np.ndarray, n: int = 1) -> np.ndarray:
    """The word n places before each word; 0 at the start of the text."""
    return np.concatenate([np.zeros(min(n, len(words)), np.uint64), words[: len(words) - n if n < len(words) else 0]])


def gram_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram types (label, t, v, w) of what one task reads, in parts: hashes of the trigram and of its last two words."""
    held: tuple[list, list] = ([], [])
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for label, own in enumerate(held):
            if own:
                t, v, w = (np.concatenate(x) for x in zip(*own, strict=True))
                _, at = np.unique(t, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, np.int32)), *[pa.array(x[at].view(np.int64)) for x in (t, v, w)]], ["label", "t", "v", "w"])
            own.clear()

    for b in batches:
        for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
            w = hashes(text)
            v = before(w)
            held[label].append((chain(before(w, 2), chain(v, w)), v, w))
            size += len(w)
            if size > AT_ONCE:
                yield from flush()
                size = 0
    yield from flush()


def word_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): how many of the documents that one task reads hold each word, in parts."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        w, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])

    for b in batches:
        for text in b["text"].to_pylist():
            held.append(np.unique(hashes(text or "")))
            size += len(held[-1])
            if size > AT_ONCE:
                yield flush()
                size = 0
    yield flush()


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int) -> tuple[DataFrame, float]:
    """train_id, label, fold: at most max_docs ids of each class, none held out; and the toxic part of all labels that aren't held out.

    Where an id has several labels the highest counts.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    order = F.xxhash64("doc_id")
    of = [known.where(F.col("label") == c).orderBy(order, "doc_id").limit(max_docs) for c in (0, 1)]
    rows = of[0].unionByName(of[1]).select(F.col("doc_id").alias("train_id"), "label", F.pmod(F.shiftright(order, 7), F.lit(4)).cast("int").alias("fold"))
    return rows, min(max(0.5 if share is None else share, 0.01), 0.99)


def departure(count: Column, expected: Column, errors: float) -> Column:
    off = count - expected
    return F.signum(off) * F.greatest(F.abs(off) - errors * F.sqrt(expected + 1) - SLACK * expected, F.lit(0.0))


def fit_counts(grams: DataFrame, corpus: DataFrame, share: float) -> list[dict]:
    """For each of ERRORS the log ratios of words and pairs that depart.

    grams: rows (label, v, w, n). corpus: rows (w, n), all documents' words.
    """
    of = lambda x, c: F.sum(F.when(F.col("label") == c, x).otherwise(0))
    types = stage(grams.groupBy("w").agg(of(F.lit(1), 0).alias("k0"), of(F.lit(1), 1).alias("k1")), "toxic-words")
    sums = types.agg(*[F.coalesce(F.sum(f(F.col(f"k{c}"))), F.lit(0)).alias(f"{name}{c}") for c in (0, 1) for name, f in (("K", lambda k: k), ("T", lambda k: (k > 0).cast("long")), ("one", lambda k: (k == 1).cast("long")), ("two", lambda k: (k == 2).cast("long")))]).first()
    if not (sums["K0"] and sums["K1"]):
        return []
    total = corpus.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part = (1 - share, share)
    discount = [min(max(sums[f"one{c}"] / max(sums[f"one{c}"] + 2 * sums[f"two{c}"], 1), 0.05), 0.95) for c in (0, 1)]
    freed = sum(part[c] * discount[c] * sums[f"T{c}"] / sums[f"K{c}"] for c in (0, 1))
    k, n = [[F.col(f"{x}{c}") for c in (0, 1)] for x in "kn"]
    kept = sum(part[c] / sums[f"K{c}"] * F.greatest(k[c] - discount[c], F.lit(0.0)) for c in (0, 1))
    words = types.join(corpus.select(F.col("w").alias("_w"), F.col("n").alias("held")), F.col("w") == F.col("_w"), "left").drop("_w")
    words = words.withColumn("s", kept + freed * F.coalesce("held", F.lit(0)) / max(total, 1)).where("s > 0")
    for z, errors in enumerate(ERRORS):
        for c in (0, 1):
            expected = sums[f"K{c}"] * F.col("s")
            words = words.withColumn(f"p{z}{c}", (expected + departure(k[c], expected, errors)) / sums[f"K{c}"])
    words = stage(words, "toxic-model")

    pairs = grams.groupBy("v", "w").agg(of(F.col("n"), 0).alias("n0"), of(F.col("n"), 1).alias("n1"))
    first = grams.groupBy("v").agg(of(F.col("n"), 0).alias("m0"), of(F.col("n"), 1).alias("m1"))
    often = pairs.where(F.greatest("n0", "n1") > min(ERRORS) + PAIR_ERRORS)
    both = often.join(first.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v")).drop("_v")
    both = both.join(words.select(F.col("w").alias("_w"), "s", *[f"p{z}{c}" for z in range(len(ERRORS)) for c in (0, 1)]), F.col("w") == F.col("_w")).drop("_w")
    m = [F.col("m0"), F.col("m1")]
    shared = sum(part[c] * F.when(m[c] > 0, n[c] / m[c]).otherwise(F.col("s")) for c in (0, 1))
    both = both.withColumn("sv", shared)
    for z, errors in enumerate(ERRORS):
        ratio = F.lit(0.0)
        for c in (0, 1):
            expected = m[c] * F.col("sv") * F.col(f"p{z}{c}") / F.col("s")
            moved = F.when(m[c] > 0, F.log((expected + departure(n[c], expected, errors + PAIR_ERRORS)) / expected)).otherwise(0.0)
            ratio = ratio + moved if c else ratio - moved
        both = both.withColumn(f"r{z}", ratio).withColumn(f"u{z}", F.log(F.col(f"p{z}1") / F.col(f"p{z}0")))
    both = stage(both.where(" or ".join(f"r{z} <> 0" for z in range(len(ERRORS)))).select("v", "w", *[f"{x}{z}" for x in "ru" for z in range(len(ERRORS))]), "toxic-pairs")
    got_pairs = both.toPandas()  # departures only
    got_words = words.where(" or ".join(f"p{z}0 <> p{z}1" for z in range(len(ERRORS)))).select("w", *[f"p{z}{c}" for z in range(len(ERRORS)) for c in (0, 1)]).toPandas()  # departures only
    out = []
    for z in range(len(ERRORS)):
        own = got_words[got_words[f"p{z}0"] != got_words[f"p{z}1"]]
        keys = own["w"].to_numpy(np.int64).view(np.uint64)
        ratios = np.log(own[f"p{z}1"].to_numpy(float) / own[f"p{z}0"].to_numpy(float))
        two = got_pairs[got_pairs[f"r{z}"] != 0]
        pair_keys = chain(two["v"].to_numpy(np.int64).view(np.uint64), two["w"].to_numpy(np.int64).view(np.uint64))
        extra = (two[f"r{z}"] + two[f"u{z}"]).to_numpy(float)
        order, pair_order = np.argsort(keys), np.argsort(pair_keys)
        out.append({"words": (keys[order], ratios[order]), "pairs": (pair_keys[pair_order], extra[pair_order])})
    return out


def look_up(entries: tuple[np.ndarray, np.ndarray], keys: np.ndarray, other: np.ndarray | float) -> np.ndarray:
    known, values = entries
    if not len(known):
        return np.broadcast_to(other, len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], other)


def mean_ratio(text: str, model: dict) -> float:
    """The difference of the two models' log-likelihoods over words + FIRM; 0 for a text without words."""
    words = hashes(text)
    if not len(words):
        return 0.0
    ratios = look_up(model["pairs"], chain(before(words), words), look_up(model["words"], words, 0.0))
    return float(ratios.sum()) / (len(words) + FIRM)


def scaled(x: np.ndarray, log: bool) -> np.ndarray:
    """The figure as it is, or on a logarithmic scale that is even around 0 and nearly linear below 0.001."""
    return np.copysign(np.log1p(1000 * np.abs(x)), x) if log else x


def probability(x: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["slope"] * scaled(np.asarray(x, float), model["log"]) + model["offset"], -700, 700)))


def fit_curve(x: np.ndarray, y: np.ndarray, share: float) -> dict:
    """Scale, slope and offset of a logistic curve, classes weighted to the share of toxic labels, and the weighted loss; Newton with a small ridge."""
    if len(x) == 0 or y.min() == y.max():
        return {"log": False, "slope": 300.0, "offset": -3.0, "loss": 0.0}
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    found = []
    for log in (False, True):
        own = scaled(x, log)
        scale = max(float(np.std(own)), 1e-6)
        z, b, ridge = np.column_stack([own / scale, np.ones(len(own))]), np.zeros(2), np.diag([1e-2, 1e-3])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            grad = z.T @ (weight * (p - y)) + ridge @ b
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            b = b - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        loss = float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ b))).sum())
        found.append((loss, {"log": log, "slope": max(float(b[0] / scale), 1e-3), "offset": float(b[1]), "loss": loss}))
    return min(found, key=lambda f: f[0])[1]


EMPTY = {"words": (np.zeros(0, np.uint64), np.zeros(0)), "pairs": (np.zeros(0, np.uint64), np.zeros(0))}


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> dict:
    """The fitted model: log ratios of words and pairs, and the curve."""
    spark = docs.sparkSession
    chosen, share = training_rows(docs, labels, max_docs)
    rows = stage(chosen, "toxic-train")
    # 2 * max_docs ids at most.
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), F.col("id") == F.col("train_id"))
    texts = stage(texts.select("id", "text", "label", "fold"), "toxic-texts")
    grams = stage(texts.where("fold > 0").select("text", "label").mapInArrow(gram_types, "label int, t long, v long, w long").dropDuplicates(["label", "t", "v", "w"]).groupBy("label", "v", "w").agg(F.count(F.lit(1)).alias("n")), "toxic-grams")
    corpus = stage(docs.select("text").mapInArrow(word_documents, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "toxic-corpus")
    models = fit_counts(grams, corpus, share) or [EMPTY]
    shared = spark.sparkContext.broadcast(models)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[mean_ratio(t, m) for m in shared.value] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["label"], pa.array(found, pa.list_(pa.float64()))], ["label", "x"])

    got = texts.where("fold = 0").select("label", "text").mapInArrow(figures, "label int, x array<double>").collect()  # 2 * max_docs rows at most
    y = np.array([r["label"] for r in got])
    fitted = [m | fit_curve(np.array([r["x"][i] for r in got]), y, share) for i, m in enumerate(models)]
    return min(fitted, key=lambda m: m["loss"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs' doc_id, held_out, score, predicted; every whole text is scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = np.array([mean_ratio(t or "", m) for t in b["text"].to_pylist()], float)
            p = probability(x, m)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype("int32"), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(scores, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted for every row of docs.

    Null and empty texts, and texts without words, get the curve's value at a ratio of 0. Repeated
    rows are scored each; a null doc_id is scored and never held out. Labels that are neither 0 nor 1, or
    whose document is missing, teach nothing; without labels of both classes a fixed curve is used. Columns
    other than doc_id and text are not read. An empty table gives no rows.
    """
    return score(docs, train(docs, labels, max_docs))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with the columns of docs.

    Each row is judged by its own text, so that repeated rows and rows that share an id stay or go by
    what they say; null and empty texts stay, as a ratio of 0 is not toxic. Extra columns come along,
    whatever their names. An empty table gives no rows.
    """
    model = train(docs, labels, max_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p = probability([0.0 if not t else mean_ratio(t, m) for t in b["text"].to_pylist()], m)
            yield b.filter(pa.array((p < 0.5) | pa.compute.equal(pa.compute.fill_null(b["text"], ""), "").to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(clean, docs.schema)
