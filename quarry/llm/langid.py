"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and every run of characters that aren't letters (Unicode category L) becomes one
space; its n-grams of 1 to ORDERS characters are hashed into 2 ** BITS buckets for each order. Training
sums bucket counts by language, smoothed by ALPHA, into a matrix of log probabilities that is broadcast
(ORDERS * 2 ** BITS rows, one column per language), with the log of each language's part of the labelled
documents as its prior. Scoring gathers the rows of a batch's n-grams, sums them by document in numpy
and adds the priors. Every language is learned; more than BLOCK make several matrices,
which are made and scored in turn, with a running maximum and sum.

The model is fitted on a bounded sample: about ``max_docs`` documents of each language, chosen by a
hash of the id; a parameter. Every document is scored whole, long texts in parts of PART characters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import held_out, stage, table

ORDERS = 3
BITS = 15
ALPHA = 0.5
MAX_DOCS = 3000
PART = 1 << 18
#: Languages of one matrix, and languages that a task counts at once.
BLOCK = 200
#: Which code points are letters. In a class of re, numbers beyond U+FFFF (and ½, ², Ⅷ beside them) would be tried one by one on every character.
LETTERS = np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)
Block = tuple[list[str], np.ndarray, np.ndarray]


def normalise(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with one space for each run of characters that aren't letters and at both ends."""
    low, space = text.lower(), np.uint32([32])
    out, inside = [space], False
    for i in range(0, len(low), PART):
        codes = np.frombuffer(low[i : i + PART].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = LETTERS[codes]
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # of other characters the first after a letter
        kept[0] |= inside
        out.append(np.where(letter, codes, space)[kept])
        inside = letter[-1]
    if inside or not any(map(len, out[1:])):
        out.append(space)
    return np.concatenate(out)


def buckets(text: str) -> Iterator[np.ndarray]:
    """The rows of the matrix that the n-grams of one text fall in; those that start in one part of PART characters at a time."""
    codes = normalise(text)
    for i in range(0, len(codes), PART):
        part = codes[i : i + PART + ORDERS - 1]
        out, h = [], np.zeros(0, np.uint32)
        for n in range(ORDERS):
            own = part[n:] * np.uint32(0x9E3779B1)
            h = own if n == 0 else (h[: len(own)] ^ (h[: len(own)] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + own
            mixed = (h[:PART] ^ (h[:PART] >> np.uint32(16))) * np.uint32(0xC2B2AE35)
            out.append((mixed >> np.uint32(32 - BITS)) + np.uint32(n << BITS))
        yield np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse sums (lang, bucket, n) of what one task reads."""
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, at in sums.items():
            full = np.flatnonzero(at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(at[full])], ["lang", "bucket", "n"])
        sums.clear()

    for b in batches:
        for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
            if has_letter(text):
                if lang not in sums and len(sums) >= BLOCK:
                    yield from flush()
                at = sums.setdefault(lang, np.zeros(ORDERS << BITS, np.int64))
                for rows in buckets(text):
                    at += np.bincount(rows, minlength=ORDERS << BITS)
    yield from flush()


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Iterator[Block]:
    """Blocks of languages in code point order, each with its matrix, row by bucket, column by language, and log priors."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(~held_out("doc_id"))
    langs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs")).collect()  # the languages' names
    names = sorted(r["lang"] for r in langs)
    if not names:
        return
    n_docs = {r["lang"]: r["n_docs"] for r in langs}
    blocks = [names[i : i + BLOCK] for i in range(0, len(names), BLOCK)]
    block_of = {x: k for k, own in enumerate(blocks) for x in own}
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, max_docs / r["n_docs"]), block_of[r["lang"]]) for r in langs], "known_lang string, share double, block int")
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    sample = known.join(F.broadcast(shares.select("known_lang", "share")), F.col("lang") == F.col("known_lang")).where(F.coalesce(u < F.col("share"), F.lit(False))).select("text", "lang")
    sums = sample.mapInArrow(count_buckets, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if len(blocks) > 1:
        sums = stage(sums.join(F.broadcast(shares.select("known_lang", "block")), F.col("lang") == F.col("known_lang")).select("block", "lang", "bucket", "n"), "langid-counts")
    for k, own in enumerate(blocks):
        counts = np.zeros((ORDERS << BITS, len(own)))
        at = {x: i for i, x in enumerate(own)}
        got = (sums.where(F.col("block") == k).drop("block") if len(blocks) > 1 else sums).toPandas()  # one matrix: ORDERS * 2 ** BITS rows for each of its languages at most
        if len(got):
            counts[got["bucket"].to_numpy(), got["lang"].map(at).to_numpy()] = got["n"].to_numpy()
        counts += ALPHA
        for n in range(ORDERS):
            part = counts[n << BITS : (n + 1) << BITS]
            part /= part.sum(axis=0)
        yield own, np.log(counts).astype(np.float32), np.log(np.array([n_docs[x] for x in own]) / sum(n_docs.values()))


def log_odds(text: str, matrix: np.ndarray) -> np.ndarray:
    total = np.zeros(matrix.shape[1])
    for found in buckets(text):
        # Counting first keeps the gather as small as the number of different buckets.
        rows, n = np.unique(found, return_counts=True)
        total += n.astype(np.float32) @ matrix[rows]
    return total


def score_blocks(texts: list[str | None], blocks: Iterable[Block]) -> tuple[list[str], np.ndarray]:
    """Predicted languages and posteriors over all blocks. Short texts of a batch are scored together, as one sparse matrix."""
    pred, peak, mass = ["und"] * len(texts), np.full(len(texts), -np.inf), np.zeros(len(texts))
    todo = [i for i, t in enumerate(texts) if has_letter(t)]
    for names, matrix, prior in blocks:
        start = 0
        while start < len(todo) and names:
            end, chars = start, 0
            while end < len(todo) and (end == start or chars + len(texts[todo[end]]) <= PART):
                chars += len(texts[todo[end]])
                end += 1
            own = todo[start:end]
            if len(own) == 1 and chars > PART:
                sums = log_odds(texts[own[0]], matrix)[None]
            else:
                parts = [np.concatenate(list(buckets(texts[i]))) for i in own]
                at = np.cumsum([0, *map(len, parts)])[:-1]
                sums = np.add.reduceat(matrix[np.concatenate(parts)], at, axis=0, dtype=np.float64)
            sums = sums + prior
            top, most = sums.argmax(axis=1), sums.max(axis=1)  # the first of equals: code point order
            odds = np.exp(sums - most[:, None]).sum(axis=1)
            for i, k, m, p in zip(own, top, most, odds, strict=True):
                if m > peak[i]:
                    pred[i], mass[i], peak[i] = names[k], mass[i] * np.exp(peak[i] - m) + p, m
                else:
                    mass[i] += p * np.exp(m - peak[i])
            start = end
    return pred, np.divide(1.0, mass, out=np.zeros(len(texts)), where=mass > 0)


def score_batch(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    return score_blocks(texts, [(names, matrix, np.zeros(len(names)))])


def language_id(docs: DataFrame, max_docs: int = MAX_DOCS, model: Block | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    lang_pred is a learned language, or ``und`` with score 0 where the text is null, empty or has no
    letter, or where nothing could be learned. score is the posterior of lang_pred. Equal posteriors
    go to the language first in code point order. Repeated rows are scored each; a null doc_id is
    never held out. Only doc_id, text and, for training, lang are read.
    """
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(block) for block in ([model] if model else train(docs, max_docs))]

    def blocks() -> Iterator[Block]:
        for s in shared:
            yield s.value
            if len(shared) > 1:
                s.__dict__.pop("_value", None)  # a worker holds one block at a time and reads it again from its disk

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, best = score_blocks(b["text"].to_pylist(), blocks())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(pred, pa.string()), pa.array(best, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(scores, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
