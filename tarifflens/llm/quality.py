"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text alone. The weights come from preference
pairs of all labelled documents, a good one over a bad one, by logistic loss on the difference of their features. The
quantile of training strengths at the share of bad documents becomes the point where the score is CUT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, let, text_of, words_of, written
from .prefix_join import maybe_among

CUT = 0.3
#: Documents of the rarer class in a group whose pairs training takes, and a seed of the groups; most Newton steps, and ranges of a step to a quantile.
MINOR, SEED, STEPS, RANGES = 2, 5, 15, 4096
FOLDS = 5
#: How many features there are.
WIDTH = 13


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _rate(text: Column, pattern: str, per: Column) -> Column:
    """How densely a pattern stands, so damped that a few and very many differ less."""
    return F.log1p(F.regexp_count(text, F.lit(pattern)) * 100.0 / per)


def features(text: Column) -> Column:
    """Array of doubles that tell junk from prose; zeros for an empty text."""
    n = F.greatest(F.length(text), F.lit(1))

    def of_words(w: Column) -> Column:
        m = F.greatest(F.size(w), F.lit(1))
        return F.array(F.size(F.array_distinct(w)) / m, F.log1p(F.size(w).cast("double")), F.least(n / m, F.lit(40.0)) / 10.0)

    rates = ("[*$%&#@^~=<>]", "!", "[|]", "\\d", "\\p{Lu}", "[.,;:?]", "\\n", "[^\\p{L}\\p{N}\\s\\p{P}]", "\\p{Lu}{4,}", "[^\\p{L}\\s]{2,}")
    return F.concat(F.array(*(_rate(text, p, n) for p in rates)), let(words_of(text), of_words))


@dataclass(frozen=True)
class Ranker:
    """score = 1 / (1 + exp(-(bias + weights . features)))."""

    weights: tuple[float, ...]
    bias: float

    def score(self, text: Column) -> Column:
        total = let(features(text), lambda f: F.aggregate(F.zip_with(f, F.array(*(F.lit(w) for w in self.weights)), lambda x, w: x * w), F.lit(self.bias), lambda a, x: a + x))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sums(pairs: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient and curvature of the logistic loss at w, summed over all pairs' differences, and how many these are."""
    width = len(w)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * (width + 1) + 1)
        for batch in batches:
            x = batch.column(0).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            lost = 1 / (1 + np.exp(np.clip(x @ w, -40, 40)))
            total += np.concatenate([x.T @ lost, ((x.T * (lost * (1 - lost))) @ x).ravel(), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])

    found = np.zeros(width * (width + 1) + 1)
    for k, v in pairs.select("x").mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v")).collect():
        found[k] = v
    return found[:width], found[width:-1].reshape(width, width), int(found[-1])


def rank(pairs: DataFrame, width: int, penalty: float = 1e-3) -> np.ndarray:
    """Bradley-Terry weights by Newton steps on the penalised logistic loss of all pairs; pairs: x, arrays of differences. Only sums reach the driver."""
    w = np.zeros(width)
    for _ in range(STEPS):
        slope, curve, n = _sums(pairs, w)
        step = np.linalg.solve(curve / max(n, 1) + penalty * np.eye(width), slope / max(n, 1) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _between(values: DataFrame, k: int) -> float:
    """The mean of the k-th and the next smallest v of values, from 1. Counts in ever finer ranges; few rows reach the driver."""

    def at(k: int) -> float:
        low, high = values.agg(F.min("v"), F.max("v")).first()
        some, before = values, 0
        while low < high:
            size = (high - low) / RANGES
            counts = some.groupBy(F.least(F.floor((F.col("v") - low) / size), F.lit(RANGES - 1)).alias("r")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("r").collect()
            for c in counts:
                if before + c["n"] >= k:
                    break
                before += c["n"]
            low, high = c["lo"], c["hi"]
            some = values.where((F.col("v") >= low) & (F.col("v") <= high))
        return low

    return (at(k) + at(k + 1)) / 2


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A table (doc_id, quality, f) of all labelled documents that aren't held out. Features are taken before anything is shuffled."""
    usable = written(labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")))
    rows = maybe_among(docs.select("doc_id", "text"), ["doc_id"], usable).select("doc_id", F.xxhash64(text_of()).alias("mark"), features(text_of()).alias("f"))
    read = rows.join(usable, "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min_by("f", "mark").alias("f"))
    out = written(read)
    delete(usable)
    return out


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """A ranker from all labelled documents that aren't held out.

    Documents are dealt by a hash of their id to groups of about MINOR of the rarer class. A document is paired with all
    of the other class in its group and with the mean of that class, so that each takes part. Ids that are labelled
    more than once count with their greatest label, null labels not at all. Without documents of both classes
    every score is one half.
    """
    rows = _labelled(docs, labels)
    classes = {r["quality"]: r for r in rows.groupBy("quality").agg(F.count("*").alias("n"), *(F.avg(F.get("f", F.lit(i))).alias(f"m{i}") for i in range(WIDTH)), *(F.avg(F.get("f", F.lit(i)) * F.get("f", F.lit(i))).alias(f"s{i}") for i in range(WIDTH))).collect()}
    if {*classes} != {0, 1}:
        delete(rows)
        return Ranker((0.0,) * WIDTH, 0.0)
    n = np.array([classes[q]["n"] for q in (0, 1)])
    means, squares = (np.array([[classes[q][f"{c}{i}"] for i in range(WIDTH)] for q in (0, 1)]) for c in "ms")
    mean = n @ means / n.sum()
    scale = np.maximum(np.sqrt(np.maximum(n @ squares / n.sum() - mean**2, 0)), 1e-6)
    array = lambda v: F.array(*(F.lit(float(x)) for x in v))
    z = F.zip_with(F.zip_with("f", array(mean), lambda x, m: x - m), array(scale), lambda x, s: x / s)
    group = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(max(1, int(n.min()) // MINOR)))
    of = lambda q: F.concat(F.collect_list(F.when(F.col("quality") == q, F.col("z"))), F.array(array((means[q] - mean) / scale)))
    groups = rows.select(group.alias("group"), "quality", z.alias("z")).groupBy("group").agg(of(1).alias("good"), of(0).alias("bad"))
    pairs = written(groups.select(F.flatten(F.transform("good", lambda g: F.transform("bad", lambda b: F.zip_with(g, b, lambda x, y: x - y)))).alias("x")))
    w = rank(pairs, WIDTH) / scale
    strength = F.aggregate(F.zip_with("f", array(w), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    cut = _between(rows.select(strength.alias("v")), int(n[0]))
    delete(rows, pairs)
    return Ranker(tuple(w.tolist()), float(np.log(CUT / (1 - CUT)) - cut))


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs.

    Scores see the text alone; null counts as empty, and empty texts have a score like any other. A null
    doc_id is not held out.
    """
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), train(docs, labels).score(text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score is at least cut."""
    return docs.where(train(docs, labels).score(text_of()) >= cut)
