"""Document fingerprints: bottom-k sketches of shingle hashes, as column expressions.

A sketch is the ascending array of the k least distinct 64-bit hashes of a text's five-word shingles.
Sketches of parts merge into the sketch of the whole, and two sketches estimate the resemblance and
containment of their texts' shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, let, shuffle_partitions, text_of, words_of

K, SHINGLE = 128, 5
#: Ranges of ids for each shuffle partition; the more, the more even.
RANGES = 8


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The sketch of a text: A-Z lower-cased, words between ASCII white space. Fewer than n words are one shingle, none give an empty sketch."""

    def shingles(h: Column) -> Column:
        rolling = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < n, F.array(F.xxhash64(h))).otherwise(rolling)

    hashes = let(F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w)), shingles)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(docs: DataFrame, by: list[str], sketches: str, k: int = K) -> DataFrame:
    """Rows (*by, sketches): the sketch of each group's parts together. Each of a group's k least hashes is found by a top-k of its distinct ones; no group meets in one task before its hashes are distinct."""
    hashes = docs.select(*by, F.explode_outer(sketches).alias("h")).distinct()
    salted = hashes.withColumn("salt", F.pmod("h", F.lit(64))).groupBy(*by, "salt").agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias("p"))
    return salted.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, k).alias(sketches))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard index of the shingle sets; two empty sketches are alike."""
    both = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(both, F.lit(0.0)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has, from resemblance and the estimated counts; an empty a is contained."""
    j, n, m = resemblance(a, b, k), shingle_count(a, k), shingle_count(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def shingle_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.get(a, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def as_text(a: Column) -> Column:
    """16 hexadecimal digits for each hash, in order."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame, id_column: str, values: list[str], tie: str) -> DataFrame:
    """docs with next_<value> for each of values: the value of the following row by ascending id, the first row's after the last.

    Null ids come first, equal ids in the order of tie. Ids are cut into ranges at quantiles that are ids
    themselves, so a range's successor is the row at the next cut, which is copied into the range: one
    shuffle, no global sort and no join.
    """
    ranges = RANGES * shuffle_partitions(docs.sparkSession)
    cuts, least, nulls = docs.agg(
        F.percentile_approx(id_column, [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)), F.min(id_column), F.count(F.when(F.col(id_column).isNull(), 1))
    ).first()
    cuts = sorted({*(cuts or [])})
    wide = max(1, round(len(cuts) ** 0.5))
    coarse, fine = (F.from_json(F.lit(str(x)), "array<bigint>") for x in (cuts[::wide], cuts))  # one literal each, folded before it runs
    at = F.col(id_column)
    tens = F.size(F.filter(coarse, lambda c: c <= at))
    place = let(tens, lambda t: F.when(t == 0, 0).otherwise((t - 1) * wide + F.size(F.filter(F.slice(fine, (t - 1) * wide + 1, wide), lambda c: c <= at))))
    place = F.when(at.isNull(), 0).otherwise(place) if cuts else F.lit(0)
    first = at.isNull() if nulls else at == F.lit(least)
    cut = at.isin(cuts) if len(cuts) <= 10 else F.array_contains(fine, at)
    spots = F.array_compact(
        F.array(
            F.struct(F.col("_at").alias("range"), F.lit(0).alias("last"), F.lit(True).alias("own")),
            F.when(cut & (F.col("_at") > 0), F.struct((F.col("_at") - 1).alias("range"), F.lit(0).alias("last"), F.lit(False).alias("own"))),
            F.when(first, F.struct(F.lit(len(cuts)).alias("range"), F.lit(1).alias("last"), F.lit(False).alias("own"))),
        )
    )
    dealt = docs.withColumn("_at", place).withColumn("_spot", F.explode(spots)).select("*", "_spot.range", "_spot.last", "_spot.own").drop("_at", "_spot")
    order = W.partitionBy("range").orderBy("last", F.col(id_column).asc_nulls_first(), tie)
    return dealt.select("*", *(F.lead(v).over(order).alias(f"next_{v}") for v in values)).where("own").drop("range", "last", "own")


def compare_edits(docs: DataFrame) -> DataFrame:
    """A row for each document: its sketch, that of its text with the later half replaced by the next one's beginning, and how alike they are.

    Null texts count as empty. Rows that repeat a doc_id follow one another in the order of their texts'
    hashes, rows without one come first. Other columns are not read.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("sketch", sketch(F.col("text")))
    rows = with_next(rows, "doc_id", ["text", "sketch"], "tie")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.when(half > 0, edited).otherwise(F.col("text")).alias("edited"), "sketch", "next_sketch")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return rows.withColumn("near_edited", resemblance(F.col("sketch"), F.col("edited_sketch"))).withColumn("near_next", resemblance(F.col("sketch"), F.col("next_sketch")))
