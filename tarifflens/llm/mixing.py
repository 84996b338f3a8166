"""Mixing sources to target weights by weighted fair queueing, on DataFrame operations alone.

Within a source, documents are shuffled by a keyed hash and may be taken up to REPEATS times, pass after
pass. A document's virtual finish time is the size taken from its source up to and with it, divided by
the source's weight. Documents leave in the order of finish times until the total budget is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, same, text_of, written

REPEATS, WEIGHTS, SEED = 3, (1, 2, 3), 17
#: Rows for each hash range of a source and each range of finish times, on average, and the least number of either; running sums are kept within one range and carried over between them.
ROWS, LEAST = 20_000, 1024


def document_size(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\x09-\\x0D]+")).cast("long")


def place_of(seed: int = SEED) -> Column:
    """Where the shuffle puts a document; rows with the same id and text share it."""
    return F.xxhash64(F.lit(seed), "doc_id", text_of())


def source_targets(sizes: DataFrame, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, float, int]:
    """Rows (lane_source, source_size, weight, target), the level at which the sources stop, and the budget.

    sizes: rows (lane_source, source_size), one for each source. A target is the level times the weight, or
    repeats times the source's size if that is less. The level rises until the targets share out the budget;
    each round is one aggregation. The sources, not their documents, are numbered in one task.
    """
    number = F.row_number().over(W.orderBy(F.col("lane_source").asc())) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(number, F.lit(len(weights))))
    sources = written(sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(repeats)))
    budget, heft = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    level = budget / heft
    while True:
        full = F.col("most") <= F.col("weight") * level
        used, free = sources.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not free or (budget - used) / free <= level * (1 + 1e-12):
            break
        level = (budget - used) / free
    return sources.withColumn("target", F.least("most", F.col("weight") * level)), level, budget


def mix(docs: DataFrame, columns: list[str], repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Rows (*columns, place, size, source_size, target, copies), one for each row of docs; place is the shuffling hash.

    columns: those of docs to carry along, no text among them. Null texts have size 0, and such documents
    are taken no time; sources order by code point with null last. Rows that repeat are documents of
    their own. No document is taken more than repeats times; reruns agree.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    rows = written(docs.select(*columns, key.alias("lane_source"), document_size(text_of()).alias("size"), place_of(seed).alias("place")))
    ranges = max(LEAST, 1 << (rows.count() // ROWS).bit_length())
    rows = rows.withColumn("lane", F.shiftright("place", 64 - (ranges.bit_length() - 1)))
    lanes = rows.groupBy("lane_source", "lane").agg(F.sum("size").alias("lane_size"))
    sources, level, budget = source_targets(lanes.groupBy("lane_source").agg(F.sum("lane_size").alias("source_size")), repeats, weights)
    before = F.sum("lane_size").over(W.partitionBy("lane_source").orderBy("lane").rowsBetween(W.unboundedPreceding, -1))
    lanes = lanes.withColumn("before", F.coalesce(before, F.lit(0))).join(sources, "lane_source").drop("lane_size", "most")
    running = F.sum("size").over(W.partitionBy("lane_source", "lane").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    queue = written(rows.withColumn("running", running).join(lanes, ["lane_source", "lane"]).withColumn("upto", F.col("before") + F.col("running")))

    def finish(k: Column | int) -> Column:
        return (F.col("upto") + F.lit(1) * k * F.col("source_size")) / F.col("weight")

    copies = queue.where("size > 0").select("size", "lane_source", "place", F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), finish)).alias("finish"))
    # The cut is near level; what is far beyond it shares the last range.
    time = F.least(F.lit(4 * ranges), F.floor(F.col("finish") / (level or 1.0) * 4 * ranges * 0.98))
    copies = copies.withColumn("time", time)
    times = copies.groupBy("time").agg(F.sum("size").alias("sum"))
    times = times.withColumn("upto", F.sum("sum").over(W.orderBy("time").rowsBetween(W.unboundedPreceding, 0)))
    over = times.where(F.col("upto") > budget).orderBy("time").select("time", (F.col("upto") - F.col("sum")).alias("before")).first()
    taken = F.lit(repeats)
    if over is not None:
        order = W.orderBy("finish", "lane_source", "place").rowsBetween(W.unboundedPreceding, 0)
        cut = copies.where(F.col("time") == over["time"]).withColumn("upto", F.sum("size").over(order) + over["before"])
        left = cut.where(F.col("upto") > budget).agg(F.min(F.struct("finish", "lane_source", "place")).alias("x")).first()["x"]
        left = F.struct(*(F.lit(left[c]).alias(c) for c in ("finish", "lane_source", "place")))
        taken = sum((F.when(F.struct(finish(k).alias("finish"), "lane_source", "place") < left, 1).otherwise(0) for k in range(repeats)), F.lit(0))
    return queue.select(*columns, "place", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows with the same id and text count as often as they stand there, and come out as copies of one of them. Null and empty texts have no size and aren't taken; an empty table gives none. Other columns pass through under any name."""
    of, its, copies, place, copy = fresh(docs, "of", "its", "copies", "place", "copy")
    chosen = mix(docs, ["doc_id"]).groupBy("doc_id", "place").agg(F.sum("copies").cast("int").alias("n")).where("n > 0")
    chosen = chosen.select(F.col("doc_id").alias(of), F.col("place").alias(its), F.col("n").alias(copies))
    rows = docs.withColumn(place, place_of())
    joined = rows.join(chosen, (rows[place] == chosen[its]) & same(rows["doc_id"], chosen[of]))  # dealt by place alone, so that texts are shuffled once
    return joined.dropDuplicates(["doc_id", place]).withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))
