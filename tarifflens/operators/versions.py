"""Versions of prices: which is active, and which was current when a document came in.

A version is live until a later document of the same partner and service has a date on or after its own. The
dated ones that are live at any time therefore form a stack whose dates fall from the oldest document to
the newest; one pass over a key's documents keeps it, finds the latest date below a document's own by bisection,
and takes off what the document replaces. The stack never has more rows than there are different dates. Keys of many
versions are cut into blocks of documents, each of which starts from the stack that the blocks before it leave.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Versions of one key that one task takes at once.
BLOCK = 8_192
KEY = ("partner_id", "service_id")
#: Before any day.
NO_DAY = -(1 << 31)


def active_versions(items: DataFrame) -> DataFrame:
    """items with active: no later document of the same partner and service has a date on or after the item's."""
    later = F.max("effective_date").over(W.partitionBy(*KEY).orderBy("doc_seq").rangeBetween(1, W.unboundedFollowing))
    replaced = F.col("service_id").isNotNull() & F.col("later").isNotNull() & (F.col("effective_date").isNull() | (F.col("effective_date") <= F.col("later")))
    return items.withColumn("later", later).withColumn("active", ~replaced).drop("later")


def _greater(v: tuple, w: tuple) -> bool:
    """Whether a version (day, item_id, price, place) stands above another of its day and place."""
    return (v[1], v[2] is not None, v[2] or 0) > (w[1], w[2] is not None, w[2] or 0)


class Live:
    """The live versions of one key: dated ones by falling date, and those without a date since the last dated document.

    Of one date and document only the version of the greatest id can be an answer, so only that is kept; of one id, that of the greatest price.
    """

    def __init__(self):
        self.days: list[int] = []  # negative, so that they rise
        self.dated: list[tuple] = []
        self.undated: tuple | None = None

    def before(self, day: int | None) -> tuple | None:
        """The version of the latest date below day (of any date, where day isn't known), else one without a date."""
        at = 0 if day is None else bisect_right(self.days, -day)
        return self.dated[at] if at < len(self.dated) else self.undated

    def add(self, versions: list[tuple]) -> None:
        """versions (day, item_id, price, place) of one place in the order of documents; they don't replace one another."""
        newest: dict[int | None, tuple] = {}
        for v in versions:
            if v[0] not in newest or _greater(v, newest[v[0]]):
                newest[v[0]] = v
        undated = newest.pop(None, None)
        if newest:
            while self.days and -self.days[-1] <= max(newest):
                self.days.pop()
                self.dated.pop()
            for day in sorted(newest, reverse=True):
                self.days.append(-day)
                self.dated.append(newest[day])
            self.undated = None
        self.undated = undated or self.undated


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Pairs of the first width values and the rows that follow one another with these."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for start, some in groupby(rows, key=lambda r: r[:width]):
        yield start, [r[width:] for r in some]


def _carried(hot: DataFrame) -> DataFrame:
    """For each block, the rows that are live where it starts. Only what is live at a block's end is shuffled by key."""
    ahead = W.partitionBy(*KEY, "block").orderBy("doc_seq").rangeBetween(1, W.unboundedFollowing)
    left = hot.withColumn("later", F.max("day").over(ahead)).where("later IS NULL OR day > later").drop("later")
    # Of what one document leaves with one date the greatest id is enough, and of documents without a date the last.
    best = F.max(F.struct("doc_seq", "item_id", "price")).alias("b")
    left = left.groupBy(*KEY, "block", "day").agg(best).select(*KEY, "block", "b.doc_seq", "day", "b.item_id", "b.price")
    left = left.withColumn("own", F.col("doc_seq"))
    schema = StructType([left.schema[c] for c in (*KEY, "block", "day", "item_id", "price", "own")])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, live = None, Live()
        for (*key, block, _), versions in _runs(batches, 4):
            if key != last:
                last, live, at = key, Live(), None
            if block != at:
                rows = [(*key, block, *v) for v in [*live.dated, *([live.undated] if live.undated else [])]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)
                at = block
            live.add(versions)

    types = to_arrow_schema(schema).types
    return left.repartition(*KEY).sortWithinPartitions(*KEY, "block", "doc_seq").select(*KEY, "block", "doc_seq", "day", "item_id", "price", "own").mapInArrow(carry, schema)


def previous_prices(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (item_id, previous_id, previous_price): the version that was current when the item's document came in.

    An earlier item counts if it is dated before this one (or either has no date) and no document between
    them replaced it; the latest date wins, then the later document, then the greater id. Rows of one item_id have
    one answer, the best of theirs. Items without a service or a place have none. One pass in the order of documents; keys of over block versions are dealt to several tasks.
    """
    known = items.where("service_id IS NOT NULL AND doc_seq IS NOT NULL").select("item_id", *KEY, F.col("doc_seq").cast("long").alias("doc_seq"), F.unix_date("effective_date").alias("day"), "price")
    many = known.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("doc_seq").alias("first"), F.max("doc_seq").alias("last")).where(F.col("n") > block)
    same = F.lit(True)
    for c in KEY:
        same &= F.col(f"k.{c}").eqNullSafe(F.col(f"m.{c}"))
    parts = F.ceil(F.col("n") / block)
    at = F.floor((F.col("doc_seq") - F.col("first")) / (F.col("last") - F.col("first") + 1) * parts).cast("int")
    rows = known.alias("k").join(many.alias("m"), same, "left").select(*(f"k.{c}" for c in known.columns), F.coalesce(at, F.lit(0)).alias("block"), F.col("n").isNotNull().alias("hot"))
    carried = _carried(rows.where("hot").drop("hot")).select(*KEY, "block", F.lit(None).cast("long").alias("doc_seq"), "day", "item_id", "price", "own")
    both = rows.select(*KEY, "block", "doc_seq", "day", "item_id", "price", F.col("doc_seq").alias("own")).union(carried)
    dealt = both.repartition(*KEY, "block").sortWithinPartitions(*KEY, "block", F.col("doc_seq").asc_nulls_first())
    item, price = both.schema["item_id"].dataType, both.schema["price"].dataType
    schema = StructType([StructField("item_id", item), StructField("previous_id", item), StructField("previous_price", price), StructField("day", IntegerType()), StructField("own", LongType())])
    types = to_arrow_schema(schema).types

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, live, found = None, Live(), []

        def rows() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else ((), (), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for (*key, seq), versions in _runs(batches, 4):
            if key != last:
                last, live = key, Live()
            if seq is not None:
                for day, item, *_ in versions:
                    was = live.before(day)
                    if was is not None:
                        found.append((item, was[1], was[2], was[0], was[3]))
            live.add(versions)
            if len(found) >= 4_096:
                yield rows()
                found = []
        yield rows()

    best = F.max(F.struct(F.coalesce("day", F.lit(NO_DAY)).alias("day"), "own", "previous_id", "previous_price")).alias("b")
    return dealt.mapInArrow(answer, schema).groupBy("item_id").agg(best).select("item_id", "b.previous_id", "b.previous_price")
