"""Lossless joins of like sets or sequences, on DataFrame operations alone.

Each item has its size n, the first of its members in one order that holds for all items (its prefix), and
parity bits of its members. Two items that share enough members share one within their prefixes, and no
more parity bits differ than members do; so nothing is lost, whatever the order, and a good order (rare
members first) only makes buckets small.

Members are longs: all but the last PLACE_BITS bits are the key that items meet on, those bits the place
in the item, ANYWHERE if it isn't known. The rows of the prefixes are shuffled once, narrow, by their keys;
the few whose key has more items than one go on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, delete, fresh, written

PLACE_BITS = 16
ANYWHERE = (1 << PLACE_BITS) - 1
#: Columns of parity bits, a power of two of them.
BITS = ("b0", "b1", "b2", "b3")
#: Items of larger buckets also have to be of like size to meet, by an equality of the join.
LARGE = 64
#: Larger buckets are joined through one of their items, and another one, before all of their items are compared.
FEW = 8
#: Rows of keys of at most so many go on only if another row of their key can belong to a link with them.
SMALL = 16
#: A pair of items is put out at none of the keys that follow on one where it meets, among so many of an item's.
BEFORE = 4
#: Addresses of a filter for each wanted row, and bits of the greatest filter's addresses: 16 MB of map.
ROOM, FILTER_BITS = 16, 27


def maybe_among(rows: DataFrame, key: list[str], wanted: DataFrame, others: bool = False) -> DataFrame:
    """rows without most of those whose key (columns of these names) isn't in the table wanted: a bit map sized by its count goes to every executor.

    Beyond what the greatest map can tell apart, rows itself is returned; either way the caller's join decides.
    others: the rows left out instead, whatever their key.
    """
    count = wanted.count()
    bits = max(15, (count * ROOM).bit_length())
    if bits > FILTER_BITS:
        return rows
    at, low = F.xxhash64(*key).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")), F.lit(32767).cast("bigint")
    pages = wanted.select(at.alias("_p")).groupBy(F.shiftright("_p", 15).alias("_page")).agg(F.bitmap_construct_agg(F.col("_p").bitwiseAND(low)).alias("_map"))
    p, page, bitmap = fresh(rows, "p", "page", "map")
    pages = pages.select(F.col("_page").alias(page), F.col("_map").alias(bitmap))
    joined = rows.withColumn(p, at).join(F.broadcast(pages), F.shiftright(p, 15) == F.col(page), "left" if others else "inner")
    bit = F.col(p).bitwiseAND(low).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, bit % 8), F.lit(0).cast("tinyint"))
    return joined.where(found == (0 if others else 1)).drop(p, page, bitmap)


def _key(e: Column | str) -> Column:
    return F.shiftright(e, PLACE_BITS)


def _band(n: Column) -> Column:
    """Sizes whose ratio is at most 5 : 4 are in one band or in neighbouring ones."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1.25 + 1e-9))).cast("int")


def _place(e: Column) -> Column:
    return e.bitwiseAND(F.lit(ANYWHERE).cast("bigint"))


def meeting(members: DataFrame, may: Callable[[Callable, Callable], Column]) -> DataFrame:
    """A table of the rows (e, h, n) of members, which may repeat, that meet another item by their key.

    Where up to SMALL rows meet, may has to hold for a row and another item's, or the row goes: words that common
    by themselves meet by chance, the more often the more lines there are. may has to depend on differences of places
    alone: keys that the same items hold at the same distances become one key, places count from the key's first
    one, and such rows stay once. Near copies share many keys and are compared for few of them.
    """
    keyed = members.repartition(_key("e")).withColumn("k", _key("e"))  # dealt before k is there, so k isn't shuffled
    bucket = W.partitionBy("k")
    at = _place(F.col("e"))
    ends = {"lo": F.min("h").over(bucket), "hi": F.max("h").over(bucket), "size": F.count("*").over(bucket)}
    shared = _with_mates(keyed.withColumns(ends).where("lo <> hi"), ["h", "n", "e"], may)
    shared = shared.withColumns(ends | {"from": F.min(at).over(bucket)})
    place = F.when(at == ANYWHERE, at).otherwise(at - F.col("from"))
    shared = shared.withColumn("place", place).withColumn("same", F.bit_xor(F.xxhash64("h", "place")).over(bucket))
    key = F.xxhash64("same", "size", "lo", "hi").bitwiseAND(F.lit((1 << 63) - 1 - ANYWHERE).cast("bigint"))
    rows = written(shared.select(key.bitwiseOR(F.col("place")).alias("e"), "h", "n"))
    out = written(rows.distinct())
    delete(rows)
    return out


def _with_mates(rows: DataFrame, columns: list[str], test: Callable[[Callable, Callable], Column]) -> DataFrame:
    """rows (k, size and columns, h among these) without those of keys of at most SMALL rows that test lets meet no other item's."""
    mates = F.collect_set(F.when(F.col("size") <= SMALL, F.struct(*columns))).over(W.partitionBy("k"))
    meets = F.exists("mates", lambda y: (y["h"] != F.col("h")) & test(lambda c: F.col(c), lambda c: y[c]))
    return rows.withColumn("mates", mates).where((F.col("size") > SMALL) | meets).drop("mates")


def groups(shared: DataFrame, items: DataFrame, may: Callable[[Callable, Callable], Column], allowed: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (node, component) of the items that links join with others: the components of all pairs that verify lets through.

    shared: the table that meeting makes of the items' prefixes; it is deleted. items: a table of distinct h with n
    and the longs BITS. may: whether two rows (h, n, e) of one key, as functions of a column's name, can belong to a
    link; only items whose sizes' ratio is at most 5 : 4 can. allowed: how many members two items of these sizes
    may not share. verify: a table of those of the pairs (a, b) of h that are links. Items are first linked with the
    least of the least items of their buckets, then with the others of these, each time only what isn't joined
    yet, so that a group of near copies costs what it has members. Where large buckets still hold several parts, their
    items are linked with one of them, another one each time, as long as that halves the pairs of items of different
    parts. Then all items of a bucket that these links don't join are compared, a pair not again at keys that follow
    on one where it met. All parity bits and places tell before a pair leaves a join.
    """
    bucket = W.partitionBy("k")
    apart = lambda x, y: reduce(Column.__add__, (F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x, y, strict=True)))

    def near(x: Callable, y: Callable) -> Column:
        return may(x, y) & (apart([x(c) for c in BITS], [y(c) for c in BITS]) <= allowed(x("n"), y("n")))

    own = ["h", "n", "e", *BITS]
    rows = shared.join(items.select("h", *BITS), "h").repartition(_key("e")).withColumn("k", _key("e"))
    rows = rows.withColumn("size", F.count("*").over(bucket).cast("int")).withColumn("rep", F.min(F.struct(*own)).over(bucket))
    by_rep = (F.col("h") != F.col("rep.h")) & near(lambda c: F.col(c), lambda c: F.col(f"rep.{c}"))
    rows = rows.select("k", *own, "size", F.when(by_rep, F.col("rep.h")).alias("a"))
    rows = written(_with_mates(rows, own, near).where("size > 2 OR a IS NOT NULL").drop("k"))
    delete(shared)

    star = written(rows.where("a IS NOT NULL").select("a", F.col("h").alias("b")).distinct())
    parts = written(connected_components(verify(written(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))), "a", "b"))
    parts = _joined(parts, verify(_apart(star, parts)))

    now = _mixed(rows.where("size > 2"), parts)
    delete(rows, star)
    left, turn = _crossing(now), 0
    while left:
        turn += 1
        chosen = F.min(F.struct(F.xxhash64(F.lit(turn), "h"), *own, "part")).over(bucket)
        pairs = now.where(F.col("size") > FEW).withColumn("rep", chosen).where((F.col("part") != F.col("rep.part")) & near(lambda c: F.col(c), lambda c: F.col(f"rep.{c}")))
        some = written(pairs.select(F.least("h", "rep.h").alias("a"), F.greatest("h", "rep.h").alias("b")).distinct())
        parts = _joined(parts, verify(some))
        old, now = now, _mixed(now, parts)
        delete(old, some)
        before, left = left, _crossing(now)
        if 2 * left > before:
            break

    band = F.when(F.col("size") > LARGE, _band(F.col("n"))).otherwise(0)
    table, before = now, F.collect_list("e").over(W.partitionBy("h").orderBy("k").rowsBetween(-BEFORE, -1))
    now = now.withColumn("band", band).withColumn("before", before)
    reach = F.when(F.col("size") > LARGE, F.array(F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(0)))
    x, y = now.alias("x"), now.select("*", F.explode(reach).alias("meet")).alias("y")
    once = (F.col("x.band") != F.col("y.band")) | (F.col("x.h") < F.col("y.h"))
    on = (F.col("x.k") == F.col("y.k")) & (F.col("x.band") == F.col("y.meet")) & once & (F.col("x.part") != F.col("y.part"))

    def met(p: Column, q: Column) -> Column:
        of = lambda side, e: lambda c: e if c == "e" else F.col(f"{side}.{c}")
        return (_key(p) == _key(q)) & may(of("x", p), of("y", q))

    again = F.exists("x.before", lambda p: F.exists("y.before", lambda q: met(p, q)))
    pairs = x.join(y, on & near(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")) & ~again)
    rest = written(pairs.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")).distinct())
    out = _joined(parts, verify(rest))
    delete(table, rest)
    return out


def _mixed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """A table of the rows of those keys that hold items of several parts, with k and part."""
    of = parts.select(F.col("node").alias("h"), "component")
    now = rows.drop("k", "part").join(of, "h", "left").select("e", "h", "n", *BITS, "size", F.coalesce("component", "h").alias("part"))
    now = now.repartition(_key("e")).withColumn("k", _key("e"))
    bucket = W.partitionBy("k")
    return written(now.withColumns({"lo": F.min("part").over(bucket), "hi": F.max("part").over(bucket)}).where("lo <> hi").drop("lo", "hi"))


def _crossing(rows: DataFrame) -> float:
    """How many pairs of items of different parts the larger keys hold."""
    own = rows.where(F.col("size") > FEW).groupBy("k", "part").count()
    n = F.col("count").cast("double")
    return own.groupBy("k").agg((F.sum(n) * F.sum(n) - F.sum(n * n)).alias("pairs")).agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0] / 2


def _parts_of(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs (a, b) with the parts that their items are in, pa and pb."""
    of = lambda x: parts.select(F.col("node").alias(f"n{x}"), F.col("component").alias(f"p{x}"))
    both = pairs.join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left")
    return both.select("a", "b", F.coalesce("pa", "a").alias("pa"), F.coalesce("pb", "b").alias("pb"))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """A table of those of the pairs whose items are in different parts."""
    return written(_parts_of(pairs, parts).where("pa <> pb").select("a", "b"))


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """A table of the parts (node, component) with links added; only the parts that these join go through the search for components."""
    more = written(connected_components(_parts_of(links, parts).select("pa", "pb").distinct(), "pa", "pb").withColumnsRenamed({"node": "part", "component": "root"}))
    old = parts.join(more, F.col("component") == F.col("part"), "left").select("node", F.coalesce("root", "component").alias("component"))
    return written(old.union(more.select("part", "root")).distinct())
