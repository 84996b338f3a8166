"""Candidates of a bounded insert-delete distance, through an inverted index of character q-grams.

Two texts of n and m characters whose similarity 2 L / (n + m) is at least some bound (L: the length of their longest
common subsequence) have few characters apart. One of them takes at most q of the other's q-grams where it is missing,
and q - 1 where it stands in between. So of a text's q-grams, counted with repeats, only a known number can be
lost, and if both texts put theirs in one order, they share one among the first so many and one. The order
is by how rare grams are, so common ones are seldom needed; places of grams and lengths rule out most of the pairs
that still meet. Nothing is lost, whatever the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Length of grams by the least length of the one text, longest first; the other may be shorter by a quarter, and both must have a gram left.
CLASSES = ((19, 3), (7, 2), (1, 1))
#: Bits of a gram's address in the table of how common grams are.
ADDRESS_BITS = 16


def spread(least: float) -> float:
    """How many times as long as the other a text may be."""
    return (2 - least) / least


def lost(n: Column, q: Column, least: float) -> Column:
    """How many q-grams a text of n characters may not share with one of that similarity.

    Of its characters x may be missing in the other and y of the other's in it, with x + y <= (1 - least) (n + m) and m = n - x + y.
    """
    share = 1 - least
    return F.floor(n * 2 * share * F.greatest(q / (1 + share), (q - 1) / (1 - share)) + 1e-9).cast("int")


def _grams(text: Column, q: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - q + 1, F.lit(1))), lambda i: F.substring(text, i, q))


def _address(gram: Column) -> Column:
    return F.xxhash64(gram).bitwiseAND(F.lit((1 << ADDRESS_BITS) - 1).cast("bigint"))


def commonness(texts: DataFrame, column: str) -> bytes:
    """By address, how many grams of texts have it, as a power of two. It orders grams and leaves none out; 65,536 numbers come to the driver."""
    grams = texts.select(F.explode(F.concat(*(_grams(F.col(column), F.lit(q)) for _, q in CLASSES))).alias("g"))
    out = bytearray(1 << ADDRESS_BITS)
    for address, n in grams.groupBy(_address(F.col("g")).alias("a")).count().collect():
        out[address] = n.bit_length()
    return bytes(out)


def _prefix(text: Column, q: Column, least: float, common: bytes) -> Column:
    """Structs (gram, at) of the text's first q-grams in the order; at is null for a gram that stands more than once, where it isn't known which is which."""
    rank = lambda g: F.hex(F.substring(F.lit(common), _address(g).cast("int") + 1, F.lit(1)))

    def numbered(grams: Column) -> Column:
        # grams are sorted by text, so a gram's repeats follow one another
        return F.transform(grams, lambda g, i: F.struct(rank(g).alias("rank"), g.alias("gram"), (i + 1 - F.array_position(grams, g)).alias("copy")))

    ordered = F.array_sort(let(F.array_sort(_grams(text, q)), numbered))
    first = F.slice(ordered, 1, lost(F.length(text), q, least) + 1)
    place = lambda g: let(F.call_function("locate", g, text), lambda p: F.when(F.call_function("locate", g, text, p + 1) == 0, p))
    return F.transform(first, lambda x: F.struct(x["gram"].alias("gram"), x["copy"].alias("copy"), place(x["gram"]).alias("at")))


def _parity(text: Column, q: int) -> Column:
    """A bit for each of 64 addresses: whether an odd number of q-grams is there. A character put in or left out changes 2 q - 1 of them at most."""
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.xxhash64(g).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    return F.aggregate(_grams(text, F.lit(q)), F.lit(0).cast("bigint"), lambda b, g: b.bitwiseXOR(bit(g)))


def candidates(names: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (x, y) within as many edits as that similarity allows, among them all that have it; names: distinct texts x, labels: distinct texts y, none empty.

    Postings meet in an equality join on grams, which adaptive execution splits where a gram is hot; lengths,
    places, parity bits and a bounded edit distance decide within the join, so only near pairs leave it. Names meet
    only gram lengths of their class, so each is looked up once.
    """
    common, wide = commonness(labels, "y"), spread(least)
    n, m = F.length("x"), F.length("y")
    names, labels = (t.select(c, *(_parity(F.col(c), q).alias(f"{c}{q}") for q in (1, 2))) for t, c in ((names, "x"), (labels, "y")))
    most = F.floor((n + m) * (1 - least) + 1e-9).cast("int")
    own, reached, longest = F.lit(None).cast("int"), [], None
    for shortest, q in CLASSES:
        own = F.coalesce(own, F.when(n >= shortest, q))
        within = m >= F.ceil(F.lit(shortest / wide - 1e-9))
        reached.append(F.when(within if longest is None else within & (m <= longest * wide), q))
        longest = shortest
    # Outer, though none is empty: otherwise a filter by size computes the prefixes once more.
    left = names.withColumn("q", own).select("x", "x1", "x2", F.explode_outer(_prefix(F.col("x"), F.col("q"), least, common)).alias("p"))
    right = labels.withColumn("q", F.explode(F.array_compact(F.array(*reached)))).select("y", "y1", "y2", F.explode_outer(_prefix(F.col("y"), F.col("q"), least, common)).alias("p"))
    left = left.select("x", "x1", "x2", "p.gram", "p.copy", F.col("p.at").alias("at"))
    right = right.select("y", "y1", "y2", "p.gram", "p.copy", F.col("p.at").alias("there"))
    moved = F.abs(F.col("at") - F.col("there")) + F.abs((n - F.col("at")) - (m - F.col("there")))
    near = (F.abs(n - m) <= most) & (F.bit_count(F.col("x1").bitwiseXOR(F.col("y1"))) <= most) & (F.bit_count(F.col("x2").bitwiseXOR(F.col("y2"))) <= 3 * most)
    near &= F.coalesce(moved <= most, F.lit(True)) & (F.call_function("levenshtein", F.col("x"), F.col("y"), most) >= 0)
    return left.join(right, ["gram", "copy"]).where(near).select("x", "y").distinct()
