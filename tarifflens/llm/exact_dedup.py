"""Exact duplicates by a minimal perfect hash over the distinct digests of a history.

Digests are dealt to buckets by their first digits. In each bucket a hash-and-displace function sends
its digests to slots without gap or clash; a slot holds the whole digest, the winner's id and the size of
the group. A row finds its slot by arithmetic and the digests are compared in full, so a text that the
history lacks is noticed; such texts are grouped by themselves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: Digests of a bucket, and of a displacement group, on average.
BUCKET, GROUP = 2048, 3
#: First argument of the hash that picks a displacement group; displacements themselves count from 0.
GROUP_SALT = -1
_INDEX = "bucket long, m long, seeds array<long>, digests array<string>, winners array<long>, sizes array<long>"


def _hash(salt: int, digest: bytes) -> int:
    """Spark's xxhash64(salt, digest), as a signed long."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(digest, xxh64_intdigest(salt.to_bytes(8, "little", signed=True), 42))
    return h - (1 << 64) if h >> 63 else h


def displacements(digests: list[str]) -> tuple[list[int], list[int]]:
    """Displacement of each group, and slot of each digest. A negative displacement d names slot -d-1."""
    m = len(digests)
    raw = [d.encode() for d in digests]
    groups: list[list[int]] = [[] for _ in range(-(-m // GROUP))]
    for i, d in enumerate(raw):
        groups[_hash(GROUP_SALT, d) % len(groups)].append(i)
    seeds, slots, taken = [0] * len(groups), [-1] * m, bytearray(m)
    single = [g for g, x in enumerate(groups) if len(x) == 1]
    for g in sorted((g for g, x in enumerate(groups) if len(x) > 1), key=lambda g: -len(groups[g])):
        seed = 0
        while True:
            found = []
            for i in groups[g]:
                s = _hash(seed, raw[i]) % m
                if taken[s] or s in found:
                    break
                found.append(s)
            else:
                break
            seed += 1
        seeds[g] = seed
        for i, s in zip(groups[g], found, strict=True):
            slots[i], taken[s] = s, 1
    free = (s for s in range(m) if not taken[s])
    for g in single:
        slots[groups[g][0]] = s = next(free)
        seeds[g] = -s - 1
    return seeds, slots


def _build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    seeds, slots = displacements(list(part["digest"]))
    part = part.assign(slot=slots).sort_values("slot")
    return pd.DataFrame([{"bucket": key[0], "m": len(part), "seeds": seeds, "digests": list(part["digest"]), "winners": [None if pd.isna(x) else int(x) for x in part["winner"]], "sizes": list(part["n"])}])


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index, a row for each bucket, of rows (digest, id); of equal digests the greatest id wins."""
    distinct = history.groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("n"))
    return distinct.withColumn("bucket", bucket_of(F.col("digest"), buckets)).groupBy("bucket").applyInPandas(_build, _INDEX)


def look_up(rows: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """rows with digest, and winner and n of the slot whose digest is the same (null: not in the index)."""
    joined = rows.withColumn("bucket", bucket_of(F.col("digest"), buckets)).join(index, "bucket", "left")
    seed = F.get("seeds", F.pmod(F.xxhash64(F.lit(GROUP_SALT).cast("long"), F.col("digest")), F.size("seeds").cast("long")).cast("int"))
    slot = F.when(F.col("seed") < 0, -F.col("seed") - 1).otherwise(F.pmod(F.xxhash64(F.col("seed"), F.col("digest")), F.col("m"))).cast("int")
    same = F.get("digests", F.col("slot")) == F.col("digest")
    found = joined.withColumn("seed", seed).withColumn("slot", slot)
    return found.select(*rows.columns, F.coalesce(same, F.lit(False)).alias("member"), F.when(same, F.get("winners", F.col("slot"))).alias("winner"), F.when(same, F.get("sizes", F.col("slot"))).alias("n"))


def _digests(frame: DataFrame) -> DataFrame:
    return written(frame.select(F.col("doc_id").cast("long").alias("id"), F.sha2(text_of(), 256).alias("digest")))


def _indexed(known: DataFrame) -> tuple[DataFrame, int]:
    count = known.agg(F.approx_count_distinct("digest")).first()[0]
    buckets = max(1, -(-count // BUCKET))
    return written(build_index(known, buckets)), buckets


def _grouped(found: DataFrame) -> DataFrame:
    """Looked-up rows (id, digest, member, winner, n) with the winners and sizes of what the index lacks taken from themselves."""
    columns = ["id", "digest", "member", "winner", "n"]
    rest = found.where(~F.col("member")).select("id", "digest", "member")
    groups = rest.groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("n"))
    return found.where("member").select(*columns).union(rest.join(groups, "digest").select(*columns))


def exact_groups(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Rows (id, digest, keep_id, group_size), one for each row of docs.

    history: documents seen before (default: docs itself). A row whose text the history has gets its winner
    there, the greatest doc_id of that text; texts that it lacks form groups among docs. group_size counts
    the rows of the group in the history or, where it lacks the text, in docs. Null texts count as empty;
    equal means identical. Null ids lose to any other. Texts are read whole; rows that repeat give a row each; an
    empty table gives none. Columns beside doc_id and text are not read.
    """
    rows = _digests(docs)
    found = written(look_up(rows, *_indexed(rows if history is None else _digests(history))))
    return _grouped(found).select("id", "digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"))


def with_arrivals(history: DataFrame, arriving: DataFrame) -> DataFrame:
    """Rows (id, digest, keep_id, group_size), one for each row of both, as if both were one table.

    Arriving rows whose text the history has are found by its index; those that it lacks form groups of
    their own. What arrives for a text of the history counts towards its group, and its greatest id may take
    the group over. Nulls, repeats and other columns as in exact_groups; either table may be empty.
    """
    old, new = _digests(history), _digests(arriving)
    index, buckets = _indexed(old)
    found = written(look_up(new, index, buckets))
    late = found.where("member").groupBy("digest").agg(F.max("id").alias("late_id"), F.count("*").alias("late"))
    both = look_up(old, index, buckets).union(_grouped(found).select("id", "digest", "member", "winner", "n")).join(late, "digest", "left")
    # greatest() passes nulls over, as max() does.
    return both.select("id", "digest", F.greatest("winner", F.when(F.col("member"), F.col("late_id"))).alias("keep_id"), (F.col("n") + F.when(F.col("member"), F.coalesce("late", F.lit(0))).otherwise(0)).alias("group_size"))
