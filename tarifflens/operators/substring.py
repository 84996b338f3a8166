"""Substring search, whatever the case, over an inverted index of trigrams.

A text has a pattern only if it has all trigrams of the pattern's literal parts. The lists of the rarest few are
intersected, and what is left is compared with the pattern itself, so the result is that of ILIKE. A table of postings
that is sorted by gram lets a search read the row groups of its grams alone. Long lists are cut into blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of a block of a list, on average; lists that are intersected.
BLOCK, RAREST = 10_000, 3


def literals(pattern: str) -> list[str]:
    """The parts of a LIKE pattern without wildcards; a backslash takes the meaning of the character behind it."""
    parts, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            parts[-1] += pattern[at]
        elif c in "%_":
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    return [p for p in parts if p]


def grams_of(pattern: str) -> list[str]:
    return sorted({p[i : i + 3] for p in (x.lower() for x in literals(pattern)) for i in range(len(p) - 2)})


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (gram, block, n, keys): by gram, the sorted keys of the texts that have it, in blocks. Null texts have no grams."""
    low = F.lower(text)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))
    rows = texts.where(F.length(low) >= 3).select(F.col(key).alias("key"), F.explode(grams).alias("gram"))
    blocks = rows.groupBy("gram").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(blocks, "gram").select("gram", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"), "key")
    return dealt.groupBy("gram", "block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("key")).alias("keys"))


def save(index: DataFrame, path: str) -> None:
    """Writes postings sorted by gram, so that a filter on grams prunes files and row groups."""
    index.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(path)


def search(index: DataFrame, texts: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """The rows of texts whose text holds query, whatever the case; % and _ in it are wildcards.

    A query without three letters in a row reads all texts. Of the index, the sizes of the query's lists come to the driver.
    """
    found = F.col(text).ilike(f"%{query}%")
    grams = grams_of(query)
    if not grams:
        return texts.where(found)
    lists = index.where(F.col("gram").isin(grams))
    sizes = sorted((n, g) for g, n in lists.groupBy("gram").agg(F.sum("n")).collect())
    if len(sizes) < len(grams):
        return texts.limit(0)
    rare = [g for _, g in sizes[:RAREST]]
    hits = lists.where(F.col("gram").isin(rare)).select(F.explode("keys").alias("_key")).groupBy("_key").count().where(F.col("count") == len(rare)).select("_key")
    return texts.join(hits, F.col(key) == F.col("_key"), "left_semi").where(found)
