"""Near-duplicates by their five-word shingles: the pipeline's stage.

Texts whose shingle sets have a Jaccard similarity of 0.8 or more are linked, and one row of each component
stays. Fingerprints (SimHash of the shingles, four bits of radius) link most copies first, each link confirmed on the
full sets. At 0.8 about 15 of 100 bits differ, which no radius with segments long enough to select anything covers, so
what SimHash leaves apart meets by the registers of minhash_dedup, which miss one link in 100 million.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, same, text_of, written
from .minhash_dedup import near_groups

SHINGLE = 5


def similar_groups(docs: DataFrame) -> DataFrame:
    """Rows (id, mark, root), one for each row of docs: its doc_id, a hash of its text, and its group. Texts without words are one group."""
    rows, others = near_groups(docs, shingle=SHINGLE, simhash=True)
    return rows.select("id", "mark", "root").union(others.select("id", "mark", F.lit(-1).cast("long")))


def drop_similar(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the least doc_id, then of the least text hash; a null doc_id only where no other is there.

    Null and empty texts are one group. Rows that repeat id and text come out once. Texts are read whole. An
    empty table gives none. Other columns pass through under any name.
    """
    mark, key, of, its, row = fresh(docs, "mark", "key", "of", "its", "row")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("mark"))
    keep = written(similar_groups(docs).groupBy("root").agg(F.min(order).alias("keep")).select(F.col("keep.id").alias(of), F.col("keep.mark").alias(its), F.xxhash64("keep.id", "keep.mark").alias(row)))
    marked = docs.withColumn(mark, F.xxhash64(text_of()))
    marked = marked.withColumn(key, F.xxhash64("doc_id", mark))
    # Dealt by one key alone, so that texts are shuffled once.
    kept = marked.join(keep, (marked[key] == keep[row]) & same(marked["doc_id"], keep[of]) & same(marked[mark], keep[its]), "left_semi")
    return kept.dropDuplicates([key, "doc_id", mark]).drop(mark, key)
