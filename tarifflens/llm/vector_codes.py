"""Vector code compression: product codes found by VA-file filtering.

Vectors become integers and are cut into parts; each part is coded by the nearest entry of its position's
codebook. The entries' coordinates are quantised to cells of a few bits. For a query part, lookup tables hold the
least and greatest squared distance of each of its coordinates to each cell; their sums bound an entry's
distance from below and above. Only entries whose lower bound reaches the least upper bound are compared in full.
Spark deals the vectors out; a task keeps one batch and the codebooks, whose size the parameters fix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a cell's number, and the greatest integer of a component (beyond it, the integer stays there), so that sums of squares fit 64 bits.
CELL_BITS, GREATEST = 4, 1 << 24
#: Vectors that are compared at once.
ROWS = 2_048


class CellIndex:
    """One part's codebook as a VA file: each coordinate's entries in cells of nearly equal numbers."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries  # (entries, width)
        count, width = entries.shape
        cells = min(1 << bits, count)
        rank = np.empty_like(entries)
        order = np.argsort(entries, axis=0, kind="stable")
        np.put_along_axis(rank, order, np.arange(count)[:, None].repeat(width, 1), axis=0)
        self.cell = rank * cells // count
        among = [self.cell == c for c in range(cells)]
        self.low = np.stack([np.where(m, entries, np.iinfo(np.int64).max).min(axis=0) for m in among])
        self.high = np.stack([np.where(m, entries, np.iinfo(np.int64).min).max(axis=0) for m in among])

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance, as the cells tell it, of each query to each entry."""
        q = queries[:, None, :]
        near = np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2  # the lookup tables: (query, cell, coordinate)
        far = np.maximum(np.abs(q - self.low), np.abs(q - self.high)) ** 2
        lower, upper = (np.zeros((len(queries), len(self.entries)), dtype=np.int64) for _ in range(2))
        for j in range(self.entries.shape[1]):
            lower += near[:, self.cell[:, j], j]
            upper += far[:, self.cell[:, j], j]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each query, the first of equals, and its squared distance."""
        lower, upper = self.bounds(queries)
        query, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        distance = np.full(lower.shape, np.iinfo(np.int64).max)
        distance[query, entry] = ((queries[query] - self.entries[entry]) ** 2).sum(axis=1)
        best = distance.argmin(axis=1)
        return best, distance[np.arange(len(best)), best]


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """First and end of each part; where the width isn't a multiple, the first parts have one component more."""
    sizes = [width // parts + (p < width % parts) for p in range(parts)]
    ends = np.cumsum(sizes).tolist()
    return [(e - s, e) for s, e in zip(sizes, ends, strict=True)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def integers(vector: Column) -> Column:
    """floor(256 x) for each component."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(float(GREATEST))), F.lit(float(-GREATEST))).cast("bigint"))


def _kept(vectors: DataFrame, vector: str) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~bad)


def _sums(vectors: DataFrame, books: list[np.ndarray], cuts: list[tuple[int, int]]) -> dict[int, int]:
    """By address: how many parts each entry is nearest to, and their components' sums. One row for each address and task is shuffled."""
    width = cuts[-1][1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [CellIndex(b) for b in books]
        entries = len(books[0])
        counts, totals = np.zeros((len(cuts), entries), dtype=np.int64), np.zeros((entries, width), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = _matrix(batch.column(0).slice(at, ROWS), width)
                for p, (s, e) in enumerate(cuts):
                    best, _ = indexes[p].nearest(rows[:, s:e])
                    counts[p] += np.bincount(best, minlength=entries)
                    np.add.at(totals[:, s:e], best, rows[:, s:e])
        flat = np.concatenate([counts.ravel(), totals.ravel()])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["a", "n"])

    return dict(tuple(r) for r in vectors.mapInArrow(partial, "a long, n long").groupBy("a").agg(F.sum("n")).collect())


def train(vectors: DataFrame, first: DataFrame, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The parts' codebooks. vectors: one column of integer arrays of one length; first: those that they start as, in order, few of them.

    Each round is one pass over the vectors. Only entries times width sums come to the driver.
    """
    start = np.array([r[0] for r in first.collect()], dtype=np.int64).reshape(-1, len(first.first()[0]))
    cuts = _cuts(start.shape[1], parts)
    books = [start[:, s:e].copy() for s, e in cuts]
    for _ in range(rounds):
        found, entries, width = _sums(vectors, books, cuts), len(start), cuts[-1][1]
        flat = np.zeros(parts * entries + entries * width, dtype=np.int64)
        flat[list(found)] = list(found.values())
        counts, totals = flat[: parts * entries].reshape(parts, entries), flat[parts * entries :].reshape(entries, width)
        for p, (s, e) in enumerate(cuts):
            used = counts[p] > 0
            books[p][used] = totals[used, s:e] // counts[p][used, None]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, label, code, error, label_error, codebooks_sha256), one for each kept vector.

    Vectors that are null or have a null, infinite or undefined component are left out; so are, as no distance to
    them is defined, those of another length than the first of the order. The order is by id, nulls last, equal ids by
    their vectors. Rows that repeat count each. Fewer vectors than entries make smaller codebooks; a length that
    isn't a multiple of the parts makes the first parts longer by one; components beyond 65,536 count as
    65,536. Nulls are one label. An empty table gives none. Other columns are not read.
    """
    rows = _kept(vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")), "v").withColumn("v", integers(F.col("v")))
    ordered = rows.orderBy(F.col("id").asc_nulls_last(), "v")
    head = ordered.select("v").first()
    schema = StructType([rows.schema["id"], rows.schema["label"], *StructType.fromDDL("code string, error long")])
    if head is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
    width = len(head[0])
    rows, ordered = (x.where(F.size("v") == width) for x in (rows, ordered))
    books = train(rows.select("v"), ordered.select("v").limit(entries), parts, rounds)
    cuts = _cuts(width, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [CellIndex(b) for b in books]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                piece = batch.slice(at, ROWS)
                of = _matrix(piece.column(2), width)
                found = [indexes[p].nearest(of[:, s:e]) for p, (s, e) in enumerate(cuts)]
                codes = np.stack([best for best, _ in found], axis=1)
                texts = pa.array(["".join(f"{x:02x}" for x in row) for row in codes.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), texts, pa.array(sum(d for _, d in found))], names=schema.names)

    coded = written(rows.mapInArrow(encode, schema))
    (total,) = fresh(coded, "label_error")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias(total))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of").withColumn("codebooks_sha256", F.lit(digest(books)))


def _rounds_sql() -> str:
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""
        near{r} AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
            SELECT vec_id, p, e, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts JOIN book{r} USING (p)) GROUP BY ALL)""")
        if r < ROUNDS:
            out.append(f"""
        sums{r} AS (SELECT p, e, j, sum(q[j])::BIGINT AS s, count(*) AS n FROM near{r} JOIN parts USING (vec_id, p), range(1, (SELECT w + 1 FROM wide)) t(j) GROUP BY ALL),
        new{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM sums{r} GROUP BY ALL),
        book{r + 1} AS (SELECT p, e, coalesce(n.c, o.c) AS c FROM book{r} o LEFT JOIN new{r} n USING (p, e))""")
    return ",".join(out)


#: For vectors whose length is a multiple of the parts and ids that don't repeat.
COMPRESS_SQL = f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        wide AS (SELECT max(len(v)) // {PARTS} AS w FROM kept),
        parts AS (SELECT vec_id, p, v[p * w + 1 : (p + 1) * w] AS q FROM kept, wide, range({PARTS}) t(p)),
        book0 AS (SELECT p, e, q AS c FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}) JOIN parts USING (vec_id)),
        {_rounds_sql()},
        coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""
