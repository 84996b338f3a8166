"""Ranked lexical search over a clustered index whose order comes from recursive graph bisection.

The terms of a block of items are the index's vocabulary. Bisection is fitted on a bounded sample of
documents: halves swap documents as long as that shortens the logarithmic gaps of their terms' postings, then each
half is bisected in turn. Every document descends the tree to the side where its terms cost less, and takes its
place in the order. Shards are runs of that order. An item visits a task's shards by their bounds, the sums
of its terms' greatest impacts there, and stops at the first bound below the score that its result needs;
bounds never fall short, so the result is exact. Ties are settled by the doc_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import shuffle_partitions, text_of, written

TOP = 10
#: Distinct terms and items of a block; further items make further blocks, each with a pass of its own.
BLOCK_TERMS, BLOCK_ITEMS = 50_000, 4_096
#: Documents that bisection is fitted on, terms of each that count there, depth of the tree, rounds of swaps.
SAMPLE, SAMPLE_TERMS, DEPTH, SWAPS = 2_048, 512, 6, 20
#: Documents of a shard; documents and postings that a task holds at once.
SHARD, HELD_DOCS, HELD_POSTINGS = 256, 16_384, 2_000_000

#: Letters, digits and all bytes of characters beyond ASCII make terms; A-Z become a-z, the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Block:
    """Items with their terms as numbers."""

    def __init__(self):
        self.ids, self.queries, self.vocabulary = [], [], {}

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_ITEMS or len(self.vocabulary) >= BLOCK_TERMS

    def add(self, item_id, text: bytes) -> None:
        counts = Counter(terms_of(text))
        numbers = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counts], dtype=np.int64)
        self.ids.append(item_id)
        self.queries.append((numbers, np.array(list(counts.values()), dtype=np.int64)))


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[Block]:
    """The items by blocks of bounded size (beyond the last item's terms); one partition of items at a time comes to the driver."""
    block = Block()
    for row in items.select(F.col(item), text_of(text).cast("binary")).toLocalIterator():
        block.add(row[0], bytes(row[1]))
        if block.full():
            yield block
            block = Block()
    if block.ids:
        yield block


def _postings(docs: DataFrame, id_column: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows (id, n, terms, tfs) of the documents that have a term: all terms' number, and how often the vocabulary's stand there."""
    of = docs.select(F.col(id_column).alias("id"), text_of(text).cast("binary").alias("text"))
    schema = StructType([of.schema["id"], *StructType.fromDDL("n long, terms array<int>, tfs array<int>")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, terms, tfs, ends = [], [], [], [], [0]
            for i, value in enumerate(batch.column(1)):
                words = terms_of(value.as_py())
                if words:
                    numbers = np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                    known, tf = np.unique(numbers[numbers >= 0], return_counts=True)
                    at.append(i)
                    sizes.append(len(words))
                    terms.append(known)
                    tfs.append(tf.astype(np.int32))
                    ends.append(ends[-1] + len(known))
            if at:
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(sizes, pa.int64()), *lists], names=schema.names)

    return of.mapInArrow(count, schema)


def _cost(degree: np.ndarray, n: int) -> np.ndarray:
    """What the gaps of a term's postings cost in a half of n documents that has so many of them."""
    return degree * np.log2(max(n, 1) / (degree + 1.0))


def bisect(documents: list[np.ndarray], terms: int, depth: int = DEPTH) -> tuple[np.ndarray, list[int]]:
    """The tree that recursive graph bisection makes of documents (arrays of distinct term numbers).

    Returns, for each inner node in heap order, by term how much more it costs on the left than on the right, and
    the documents' order.
    """
    tree = np.zeros(((1 << depth) - 1, terms), dtype=np.float32)
    order = []

    def degrees(half: list[int]) -> np.ndarray:
        return np.bincount(np.concatenate([documents[d] for d in half]), minlength=terms) if half else np.zeros(terms, dtype=np.int64)

    def split(some: list[int], node: int) -> None:
        if node >= len(tree):
            order.extend(some)
            return
        left, right = some[: len(some) // 2], some[len(some) // 2 :]
        for _ in range(SWAPS):
            a, b, n, m = degrees(left), degrees(right), len(left), len(right)
            here = _cost(a, n) + _cost(b, m)
            to_right = here - _cost(np.maximum(a - 1, 0), n) - _cost(b + 1, m)
            to_left = here - _cost(a + 1, n) - _cost(np.maximum(b - 1, 0), m)
            gains = [sorted(((float(g[documents[d]].sum()), -d) for d in half), reverse=True) for g, half in ((to_right, left), (to_left, right))]
            swapped = 0
            for x, y in zip(*gains, strict=False):
                if x[0] + y[0] <= 1e-9:
                    break
                swapped += 1
            left = [-d for _, d in gains[1][:swapped]] + [-d for _, d in gains[0][swapped:]]
            right = [-d for _, d in gains[0][:swapped]] + [-d for _, d in gains[1][swapped:]]
            if not swapped:
                break
        a, b, n, m = degrees(left), degrees(right), len(left), len(right)
        tree[node] = (_cost(a + 1, n) - _cost(a, n)) - (_cost(b + 1, m) - _cost(b, m))
        split(left, 2 * node + 1)
        split(right, 2 * node + 2)

    split(list(range(len(documents))), 0)
    return tree, order


def leaves(tree: np.ndarray, starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The leaf of each document; starts: where its terms begin in terms, and the end."""
    node = np.zeros(len(starts) - 1, dtype=np.int64)
    of = np.repeat(np.arange(len(node)), np.diff(starts))
    while len(tree) and node.max(initial=0) < len(tree):
        costs = np.bincount(of, weights=tree[node[of], terms], minlength=len(node))
        node = 2 * node + 1 + (costs > 0)
    return node - len(tree)


def _impacts(weights: np.ndarray, n: np.ndarray, tf: np.ndarray, term: np.ndarray, count: int, length: int) -> np.ndarray:
    """A posting's part of a score; n: the document's length, for each posting."""
    lengths, back = np.unique(n, return_inverse=True)
    m = np.array([25 + 75 * int(x) * count // length for x in lengths], dtype=np.int64)[back]
    return weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Shards:
    """Postings of a run of documents in the index's order, by shard and term, with each term's greatest impact in each shard."""

    def __init__(self, terms: int, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        key = doc // SHARD * terms + term
        order = np.argsort(key, kind="stable")
        self.terms, self.doc, self.impact = terms, doc[order], impact[order]
        self.keys, self.starts = np.unique(key[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(order) else np.empty(0, np.int64)
        self.docs, self.count = len(sizes), -(-len(sizes) // SHARD)

    def bounds(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The greatest score that each shard can have for a query."""
        keys = (np.arange(self.count)[:, None] * self.terms + terms).ravel()
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        most = np.where(self.keys[at] == keys, self.most[at], 0) if len(self.keys) else np.zeros(len(keys), dtype=np.int64)
        return (most.reshape(self.count, -1) * times).sum(axis=1)

    def scores(self, shard: int, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        keys = shard * self.terms + terms
        at = np.searchsorted(self.keys, keys)
        out = np.zeros(min(SHARD, self.docs - shard * SHARD), dtype=np.int64)
        for i, k, n in zip(at.tolist(), keys.tolist(), times.tolist(), strict=True):
            if i < len(self.keys) and self.keys[i] == k:
                s, e = self.starts[i], self.ends[i]
                out[self.doc[s:e] - shard * SHARD] += n * self.impact[s:e]  # a document stands once among a term's postings
        return out


def _better(best: list[tuple], more: list[tuple], top: int) -> list[tuple]:
    return sorted(best + more, key=lambda r: (-r[0], r[1] is None, r[1]))[:top]


def visit(shards: Shards, ids: list, query: tuple[np.ndarray, np.ndarray], best: list[tuple], least: int, top: int) -> tuple[list[tuple], int]:
    """best (score, id) with what shards has, and the number of shards that were visited. least: a score that the result's last is known to have at least."""
    bounds = shards.bounds(*query)
    visited = 0
    for shard in np.argsort(-bounds, kind="stable").tolist():
        need = max(least, best[-1][0] if len(best) == top else 0, 1)
        if bounds[shard] < need:
            break
        visited += 1
        scores = shards.scores(shard, *query)
        some = np.flatnonzero(scores >= need).tolist()
        best = _better(best, [(int(scores[i]), ids[shard * SHARD + i]) for i in some], top)
    return best, visited


def _search_block(docs: DataFrame, block: Block, id_column: str, text: str, top: int, schema: StructType) -> DataFrame:
    spark, terms = docs.sparkSession, max(1, len(block.vocabulary))
    postings = written(_postings(docs, id_column, text, block.vocabulary))
    count, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], schema)
    weights = np.zeros(terms, dtype=np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[r[0]] = floor(1000 * log((2 * count + 2) / (2 * r[1] + 1)))

    # The sample: documents of the least hashes, of each the terms of the least hashes.
    by_hash = F.array_sort(F.transform(F.arrays_zip("terms", "tfs"), lambda z: F.struct(F.xxhash64(z["terms"]).alias("h"), z["terms"].alias("t"), z["tfs"].alias("f"))))
    some = postings.where(F.size("terms") > 0).orderBy(F.xxhash64("id", "terms"), "n").limit(SAMPLE).select("n", F.slice(by_hash, 1, SAMPLE_TERMS).alias("p")).select("n", "p.t", "p.f").collect()
    fitted = [np.array(r[1], dtype=np.int64) for r in some]
    tree, order = bisect(fitted, terms)
    # Ten documents of the sample reach the tenth score among them, so the result's last one does.
    if some:
        sizes = np.array([len(fitted[d]) for d in order])
        term, tf = np.concatenate([fitted[d] for d in order]), np.concatenate([np.array(some[d][2], dtype=np.int64) for d in order])
        shards = Shards(terms, sizes, term, _impacts(weights, np.repeat([some[d][0] for d in order], sizes), tf, term, count, length))
        found = (visit(shards, list(range(len(order))), q, [], 0, top)[0] for q in block.queries)
        least = [b[-1][0] if len(b) == top else 0 for b in found]
    else:
        least = [0] * len(block.ids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            leaf = leaves(tree, starts, lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=[*batch.schema.names, "leaf"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in block.ids]
        held: list[pa.RecordBatch] = []

        def run() -> None:
            ids, *parts = (pa.concat_arrays([b.column(c) for b in held]) for c in range(4))
            sizes = np.diff(parts[1].offsets.to_numpy())
            term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in parts[1:])
            impact = _impacts(weights, np.repeat(parts[0].to_numpy(), sizes), tf, term, count, length)
            shards, ids = Shards(terms, sizes, term, impact), ids.to_pylist()
            for i, query in enumerate(block.queries):
                best[i], _ = visit(shards, ids, query, best[i], least[i], top)
            held.clear()

        docs_held = postings_held = 0
        for batch in batches:
            for at in range(0, len(batch), SHARD):
                piece = batch.slice(at, SHARD)
                held.append(piece)
                docs_held, postings_held = docs_held + len(piece), postings_held + len(piece.column(2).flatten())
                if docs_held >= HELD_DOCS or postings_held >= HELD_POSTINGS:
                    run()
                    docs_held = postings_held = 0
        if held:
            run()
        rows = [(i, block.ids[i], score, doc) for i, found in enumerate(best) for score, doc in found]
        no, item, score, doc = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((no, item, doc, score), arrow.types, strict=True)], names=arrow.names)

    fields = StructType([StructField("no", StructType.fromDDL("x int")["x"].dataType), schema["item_id"], schema["doc_id"], schema["score"]])
    arrow = to_arrow_schema(fields)
    placed = StructType([*postings.schema.fields, *StructType.fromDDL("leaf int")])
    indexed = postings.where(F.size("terms") > 0).mapInArrow(place, placed)
    indexed = indexed.repartitionByRange(shuffle_partitions(spark), "leaf", F.xxhash64("id")).sortWithinPartitions("leaf", F.xxhash64("id")).select("id", "n", "terms", "tfs")
    rank = F.row_number().over(W.partitionBy("no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return indexed.mapInArrow(search, fields).withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's documents of the highest scores above 0.

    Null and empty texts have no terms; such documents don't count, such items have no rows. Ids may be of any type
    that compares; in ties a null doc_id comes last. Rows that repeat, of documents or items, count each. Texts are
    read whole. Empty tables give none. Other columns are not read.
    """
    schema = StructType([StructField("item_id", items.schema[item].dataType), *StructType.fromDDL("rank int"), StructField("doc_id", docs.schema[id_column].dataType), *StructType.fromDDL("score long")])
    found = docs.sparkSession.createDataFrame([], schema)
    for n, block in enumerate(_blocks(items, item, text)):
        rows = _search_block(docs, block, id_column, text, top, schema)
        found = rows if n == 0 else found.union(rows)
    return found


SEARCH_SQL = f"""
        WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
        lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
        total AS (SELECT count(*) AS N_, sum(n)::BIGINT AS L_ FROM lengths),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * N_ + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term, N_),
        asked AS (SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * N_) // L_))))::BIGINT AS score
            FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), total GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}"""
