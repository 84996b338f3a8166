"""MinHash near-duplicates by HyperMinHash registers.

The hashes of a document's shingles are dealt into buckets. A bucket's register holds its least hash as a count
of leading zeros and a few mantissa bits; an empty bucket borrows another one's register. Documents whose registers
agree in a whole band are candidates. The share of equal registers, corrected for collisions of short
registers, estimates their similarity; what may be similar enough is confirmed on the full sets.

At a similarity of 0.8, 64 bands of 6 registers miss a pair with a probability of 4e-9, and the estimate's floor
lies more than six standard deviations below, so that a link is lost with less than 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import connected_components, delete, text_of, written
from .prefix_join import maybe_among
from .simhash_dedup import link_fingerprints, majority

SHINGLE = 2
#: Links have 100 x intersection >= NEAR x union.
NEAR = 80
BANDS, ROWS, MANTISSA_BITS = 64, 6, 10
REGISTERS = BANDS * ROWS
#: The least estimate that is confirmed.
FLOOR = 0.67
#: Bands of more documents than this are compared in blocks, of at most so many documents and bytes of hashes on average.
LARGE, BLOCK_ROWS, BLOCK_BYTES = 16, 4_096, 8 << 20
#: Rows and shingles that are compared at once within a block.
ROWS_AT_ONCE, COLUMNS_AT_ONCE = 1_024, 1_024


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of so many words; fewer words are one shingle, none make none.

    Words are runs without ASCII white space, A-Z lower-cased. Two shingles of a pair of documents share a hash
    with a probability of 5e-20.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    hashes = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(words))
    if not width:
        return hashes
    runs = len(words) - width + 1
    out = hashes[:runs]
    for k in range(1, width):
        out = _mixed(out) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + runs]
    return np.unique(_mixed(out + np.uint64(width < shingle)))


#: For each register, all others in an order of its own: where it borrows when it is empty.
PROBES = np.argsort(_mixed(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1 << 32)).reshape(REGISTERS, REGISTERS), axis=1, kind="stable")


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set's sorted hashes: 1 + leading zeros and mantissa of each bucket's least hash; 0 everywhere for an empty set."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if not len(hashes):
        return out
    high, low, many = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF), np.uint64(REGISTERS)
    bucket = ((high * many + (low * many >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = (hashes[first] * many) >> np.uint64(11)  # the place within the bucket, as a fraction of 53 bits
    mantissa, exponent = np.frexp(rest.astype(np.float64))
    bits = np.maximum((mantissa * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
    out[bucket[first]] = ((53 - exponent) << MANTISSA_BITS) + bits + 1
    empty = np.flatnonzero(out == 0)
    filled = out > 0
    for probes in (16, REGISTERS):
        near = filled[PROBES[empty, :probes]]
        at = near.argmax(axis=1)
        found = near[np.arange(len(empty)), at]
        out[empty[found]] = out[PROBES[empty[found], at[found]]]
        empty = empty[~found]
    return out


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that two registers of sets of n and m shingles are equal though their hashes aren't."""
    step = 2.0 ** -np.arange(54)

    def level(size: np.ndarray) -> np.ndarray:
        rate = np.maximum(size / REGISTERS, 1 / REGISTERS)[:, None]
        p = np.exp(-rate * step / 2) - np.exp(-rate * step)
        return p / p.sum(axis=1, keepdims=True)

    return (level(n) * level(m)).sum(axis=1) / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of pairs of rows of registers, of sets of n and m shingles."""
    equal, by_chance = (a == b).mean(axis=1), collisions(n, m)
    return np.clip((equal - by_chance) / (1 - by_chance), 0, 1)


def _sketches(docs: DataFrame, id_column: str, text: str, shingle: int, simhash: bool) -> DataFrame:
    """Rows (id, mark, n, digest, registers, f); mark: a hash of the text, digest: of the set, f: its SimHash where asked for, else null."""
    of = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).cast("binary").alias("text"))
    schema = StructType([of.schema["id"], *StructType.fromDDL("mark long, n long, digest binary, registers binary, f long")])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, found, prints = [], [], [], []
            for value in batch.column(2):
                hashes = shingle_set(value.as_py(), shingle)
                n.append(len(hashes))
                digests.append(blake2b(hashes.tobytes(), digest_size=16).digest())
                found.append(registers(hashes).astype("<u2").tobytes())
                prints.append(np.uint64(majority(hashes)).view(np.int64) if simhash else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.binary()), pa.array(prints, pa.int64())], names=schema.names)

    return of.mapInArrow(sketch, schema)


def _estimates(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    of = lambda x: np.frombuffer(b"".join(x), dtype="<u2").reshape(len(x), REGISTERS)
    return pd.Series(estimate(of(a), of(b), n.to_numpy(), m.to_numpy()))


def _near(a: Column, b: Column, shingle: int) -> Column:
    """Whether two texts are near, by their full sets."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        last, known = None, np.empty(0, np.uint64)
        out = []
        for x, y in zip(a, b, strict=True):
            if x is not last and x != last:  # rows come by a
                last, known = x, shingle_set(x, shingle)
            other = shingle_set(y, shingle)
            both = len(np.intersect1d(known, other, assume_unique=True))
            out.append(100 * both >= NEAR * (len(known) + len(other) - both))
        return pd.Series(out, dtype=bool)

    return near(a, b)


def bands(column: str = "registers") -> Column:
    """A key for each band of registers."""
    return F.array(*(F.xxhash64(F.lit(b), F.substring(F.col(column), 1 + 2 * ROWS * b, 2 * ROWS)) for b in range(BANDS)))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are links: by the estimate first, then by the texts' full sets."""
    of = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("registers").alias(f"{x}_r"), F.col("mark").alias(f"{x}_mark"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * NEAR)
    alike = F.pandas_udf(_estimates, "double")("a_r", "b_r", "a_n", "b_n") >= FLOOR
    maybe = written(both.where(alike).select("a", "b", "a_mark", "b_mark"))
    wanted = written(maybe.select(F.col("a_mark").alias("mark")).union(maybe.select("b_mark")).distinct())
    texts = maybe_among(docs.select(F.xxhash64(text_of(text)).alias("mark"), text_of(text).cast("binary").alias("text")), ["mark"], wanted)
    texts = written(texts.join(wanted, "mark", "left_semi").dropDuplicates(["mark"]))
    of_text = lambda x: texts.select(F.col("mark").alias(f"{x}_mark"), F.col("text").alias(f"{x}_text"))
    found = written(maybe.join(of_text("b"), "b_mark").join(of_text("a"), "a_mark").where(_near(F.col("a_text"), F.col("b_text"), shingle)).select("a", "b"))
    delete(maybe, wanted, texts)
    return found


def _members(classes: DataFrame) -> DataFrame:
    """Rows (k, node, n) of the bands that more classes than one share."""
    keys = classes.select(F.explode(bands()).alias("k"), "node", "n")
    shared = written(keys.groupBy("k").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("k"))
    out = written(maybe_among(keys, ["k"], shared).join(shared, "k", "left_semi"))
    delete(shared)
    return out


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with part, the component by the links so far, of bands that hold parts of more than one."""
    parts = connected_components(links, "a", "b").withColumnsRenamed({"node": "of", "component": "part"})
    now = members.join(parts, F.col("node") == F.col("of"), "left").select("k", "node", "n", F.coalesce("part", "node").alias("part"))
    some = now.groupBy("k").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("k")
    return now.join(some, "k", "left_semi")


def _distinct_bands(members: DataFrame) -> DataFrame:
    """members without the bands that hold the same nodes as another one: what is compared in one needn't be in the other."""
    hashes = (F.xxhash64("node"), F.xxhash64(F.lit(1), "node"))
    sets = members.groupBy("k").agg(F.count("*").alias("size"), *(F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(hashes)))
    return members.join(sets.groupBy("size", "h0", "h1").agg(F.min("k").alias("k")).select("k"), "k", "left_semi")


def _few(members: DataFrame) -> DataFrame:
    """Pairs (a, b): of each node, the least and the greatest one over all its bands. Linear in the members."""
    ends = members.groupBy("k").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    of = members.join(ends, "k").groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pairs = of.select("node", F.explode(F.array("lo", "hi")).alias("other")).where("node <> other")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _rest(members: DataFrame) -> DataFrame:
    """All pairs (a, b) of one band, different parts and sizes that allow a link."""
    x, y = members.alias("x"), members.alias("y")
    on = (F.col("x.k") == F.col("y.k")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part"))
    on &= F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * NEAR
    return x.join(y, on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def shared(rows: list[np.ndarray], columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes of the intersections of each of rows with each of columns, all sets of hashes, by runs of rows: the first row's number and a matrix."""
    sizes = [len(x) for x in (*rows, *columns)]
    of = np.repeat(np.arange(len(sizes)), sizes)
    _, place, times = np.unique(np.concatenate([*rows, *columns]), return_inverse=True, return_counts=True)
    often = np.cumsum(times > 1) - 1  # a hash that stands once is in no intersection
    of, place = of[times[place] > 1], often[place[times[place] > 1]]
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    width = int(place[-1]) + 1 if len(place) else 0
    cuts = np.searchsorted(place, np.arange(0, width + COLUMNS_AT_ONCE, COLUMNS_AT_ONCE))
    for first in range(0, len(rows), ROWS_AT_ONCE):
        last = min(first + ROWS_AT_ONCE, len(rows))
        out = np.zeros((last - first, len(columns)), dtype=np.float32)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            dense = np.zeros((len(sizes), COLUMNS_AT_ONCE), dtype=np.float32)
            dense[of[s:e], place[s:e] % COLUMNS_AT_ONCE] = 1
            out += dense[first:last] @ dense[len(rows) :].T
        yield first, out


def block_links(nodes: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links between the nodes of the two sides, or where there is one side, among all; only as many as it takes to join their parts."""
    root = {p: p for p in parts.tolist()}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    if side.any():
        rows, columns = np.flatnonzero(~side), np.flatnonzero(side)
    else:
        names, times = np.unique(parts, return_counts=True)
        rows, columns = np.flatnonzero(parts != names[times.argmax()]), np.arange(len(nodes))
    out = []
    if not len(rows) or not len(columns):
        return out
    n = np.array([len(x) for x in sets], dtype=np.float32)
    for first, both in shared([sets[i] for i in rows], [sets[i] for i in columns]):
        some = rows[first : first + len(both)]
        linked = (100 * both >= NEAR * (n[some][:, None] + n[columns] - both)) & (parts[some][:, None] != parts[columns])
        for at in np.flatnonzero(linked.any(axis=1)):
            i = some[at]
            found = columns[linked[at]]
            for p, k in zip(*np.unique(parts[found], return_index=True), strict=True):
                a, b = find(int(parts[i])), find(int(p))
                if a != b:
                    root[b] = a
                    x, y = int(nodes[i]), int(nodes[found[k]])
                    out.append((min(x, y), max(x, y)))
    return out


def _in_blocks(members: DataFrame, classes: DataFrame, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """Links (a, b) between parts within large bands (k, node, n, part), on the full sets.

    A band's members are dealt to blocks, and every two blocks meet in one task as a product of matrices; no pair
    that isn't a link leaves it. Memory is bounded by the blocks, work grows with the product of a band's size and the
    number of those that its largest part doesn't hold.
    """
    nodes = written(members.select("node").distinct().join(classes.select("node", "mark"), "node"))
    wanted = nodes.select("mark").distinct()
    texts = maybe_among(docs.select(F.xxhash64(text_of(text)).alias("mark"), text_of(text).cast("binary").alias("text")), ["mark"], wanted)
    texts = nodes.join(texts.dropDuplicates(["mark"]), "mark").select("node", "text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), shingle).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "hashes"])

    sets = written(texts.mapInArrow(hashes, "node long, hashes binary"))
    blocks = members.groupBy("k").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, 8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, "k").withColumn("own", own).select("k", "node", "part", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "node", "part").join(sets, "node")
    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").select("k", "i", "j", "side", "node", "part", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, some in groupby(rows, key=lambda r: r[:3]):
            side, nodes, parts, found = zip(*(r[3:] for r in some), strict=True)
            links = block_links(np.array(nodes), np.array(parts), [np.frombuffer(x, dtype=np.uint64) for x in found], np.array(side))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = written(dealt.mapInArrow(compare, "a long, b long").distinct())
    delete(nodes, sets)
    return links


def simhash_links(classes: DataFrame, docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A table of links (a, b) between classes (node, mark, n, registers, f) found by SimHash.

    Fingerprints that differ by few bits are linked by their deletion variants, as in simhash_dedup. Of each component
    the least node is compared with the others, on the full sets.
    """
    parts = link_fingerprints(classes.select("f").distinct()).withColumnsRenamed({"node": "of", "component": "part"})
    roots = written(classes.join(parts, F.col("f") == F.col("of"), "left").select("node", F.coalesce("part", "f").alias("root")))
    least = roots.groupBy("root").agg(F.min("node").alias("a"))
    links = _confirmed(roots.join(least, "root").where("a <> node").select("a", F.col("node").alias("b")), classes, docs, text, shingle)
    delete(roots)
    return links


def link_classes(classes: DataFrame, docs: DataFrame, text: str = "text", shingle: int = SHINGLE, known: DataFrame | None = None) -> DataFrame:
    """A table of links (a, b) whose components are those of all links between classes (node, mark, n, registers).

    First each node is compared with two others, so a group of near copies costs what it has members. In bands whose
    members that doesn't join, all pairs of different parts are compared: in small bands by their registers
    first, in large ones block by block. known: links found already; what they join isn't compared.
    """
    members = _members(classes)
    first = _confirmed(_few(members if known is None else _open(members, known)), classes, docs, text, shingle)
    if known is not None:
        first = written(known.union(first))
    now = written(_distinct_bands(_open(members, first)))
    sizes = now.groupBy("k").agg(F.count("*").alias("size"))
    few = _confirmed(_rest(now.join(sizes.where(F.col("size") <= LARGE), "k", "left_semi")), classes, docs, text, shingle)
    many = _in_blocks(now.join(sizes.where(F.col("size") > LARGE), "k", "left_semi"), classes, docs, text, shingle)
    links = written(first.union(few).union(many))
    delete(members, now, first, few, many)
    return links


def near_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id", shingle: int = SHINGLE, simhash: bool = False) -> tuple[DataFrame, DataFrame]:
    """simhash: whether links are looked for by SimHash first, and by registers where it joins nothing.

    Rows (id, mark, n, root) of the rows of docs that have shingles, root being the same for those that links join and mark a hash of the text; and rows (id, mark) of the others.
    """
    prints = written(_sketches(docs, id_column, text, shingle, simhash))
    classes = prints.where("n > 0").groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n", "registers", "f")), F.min("mark").alias("mark"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    known = simhash_links(classes, docs, text, shingle) if simhash else None
    parts = connected_components(link_classes(classes, docs, text, shingle, known), "a", "b").withColumnsRenamed({"node": "of", "component": "part"})
    roots = classes.join(parts, F.col("node") == F.col("of"), "left").select("digest", F.coalesce("part", "node").alias("root"))
    rows = written(prints.where("n > 0").join(roots, "digest").select("id", "mark", "n", "root"))
    return rows, prints.where("n = 0").select("id", "mark")


def near_components(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Rows (id, n, component), one for each row of docs: its number of shingles, and the least id that links reach from it.

    Null and empty texts, and texts without words, have no shingles and no links; their component is their id. Texts
    of one word have that word as their shingle. Texts are read whole. Rows that repeat an id count each, and two
    texts under one id are two documents. Ids may be of any type that compares; a null id is a component's only if
    all of it have none. An empty table gives none. Other columns are not read.
    """
    rows, others = near_groups(docs, text, id_column)
    least = rows.groupBy("root").agg(F.min("id").alias("component"))
    none = others.select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    return rows.join(least, "root").select("id", "n", "component").union(none)
