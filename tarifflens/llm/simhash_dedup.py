"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ by four bits at most
differ by one bit at most in one of them, so they share a variant of that segment with one bit blanked.
Distinct fingerprints are indexed under all 64 variants, those that share one are compared in full,
and linked fingerprints form components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, shuffle_partitions, written

MAX_BITS = 4
SHINGLE = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Buckets up to this size are compared pair by pair; in larger ones a spanning forest is grown instead.
PAIRWISE = 32


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits set in over half of the hashes, unsigned."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(np.array(hashes[at : at + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint, unsigned. Words are runs without ASCII white space, A-Z lower-cased; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(x + 1 for x in ends[:-1])]
    hashes = [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :], strict=False)] or [xxh64_intdigest(joined, 42)]
    return majority(hashes)


def _simhashes(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))


def simhash(text: Column) -> Column:
    """The fingerprint's bits as a signed long."""
    return F.pandas_udf(_simhashes, "long")(text)


def variants(fingerprint: Column) -> Column:
    """Array of one int for each segment and blanked bit: which, and the segment without that bit."""
    return F.array(
        *(
            (F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1 - (1 << bit)))).cast("int").bitwiseOR(F.lit((k * 22 + bit) << 22))
            for k, (first, width) in enumerate(SEGMENTS)
            for bit in range(width)
        )
    )


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first variant that each pair shares (for pairs that share one)."""
    x, out = a ^ b, np.full(len(a), -1, dtype=np.int64)
    for k, (first, width) in reversed(list(enumerate(SEGMENTS))):
        part = (x >> np.uint64(first)) & np.uint64((1 << width) - 1)
        bit = np.where(part > 0, np.log2(np.maximum(part, np.uint64(1)).astype(np.float64)).astype(np.int64), 0)
        value = ((a >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64) & ~(np.int64(1) << bit)
        out = np.where(np.bitwise_count(part) <= 1, value | ((k * 22 + bit) << 22), out)
    return out


def _forest(values: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For distinct values: each with the least of those that it reaches by links of at most so many bits.

    Breadth first: a value leaves the rest once it is reached, so a dense group costs about one pass.
    """
    rest, out = values, []
    while len(rest):
        reached, front, rest = [rest[:1]], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for p in front:
                far = np.flatnonzero(~near)
                if not len(far):
                    break
                near[far] = np.bitwise_count(rest[far] ^ p) <= most
            front, rest = rest[near], rest[~near]
            reached.append(front)
        group = np.concatenate(reached)
        if len(group) > 1:
            root = group.view(np.int64).min()
            others = group.view(np.int64)[group.view(np.int64) != root]
            out.append((others, np.full(len(others), root)))
    return out


def _links(keys: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat(sizes <= PAIRWISE, sizes)
    out = []
    for d in range(1, int(min(PAIRWISE, sizes.max()))):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        i = i[np.bitwise_count(values[i] ^ values[i + d]) <= most]
        i = i[_first_shared(values[i], values[i + d]) == keys[i]]  # a pair counts where it meets first
        if len(i):
            out.append((values[i].view(np.int64), values[i + d].view(np.int64)))
    for s, n in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE], strict=True):
        out += _forest(np.unique(values[s : s + n]), most)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _link_runs(batches: Iterator[pa.RecordBatch], most: int = MAX_BITS) -> Iterator[pa.RecordBatch]:
    """Batches (k, f) sorted by k to batches of links (a, b); only the last run of a batch is carried on."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []  # of the run that isn't ended, in parts

    def links():
        k, v = (np.concatenate(x) for x in zip(*kept, strict=True))
        a, b = _links(k, v, most)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut or (len(keys) and kept and kept[-1][0][-1] != keys[0]):
            kept.append((keys[:cut], values[:cut]))
            yield links()
            kept = []
        kept.append((keys[cut:], values[cut:]))
    if kept:
        yield links()


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Rows (node, component) of the distinct fingerprints f that some other one is linked with."""
    # Dealt evenly first: what an aggregation left in a few tasks would be multiplied there.
    indexed = distinct.repartition(shuffle_partitions(distinct.sparkSession), "f").select(F.explode(variants(F.col("f"))).alias("k"), "f")
    links = indexed.repartition("k").sortWithinPartitions("k").mapInArrow(_link_runs, "a long, b long")
    return connected_components(links, "a", "b")


def near_components(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Rows (id, f, component): one for each row of docs, component being the least id reachable.

    Null texts count as empty; texts without words share fingerprint 0 and are linked. Rows that repeat
    an id each give a row. A null id is never the least unless all of its component's are null.
    Columns beside the text and the id are not read.
    """
    prints = written(docs.select(F.col(id_column).alias("id"), simhash(F.col(text)).alias("f")))
    classes = prints.groupBy("f").agg(F.min("id").alias("least"))
    parts = link_fingerprints(classes.select("f"))
    joined = classes.join(parts, classes["f"] == parts["node"], "left").select("f", "least", F.coalesce("component", "f").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component"))
    of = joined.select("f", "root").join(roots, "root").select("f", "component")
    return prints.join(of, "f").select("id", "f", "component")
