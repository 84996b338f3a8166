"""Sequence packing by Karmarkar-Karp multiway differencing.

A document's full windows stand alone; what is left over goes whole into differencing. What is left over of
many documents is gathered in blocks within a task. A block starts with as few windows as could hold it. Each
piece begins as a partition with one filled window; the two partitions of greatest imbalance are merged,
the fullest windows of one with the emptiest of the other, until one is left whose windows are nearly
equal. While its fullest exceeds the capacity, the block is done again with more windows, up to a share of
padding (SLACK); what stands above the capacity then is cut off and fills windows that have room.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .token_prefixes import vocabulary

CAPACITY, END_ID, BLOCK, SLACK = 2048, 1, 3000, 0.005
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each piece, all pieces dealt to so many windows."""
    # A node: sums of its windows in falling order, and either a piece or two nodes with the order of their merged windows.
    nodes: list[tuple] = []
    heap: list[tuple[int, int]] = []
    for i, s in enumerate(sizes):
        sums = np.zeros(windows, dtype=np.int64)
        sums[0] = s
        nodes.append((sums, i))
        heap.append((-s if windows > 1 else 0, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        x, y = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        sums = nodes[x][0] + nodes[y][0][::-1]
        order = np.argsort(-sums, kind="stable").astype(np.int32)
        sums = sums[order]
        nodes[x], nodes[y] = (None, *nodes[x][1:]), (None, *nodes[y][1:])
        nodes.append((sums, x, y, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), len(nodes) - 1))
    out = np.zeros(len(sizes), dtype=np.int64)
    todo = [(heap[0][1], np.arange(windows))]  # with the window that each place of a node goes to
    while todo:
        k, places = todo.pop()
        node = nodes[k]
        if len(node) == 2:
            out[node[1]] = places[0]
        else:
            _, x, y, order = node
            merged = np.empty_like(places)
            merged[order] = places
            todo += [(x, merged), (y, merged[::-1])]
    return out


def pack_block(sizes: list[int], capacity: int = CAPACITY, slack: float | None = SLACK) -> list[list[tuple[int, int, int]]]:
    """For each window its parts (piece, start in the piece, length); no window holds more than capacity.

    slack: how many more windows than the least number there may be, as a share of it, before pieces are cut; None: as many as it takes to cut none.
    """
    least = windows = max(1, -(-sum(sizes) // capacity))
    most = None if slack is None else math.ceil(least * (1 + slack))
    while True:
        found = differencing(sizes, windows)
        if np.bincount(found, weights=sizes).max(initial=0) <= capacity or windows == most:
            break
        windows += max(1, windows // 200) if most is None else min(max(1, windows // 200), most - windows)
    parts: list[list[tuple[int, int, int]]] = [[] for _ in range(windows)]
    for piece, window in enumerate(found.tolist()):
        parts[window].append((piece, 0, sizes[piece]))
    room = [(capacity - sum(x[2] for x in w), i) for i, w in enumerate(parts)]
    free = sorted((r, i) for r, i in room if r > 0)
    for over, i in sorted((-r, i) for r, i in room if r < 0)[::-1]:
        # One piece that is long enough gives all that is too much; of several the shortest, else the longest gives first.
        while over:
            k = min(range(len(parts[i])), key=lambda j: (parts[i][j][2] <= over, abs(parts[i][j][2] - over)))
            piece, start, length = parts[i][k]
            cut = min(over, length)
            parts[i][k : k + 1] = [(piece, start, length - cut)] if cut < length else []
            over, start = over - cut, start + length - cut
            while cut:
                at = min(bisect.bisect_left(free, (cut, -1)), len(free) - 1)  # the least room that is enough, else the most
                space, window = free.pop(at)
                some = min(cut, space)
                parts[window].append((piece, start, some))
                cut, start = cut - some, start + some
                if space > some:
                    bisect.insort(free, (space - some, window))
    return parts


class _Packer:
    def __init__(self, first: int, capacity: int, block: int, slack: float | None):
        self.next, self.capacity, self.block, self.slack = first, capacity, block, slack
        self.out: list[tuple] = []
        self.waiting: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.capacity:
            self.put(doc_id, ids, at, self.capacity, n, self.next, 0)
            self.next, at = self.next + 1, at + self.capacity
        if at < n:
            self.waiting.append((doc_id, at, ids[4 * at :], n))
        if len(self.waiting) >= self.block:
            self.flush()

    def put(self, doc_id: int | None, ids: bytes, start: int, length: int, n: int, window: int, offset: int, skipped: int = 0) -> None:
        crc = zlib.crc32(memoryview(ids)[4 * (start - skipped) : 4 * (start - skipped + length)])
        self.out.append((doc_id, start, length, crc, n, window, offset))

    def flush(self) -> None:
        if not self.waiting:
            return
        for parts in pack_block([len(x[2]) // 4 for x in self.waiting], self.capacity, self.slack):
            offset = 0
            for piece, start, length in parts:
                doc_id, at, ids, n = self.waiting[piece]
                self.put(doc_id, ids, at + start, length, n, self.next, offset, at)
                offset += length
            self.next += bool(parts)
        self.waiting = []


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, block: int = BLOCK, slack: float | None = SLACK) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    A document's ids are those of the vocabulary in path, then END_ID; a null text gives END_ID alone. Each
    partition packs by itself, so nothing is shuffled and a lost task packs the same again; sequence ids
    start at the partition's number times 2**32. A block has `block` pieces or ends its partition, and gives
    slack of its windows, and one, to padding. Texts are read whole whatever their length; rows that repeat are packed
    each; an empty table gives no piece. Other columns are not read.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, end = vocabulary(path), np.array([END_ID], dtype="<u4").tobytes()
        packer = _Packer(TaskContext.get().partitionId() << 32, capacity, block, slack)

        def made() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True)) or [[]] * 7
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.add(doc_id, words.ids(text or "").astype("<u4").tobytes() + end)
                if len(packer.out) > 20_000:
                    yield made()
        packer.flush()
        yield made()

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(packed, _PIECES)
