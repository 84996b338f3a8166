"""Exact token counts of every prefix, by dynamic programming over token ends.

A byte-level BPE first cuts a text into pieces and merges bytes within each. Of a piece's prefix, the last
token is the one that may stand behind the last token of the prefix without it; so the count at each byte is
the count where that token begins plus one. Two tokens may stand side by side if the merges that make them
would not have joined anything across their border. Each distinct piece is filled in once; the pieces' totals
give the counts at all piece ends, and a cut within a piece is answered by the piece's own counts. Questions
about truncation and budgets need no further encoding of the text.

Two things change at a cut: white space that ends a prefix is one piece, and the first two of the three
characters of a contraction are two pieces.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 512
#: Fixed value: how a byte-level vocabulary splits a text before it merges; the file must ask for it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))
#: Totals that a worker keeps, and the longest piece whose total it keeps.
KEPT, KEPT_LENGTH = 500_000, 64
_LOADED: dict[str, Vocabulary] = {}


def _byte_of_character() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class _Totals(dict):
    """Tokens of whole pieces, filled as they are asked for."""

    def __init__(self, table):
        super().__init__()
        self.table = table

    def __missing__(self, piece: str) -> int:
        total = self.table(piece.encode())[-1]
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = total
        return total


class Vocabulary:
    """A byte-level BPE file whose ids are in the order of its merges."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, splitter = file["model"], file["pre_tokenizer"] or {}
        if file["normalizer"] or any(splitter.get(k) != v for k, v in SPLITTER.items()) or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        byte = _byte_of_character()
        raw = lambda token: bytes(byte[c] for c in token)
        ranks = {raw(token): n for token, n in model["vocab"].items() if token not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for a, b in merges:
            pair, whole = (ranks[raw(a)], ranks[raw(b)]), ranks[raw(a + b)]
            if whole in self.halves or whole <= max(len(self.halves) + 255, *pair):
                raise ValueError(f"{path}: ids are not in the order of merges")
            self.joined[pair], self.halves[whole] = whole, pair
        self.ranks, self.special = ranks, [*special]
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        # The same pieces; letters and digits are tried first, and white space is what the vocabulary's library sees as such, which is not what Python calls so.
        self.pieces = regex.compile(
            r" ?\p{L}++| ?\p{N}++|'(?:[stmd]|re|ve|ll)| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
        )
        self.is_space = regex.compile(r"\p{White_Space}").match
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if special else None
        self.totals = _Totals(self.table)
        self._fit: dict[tuple[int, int], bool] = {}
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 1:
                ends.setdefault(token[-3:], set()).add(len(token))
        # Lengths of tokens by their last three bytes, and whether the last two are one.
        self.sizes = {k: (*sorted(v, reverse=True), *(n for n in (2, 1) if n not in v and (n == 1 or k[-2:] in ranks))) for k, v in ends.items()}

    def ids(self, text: str) -> np.ndarray:
        """Ids of the whole text as unsigned 32-bit numbers, special strings as their tokens."""
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def fit(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay side by side: their last merges are undone, the later one first, and no merge across the border may have come before the one undone."""
        known = self._fit.get((a, b))
        if known is None:
            if len(self._fit) > 2_000_000:
                self._fit.clear()
            x, y, before, known = a, b, 1 << 40, True
            while known:
                known = self.joined.get((x, y), 1 << 41) >= before
                if x not in self.halves and y not in self.halves:
                    break
                if x in self.halves and (y not in self.halves or x > y):
                    before, x = x, self.halves[x][1]
                else:  # of two equal merges the left one comes first
                    before, y = y + 1, self.halves[y][0]
            self._fit[a, b] = known
        return known

    def table(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of a piece, by bytes, the empty one first."""
        counts, last = [0] * (len(piece) + 1), [-1] * (len(piece) + 1)
        ranks, sizes, fits = self.ranks, self.sizes, self._fit
        for end in range(1, len(piece) + 1):
            for size in sizes.get(piece[end - 3 if end > 3 else 0 : end]) or (2, 1):
                begin = end - size
                if begin < 0 or (token := ranks.get(piece[begin:end])) is None:
                    continue
                if not begin or (fits[pair] if (pair := (last[begin], token)) in fits else self.fit(*pair)):
                    counts[end], last[end] = counts[begin] + 1, token
                    break
        return counts

    def segments(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """Spans of the text between special strings, and of these."""
        at = 0
        for m in self.specials.finditer(text) if self.specials and any(s in text for s in self.special) else ():
            yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        yield at, len(text), False

    def count(self, text: str) -> int:
        """Tokens of a text that has no special string."""
        return sum(map(self.totals.__getitem__, self.pieces.findall(text)))


def vocabulary(path: str) -> Vocabulary:
    """Loaded once for each worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


class Prefixes:
    """Token counts of every prefix of one text, by code points."""

    def __init__(self, text: str, words: Vocabulary):
        self.text, self.words = text, words
        self.special: list[tuple[int, int, int]] = []  # where one begins, the segment before it begins, and it ends
        pieces, totals, began = [], [], 0
        for start, stop, special in words.segments(text):
            if special:
                self.special.append((start, began, stop))
                pieces.append(text[start:stop])
                totals.append(1)
            else:
                began = start
                found = words.pieces.findall(text[start:stop])
                pieces += found
                totals += map(words.totals.__getitem__, found)
        self.pieces = pieces
        self.ends, self.counts = [*accumulate(map(len, pieces), initial=0)], [*accumulate(totals, initial=0)]
        self._tables: dict[str, list[int]] = {}

    @property
    def total(self) -> int:
        return self.counts[-1]

    def _within(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece by code points."""
        if piece not in self._tables:
            by_byte = self.words.table(piece.encode())
            self._tables[piece] = [by_byte[k] for k in accumulate((len(c.encode()) for c in piece), initial=0)]
        return self._tables[piece]

    def _space_before(self, k: int) -> int:
        """The first of the pieces of white space that end with piece k, or k + 1."""
        while k >= 0 and self.pieces[k] and self.words.is_space(self.pieces[k][-1]):
            k -= 1
        return k + 1

    def at(self, length: int) -> int:
        """Tokens of the text's first so many code points."""
        length = max(0, min(length, len(self.text)))
        if not length:
            return 0
        k = bisect_left(self.ends, length) - 1  # the piece that the cut is in or ends
        inside = bisect_left(self.special, (length,)) - 1
        if inside >= 0 and length < self.special[inside][2]:
            began = self.special[inside][1]
            return self.counts[bisect_left(self.ends, began)] + self.words.count(self.text[began:length])
        piece, cut = self.pieces[k], length - self.ends[k]
        if self.words.is_space(self.text[length - 1]):
            first = self._space_before(k - 1)
            run = self.text[self.ends[first] : self.ends[k]] + piece[:cut]
            whole = self._run(first)
            return self.counts[first] + (whole[len(run)] if whole is not None else self._within(run)[-1])
        if cut == len(piece):
            return self.counts[k + 1]
        return self.counts[k] + (cut if piece in CONTRACTIONS else self._within(piece)[cut])

    def _run(self, first: int) -> list[int] | None:
        """Tokens of the prefixes of all white space from piece first on."""
        k = first
        while k < len(self.pieces) and self.words.is_space(self.pieces[k][-1]):
            k += 1
        run = self.text[self.ends[first] : self.ends[k]] + (" " if k < len(self.pieces) and self.pieces[k][0] == " " else "")
        return self._within(run)

    def every(self) -> list[int]:
        """Tokens of each prefix, the empty one first."""
        return [self.at(n) for n in range(len(self.text) + 1)]

    def longest_within(self, budget: int) -> int:
        """The greatest length whose prefix has at most so many tokens.

        Counts may fall within a word, but never to that of a place between a word and white space before it: so
        only what stands between the last such place within the budget and the next one is looked at.
        """
        if self.total <= budget:
            return len(self.text)
        if budget < 0:
            return 0
        over = bisect_right(self.counts, budget) - 1

        def border(k: int) -> bool:
            return k in (0, len(self.pieces)) or bool(self.words.is_space(self.pieces[k][0])) and not self.words.is_space(self.pieces[k - 1][-1])

        low, high = over, over + 1
        while not border(low):
            low -= 1
        while not (border(high) and self.counts[high] > budget):
            high += 1
        for length in range(self.ends[high], self.ends[low], -1):
            if self.at(length) <= budget:
                return length
        return self.ends[low]

    def truncated(self, budget: int) -> str:
        """The text's longest beginning that has at most so many tokens."""
        return self.text[: self.longest_within(budget)]


def _counter(path: str, limit: int):
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for texts in batches:
            rows = []
            for t in (x or "" for x in texts):
                prefixes = Prefixes(t, words)
                rows.append((len(t.encode()), prefixes.total, prefixes.longest_within(limit)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "chars_within"]).astype("int64")

    return counted


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit, chars_within), one for each row of docs.

    chars_within: code points of the text's longest beginning of at most limit tokens. path: the vocabulary's
    file, on every executor. Null texts count as empty, with zeros; texts are read whole, in time that grows with their
    length; rows that repeat are counted each; an empty table gives none. No shuffle. Other columns of
    docs are not read.
    """
    counted = F.pandas_udf(_counter(path, limit), "n_bytes long, n_tokens long, chars_within long")
    found = docs.select("doc_id", counted(F.col("text")).alias("c"))
    return found.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.chars_within")


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, counts), one for each row of docs: the tokens of each prefix by code points, the empty one first. Nulls and repeats as in count_tokens."""

    def filled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = vocabulary(path)
        for texts in batches:
            yield pd.Series([np.array(Prefixes(t or "", words).every(), dtype=np.int32) for t in texts])

    return docs.select("doc_id", F.pandas_udf(filled, "array<int>")(F.col("text")).alias("counts"))


def longest_within(counts: Column, budget: Column | int) -> Column:
    """The greatest length whose count in a table of prefix_tables is at most budget."""
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))
