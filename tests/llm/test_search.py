"""HyperMinHash links, vector codes and ranked search against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifflens.llm import lexical_search, minhash_dedup, vector_codes


def pairs_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} or ({tuple(words)} if words else set())


def components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(n)]


def near_texts(seed):
    draw = random.Random(seed)
    words = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(900)]
    out = [None, "", " \n\t", "one", "One", "one  two", "ONE two\n", "one two three", "x" * 20_000, "Word " * 9000]
    for size in (3, 5, 6, 9, 10, 12, 20, 40, 90, 200, 500, 1500):
        for _ in range(4):
            base = draw.choices(words, k=size)
            out.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for _ in range(draw.randint(0, 1 + size // 8)):
                    at = draw.randrange(len(copy))
                    copy[at : at + 1] = draw.choice([[], ["new"], [copy[at], f"n{draw.random()}"]])
                out.append(draw.choice([" ", "  ", "\n"]).join(copy))
    base = draw.choices(words, k=120)
    for _ in range(120):  # a chain of near copies, the far ends of which aren't near
        at = draw.randrange(len(base))
        base = [*base[:at], f"c{draw.random()}", *base[at + 1 :]]
        out.append(" ".join(base))
    return out


def test_minhash_links_are_those_of_all_pairs(spark):
    texts = near_texts(5)
    sets = [pairs_of(t) for t in texts]
    linked = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    want = components(len(texts), linked)
    docs = spark.createDataFrame([(i * 3, t, 7, 8, 9) for i, t in enumerate(texts)], "doc_id long, text string, n int, node int, mark int").repartition(5)
    found = minhash_dedup.near_components(docs).collect()
    assert sorted((r["id"], r["n"], r["component"]) for r in found) == [(i * 3, len(sets[i]), want[i] * 3) for i in range(len(texts))]
    assert 10 < len(set(want)) < len(texts) - 200
    assert minhash_dedup.near_components(docs.limit(0)).count() == 0


def test_minhash_large_bands_in_blocks(spark, monkeypatch):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = draw.choices(words, k=150)
    texts = []
    for n in range(170):  # a family of which some are within reach of one another and others aren't
        copy = list(base)
        for _ in range(draw.choice([2, 5, 9, 14])):
            copy[draw.randrange(150)] = f"n{draw.random()}"
        texts.append(" ".join(copy))
    sets = [pairs_of(t) for t in texts]
    want = components(len(texts), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for rows in (4_096, 20):
        monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", rows)
        assert {r["id"]: r["component"] for r in minhash_dedup.near_components(docs).collect()} == dict(enumerate(want))
    assert 1 < len(set(want)) < 170


def test_intersections_in_blocks(monkeypatch):
    draw = np.random.default_rng(8)
    monkeypatch.setattr(minhash_dedup, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(minhash_dedup, "COLUMNS_AT_ONCE", 13)
    sets = [np.unique(draw.integers(0, 60, size=draw.integers(1, 40)).astype(np.uint64)) for _ in range(50)]
    for rows, columns in ((sets[:20], sets[20:]), (sets[:1], sets[1:2])):
        found = np.concatenate([m for _, m in minhash_dedup.shared(rows, columns)])
        assert found.tolist() == [[len(np.intersect1d(a, b)) for b in columns] for a in rows]


def test_minhash_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (None, long + " end"), (4, "a b"), (4, "c d"), (4, "a b"), (2, "c D"), (None, "lone word here"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in minhash_dedup.near_components(docs).collect()), key=repr)
    assert found == sorted([(None, 49, None), (None, 50, None), (4, 1, 4), (4, 1, 2), (4, 1, 4), (2, 1, 2), (None, 2, None), (None, 0, None), (9, 0, 9)], key=repr)
    strings = docs.withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    assert {r["component"] for r in minhash_dedup.near_components(strings).collect()} == {None, "id2", "id4", "id9"}


def test_estimates_are_close():
    draw = np.random.default_rng(3)
    for n in (1, 2, 10, 100, 384, 1000, 20_000):
        for shared in (0.5, 0.8, 1.0):
            both = round(n * shared)
            values = [np.unique(draw.integers(0, 1 << 64, size=k, dtype=np.uint64)) for k in (both, n - both, n - both)]
            a, b = np.unique(np.r_[values[0], values[1]]), np.unique(np.r_[values[0], values[2]])
            true = both / (2 * n - both)
            got = minhash_dedup.estimate(minhash_dedup.registers(a)[None], minhash_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
            assert abs(got - true) < 0.25 if n <= 10 else abs(got - true) < 0.12
    none = minhash_dedup.registers(np.empty(0, np.uint64))
    assert not none.any()
    # Short registers of unlike sets collide as often as is said.
    sets = [np.unique(draw.integers(0, 1 << 64, size=3000, dtype=np.uint64)) for _ in range(400)]
    rows = np.stack([minhash_dedup.registers(s) for s in sets])
    share = (rows[::2] == rows[1::2]).mean()
    assert abs(share / minhash_dedup.collisions(np.array([3000]), np.array([3000]))[0] - 1) < 0.4


def coded(rows, parts, entries, rounds):
    """Rows (id, label, ints) to codes, errors and codebooks, entry by entry."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(rows[0][2])
    ends = np.cumsum([width // parts + (p < width % parts) for p in range(parts)]).tolist()
    cuts = list(zip([0, *ends[:-1]], ends, strict=True))
    books = [[r[2][s:e] for r in rows[:entries]] for s, e in cuts]
    nearest = lambda v, book: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p, (s, e) in enumerate(cuts):
            groups = defaultdict(list)
            for r in rows:
                groups[nearest(r[2][s:e], books[p])[1]].append(r[2][s:e])
            books[p] = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(books[p])]
    out = [(r[0], r[1], [nearest(r[2][s:e], books[p]) for p, (s, e) in enumerate(cuts)]) for r in rows]
    total = Counter()
    for _, label, found in out:
        total[label] += sum(d for d, _ in found)
    text = ",".join(str(x) for b in books for c in b for x in c)
    return [(i, label, "".join(f"{c:02x}" for _, c in found), sum(d for d, _ in found), total[label], hashlib.sha256(text.encode()).hexdigest()) for i, label, found in out]


@pytest.mark.parametrize(("width", "parts", "entries", "n"), [(8, 4, 6, 90), (7, 3, 5, 40), (4, 4, 64, 10), (2, 4, 3, 12)])
def test_vector_codes(spark, width, parts, entries, n):
    draw = random.Random(width)
    rows = [(draw.choice([None, i, i]), draw.choice([None, 1, 1, 2]), [draw.choice([-1.5, 0.0, 0.25, draw.gauss(0, 2)]) for _ in range(width)]) for i in range(n)]
    rows += [rows[3], rows[3], (5, 1, [1e30, *rows[0][2][1:]])]
    bad = [(900, 1, None), (901, 1, [None] * width), (902, 2, [float("nan")] * width), (903, 2, [float("inf")] * width), (904, 2, [-float("inf")] * width), (905, 1, [0.5] * (width + 1))]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, label int, embedding array<double>, error int, of int").repartition(3)
    ints = [(i, label, [max(-(1 << 24), min(1 << 24, floor(256 * x))) for x in v]) for i, label, v in rows]
    found = vector_codes.compress(frame, parts=parts, entries=entries)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(coded(ints, parts, entries, 2), key=repr)
    assert vector_codes.compress(frame.where("vec_id >= 900 AND vec_id <= 904")).count() == 0


def test_bounds_hold_every_distance():
    draw = np.random.default_rng(1)
    for entries, width in ((64, 4), (5, 1), (17, 9)):
        index = vector_codes.CellIndex(draw.integers(-300, 300, size=(entries, width)))
        queries = draw.integers(-400, 400, size=(50, width))
        distance = ((queries[:, None] - index.entries) ** 2).sum(axis=2)
        lower, upper = index.bounds(queries)
        assert (lower <= distance).all() and (distance <= upper).all()
        best, least = index.nearest(queries)
        assert (best == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
        assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.9


def ranked(docs, items, top=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    terms = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, len(t), Counter(t)) for i, t in found if t]
    count, length = len(found), sum(n for _, n, _ in found)
    df = Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for i, n, c in found:
            m = 25 + 75 * n * count // length
            score = sum(k * floor(1000 * log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def test_search(spark, monkeypatch):
    draw = random.Random(4)
    words = [f"t{i}" for i in range(300)] + ["ÉTÉ", "été", "Ünï", "A", "b"]
    docs = [(i, draw.choice([" ", "-", "\x00", "\n_"]).join(draw.choices(words, weights=range(len(words), 0, -1), k=draw.randint(1, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(40)] + [docs[7], docs[7], (None, docs[7][1]), (2000, None), (2001, " -- "), (2002, "Word " * 9000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for i in range(25)] + [(50, docs[7][1]), (50, docs[7][1]), (51, None), (52, "nothing"), (None, "a t1 t1")]
    frame = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, n int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    want = sorted(ranked(docs, items), key=repr)
    assert sorted((tuple(r) for r in lexical_search.search(frame, asked).collect()), key=repr) == want
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 11)
    assert sorted((tuple(r) for r in lexical_search.search(frame, asked).collect()), key=repr) == want
    strings = frame.withColumn("doc_id", F.concat(F.lit("é"), "doc_id"))
    want = ranked([(i if i is None else f"é{i}", t) for i, t in docs], items, 3)
    assert sorted((tuple(r) for r in lexical_search.search(strings, asked, top=3).collect()), key=repr) == sorted(want, key=repr)
    assert lexical_search.search(frame.limit(0), asked).count() == lexical_search.search(frame, asked.limit(0)).count() == 0
    assert lexical_search.search(frame.where("doc_id = 2001"), asked).count() == 0


def test_bisection_gathers_alike_documents_and_visits_few_shards():
    draw = random.Random(2)
    topics = [[draw.randrange(40 * k, 40 * k + 40) for _ in range(30)] for k in range(8)]
    documents = [np.unique(draw.choices(topics[i % 8], k=12)) for i in range(1024)]
    tree, order = lexical_search.bisect(documents, 320, depth=3)
    assert sorted(order) == list(range(1024))
    starts = np.r_[0, np.cumsum([len(d) for d in documents])]
    leaf = lexical_search.leaves(tree, starts, np.concatenate(documents))
    pure = sum(Counter(int(leaf[i]) for i in range(k, 1024, 8)).most_common(1)[0][1] for k in range(8))
    assert pure > 0.9 * 1024
    by_leaf = sorted(range(1024), key=lambda i: leaf[i])
    sizes = np.array([len(documents[d]) for d in by_leaf])
    term = np.concatenate([documents[d] for d in by_leaf])
    shards = lexical_search.Shards(320, sizes, term, np.arange(len(term)) % 7 + 1)
    query = (np.unique(topics[3])[:5], np.ones(len(np.unique(topics[3])[:5]), dtype=np.int64))
    best, visited = lexical_search.visit(shards, list(range(1024)), query, [], 0, 10)
    every = np.concatenate([shards.scores(s, *query) for s in range(shards.count)])
    assert [b[0] for b in best] == sorted(every.tolist(), reverse=True)[:10]
    assert visited < shards.count
