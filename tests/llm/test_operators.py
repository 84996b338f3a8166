"""Each operator against a plain version, on texts with nulls, empty and long ones, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
import corpus_pipeline  # noqa: E402
from tarifflens.llm import common, exact_dedup, fingerprints, license_scan, line_dedup, mixing, packing, pseudonyms, quality, queries, simhash_dedup, token_prefixes  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("id", "f", "k", "h", "g", "n", "w", "sim", "mark", "component", "keep_id", "place", "size", "copies", "target", "score", "label", "words", "digest", "member", "bucket", "range", "last", "own", "tie", "sketch", "_at", "_id", "_mark", "_drop", "_copies", "_place", "_copy", "_found", "_new", "_n", "_p", "_page", "_map", "n_lines", "n_dropped", "n_found", "n_changed", "of", "its", "drop", "found", "new", "month_first", "p", "page", "map", "copy", "none")


def sample(n=60, seed=1):
    draw = random.Random(seed)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(draw.choices(words, k=draw.randint(3, 40))) for _ in range(draw.randint(1, 5)))
        if i % 5 == 1:
            text = rows[draw.randrange(len(rows))][1]
        elif i % 5 == 2 and rows[-1][1]:
            parts = rows[-1][1].split(" ")
            parts[draw.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        rows.append([i * 3, text, "en", f"s{i % 4}", len(text or "")])
    rows += [[1000, None, None, None, None], [1001, "", "en", "s0", 0], [1002, "   \n ", "en", "s1", 5], [1003, "Word " * 9000, "en", None, 45000], [1004, "x" * 30000, None, "s2", 30000]]
    rows.append(list(rows[3]))  # a row that repeats
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def wider(docs):
    return docs.select("*", *(F.lit(7).alias(c) for c in CLASHES))


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_components_by_rounds(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (20, 10), (20, 11), (20, 12), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    found = dict(rows_of(common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")))
    assert found == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 10, 11: 10, 12: 10, 20: 10} | {100 + i: 100 for i in range(41)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_fingerprints(docs, empty):
    found = {r["doc_id"]: r for r in fingerprints.compare_edits(wider(docs).dropDuplicates(["doc_id"])).collect()}
    rows = sorted({r[0]: r for r in sample()}.values())
    assert len(found) == len(rows)
    for (i, text, *_), after in zip(rows, rows[1:] + rows[:1], strict=True):
        text, other = text or "", after[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert found[i]["n_chars"] == len(text) and found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(other)
        for name, x in (("near_edited", b), ("near_next", c)):
            assert abs(found[i][name] - (len(a & x) / len(a | x) if a | x else 1.0)) < 0.2
    assert fingerprints.compare_edits(docs).count() == docs.count() and fingerprints.compare_edits(empty).count() == 0


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"a{i}" for i in range(150, 900))
    frame = spark.createDataFrame([(1, a), (1, b)], "k int, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    s, t = (r["s"] for r in frame.orderBy(F.length("text")).collect())
    whole = fingerprints.merge_all(frame, ["k"], "s").first()["s"]
    assert whole == sorted({*s, *t})[: fingerprints.K]
    pair = spark.createDataFrame([(s, t)], "a array<long>, b array<long>")
    n, inside = pair.select(fingerprints.shingle_count(F.col("b")), fingerprints.containment(F.col("a"), F.col("b"))).first()
    assert abs(n - 746) < 250 and abs(inside - 0.49) < 0.2


def test_quality_learns_from_all_labels(spark):
    """Every labelled document counts: the cut is between the bad and the good ones of all, and each is in a pair."""
    rows = [(i, ("word " * (3 + i % 7)).strip() if i % 3 else "!!! ### " * (2 + i % 5)) for i in range(9_000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.range(9_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("quality"))
    wanted = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5}
    seen = quality._labelled(docs, labels)
    assert {r["doc_id"] for r in seen.select("doc_id").collect()} == wanted
    ranker = quality.train(docs, labels)
    assert docs.select("doc_id", ranker.score(F.col("text")).alias("s")).where("(s >= 0.3) <> (doc_id % 3 > 0)").count() == 0
    values = spark.createDataFrame([(float(v),) for v in [5, 1, 3, 3, 3, 9]], "v double")
    assert [quality._between(values, k) for k in (1, 2, 5)] == [2.0, 3.0, 7.0]


def test_quality(spark, empty):
    draw = random.Random(3)
    good = [" ".join(draw.choices(["alpha", "beta", "gamma", "delta"], k=30)) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in draw.choices(["alpha", "beta", "gamma"], k=30)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), rows[0]], SCHEMA)
    labels = spark.createDataFrame([*((i, int(i < 150), 0) for i in range(190)), (5, None, 0)], "doc_id long, quality int, toxic int")
    found = [r for r in quality.score_documents(wider(docs), labels).collect() if r["doc_id"] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(r["predicted"] == int(r["doc_id"] < 150) == int(r["score"] >= 0.3) for r in found)
    assert quality.keep_good(docs, labels).where("doc_id >= 150").count() == 0
    none = quality.score_documents(docs, labels.where("doc_id < 0")).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5] and quality.score_documents(empty, labels).count() == 0


def test_licenses(spark, empty):
    gpl = license_scan.TEMPLATES[5][1]
    texts = [
        "Released under the MIT License. MIT-license, Apache license", gpl.replace("redistribute", "spread").title(), "the mit of license", None, "", "license " * 20000,
        "mit license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(6, texts[6])], "doc_id long, text string")
    found = rows_of(license_scan.scan(wider(docs)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
    assert found[0] == (0, 9, 3, 3, 7, "apache,mit", "apache,mit") and found[1][5:] == ("gpl", "gpl") and found[2] == (2, 4, 0, None, None, "", "")
    assert found[3][1:3] == (0, 0) and found[5][1:3] == (20000, 0) and found[6] == found[7] == (6, 2, 1, 0, 0, "mit", "mit") and found[8][5:] == ("", "isc")
    scores = {r["doc_id"]: r["score"] for r in license_scan.scan(docs).collect()}
    assert scores[0] == 1 and scores[2] == 0 and 0.8 <= scores[7] <= 1
    assert license_scan.scan(empty).count() == 0
    isc = dict(license_scan.TEMPLATES)["isc"].split()
    fifth = " ".join("other" if i % 5 == 4 else w for i, w in enumerate(isc))
    tries = [fifth, " ".join(isc[:9] + ["new"] + isc[9:]), "x " + " ".join(isc[:9] + isc[10:]) + " y", " ".join(isc[::-1]), "licensed under the apache license version 2 0 " * 5]
    spans = license_scan.template_spans(license_scan.scanned(spark.createDataFrame(list(enumerate(tries)), "doc_id long, text string")))
    best = {}
    for r in spans.collect():
        best.setdefault((r["doc_id"], r["label"]), []).append((r["similarity"], r["first_word"], r["last_word"]))
    assert max(best[0, "isc"]) == (pytest.approx(0.8), 0, 19) and max(best[1, "isc"]) == (pytest.approx(20 / 21), 0, 20) and max(best[2, "isc"]) == (pytest.approx(0.95), 1, 19)
    assert (3, "isc") not in best and sorted(x[1:] for x in best[4, "apache"] if x[0] == 1) == [(8 * i, 8 * i + 7) for i in range(5)]


def test_mixing(spark, docs, empty):
    found = mixing.mix(wider(docs), ["doc_id", "source"]).collect()
    again = mixing.mix(docs.repartition(5), ["doc_id", "source"]).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again)) and len(found) == docs.count()
    sizes = {}
    for r in found:
        assert 0 <= r["copies"] <= 3 and (r["size"] > 0 or r["copies"] == 0)
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: float((1, 2, 3)[n % 3]) for n, s in enumerate(order)}
    level, full = 0.0, set()
    for _ in order:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / (sum(weight[s] for s in order if s not in full) or 1)
        more = {s for s in order if 3 * sizes[s] <= level * weight[s]}
        if more == full:
            break
        full = more
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(min(3 * sizes[r["source"]], level * weight[r["source"]]))
    # The plain version: copies in the order of their finish times, until the budget is used.
    queue = []
    for s in order:
        upto = 0
        own = sorted((r for r in found if r["source"] == s), key=lambda r: r["place"])
        for k in range(3):
            for n, r in enumerate(own):
                upto += r["size"]
                queue.append((upto / weight[s], "1" if s is None else "0" + s, r["place"], k, n, r["size"]))
    taken, used = {}, 0
    for _, s, place, _, n, size in sorted(q for q in queue if q[-1]):
        used += size
        if used > sum(sizes.values()):
            break
        taken[s, place, n] = taken.get((s, place, n), 0) + 1
    assert sum(taken.values()) == sum(r["copies"] for r in found)
    assert mixing.mix(empty, ["doc_id"]).count() == 0
    assert mixing.mixed_documents(wider(docs)).count() == sum(r["copies"] for r in found)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_edit_similarity(spark):
    frame = spark.createDataFrame([("abcdefghij", "abXdefghij"), ("abcdefghij", "jihgfedcba"), ("aaaaa", "aaaaa"), ("abcde", "abcdef"), ("", "")], "a string, b string")
    found = [r[0] for r in frame.select(line_dedup.edit_similarity(F.col("a"), F.col("b"))).collect()]
    assert found[:4] == [0.9, None, 1.0, pytest.approx(5 / 6)]


def test_lines(spark, empty):
    long = " ".join(f"word{i}" for i in range(200))
    near = long.replace("word77", "other")
    texts = ["one two three four five\nkeep me\n" + long, "ONE  two three four FIVE\nkeep me", near + "\nanother line of the text here", None, "", "short\nshort"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1])], "doc_id long, text string")
    found = rows_of(line_dedup.drop_repeated_lines(docs))
    assert found[0] == (0, texts[0], 3, 0) and found[1] == found[2] == (1, "keep me", 2, 1)
    assert found[3] == (2, "another line of the text here", 2, 1)
    assert found[4:] == [(3, None, 1, 0), (4, "", 1, 0), (5, texts[5], 2, 0)]
    assert line_dedup.drop_repeated_lines(wider(docs)).count() == docs.count() and line_dedup.drop_repeated_lines(empty).count() == 0


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark, empty):
    texts = [
        "card 4316522678525456, again 4316 5226 7852 5456.", "bad card 4316522678525457 2.0 v3", "call +1 (743) 555-3824 or (743) 555-3824", "born 1987-02-28 or 28.02.1987, not 1987-02-31",
        "mail Jo.Do@example.com and jo.do@example.com", "host 10.20.30.40 not 300.1.2.3 or 1.2.3.4.5", 'key "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None, "", "no data " * 20000,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pseudonyms.pseudonymise(wider(docs), "k").collect()}
    text = {i: r["text"] for i, r in found.items()}
    a, b = re.findall(r"\d[\d ]+\d", text[0])
    assert a == b.replace(" ", "") != "4316522678525456" and luhn(a) and [len(x) for x in b.split()] == [4, 4, 4, 4]
    assert text[1] == texts[1] and text[7] is None and text[8] == "" and text[9] == texts[9]
    x, y = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or \((\d{3})\) (\d{3}-\d{4})", text[2]).group(1, 3), re.findall(r"\d{3}-\d{4}", text[2])
    assert x[0] == x[1] != "743" and y[0] == y[1] != "555-3824"
    iso, dotted = re.search(r"(\d{4}-\d{2}-\d{2}) or (\d{2}\.\d{2}\.\d{4})", text[3]).groups()
    assert iso == "-".join(reversed(dotted.split("."))) != "1987-02-28" and text[3].endswith("not 1987-02-31")
    mails = re.findall(r"\S+@\S+", text[4])
    assert mails[0] == mails[1] and "example" not in text[4]
    assert "10.20.30.40" not in text[5] and text[5].endswith("not 300.1.2.3 or 1.2.3.4.5") and re.search('"[0-9a-f]{40}"', text[6]) and "24be" not in text[6]
    assert pseudonyms.pseudonymise(docs, "other").where("doc_id = 0").first()["text"] != text[0] and pseudonyms.pseudonymise(empty, "k").count() == 0


def test_permutation_is_one_to_one(spark):
    frame = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    found = {r[0] for r in frame.select(pseudonyms.permute_digits(F.col("d"), "k", "t")).collect()}
    assert found == {f"{i:03d}" for i in range(1000)}


def test_simhash(docs, empty):
    from xxhash import xxh64

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        h = [xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum((x >> b) & 1 for x in h) * 2 > len(h))

    rows = sample()
    prints = [plain(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = sorted((r[0], prints[i] - (prints[i] >> 63 << 64), least[root(i)]) for i, r in enumerate(rows))
    assert rows_of(simhash_dedup.near_components(wider(docs))) == sorted(want, key=repr)
    assert simhash_dedup.near_components(empty).count() == 0


def test_links_in_large_runs():
    draw = random.Random(4)
    centre = draw.getrandbits(64)
    values = np.unique(np.array([centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))) for _ in range(300)] + [draw.getrandbits(64) for _ in range(50)], dtype=np.uint64))
    parent = {int(v): int(v) for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v in enumerate(values):
        for w in values[:i][np.bitwise_count(values[:i] ^ v) <= 4]:
            parent[root(int(v))] = root(int(w))
    found = {frozenset(int(x) for x in np.concatenate([a.view(np.uint64), b.view(np.uint64)])) for a, b in simhash_dedup._forest(values, 4)}
    groups = {}
    for v in values:
        groups.setdefault(root(int(v)), set()).add(int(v))
    assert found == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_token_counts(spark, docs, empty, tokenizer):
    odd = ["a<|endoftext|>b  \n", " x　 y\x1c z", "don't  stop\r\n\r\n", "日本語 🙂​"]
    more = docs.union(spark.createDataFrame([(2000 + n, t, "", "", 0) for n, t in enumerate(odd)], SCHEMA))
    found = rows_of(token_prefixes.count_tokens(wider(more), P.path("byte_bpe_50k.json")))
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := size(r["text"] or ""), n > 512) for r in more.collect()]
    assert [r[:4] for r in found] == sorted(want, key=repr)
    text = {r["doc_id"]: r["text"] or "" for r in more.collect()}
    assert all(size(text[r[0]][: r[4]]) <= 512 and (r[4] == len(text[r[0]]) or size(text[r[0]][: r[4] + 1]) > 512) for r in found if r[0] != 1004)
    tables = token_prefixes.prefix_tables(more.where("doc_id < 30 or doc_id >= 2000"), P.path("byte_bpe_50k.json")).select("doc_id", "counts", token_prefixes.longest_within(F.col("counts"), 5).alias("n"))
    for r in tables.collect():
        counts = [size(text[r["doc_id"]][:n]) for n in range(len(text[r["doc_id"]]) + 1)]
        assert r["counts"] == counts and r["n"] == max(n for n, c in enumerate(counts) if c <= 5)
    assert token_prefixes.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_prefixes(tokenizer):
    draw = random.Random(6)
    pieces = [" ", "  ", "\n", "\r\n", "a", "Bc", "12", "!", "'s", "'re", "'ll", "don't", "the", "ing", "é", "\xa0", "\x85", "\x1c", "<|endoftext|>", "日", "🙂", "xyz" * 9]
    words = token_prefixes.vocabulary(P.path("byte_bpe_50k.json"))
    for _ in range(60):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 12)))
        counts = [len(tokenizer.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        assert words.count(text) == counts[-1] or "<|" in text
        prefixes = token_prefixes.Prefixes(text, words)
        assert prefixes.every() == counts and [prefixes.at(n) for n in range(len(text) + 1)] == counts and prefixes.total == counts[-1]
        for budget in range(8):
            assert prefixes.longest_within(budget) == max(n for n, c in enumerate(counts) if c <= budget)


def test_counts_come_from_the_recurrence(monkeypatch):
    import pandas as pd

    words = token_prefixes.vocabulary(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(words, "ids", None)
    monkeypatch.setattr(words, "encoding", None)
    seen = []
    table = words.table
    monkeypatch.setattr(words.totals, "table", lambda piece: seen.append(piece) or table(piece))
    words.totals.clear()
    (found,) = token_prefixes._counter(P.path("byte_bpe_50k.json"), 2)(iter([pd.Series(["one two three", None])]))
    assert found["n_tokens"].tolist() == [3, 0] and found["chars_within"].tolist() == [7, 0] and seen == [b"one", b" two", b" three"]


def test_packing(docs, empty, tokenizer):
    path = P.path("byte_bpe_50k.json")
    found = packing.pack(wider(docs).dropDuplicates(["doc_id"]).coalesce(1), path).collect()
    text = {r[0]: r[1] for r in sample()}
    at = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.array([*tokenizer.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] = r["start"] + r["length"]
    assert all(at[r["doc_id"]] == r["doc_tokens"] for r in found) and {*at} == {*text}
    filled = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) * 1.005 + 1
    assert len(found) < 1.5 * len(text) + sum(r["length"] == 2048 for r in found)  # few are cut
    assert packing.pack(docs, path).count() >= docs.count() and packing.pack(empty, path).count() == 0


def test_differencing_balances():
    draw = random.Random(8)
    sizes = [draw.randint(1, 256) for _ in range(700)]
    windows = packing.differencing(sizes, 44)
    sums = np.bincount(windows, weights=sizes, minlength=44)
    assert sums.max() - sums.min() <= 4 and packing.differencing([5], 1).tolist() == [0]
    for slack in (None, 0.0, 0.05):
        for pieces in ([1100, 1100, 1100, 900], [2047] * 7, sizes, [draw.randint(1, 2047) for _ in range(400)], [5]):
            parts = packing.pack_block(pieces, 2048, slack)
            assert max(sum(x[2] for x in w) for w in parts) <= 2048
            own = {}
            for piece, start, length in sorted(x for w in parts for x in w):
                assert length > 0 and start == own.get(piece, 0)
                own[piece] = start + length
            assert own == dict(enumerate(pieces))
            assert len(parts) <= -(-sum(pieces) // 2048) * (1 + (slack or 0)) + 1 or slack is None and sum(map(len, parts)) == len(pieces)


def test_perfect_hash():
    for n in (1, 2, 3, 50, 3000):
        digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        seeds, slots = exact_dedup.displacements(digests)
        assert sorted(slots) == list(range(n)) and len(seeds) == -(-n // exact_dedup.GROUP)


def test_exact_groups(docs, empty):
    def plain(rows):
        groups = {}
        for r in rows:
            groups.setdefault(hashlib.sha256((r[1] or "").encode()).hexdigest(), []).append(r[0])
        return groups

    groups = plain(sample())
    want = sorted(((i, d, max(g), len(g)) for d, g in groups.items() for i in g), key=repr)
    assert rows_of(exact_dedup.exact_groups(wider(docs))) == want
    past = plain(r for r in sample() if r[0] < 90)
    want = [(i, d, max(past.get(d, g)), len(past.get(d, g))) for d, g in groups.items() for i in g]
    assert rows_of(exact_dedup.exact_groups(docs, docs.where("doc_id < 90"))) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(empty).count() == 0
    want = sorted(((i, d, max(g), len(g)) for d, g in groups.items() for i in g), key=repr)
    for cut in (0, 90, 1001, 10_000):
        assert rows_of(exact_dedup.with_arrivals(docs.where(F.col("doc_id") < cut), wider(docs).where(F.col("doc_id") >= cut))) == want
    assert len(rows_of(exact_dedup.exact_groups(docs, empty))) == docs.count()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    assert [len(corpus_pipeline.STAGES)] == [5]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = common.written(stage(spark, docs, sf))
        assert found.columns == docs.columns and found.count() > 0
        docs = found
    ids = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == ids


COLUMNS = {
    "op1": "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2": "doc_id long, held_out boolean, score double, predicted int",
    "op3": "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    "op4": "doc_id long, size long, source_size long, target double, taken long",
    "op5": "doc_id long, text string",
    "op6": "doc_id long, text string",
    "op7": "doc_id long, fingerprint string, component_id long",
    "op8": "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    "op9": "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    "op10": "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string",
    "op11": "doc_id long, n_shingles long, component_id long, kept boolean",
    "op12": "vec_id long, code string, error long, label_error long, codebooks_sha256 string",
    "op13": "item_id long, rank int, doc_id long, score long",
}


def test_queries_have_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    n = common.table(spark, sf, "documents").count()
    for name, query in queries.QUERIES.items():
        found = query(spark, sf)
        want = [tuple(x.split()) for x in COLUMNS[name.partition("_")[0]].split(", ")]
        types = dict(found.dtypes)
        assert [(c, types[c].replace("bigint", "long")) for c, _ in want] == want, name
        if name.startswith("op12"):
            assert found.count() == common.table(spark, sf, "embeddings").count()
        elif name.startswith("op13"):
            assert found.select("item_id").distinct().count() == common.table(spark, sf, "benchmark").count()
        else:
            assert (found.select("doc_id").distinct() if name.startswith("op9") else found).count() == n, name
