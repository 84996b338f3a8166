"""Candidates of fuzzy matching against all pairs, and how their number grows; substring search against ILIKE."""

import random

import pytest
from pyspark.sql import functions as F

from tarifflens.operators import qgrams, substring


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edited(draw, text, most):
    out = list(text)
    for _ in range(draw.randint(0, most)):
        at = draw.randrange(len(out))
        out[at : at + 1] = draw.choice([[], ["x"], [out[at], "y"], [out[at], out[at]]])
    return "".join(out) or "x"


@pytest.mark.parametrize("least", [0.85, 0.92])
def test_candidates_lose_no_pair(spark, least):
    draw = random.Random(21)
    bases = ["".join(draw.choices("абвгde ", k=n)).strip() or "a" for n in (*range(1, 30), 40, 60, 90)] + ["a" * n for n in (1, 2, 5, 7, 8, 19, 25)]
    texts = sorted({edited(draw, b, 1 + len(b) // 6) for b in bases for _ in range(4)} | set(bases))
    names, labels = texts[::2], texts[1::2] + texts[:20]
    found = qgrams.candidates(spark.createDataFrame([(x,) for x in names], "x string"), spark.createDataFrame([(y,) for y in sorted(set(labels))], "y string"), least)
    got = {(r["x"], r["y"]) for r in found.collect()}
    want = {(x, y) for x in names for y in labels if 2 * common(x, y) >= least * (len(x) + len(y)) - 1e-9}
    assert want <= got and len(want) > 30


def test_candidates_grow_as_names_do(spark):
    draw = random.Random(2)
    syllables = [a + b for a in "бвгдклмнпрст" for b in "аеиоу"]
    words = ["".join(draw.choices(syllables, k=draw.randint(2, 5))) for _ in range(3_000)]
    counts = []
    for n in (150, 1_500):
        labels = sorted({" ".join(sorted(draw.choices(words, k=draw.randint(2, 5)))) for _ in range(n)})
        names = sorted({edited(draw, draw.choice(labels), 3) for _ in range(n)})
        found = qgrams.candidates(spark.createDataFrame([(x,) for x in names], "x string"), spark.createDataFrame([(y,) for y in labels], "y string"), 0.85)
        counts.append((found.count(), len(names) * len(labels)))
    (few, _), (many, pairs) = counts
    assert many < 20 * few and many < pairs / 500, counts


def test_substring_search_is_ilike(spark, tmp_path):
    draw = random.Random(5)
    rows = [(n, draw.choice([None, *("".join(draw.choices("abCÉ%_ ", k=draw.randint(0, 14))) for _ in range(6))])) for n in range(600)]
    texts = spark.createDataFrame(rows, "id long, name string").repartition(3).cache()
    substring.save(substring.postings(texts, "id", "name"), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    queries = ["abc", "B", "", "ab", "aB_C", "a%bc", "éab", "abcabcabc", "\\%ab", "c a", "___", "zzz", "a%b%c", "bca_%é"]
    for q in queries:
        want = sorted(r["id"] for r in texts.where(F.col("name").ilike(f"%{q}%")).collect())
        assert sorted(r["id"] for r in substring.search(index, texts, "id", "name", q).collect()) == want, q
    plan = index.where(F.col("gram").isin(["abc"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), EqualTo(gram" in plan
    assert substring.grams_of("a\\%bC%de_fgh") == ["%bc", "a%b", "fgh"]
