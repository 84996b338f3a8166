"""Near-duplicates and line links against all pairs."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tarifflens.llm import line_dedup, minhash_dedup, mixing, near_documents, prefix_join, pseudonyms, queries  # noqa: E402


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups_of(n, linked):
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


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        at = draw.randrange(len(words))
        words[at : at + 1] = draw.choice([[], ["changed"], [words[at], f"new{draw.random()}"]])
    return words


@pytest.fixture(scope="module")
def near_texts():
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = draw.choices(vocabulary, k=40)
    out = [None, "", " \n", "a b", "A  b", "a b c"]
    for n in range(40):
        words = draw.choices(vocabulary, k=draw.randint(6, 200)) + passage * (n % 2)
        out += [" ".join(words)] + [" ".join(edited(draw, words, draw.randint(0, 5))) for _ in range(3)]
    words = draw.choices(vocabulary, k=150)
    out += [" ".join(edited(draw, words, draw.randint(1, 3))) for _ in range(150)]  # a bucket above prefix_join.LARGE
    return out


def test_stage_links_all_pairs_of_like_texts(spark, near_texts):
    sets = [shingles(t) for t in near_texts]
    near = lambda i, j: not (sets[i] | sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    docs = spark.createDataFrame(list(enumerate(near_texts)), "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == sorted(set(groups_of(len(near_texts), near)))
    assert stage(spark, docs.limit(0), "").count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_are_linked_as_all_pairs_are(spark):
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    lines = []
    for _ in range(25):
        words = draw.choices(vocabulary, k=draw.randint(5, 25))
        lines += [words] + [edited(draw, words, draw.randint(1, 3)) for _ in range(3)]
    a = draw.choices(vocabulary, k=10)
    lines += [a[::-1], a, [a[1], a[0], *a[2:]], a * 2]  # one SimHash, and one of them is far from the others
    words = draw.choices(vocabulary, k=30)
    lines += [edited(draw, words, draw.randint(1, 3)) for _ in range(90)]  # a bucket above prefix_join.LARGE
    near = lambda i, j: lines[i] == lines[j] or len(lines[i]) >= 5 <= len(lines[j]) and 5 * edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j]))
    want = [int(root != i) for i, root in enumerate(groups_of(len(lines), near))]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    assert [r["n_dropped"] for r in line_dedup.drop_repeated_lines(docs).orderBy("doc_id").collect()] == want


def test_short_lines_and_lines_without_spaces_go(spark, tmp_path):
    url, chinese = "https://example.com/" + "x" * 80, "版权所有未经许可不得转载本站内容"
    texts = [f"all rights reserved.\n{url}\n\n{chinese}\none", f"ALL rights  reserved.\n{chinese}\n\n{url}\nan other line\none\ntwo", "one two three four\none two three four five"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert found == [(0, texts[0], 5, 0), (1, "\nan other line\ntwo", 7, 4), (2, "one two three four", 2, 1)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    assert [r["text"] for r in stage(spark, docs, "").orderBy("doc_id").collect()] == [r[1] for r in found]


def test_cards_beside_other_numbers(spark):
    texts = ["card 4111 1111 1111 1111 12/25", "4111 1111 1111 1111 123", "4111111111111111 99", "no 12 4111-1111-1111-1111 here", "bad 4111 1111 1111 1112 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r["text"] for r in pseudonyms.pseudonymise(docs, "k").orderBy("doc_id").collect()]
    cards = [re.search(r"(?:\d{4}[ -]?){3}\d{4}", x)[0] for x in found]
    assert len({re.sub(r"\D", "", c) for c in cards[:4]}) == 1 and "4111" not in cards[0] and found[4] == texts[4]
    assert [x.replace(c, "") for x, c in zip(found[:4], cards, strict=False)] == ["card  12/25", " 123", " 99", "no 12  here"]


def test_stage_tells_rows_of_one_id_apart(spark):
    rows = [(1, "one text of its own here"), (1, "quite another text stands here"), (None, "a text without an id"), (None, "a text without an id"), (7, "one text of its own here"), (None, "one text of its own here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(map(tuple, stage(spark, docs, "").collect()), key=repr) == sorted(rows[:3], key=repr)


def test_hostile_texts(spark):
    long = ["x@" + "a." * 200_000, "a" * 400_000, "a@" * 200_000, "1-" * 100_000, "ab12 " * 100_000, "f:" * 200_000, "12/12/" * 50_000, "DE89 3704 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert pseudonyms.pseudonymise(docs, "k").count() == len(long)


def test_kinds_of_personal_data(spark):
    texts = [
        "ssn 123-45-6789 not 666-12-1234 nor 123-00-1234", "DE89 3704 0044 0532 0130 00 and DE89370400440532013000 not DE88370400440532013000",
        "2001:db8::ff00:42:8329 and 2001:0db8:0000:0000:0000:ff00:0042:8329 not Bad::Cafe 12:30:45", "3/4/1987 and 12/25/1987 or 1987-03-04 or 1987/03/04", "03/04/1987 and 28/02/1987 or 1987-04-03",
        "555 123 4567 or 555-123-4567 or (555) 123-4567 or +1 555 123 4567", "1815-06-18 or 18.06.1815 not 0001-01-01", "IV12 4111 1111 1111 1111",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r["text"] for r in pseudonyms.pseudonymise(docs, "k").orderBy("doc_id").collect()]
    assert re.fullmatch(r"ssn (?!123-45-6789)\d{3}-\d{2}-\d{4} not 666-12-1234 nor 123-00-1234", found[0])
    a, b = re.fullmatch(r"(DE(?: ?\d){20}) and (DE\d{20}) not DE88370400440532013000", found[1]).groups()
    assert a.replace(" ", "") == b != "DE89370400440532013000" and int(b[4:] + "1314" + b[2:4]) % 97 == 1
    a, b = re.fullmatch(r"(\S+) and (\S+) not Bad::Cafe 12:30:45", found[2]).groups()
    assert a == b != "2001:0db8:0000:0000:0000:ff00:0042:8329"
    m, d, y = re.match(r"(\d+)/(\d+)/(\d{4})", found[3]).groups()
    assert found[3].endswith(f" or {y}-{int(m):02}-{int(d):02} or {y}/{int(m):02}/{int(d):02}") and (y, m, d) != ("1987", "3", "4")
    d, m, y = re.match(r"(\d+)/(\d+)/(\d{4})", found[4]).groups()
    assert found[4].endswith(f" or {y}-{m}-{d}")
    assert len({re.sub(r"\D", "", x)[-10:] for x in found[5].split(" or ")}) == 1 and "555" not in found[5].split(" or ")[0][:3]
    iso, dotted = re.fullmatch(r"(\S+) or (\S+) not 0001-01-01", found[6]).groups()
    assert iso == "-".join(reversed(dotted.split("."))) and 1000 <= int(iso[:4]) < 1900 and "4111" not in found[7]


def test_buckets_of_like_and_unlike_lines(spark):
    """Large buckets of lines that share words but aren't near, of different sizes, and near ones among them."""
    draw = random.Random(21)
    shared = [f"s{i}" for i in range(6)]
    lines = [draw.choices([f"v{i}" for i in range(4000)], k=draw.randint(2, 30)) + shared + draw.choices([f"v{i}" for i in range(4000)], k=draw.randint(2, 30)) for _ in range(120)]
    lines += [edited(draw, draw.choice(lines), draw.randint(1, 4)) for _ in range(60)]
    near = lambda i, j: 5 * edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j]))
    want = [int(root != i) for i, root in enumerate(groups_of(len(lines), near))]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    assert [r["n_dropped"] for r in line_dedup.drop_repeated_lines(docs).orderBy("doc_id").collect()] == want


def test_short_lines_of_one_template_put_out_no_pairs(spark, monkeypatch):
    sizes = []
    written = prefix_join.written

    def noted(frame):
        out = written(frame)
        if frame.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(prefix_join, "written", noted)
    lines = [f"written by user u{n}" for n in range(400)] + [f"seen in the hall of h{n} on day d{n}" for n in range(300)]
    docs = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(docs, 1).where("n_dropped > 0").count() == 0
    assert max(sizes) < 3 * len(lines)


def test_lines_without_python_and_few_links_in_a_large_group(spark, monkeypatch):
    """Only DataFrame operations; and near copies of one line put out about as many links as they are, not one for each of the buckets that they share."""
    plans, links = [], []
    written, components = line_dedup.written, prefix_join.connected_components

    def noted(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return written(frame)

    def counted(edges, a, b):
        links.append(edges.count())
        return components(edges, a, b)

    for module in (line_dedup, prefix_join):
        monkeypatch.setattr(module, "written", noted)
    monkeypatch.setattr(prefix_join, "connected_components", counted)
    draw = random.Random(31)
    words = draw.choices([f"v{i}" for i in range(4000)], k=60)
    lines = [" ".join(edited(draw, words, draw.randint(1, 3))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(docs, 1).where("n_dropped > 0").count() == 299
    assert plans and not [p for p in plans if "Python" in p or "Arrow" in p]
    assert sum(links) <= 2 * len(lines)


def test_rarest_pairs_of_a_line_are_computed_once(spark):
    """Enough pairs that edits within reach leave one of them, each with its place where it stands once; and no step of the plan computes them for a filter too."""
    draw = random.Random(61)
    lines = [draw.sample(range(1, 1 << 17), k=n) for n in (2, 3, 4, 5, 9, 40, 101)] + [draw.sample(range(1, 1 << 17), k=30) * 2]
    rows = spark.createDataFrame([(i, [w << 45 for w in x]) for i, x in enumerate(lines)], "h long, w array<long>")
    made = line_dedup._members(rows, F.array_repeat(F.lit(0).cast("bigint"), 1 << line_dedup.RANK_BITS))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("zip_with(") == 1 and "sort_array(" in plan
    found = {}
    for r in made.collect():
        found.setdefault(r["h"], []).append((r["e"] >> prefix_join.PLACE_BITS, r["e"] & prefix_join.ANYWHERE))
    assert sorted(found) == [2, 3, 4, 5, 6, 7]
    for h, own in found.items():
        n, pairs = len(lines[h]), [(x + y << 45 - 64 + line_dedup.RANK) >> prefix_join.PLACE_BITS for x, y in zip(lines[h], lines[h][1:])]
        last = sorted(pairs)[2 * (n // 5) + (n % 5 == 4)]
        assert sorted(own) == sorted((x, i) for i, x in enumerate(pairs) if x <= last) if h < 7 else sorted(own) == sorted({(x, prefix_join.ANYWHERE) for x in pairs if x <= last})


def test_keys_that_the_same_items_hold_become_one(spark):
    at = lambda key, place: (key << prefix_join.PLACE_BITS) | place
    rows = [(at(k, 5 + k + 3 * h), h, 40) for k in range(1, 11) for h in (0, 1, 2)]
    rows += [(at(20, 9), 0, 40), (at(20, prefix_join.ANYWHERE), 1, 40), (at(21, 9), 0, 40)]
    found = prefix_join.meeting(spark.createDataFrame(rows, "e long, h long, n int"), lambda x, y: x("n") == y("n")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["e"] >> prefix_join.PLACE_BITS, []).append((r["h"], r["e"] & prefix_join.ANYWHERE))
    assert sorted(map(sorted, groups.values())) == [[(0, 0), (1, 3), (2, 6)], [(0, 0), (1, prefix_join.ANYWHERE)]]


def test_rows_that_meet_by_chance_go(spark):
    """Of a small key's rows only those stay that can belong to a link; of the others not one, however many items share the key."""
    at = lambda key, place: (key << prefix_join.PLACE_BITS) | place
    rows = [(at(1, 3), 0, 10), (at(1, 5), 1, 40), (at(1, 7), 2, 90)] + [(at(2, 3), 3, 10), (at(2, 5), 4, 40), (at(2, 7), 5, 40), (at(2, 7), 5, 40)]
    rows += [(at(k, 1), h, n) for k, h, n in ((3, 6, 20), (4, 8, 20))] * 2 + [(at(k, 1), h, n) for k, h, n in ((3, 7, 20), (4, 9, 20))] * 2
    found = prefix_join.meeting(spark.createDataFrame(rows, "e long, h long, n int"), lambda x, y: x("n") == y("n")).collect()
    keys = {}
    for r in found:
        keys.setdefault(r["e"] >> prefix_join.PLACE_BITS, set()).add(r["h"])
    assert sorted(map(sorted, keys.values())) == [[4, 5], [6, 7], [8, 9]]


def test_a_pair_is_put_out_at_few_of_the_keys_where_it_meets(spark, monkeypatch):
    """Lines of the same words, most of them no links: each pair meets in many large buckets."""
    draw, words, sizes = random.Random(51), [f"v{i}" for i in range(60)], []
    lines = []
    for _ in range(40):
        swapped = set(draw.sample(range(30), 7))
        lines.append([w for i in range(30) for w in words[2 * i : 2 * i + 2][:: -1 if i in swapped else 1]])
    docs = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(lines)], "doc_id long, text string")
    near = lambda i, j: 5 * edits(lines[i], lines[j]) <= 60
    want = [int(root != i) for i, root in enumerate(groups_of(len(lines), near))]
    distinct = type(docs).distinct

    def noted(frame):
        if frame.columns == ["a", "b"]:
            sizes.append(frame.count())
        return distinct(frame)

    monkeypatch.setattr(type(docs), "distinct", noted)
    assert [r["n_dropped"] for r in line_dedup.drop_repeated_lines(docs, 1).orderBy("doc_id").collect()] == want
    assert max(sizes) <= 3 * 780 // 2


def test_near_copies_without_a_common_copy_put_out_few_pairs(spark, monkeypatch):
    """Copies about as far from each other as links reach: the least one isn't linked with all of them, yet most pairs are."""
    sizes = []
    written = prefix_join.written

    def noted(frame):
        out = written(frame)
        if frame.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(prefix_join, "written", noted)
    draw = random.Random(41)
    words = draw.choices([f"v{i}" for i in range(4000)], k=60)
    copy = lambda n: [f"c{draw.random()}" if i in x else w for x in [set(draw.sample(range(60), n))] for i, w in enumerate(words)]
    lines = [copy(12)] + [copy(draw.choice([5, 6, 7])) for _ in range(300)]
    docs = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(lines)], "doc_id long, text string")
    near = lambda i, j: 5 * sum(x != y for x, y in zip(lines[i], lines[j], strict=True)) <= 60
    want = [int(root != i) for i, root in enumerate(groups_of(len(lines), near))]
    assert [r["n_dropped"] for r in line_dedup.drop_repeated_lines(docs, 1).orderBy("doc_id").collect()] == want
    assert max(sizes) <= 4 * len(lines)


def test_stage_links_by_simhash_and_shuffles_texts_once(spark, near_texts, monkeypatch):
    found = []
    links = minhash_dedup.simhash_links

    def noted(*a):
        found.append(links(*a))
        return found[0]

    monkeypatch.setattr(minhash_dedup, "simhash_links", noted)
    docs = spark.createDataFrame(list(enumerate(near_texts)), "doc_id long, text string")
    kept = near_documents.drop_similar(docs)
    assert found[0].count() > 20
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The documents and the small side, which the mix has aggregated before.
        for frame, shuffles in ((kept, 2), (mixing.mixed_documents(docs.withColumn("source", F.lit("s"))), 3)):
            plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert len([x for x in plan.splitlines() if "Exchange" in x]) == shuffles
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bands_of_the_same_nodes_are_compared_once(spark):
    rows = [(k, n) for k in (1, 2, 3) for n in (10, 20, 30)] + [(4, 10), (4, 20)]
    members = spark.createDataFrame(rows, "k long, node long")
    assert sorted(map(tuple, minhash_dedup._distinct_bands(members).collect())) == [(1, 10), (1, 20), (1, 30), (4, 10), (4, 20)]
