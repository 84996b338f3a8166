"""Set-based versions against a simulation that takes one document after the other."""

import random
from datetime import date

from pyspark.sql import functions as F

from tarifflens.operators import history


def simulate(items):
    state, previous = [], {}
    for seq in sorted({i["doc_seq"] for i in items}):
        doc = [i for i in items if i["doc_seq"] == seq]
        for c in doc:
            fits = [i for i in state if i["live"] and i["service_id"] is not None and i["service_id"] == c["service_id"] and i["partner_id"] == c["partner_id"] and (c["effective_date"] is None or i["effective_date"] is None or i["effective_date"] < c["effective_date"])]
            if fits:
                previous[c["item_id"]] = max(fits, key=lambda i: (i["effective_date"] or date.min, i["doc_seq"], i["item_id"]))["item_id"]
        for c in doc:
            for i in state:
                if c["service_id"] is not None and c["effective_date"] and (i["partner_id"], i["service_id"]) == (c["partner_id"], c["service_id"]) and (i["effective_date"] is None or i["effective_date"] <= c["effective_date"]):
                    i["live"] = False
        state += [i.__setitem__("live", True) or i for i in doc]
    return {i["item_id"]: i["live"] for i in state}, previous


def test_versions(spark):
    draw = random.Random(7)
    docs = [(s, draw.choice([1, 2]), draw.choice([None, *(date(2024, m, 1) for m in range(1, 7))])) for s in range(60)]
    items = [{"item_id": n, "partner_id": p, "service_id": draw.choice([None, 1, 2, 3]), "doc_seq": s, "effective_date": d, "price": float(n)} for n, (s, p, d) in enumerate(draw.choices(docs, k=200))]
    frame = spark.createDataFrame([tuple(i.values()) for i in items], "item_id long, partner_id long, service_id long, doc_seq long, effective_date date, price double")
    live, previous = simulate(items)
    assert {r["item_id"]: r["active"] for r in history.active_versions(frame).collect()} == live
    for block in (8_192, 16, 1):  # in the latter, keys are cut
        found = history.previous_prices(frame, block).collect()
        assert {r["item_id"]: r["previous_id"] for r in found} == previous
        assert all(r["previous_price"] == float(r["previous_id"]) for r in found)
    assert history.previous_prices(frame.limit(0)).count() == 0


def test_versions_of_documents_at_one_place(spark):
    draw = random.Random(3)
    dates = [None, *(date(2024, m, 1) for m in range(1, 5))]
    items = [{"item_id": n, "partner_id": draw.choice([None, 1]), "service_id": 1, "doc_seq": draw.randrange(12), "effective_date": draw.choice(dates), "price": n / 2} for n in range(80)]
    frame = spark.createDataFrame([tuple(i.values()) for i in items], "item_id long, partner_id long, service_id long, doc_seq long, effective_date date, price double").repartition(3)
    _, previous = simulate(items)
    for block in (8_192, 4):
        assert {r["item_id"]: r["previous_id"] for r in history.previous_prices(frame, block).collect()} == previous


def test_many_versions_of_one_key(spark):
    # Dates that fall, so that all stay live, then rise; 200,000 versions of one partner and service.
    n = 200_000
    day = F.when(F.col("id") < n // 2, n // 2 - F.col("id")).otherwise(F.col("id") - n // 2) % 5_000
    rows = spark.range(n).select(F.col("id").alias("item_id"), (F.col("id") % 1).alias("partner_id"), (F.col("id") % 1).alias("service_id"), F.col("id").alias("doc_seq"), F.date_add(F.lit(date(2000, 1, 1)), day.cast("int")).alias("effective_date"), F.col("id").cast("double").alias("price"))
    found = history.previous_prices(rows)
    assert found.count() > n // 2 - 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    sample = {r["item_id"]: r["previous_id"] for r in found.where("item_id >= 199000").collect()}
    # After the turn, dates repeat every 5,000 documents: the one before this one is a day earlier and the only live one below it.
    assert all(sample[i] == i - 1 for i in range(199_000, n) if (i - n // 2) % 5_000)


def test_names_match(spark):
    services = spark.createDataFrame([(1, "прием врача кардиолога", ["кардиолог"], True), (2, "узи сердца", None, True), (3, "рентген", [], False)], "service_id long, service_name string, synonyms array<string>, is_active boolean")
    names = spark.createDataFrame([(x,) for x in ("прием врача кардиолог", "УЗИ Сердца", "КАРДИОЛОГ", "рентген", "узи", None, "узи сердец")], "raw_name string")
    found = {r["raw_name"]: (r["service_id"], r["status"]) for r in history.match_names(names, services).collect()}
    assert found == {"прием врача кардиолог": (1, "fuzzy_auto"), "УЗИ Сердца": (2, "exact"), "КАРДИОЛОГ": (1, "synonym"), "рентген": (None, "none"), "узи": (None, "none"), "узи сердец": (None, "fuzzy_review")}
