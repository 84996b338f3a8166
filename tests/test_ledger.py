"""Events applied as sets against a simulation that takes one after the other; imports that are repeated or break off."""

import random

import pytest
from pyspark.sql import functions as F

from tarifflens.operators import ingest, ledger

DOCS = "doc_id long, archive string, parse_status string"
ITEMS = "item_id long, doc_id long, service_name_raw string, service_code_source string, service_id long, price_resident double, price_nonresident double, price_original double, currency string, is_verified boolean, verification_note string"
SERVICES = "service_id long, service_name string, category string, icd_code string, synonyms array<string>, is_active boolean"


def waits(i):
    prices = [i[c] for c in ("price_resident", "price_nonresident", "price_original") if i[c] is not None]
    low = i["price_resident"] is not None and i["price_nonresident"] is not None and i["price_nonresident"] < i["price_resident"]
    return not i["is_verified"] and (i["service_id"] is None or not prices or min(prices) <= 0 or low or "anomaly:" in (i["verification_note"] or ""))


def simulate(docs, items, services, events):
    docs, items, services = ({r[k]: dict(r) for r in rows} for rows, k in ((docs, "doc_id"), (items, "item_id"), (services, "service_id")))
    for kind, e in events:
        if kind == "deletions":
            gone = [d for d, r in docs.items() if d == e["doc_id"] or (e["archive"] is not None and r["archive"] == e["archive"])]
            for d in gone:
                del docs[d]
                items = {k: i for k, i in items.items() if i["doc_id"] != d}
            continue
        i = items.get(e["item_id"])
        if i is None:
            continue
        doc = docs[i["doc_id"]]
        if kind == "reviews":
            i["service_name_raw"] = (e["service_name_raw"] or "").strip() or i["service_name_raw"]
            i["service_code_source"] = e["service_code_source"].strip() if e["service_code_source"] else None
            prices = [e[c] for c in ("price_resident", "price_nonresident", "price_original")]
            i["price_resident"], i["price_nonresident"], i["price_original"] = prices
            i["currency"] = e["currency"] if any(p is not None for p in prices) else None
            i["is_verified"], i["verification_note"], doc["parse_status"] = True, "manual verified", "processed"
            continue
        if e["service_id"] is not None:
            if e["service_id"] not in services:
                continue
            service = e["service_id"]
        else:
            name = (e["create_name"] or "").strip()
            if not name:
                continue
            service = min((s for s, r in services.items() if r["service_name"].lower() == name.lower()), default=None)
            if service is None:
                service = ("new", name.lower())
                services[service] = {"service_id": service, "service_name": name, "category": e["create_category"], "icd_code": e["create_code"], "synonyms": [i["service_name_raw"]] if i["service_name_raw"] != name else [], "is_active": True}
        i["service_id"], i["is_verified"], i["verification_note"] = service, True, e["note"] or "manual matched"
        if not any(waits(x) for x in items.values() if x["doc_id"] == i["doc_id"]):
            doc["parse_status"] = "processed"
    return docs, items, services


def frame(spark, rows, schema):
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def history(draw):
    docs = [{"doc_id": d, "archive": draw.choice([None, "a", "b", "c"]), "parse_status": draw.choice(["processed", "needs_review", "error"])} for d in range(40)]
    price = lambda: draw.choice([None, None, -1.0, 10.0, 20.0])
    items = [
        {"item_id": n, "doc_id": draw.randrange(40), "service_name_raw": f"name {n % 7}", "service_code_source": draw.choice([None, "A1"]), "service_id": draw.choice([None, 1, 2]), "price_resident": price(), "price_nonresident": price(), "price_original": price(), "currency": "KZT", "is_verified": draw.random() < 0.4, "verification_note": draw.choice([None, "anomaly: x"])}
        for n in range(120)
    ]
    services = [{"service_id": n, "service_name": name, "category": "c", "icd_code": None, "synonyms": ["s"], "is_active": True} for n, name in ((1, "Blood"), (2, "Urine"), (3, "blood"))]
    events = []
    for seq in range(160):
        kind = draw.choice(["reviews"] * 3 + ["matches"] * 6 + ["deletions"] * (seq % 8 == 0))
        if kind == "deletions":
            e = {"seq": seq, **draw.choice([{"doc_id": draw.randrange(45), "archive": None}, {"doc_id": None, "archive": draw.choice(["c", "zz"])}])}
        elif kind == "reviews":
            e = {"seq": seq, "item_id": draw.randrange(125), "service_name_raw": draw.choice([None, "  ", f" seen {seq}"]), "service_code_source": draw.choice([None, "", " B2 "]), "price_resident": price(), "price_nonresident": price(), "price_original": price(), "currency": draw.choice(["USD", None])}
        else:
            by = draw.choice([{"service_id": draw.choice([1, 2, 9])}, {"create_name": draw.choice([" BLOOD ", "New One", "new one", "name 3", " ", None])}])
            e = {"seq": seq, "item_id": draw.randrange(125), "service_id": None, "create_name": None, "create_category": draw.choice([None, "k"]), "create_code": None, "note": draw.choice([None, "", "by hand"]), **by}
        events.append((kind, e))
    return docs, items, services, events


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_events_are_applied_as_one_after_the_other(spark, seed):
    docs, items, services, events = history(random.Random(seed))
    tables = [frame(spark, docs, DOCS), frame(spark, items, ITEMS), frame(spark, services, SERVICES)]
    kinds = [frame(spark, [e for k, e in events if k == kind], ledger.EVENTS[kind]).repartition(2) for kind in ("reviews", "matches", "deletions")]
    state = ledger.current(*tables, *kinds)
    want_docs, want_items, want_services = simulate(docs, items, services, events)
    found_services = {r["service_id"]: r.asDict() for r in state.services.collect()}
    ids = {s: s if isinstance(s, int) else next(i for i, r in found_services.items() if i > 3 or i < 0 if r["service_name"].lower() == s[1]) for s in want_services}
    assert {r["doc_id"]: r.asDict() for r in state.documents.collect()} == want_docs
    assert {r["item_id"]: r.asDict() for r in state.items.collect()} == {k: {**i, "service_id": ids.get(i["service_id"])} for k, i in want_items.items()}
    assert found_services == {ids[k]: {**s, "service_id": ids[k]} for k, s in want_services.items()}
    totals = {r["archive"]: (r["n_documents"], r["n_items"], r["n_matched"]) for r in state.archives().collect()}
    for archive in {d["archive"] for d in want_docs.values()} - {None}:
        of = [i for i in want_items.values() if want_docs[i["doc_id"]]["archive"] == archive]
        assert totals[archive] == (sum(d["archive"] == archive for d in want_docs.values()), len(of), sum(i["service_id"] is not None for i in of))


def imported(spark, path):
    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    return ingest.Ingested(one("partner_id long, name string", (1, path)), one(DOCS, (hash(path) % 1000, path, "processed")), one("item_id long, doc_id long", (1, 2), (3, 4)), one("archive string, path string, n int, warning string", (path, "p", 0, "w")))


def test_imports_are_kept_once_and_whole(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    for name in ("first", "second", "first"):
        ledger.save(imported(spark, name), out, name)
    tables = ledger.load(spark, out)
    assert {n: t.count() for n, t in tables.items()} == {"partners": 1, "documents": 2, "items": 4, "warnings": 2}
    # One that breaks off after its documents can't be seen, and can be done again.
    put = ledger._put
    monkeypatch.setattr(ledger, "_put", lambda f, path, part: put(f, path, part) if not path.endswith("/items") else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ledger.save(imported(spark, "third"), out, "third")
    assert ledger.load(spark, out)["documents"].count() == 2
    monkeypatch.setattr(ledger, "_put", put)
    ledger.save(imported(spark, "third"), out, "third")
    assert ledger.load(spark, out)["documents"].count() == 3 and ledger.load(spark, out)["items"].count() == 6


def test_events_are_kept_once(spark, tmp_path):
    out = str(tmp_path)
    assert ledger.events(spark, out, "matches").count() == 0
    batch = spark.range(3).select(F.col("id").alias("seq"), F.col("id").alias("item_id"), F.lit(1).alias("service_id"))
    for name in ("x", "x", "y"):
        ledger.record(batch, out, "matches", name)
    found = ledger.events(spark, out, "matches")
    assert found.count() == 6 and sorted(found.columns) == sorted(x.split()[0] for x in ledger.EVENTS["matches"].split(", "))
