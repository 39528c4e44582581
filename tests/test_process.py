from __future__ import annotations

import json

from fenwright.operators import evidence, extraction
from fenwright.plans import process


def test_files_to_reports(spark, tmp_path):
    from test_operators import CARDS

    html = "".join(f"<p>{x}</p>" for x in CARDS.split("\n"))
    (tmp_path / "Fw_ Acme - 14_07_2026.html").write_text(html)
    (tmp_path / "Acme - sheet.csv").write_text("Building,Floor,Size,Rent\nGamma House EC1A 1BB,4th,400,£90\n,,,\n")
    (tmp_path / "note.html").write_text("<p>Free text about Omega</p>")
    (tmp_path / "bad.pdf").write_bytes(b"x")
    model = lambda prompt: json.dumps([{"building": "Omega", "floor_unit": "1st", "size": "500"}]) if "Omega" in prompt else "[]"
    geo = spark.createDataFrame([], "query string, address string, lat double, lng double, postcode string")
    found = spark.createDataFrame([], "name string, address string, sources int")
    r = process.process_files(spark, str(tmp_path), model=model, geocoded=geo, searched=found, today="2026-07-20")
    rows = sorted((x["source_file"], x["building"], x["floor_unit"], x["external_ref"], x["parser"]) for x in r.listings.collect())
    assert rows == [
        ("Acme - sheet.csv", "Gamma House EC1A 1BB", "4th", "Acme_2026-07-20", "availability sheet"),
        ("Fw_ Acme - 14_07_2026.html", "Alpha House, 8 Mill Street W1A 2BB", "1st floor", "Acme_2026-07-14", "button cards"),
        ("Fw_ Acme - 14_07_2026.html", "Alpha House, 8 Mill Street W1A 2BB", "2nd floor", "Acme_2026-07-14", "button cards"),
        ("note.html", "Omega", "1st", "note_2026-07-20", "model"),
    ]
    rep = {x["filename"]: x for x in r.reports.collect()}
    assert rep["bad.pdf"]["status"] == "error" and rep["Fw_ Acme - 14_07_2026.html"]["record_count"] == 2
    assert len({x["output_name"] for x in rep.values()}) == 4 and rep["note.html"]["review_required"]


def test_chunks_fail_alone(spark):
    rows = spark.createDataFrame([("d", 0, i, [f"row {i}"]) for i in range(70)], "doc_id string, table_idx int, row_idx int, cells array<string>")

    def model(prompt):
        if "Row 30:" in prompt:
            raise TimeoutError("slow")
        return "```json\n" + json.dumps([{"building": x.split(": ")[1]} for x in prompt.split("\n")]) + "\n```"

    a = extraction.ask(extraction.chunks(rows), model)
    d = extraction.diagnostics(a).first()
    assert d["failed"] and d["ok"] >= 2
    names = [x["building"] for x in extraction.extracted(a).orderBy("ordinal").collect()]
    assert len(names) == len(set(names)) and "row 0" in names and "row 69" in names


def test_long_answers_are_whole_or_fail(spark):
    rows = spark.createDataFrame([(d, 0, i, [f"{d} {i}"]) for d, n in (("small", 30), ("large", 70)) for i in range(n)], "doc_id string, table_idx int, row_idx int, cells array<string>")

    def model(prompt):
        names = [x.split(": ")[1] for x in prompt.split("\n")]
        return json.dumps([{"building": x + y} for x in names for y in ("", "b")[: 2 if "Row 30:" in prompt else 1]])

    a = extraction.ask(extraction.chunks(rows), model).cache()
    d = {x["doc_id"]: x for x in extraction.diagnostics(a).collect()}
    assert d["small"]["ok"] == 1 and not d["small"]["failed"] and d["large"]["failed"] == [1] and d["large"]["ok"] == 2
    errors = [x["error"] for x in a.collect() if x["error"]]
    assert errors == ["Chunk 1 returned 50 records, above the safe 25-record limit"]
    names = {x["building"] for x in extraction.extracted(a).collect()}
    assert {f"small {i}" for i in range(30)} <= names and "large 69" in names and "large 30b" not in names


def test_long_answers_are_asked_for_in_chunks(spark):
    rows = spark.createDataFrame([(d, 0, i, [f"{d} {i}", "x" * 900]) for d, n in (("dense", 20), ("bad", 3), ("down", 20)) for i in range(n)], "doc_id string, table_idx int, row_idx int, cells array<string>")
    calls = []

    def model(prompt):
        calls.append(prompt)
        names = [x.split(": ")[1].split(" |")[0] for x in prompt.split("\n")]
        if "bad 0" in prompt and len(names) > 1:
            return "[{"
        if "down" in prompt:
            raise TimeoutError("slow")
        if len(names) > 12:
            raise ValueError("Response was truncated")
        return "Here it is: " + json.dumps([{"building": x} for x in names]) + " [done]"

    a = extraction.ask(extraction.chunks(rows), model).cache()
    d = {x["doc_id"]: (x["ok"], x["failed"]) for x in extraction.diagnostics(a).collect()}
    assert d == {"dense": (3, []), "bad": (0, [0]), "down": (0, [0])}
    names = [x["building"] for x in extraction.extracted(a).collect()]
    assert sorted(names) == sorted(f"dense {i}" for i in range(20))
    parts = extraction.split_rows([f"r{i}" for i in range(60)])
    assert [len(p) for p in parts] == [25, 25, 14] and parts[0][-2:] == parts[1][:2]
    assert [len(p) for p in extraction.split_rows(["x" * 20_000, "y"])] == [1, 1]


def test_evidence(spark):
    page = b"<main><p>Alpha House, 1 High St EC1A 1BB</p><p>First floor</p><p>1,500 sq ft</p><p>Minimum term: 24 months</p><img src='/a/floorplan.png'><a href='/b.pdf'>Brochure</a></main>"
    res = spark.createDataFrame([("https://x.y/p?utm_source=1", "text/html", bytearray(page)), ("https://x.y/z", "", bytearray(b"%PDF-1"))], "url string, content_type string, payload binary")
    t = evidence.typed(res)
    assert {r["key"]: r["resource_type"] for r in t.collect()} == {"https://x.y/p": "html", "https://x.y/z": "pdf"}
    assert [r["document"] for r in evidence.nested_documents(t.filter("page is not null")).collect()] == ["https://x.y/b.pdf"]
    assert [(r["class"], r["url"]) for r in evidence.candidates(t.filter("page is not null")).collect()] == [("floorplan", "https://x.y/a/floorplan.png")]
    cols = "doc_id string, ordinal int, building string, property_address_1 string, property_postcode string, floor_unit string, brochure_url string"
    d = spark.createDataFrame([("d", 0, "Alpha House", "1 High St", "", "1st", "https://x.y/p"), ("d", 1, "Alpha House", "", "", "2nd", "https://x.y/p"), ("d", 2, "Zeta", "", "", "1st", "https://x.y/p"), ("d", 3, "Alpha House", "", "W1A 1AA", "1st", "https://x.y/p")], cols)
    got = {}
    for r in evidence.for_listings(d, t).collect():
        got.setdefault(r["ordinal"], {})[r["field"]] = r["value"]
    assert got[0]["size_sqft"] == "1500" and got[0]["min_term"] == "24 months" and got[0]["property_postcode"] == "EC1A 1BB"
    assert "size_sqft" not in got[1] and got[1]["min_term"] == "24 months" and 2 not in got and 3 not in got
