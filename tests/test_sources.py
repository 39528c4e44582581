from __future__ import annotations

import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from fenwright.sources import files, images, office, sinks
from fenwright.streaming import lookups

EML = b"From: Ann <a@b.co>\r\nSubject: Hi\r\nDate: Mon, 13 Jul 2026 09:00:00 +0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nplain\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Hello <b>you</b></p><a href='https://x.y/b'>View  brochure</a><img src='https://x.y/i.png' alt='Photo'><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><script>no()</script>\r\n--B--\r\n"


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.eml").write_bytes(EML)
    (tmp_path / "b.csv").write_bytes("name,größe\n,\nx,1\n".encode("latin-1"))
    (tmp_path / "c.html").write_text("<div>One<br>Two</div>")
    docx(tmp_path / "d.docx")
    (tmp_path / "e.xlsx").write_bytes(office.write_xlsx([("Sheet", ["Name", "Link"], [["Alpha", "https://x.y/z"], ["Beta", None]])], frozenset({"Link"})))
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.docx").write_bytes(b"broken")
    return tmp_path


def test_read_documents(spark, folder):
    d = {r["filename"]: r for r in files.read_documents(spark, str(folder)).collect()}
    assert len(d) == 7
    assert d["a.eml"]["text"].split("\n")[:2] == ["Hello", "you"] and d["a.eml"]["sender"].startswith("Ann") and "no()" not in d["a.eml"]["text"]
    assert [(i["kind"], i["text"]) for i in d["a.eml"]["html_items"]] == [("link", "View brochure"), ("image", "Photo")]
    assert d["a.eml"]["tables"] == [[["A", "B"], ["1", "2"]]]
    assert d["b.csv"]["tables"] == [[["name", "größe"], ["x", "1"]]]
    assert d["c.html"]["text"] == "One\nTwo"
    assert d["d.docx"]["text"] == "Title\nc1 | c2"
    assert d["e.xlsx"]["tables"][0][1][0] == "Alpha" and d["e.xlsx"]["row_links"][0]["links"][0]["url"] == "https://x.y/z" and d["e.xlsx"]["row_links"][0]["row_number"] == 2
    assert d["f.pdf"]["status"] == "error" and d["g.docx"]["status"] == "error"
    rows = files.table_rows(files.read_documents(spark, str(folder)).filter("filename = 'a.eml'")).collect()
    assert [(r["row_idx"], r["cells"]) for r in rows] == [(0, ["A", "B"]), (1, ["1", "2"])]


def test_pages(spark):
    p = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a"), ("d", 2, None)], "doc_id string, page_no int, text string")
    r = files.documents_from_pages(p).first()
    assert r["pages_text"] == ["a", "b", ""] and r["text"] == "a\nb"


def png(path, w, h, colour):
    raw = b"".join(b"\0" + bytes(v for x in range(w) for v in colour(x, y)) for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "plan.png", 400, 300, lambda x, y: (0, 0, 0) if x % 40 == 0 else (255, 255, 255))
    png(tmp_path / "photo.png", 400, 300, lambda x, y: (x % 256, y % 256, (x * y) % 256))
    png(tmp_path / "blank.png", 400, 300, lambda x, y: (9, 9, 9))
    png(tmp_path / "small.png", 50, 50, lambda x, y: (x, y, 0))
    got = {r["url"].rsplit("/", 1)[1]: r["verdict"] for r in images.read_images(spark, str(tmp_path)).collect()}
    assert got == {"plan.png": "floorplan", "photo.png": "ok", "blank.png": "blank", "small.png": "small"}


def test_workbook_round_trip(spark):
    from test_operators import listing

    from fenwright.operators import listings, validation

    d = listings.normalize(listing(spark)).withColumns({"source_file": F.lit("a"), "source_url": F.lit(""), "source_url_expected": F.lit(False), "brochure_url": F.lit("https://a.b/x.pdf")})
    d = validation.with_issues(d, validation.listing_rules())
    none = spark.createDataFrame([], "doc_id string, building string, status string, resource_type string, detail string, original_url string")
    book = sinks.workbooks(d, sinks.qa_rows(d, none)).first()
    back = office.read_xlsx(book["content"])
    assert back["sheet_names"] == ["Listings", "QA Review"] and back["tables"][0][0] == [n for n, _ in listings.COLUMNS]
    assert back["tables"][0][1][11] in ("1200.0", "1200") and back["row_links"][0]["links"][0]["url"] == "https://a.b/x.pdf"
    assert back["tables"][1][1][3] == "No issues found"
    html = spark.range(1).select(sinks.gallery_html(F.lit("A & B"), F.array(F.lit("https://x/1"), F.lit("https://x/2")))).first()[0]
    assert "A &amp; B" in html and html.count("<img") == 2


def test_answer_states(spark, tmp_path):
    log = [("a", False), ("a", False), ("a", True), ("b", False), ("b", False), ("b", False), ("b", True), ("c", False)]
    d = spark.createDataFrame([(k, f, i) for i, (k, f) in enumerate(log)], "key string, found boolean, i int")
    want = {"a": ("found", 2), "b": ("final", 3), "c": ("flaky", 1)}
    assert {r["key"]: (r["status"], r["misses"]) for r in lookups.answer_states_batch(d, "key", ["i"]).collect()} == want
    d.coalesce(1).orderBy("i").select("key", "found").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, found boolean").parquet(str(tmp_path / "in"))
    q = lookups.answer_states(stream, "key").writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["key"]: (r["status"], r["misses"]) for r in spark.table("states").collect()} == want
