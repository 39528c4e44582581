"""Word and Excel files (Office Open XML) by the standard zip and XML modules: reading, and writing of workbooks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_DC = "{http://purl.org/dc/terms/}"


def _date(z: zipfile.ZipFile) -> str:
    if "docProps/core.xml" not in z.namelist():
        return ""
    root = ET.fromstring(z.read("docProps/core.xml"))
    found = root.findtext(f"{_DC}modified") or root.findtext(f"{_DC}created") or ""
    return found[:10]


def read_docx(data: bytes) -> dict:
    """text (paragraphs, then table rows), tables, file_date"""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
        paragraphs = [text(p).strip() for p in body.findall(f"{_W}p")]
        tables = [[[text(c).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
        lines = [p for p in paragraphs if p] + [" | ".join(r) for t in tables for r in t]
        return {"text": "\n".join(lines), "tables": tables, "file_date": _date(z)}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    path = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if path not in z.namelist():
        return {}
    return {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read(path)).iter(f"{_P}Relationship")}


def read_xlsx(data: bytes) -> dict:
    """text, tables (one per sheet), sheet_names, row_links, file_date"""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        book = ET.fromstring(z.read("xl/workbook.xml"))
        targets = _rels(z, "xl/workbook.xml")
        names, tables, links, lines = [], [], [], []
        for sheet in book.iter(f"{_S}sheet"):
            target = targets.get(sheet.get(f"{_R}id"), "")
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            root, rels, rows, at = ET.fromstring(z.read(part)), _rels(z, part), [], {}
            for row in root.iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.findall(f"{_S}c"):
                    k = _column(c.get("r", "")) if c.get("r") else len(cells)
                    v, kind = c.findtext(f"{_S}v"), c.get("t")
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else shared[int(v)] if kind == "s" and v else v or ""
                    cells += [""] * (k - len(cells)) + [value]
                at[int(row.get("r", len(rows) + 1))] = cells
                rows.append(cells)
            by_row: dict[int, list[dict]] = {}
            for h in root.iter(f"{_S}hyperlink"):
                url = rels.get(h.get(f"{_R}id"), "")
                n, k = int(re.sub("[^0-9]", "", h.get("ref", "A0").split(":")[0])), _column(h.get("ref", ""))
                if url:
                    cells = at.get(n, [])
                    by_row.setdefault(n, []).append({"text": cells[k] if k < len(cells) else "", "url": url})
            names.append(sheet.get("name"))
            tables.append(rows)
            lines += [" ".join(c for c in r if c) for r in rows]
            links += [{"sheet_name": names[-1], "row_number": n, "row_text": " ".join(c for c in at.get(n, []) if c), "links": v} for n, v in sorted(by_row.items())]
        if not any(len(t) > 1 for t in tables):
            raise ValueError("no rows below a header")
        return {"text": "\n".join(x for x in lines if x), "tables": tables, "sheet_names": names, "row_links": links, "file_date": _date(z)}


def _ref(row: int, col: int) -> str:
    s, n = "", col + 1
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return f"{s}{row}"


def write_xlsx(sheets: list[tuple[str, list[str], list[list]]], link_columns: frozenset[str] = frozenset()) -> bytes:
    """A workbook of (name, header, rows). Numbers stay numbers, header rows are frozen, addresses in link columns become links with a short
    label, columns are as wide as their longest line (10 to 45)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_P[1:-1]}"><Relationship Id="rId1" Type="{_R[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>' + "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="rId{i}"/>' for i, (n, _, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_P[1:-1]}">' + "".join(f'<Relationship Id="rId{i}" Type="{_R[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, header, rows) in enumerate(sheets, 1):
            links: list[tuple[str, str]] = []
            body = []
            for r, row in enumerate([header, *rows], 1):
                cells = []
                for c, v in enumerate(row):
                    if v is None or v == "":
                        continue
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{_ref(r, c)}"><v>{v}</v></c>')
                        continue
                    label = str(v)
                    if r > 1 and header[c] in link_columns and re.match("https?://", label):
                        links.append((_ref(r, c), label))
                        label = "Open link"
                    cells.append(f'<c r="{_ref(r, c)}" t="inlineStr"><is><t xml:space="preserve">{escape(label)}</t></is></c>')
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
            width = [min(45, max(10, 2 + max((len(x) for row in [header, *rows] for x in str("" if row[c] is None else row[c]).split("\n")), default=0))) for c in range(len(header))]
            cols = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w}" customWidth="1"/>' for c, w in enumerate(width))
            marks = "".join(f'<hyperlink ref="{ref}" r:id="rId{k}"/>' for k, (ref, _) in enumerate(links, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData>{"".join(body)}</sheetData>' + (f"<hyperlinks>{marks}</hyperlinks>" if links else "") + "</worksheet>")
            if links:
                z.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_P[1:-1]}">' + "".join(f'<Relationship Id="rId{k}" Type="{_R[1:-1]}/hyperlink" Target={quoteattr(u)} TargetMode="External"/>' for k, (_, u) in enumerate(links, 1)) + "</Relationships>")
    return out.getvalue()
