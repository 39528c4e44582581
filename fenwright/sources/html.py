"""HTML to text lines, links, an ordered item stream and tables, by the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

HIDDEN = {"script", "style", "noscript", "template", "head"}
IMAGE_ATTRS = ("src", "data-src", "data-lazy-src", "data-original", "background")
MAIN = {"main", "article", "section", "figure"}


def squeeze(s: str) -> str:
    return " ".join(s.split())


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.links: list[dict] = []
        self.items: list[dict] = []
        self.images: list[dict] = []
        self.tables: list[list[list[str]]] = []
        self._hidden = 0
        self._main = 0
        self._anchor: tuple[str, list[str]] | None = None
        self._open: list[list[list[str]]] = []
        self._cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in HIDDEN and tag != "head":
            self._hidden += 1
        if tag in MAIN:
            self._main += 1
        if tag == "a" and a.get("href"):
            self._close_anchor()
            self._anchor = (a["href"].strip(), [])
        elif tag in ("img", "source"):
            found = [a[k].strip() for k in IMAGE_ATTRS if a.get(k, "").strip()]
            found += [p.split()[0] for p in a.get("srcset", "").split(",") if p.strip()]
            for url in dict.fromkeys(found):
                self.images.append({"url": url, "alt": squeeze(a.get("alt", "")), "association": 0.85 if self._main else 0.55})
            if tag == "img" and found:
                self.items.append({"kind": "image", "text": squeeze(a.get("alt", "")), "url": found[0]})
        elif tag == "meta" and (a.get("property") or a.get("name")) in ("og:image", "twitter:image") and a.get("content"):
            self.images.append({"url": a["content"].strip(), "alt": "", "association": 0.55})
        elif tag == "table":
            self._open.append([])
        elif tag == "tr" and self._open:
            self._open[-1].append([])
        elif tag in ("td", "th") and self._open:
            if not self._open[-1]:
                self._open[-1].append([])
            self._flush_cell()
            self._cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and tag != "head" and self._hidden:
            self._hidden -= 1
        if tag in MAIN and self._main:
            self._main -= 1
        if tag == "a":
            self._close_anchor()
        elif tag in ("td", "th"):
            self._flush_cell()
        elif tag == "table" and self._open:
            self._flush_cell()
            rows = [r for r in self._open.pop() if r]
            if rows:
                self.tables.append(rows)

    def _flush_cell(self) -> None:
        if self._cell is not None and self._open and self._open[-1]:
            self._open[-1][-1].append(squeeze(" ".join(self._cell)))
        self._cell = None

    def _close_anchor(self) -> None:
        if self._anchor:
            url, parts = self._anchor
            text = squeeze(" ".join(parts))
            self.links.append({"text": text, "url": url})
            self.items.append({"kind": "link", "text": text, "url": url})
            self._anchor = None

    def handle_data(self, data: str) -> None:
        t = squeeze(data)
        if not t or self._hidden:
            return
        self.lines.append(t)
        if self._anchor:
            self._anchor[1].append(t)
        if self._cell is not None:
            self._cell.append(t)


def parse_html(html: str) -> dict:
    """text, links, html_items, tables, images"""
    p = _Page()
    p.feed(html or "")
    p.close()
    p._close_anchor()
    return {"text": "\n".join(p.lines), "links": p.links, "html_items": p.items, "tables": p.tables, "images": p.images}


#: Attributes that may hold the address of a floor plan, in the order in which they are looked at, and elements without an end (fixed values).
PLAN_ATTRS = ("data-modal-path", "data-modal-url", "data-floorplan-url", "data-floor-plan-url", "data-plan-url", "data-plan-src", "data-href", "data-url", "data-src", "href")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PLAN_WORDS = re.compile(r"floor[\s_-]*plan|floorplan", re.I)
IMAGE_ENDS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".jpx")


class _Elements(HTMLParser):
    """Elements with one of the attributes, with the text within them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[dict, list[str]]] = []
        self._open: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a, texts = {k: v or "" for k, v in attrs}, []
        if any(a.get(k, "").strip() for k in PLAN_ATTRS):
            self.found.append((a, texts))
        if tag not in VOID:
            self._open.append((tag, texts))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self._open):
            while self._open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if t := squeeze(data):
            for _, texts in self._open:
                texts.append(t)


def plan_links(html: str, base: str) -> list[dict]:
    """(url, label, kind) of what a page says is a floor plan: pages about one that are still to be followed, images and PDFs. The signal is in the
    address, or in the element's class, id, target or text. Each address once."""
    p = _Elements()
    p.feed(html or "")
    p.close()
    out: dict[str, dict] = {}
    for attr in PLAN_ATTRS:
        for a, texts in p.found:
            raw = a.get(attr, "").strip()
            label = " ".join(texts)
            if not raw or raw.startswith("#") or raw.lower().startswith("javascript:") or not PLAN_WORDS.search(" ".join([raw, a.get("class", ""), a.get("id", ""), a.get("data-modal-target", ""), label])):
                continue
            url = urljoin(base, raw)
            parts = urlsplit(url)
            path = parts.path.lower()
            kind = "image" if path.endswith(IMAGE_ENDS) else "pdf" if path.endswith(".pdf") else "page" if PLAN_WORDS.search(f"{path} {parts.query}") else ""
            if kind:
                out.setdefault(urldefrag(url).url, {"url": url, "label": label or "Floor plan", "kind": kind})
    return list(out.values())
