"""Pages and feeds to structs: one pass of the standard parser a page, in Arrow batches."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


LINK = _struct(url=_S, text=_S, is_external=_B, rel=_S)
IMAGE = _struct(src=_S, alt=_S, title=_S, width=_I, height=_I, caption=_S)
HEADING = _struct(level=_I, text=_S)
TABLE = _struct(caption=_S, headers=T.ArrayType(_S), rows=T.ArrayType(T.ArrayType(_S)))
CITATION = _struct(id=_S, kind=_S, text=_S, url=_S, author=_S, language=_S, position=_I)
PAGE = _struct(
    title=_S, language=_S, description=_S, author=_S, published=_S, canonical=_S, site_name=_S, keywords=T.ArrayType(_S), main_text=_S, markdown=_S, og=T.MapType(_S, _S), twitter=T.MapType(_S, _S),
    dublin_core=T.MapType(_S, _S), json_ld=T.ArrayType(_S), feeds=T.ArrayType(_S), links=T.ArrayType(LINK), images=T.ArrayType(IMAGE), headings=T.ArrayType(HEADING), tables=T.ArrayType(TABLE), citations=T.ArrayType(CITATION),
)

_VOID = frozenset("br hr img input meta link source area base col embed track wbr".split())
_OUT = frozenset("nav header footer aside script style noscript template".split())
_BLOCKS = frozenset("p div section article h1 h2 h3 h4 h5 h6 li tr blockquote pre table ul ol figure main br".split())


class _Reader(HTMLParser):
    """Collects what a page holds; unclosed elements end with their parents."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.stack = base, []
        self.meta: list[dict[str, str]] = []
        self.titles, self.ld, self.links, self.images, self.headings, self.tables, self.quotes, self.codes, self.figures = [], [], [], [], [], [], [], [], []
        self.lang = self.canonical = ""
        self.feeds: list[str] = []
        self.areas: dict[str, list[str]] = {"article": [], "body": []}
        self.open: list[tuple[str, dict, list[str]]] = []  # elements whose text is wanted
        self.table: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            self.meta.append(a)
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if rel == "canonical":
                self.canonical = urljoin(self.base, a.get("href", ""))
            elif "alternate" in rel and re.search(r"rss|atom", a.get("type", "")):
                self.feeds.append(urljoin(self.base, a.get("href", "")))
        elif tag == "img":
            size = lambda k: int(a[k]) if a.get(k, "").isdigit() else None
            image = {"src": urljoin(self.base, a.get("src", "")), "alt": a.get("alt") or None, "title": a.get("title") or None, "width": size("width"), "height": size("height"), "caption": None}
            self.images.append(image)
            for name, data, _ in self.open:
                if name == "figure":
                    data["image"] = image
        elif tag == "table":
            self.table = {"caption": None, "headers": [], "rows": [], "row": None, "head": False}
            self.tables.append(self.table)
        elif tag == "thead" and self.table:
            self.table["head"] = True
        elif tag == "tr" and self.table is not None:
            self.table["row"] = []
            self.table["rows"].append((self.table["head"], self.table["row"]))
        if tag in _BLOCKS:
            for v in self.areas.values():
                v.append("\n")
        if tag in ("title", "h1", "h2", "h3", "h4", "h5", "h6", "a", "blockquote", "figcaption", "figure", "code", "script", "caption", "td", "th", "footer", "cite"):
            self.open.append((tag, a | {"in": [t for t, _, _ in self.open]}, []))
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass
        if tag == "thead" and self.table:
            self.table["head"] = False
        if tag == "table":
            self.table = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                name, data, parts = self.open.pop(k)
                self._finish(name, data, " ".join("".join(parts).split()), "".join(parts))
                break
        if tag in _BLOCKS:
            for v in self.areas.values():
                v.append("\n")

    def _finish(self, tag: str, a: dict, text: str, raw: str) -> None:
        if tag == "title":
            self.titles.append(text)
        elif tag[0] == "h" and tag[1:].isdigit():
            self.headings.append({"level": int(tag[1]), "text": text})
        elif tag == "a":
            href = a.get("href", "")
            if href and not href.startswith("#"):
                url = urljoin(self.base, href)
                self.links.append({"url": url, "text": text, "is_external": urlsplit(url).netloc != urlsplit(self.base).netloc, "rel": (a.get("rel") or "").split(" ")[0] or None, "in": a["in"], "class": a.get("class", "")})
        elif tag == "blockquote":
            self.quotes.append({"text": text, "url": a.get("cite") or None, "author": a.get("author")})
        elif tag in ("footer", "cite"):
            for name, data, _ in self.open:
                if name == "blockquote":
                    data["author"] = text
        elif tag == "figcaption":
            for name, data, _ in self.open:
                if name == "figure":
                    data["caption"] = text
                    if data.get("image"):
                        data["image"]["caption"] = text
        elif tag == "figure":
            self.figures.append({"alt": (a.get("image") or {}).get("alt") or "", "caption": a.get("caption") or "", "url": (a.get("image") or {}).get("src")})
        elif tag == "code":
            m = re.search(r"language-([\w+#-]+)", a.get("class", ""))
            self.codes.append({"text": raw.strip(), "language": m[1] if m else None})
        elif tag == "script" and a.get("type") == "application/ld+json":
            self.ld.append(raw)
        elif tag == "caption" and self.table is not None:
            self.table["caption"] = text
        elif tag in ("td", "th") and self.table is not None and self.table["row"] is not None:
            self.table["row"].append(text)

    def handle_data(self, data: str) -> None:
        for _, _, parts in self.open:
            parts.append(data)
        if "head" in self.stack or _OUT.intersection(self.stack):
            return
        self.areas["body"].append(data)
        if "article" in self.stack or "main" in self.stack:
            self.areas["article"].append(data)


def _tidy(parts: list[str]) -> str:
    return "\n".join(line for line in (" ".join(x.split()) for x in "".join(parts).split("\n")) if line)


_INLINE = re.compile(r"\[(\d+)\]|\(([A-Z][\w'-]+(?: et al\.?)?),? (\d{4}[a-z]?)\)")


def citation_id(text: str, position: int) -> str:
    from hashlib import md5

    return md5(f"{text[:100]}{position}".encode()).hexdigest()[:16]


def read_page(html: str | None, url: str | None) -> dict | None:
    """A page as a struct of PAGE; null for null. Broken markup and JSON never raise."""
    if html is None:
        return None
    r = _Reader(url or "")
    r.feed(html)
    r.close()
    for tag, a, parts in reversed(r.open):
        r._finish(tag, a, " ".join("".join(parts).split()), "".join(parts))
    low = {}
    for m in r.meta:
        key = (m.get("property") or m.get("name") or "").lower()
        if key and key not in low:
            low[key] = m.get("content", "")
    og = {k[3:] if k.startswith("og:") else k: v for k, v in low.items() if k.startswith(("og:", "article:"))}
    twitter = {k[8:]: v for k, v in low.items() if k.startswith("twitter:")}
    dc = {k[3:]: v for k, v in low.items() if k.startswith(("dc.", "dc:"))}
    objects = []
    for raw in r.ld:
        try:
            found = json.loads(raw)
        except ValueError:
            continue
        objects += found if isinstance(found, list) else [found]
    first = lambda *xs: next((x for x in xs if x), None)
    date = next((o.get("datePublished") for o in objects if isinstance(o, dict) and o.get("datePublished")), None)
    main = _tidy(r.areas["article"]) or _tidy(r.areas["body"])
    title = first(og.get("title"), twitter.get("title"), r.titles[0] if r.titles else None, next((h["text"] for h in r.headings if h["level"] == 1), None))
    tables = []
    for t in r.tables:
        heads, body = [x for h, x in t["rows"] if h], [x for h, x in t["rows"] if not h]
        headers = heads[0] if heads else (body[0] if body else [])
        tables.append({"caption": t["caption"], "headers": headers, "rows": body if heads else body[1:]})
    cites = [{"kind": "quote", "text": q["text"], "url": q["url"], "author": q["author"]} for q in r.quotes]
    cites += [{"kind": "figure", "text": f"{f['alt']}\n{f['caption']}", "url": f["url"]} for f in r.figures]
    cites += [
        {"kind": "link", "text": x["text"], "url": x["url"]} for x in r.links
        if len(x["text"]) >= 5 and (set(x["in"]) & {"blockquote", "cite", "q"} or re.search(r"cite|reference|source", x["class"]) or re.search(r"\[\d+\]|\(\d{4}\)", x["text"]))
    ]
    cites += [{"kind": "code", "text": c["text"], "language": c["language"]} for c in r.codes if len(c["text"]) >= 10]
    for i, c in enumerate(cites):
        c["position"] = i
    cites += [{"kind": "reference", "text": m[0], "position": m.start()} for m in _INLINE.finditer(main)]
    for c in cites:
        c["id"] = citation_id(c["text"], c["position"])
    heading = {1: "# ", 2: "## ", 3: "### ", 4: "#### ", 5: "##### ", 6: "###### "}
    marks = {h["text"]: heading[h["level"]] for h in r.headings}
    return {
        "title": title, "language": first(og.get("locale"), r.lang, low.get("language")), "description": first(og.get("description"), twitter.get("description"), low.get("description")),
        "author": first(og.get("article:author"), dc.get("creator"), low.get("author")), "published": first(og.get("article:published_time"), date, low.get("date")), "canonical": r.canonical or None,
        "site_name": og.get("site_name"), "keywords": [k for k in (x.strip() for x in low.get("keywords", "").split(",")) if k], "main_text": main,
        "markdown": "\n\n".join(marks.get(x, "") + x for x in main.split("\n") if x), "og": og, "twitter": twitter, "dublin_core": dc, "json_ld": [json.dumps(o, sort_keys=True, ensure_ascii=False) for o in objects],
        "feeds": r.feeds, "links": [{k: x[k] for k in ("url", "text", "is_external", "rel")} for x in r.links], "images": r.images, "headings": r.headings, "tables": tables,
        "citations": [{k: c.get(k) for k in ("id", "kind", "text", "url", "author", "language", "position")} for c in cites],
    }


@F.pandas_udf(PAGE)
def parse_page(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = [f.name for f in PAGE.fields]
    for html, url in batches:
        rows = [read_page(h, u) or dict.fromkeys(names) for h, u in zip(html, url)]
        yield pd.DataFrame(rows, columns=names)


EPISODE = _struct(show=_S, title=_S, link=_S, guid=_S, published=_S, seconds=_I, audio=_S, audio_type=_S, explicit=_B, notes=_S, categories=T.ArrayType(_S), image=_S)
_NS = {"itunes": "http://www.itunes.com/dtds/podcast-1.0.dtd", "content": "http://purl.org/rss/1.0/modules/content/"}


def duration_seconds(text: str | None) -> int | None:
    """[(h:)]m:s or a number of seconds; null otherwise."""
    if not text:
        return None
    m = re.match(r"^(?:(\d+):)?(\d+):(\d+)", text.strip())
    if m:
        return int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3])
    return int(text) if text.strip().isdigit() else None


def read_feed(xml: str | None) -> list[dict]:
    """Episodes of a feed; items without a title are dropped, broken xml has none."""
    try:
        channel = ET.fromstring(xml or "").find("channel")
    except ET.ParseError:
        return []
    if channel is None:
        return []
    out = []
    for item in channel.findall("item"):
        title = (item.findtext("title") or "").strip()
        if not title:
            continue
        enclosure = item.find("enclosure")
        image = item.find("itunes:image", _NS)
        out.append({
            "show": channel.findtext("title"), "title": title, "link": item.findtext("link"), "guid": item.findtext("guid"), "published": item.findtext("pubDate"), "seconds": duration_seconds(item.findtext("itunes:duration", None, _NS)),
            "audio": enclosure.get("url") if enclosure is not None else None, "audio_type": enclosure.get("type") if enclosure is not None else None,
            "explicit": (item.findtext("itunes:explicit", "", _NS) or "").strip().lower() in ("yes", "true", "explicit"), "notes": item.findtext("content:encoded", None, _NS) or item.findtext("description"),
            "categories": [c.text for c in item.findall("category") if c.text], "image": image.get("href") if image is not None else None,
        })
    return out


@F.pandas_udf(T.ArrayType(EPISODE))
def parse_feed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for xml in batches:
        yield xml.map(read_feed)
