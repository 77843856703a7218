"""HTML pages to ordered blocks: stripping, candidate scoring, tables and metadata, by a small tree of our own rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPPED = {"script", "style", "noscript", "svg", "button", "form", "iframe", "template"}
FURNITURE = {"nav", "footer", "header", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "header", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *(f"h{k}" for k in range(1, 7))}
HEADINGS = {f"h{k}": k for k in range(1, 7)}
CANDIDATES = {"article", "main", "section", "div", "td", "body"}
MIN_CANDIDATE, KEPT_CANDIDATES, KEPT_SHARE, LONG_FURNITURE = 100, 12, 0.15, 400
MARKER = re.compile(r"第[一二三四五六七八九十百零〇\d]{1,6}[章节条]")
CHAPTER, ARTICLE = re.compile(r"第[一二三四五六七八九十百零〇\d]{1,6}章"), re.compile(r"第[一二三四五六七八九十百零〇\d]{1,6}条")
NAVIGATION = re.compile(r"nav|menu|breadcrumb|sidebar|footer|header|share|toolbar|pagination", re.I)
PAGE_LINK = re.compile(r"^(\d{1,4}|上一页|下一页|首页|尾页|末页|prev(ious)?|next|first|last|[«»<>]+)$", re.I)
SITE_SUFFIX = re.compile(r"\s*[-_|—–]\s*[^-_|—–]{2,30}$")


def candidate_score() -> Column:
    """Score of a candidate from its feature columns; under a hundred characters it is -1 (H3).

    Missing features count 0.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    total = (
        n("length") + 500 * n("n_headings") + 30 * n("n_paragraphs") - 5000 * n("link_density") - 80 * n("short_links") + 2000 * n("chapter_hits") + 3000 * n("article_hits")
        + 4500 * flag("end_hit") + 5500 * flag("start_hit") + 2000 * flag("has_first_article_front") + 2000 * flag("has_first_chapter_front") - 1500 * flag("tail_penalty")
    )
    return F.when(n("length") < MIN_CANDIDATE, F.lit(-1.0)).otherwise(total.cast("double"))


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)

    def text(self) -> str:
        return re.sub(r"\s+", " ", "".join(c if isinstance(c, str) else (" " if c.tag in BLOCKS or c.tag == "br" else "") + c.text() + (" " if c.tag in BLOCKS else "") for c in self.children)).strip()

    def walk(self) -> Iterator["Node"]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def find(self, *tags: str) -> list["Node"]:
        return [x for x in self.walk() if x.tag in tags]


class TreeBuilder(HTMLParser):
    """A tree that any input yields: unknown ends are ignored, open elements end with their parent.

    A new paragraph, list item, row or cell ends an open one of its kind within the same container.
    """

    CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
    FENCES = {"table", "ul", "ol", "div", "section", "article", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        closing = self.CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in closing:
                del self.stack[k:]
                break
            if self.stack[k].tag in self.FENCES:
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID and len(self.stack) < 200:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def is_pagination(node: Node) -> bool:
    """At least two signs of a page list: its name, its link texts, its link targets, or little other text (H2)."""
    links = node.find("a")
    if len(links) < 2:
        return False
    texts = [a.text() for a in links]
    named = bool(re.search(r"pag(e|ination|er)|fenye", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}", re.I))
    numbered = sum(bool(PAGE_LINK.match(t)) for t in texts) >= 0.6 * len(texts)
    targets = sum(bool(re.search(r"(page|p)[=_/-]?\d+|_\d+\.s?html?", a.attrs.get("href", ""), re.I)) for a in links) >= 0.5 * len(links)
    whole = node.text()
    return named + numbered + targets + (len(whole) < 120 and not MARKER.search(whole)) >= 2 and (numbered or targets)


def strip_furniture(node: Node) -> None:
    """Remove scripts, page lists, and navigation that holds neither headings nor much text (H1)."""
    kept = []
    for c in node.children:
        if isinstance(c, str):
            kept.append(c)
            continue
        text = c.text()
        marked = bool(MARKER.search(text))
        name = f"{c.attrs.get('class', '')} {c.attrs.get('id', '')}"
        gone = c.tag in DROPPED or c.tag in FURNITURE and not marked or c.tag in {"div", "ul", "section"} and is_pagination(c)
        gone = gone or c.tag in {"div", "ul", "section"} and NAVIGATION.search(name) and not c.find(*HEADINGS) and len(text) < LONG_FURNITURE and not marked
        if not gone:
            strip_furniture(c)
            kept.append(c)
    node.children = kept


def features(node: Node) -> dict:
    """The features of a candidate container."""
    text = node.text()
    links = [a.text() for a in node.find("a")]
    head, tail = text[:300], text[-300:]
    return {
        "length": len(text), "n_headings": len(node.find(*HEADINGS)), "n_paragraphs": len(node.find("p")), "link_density": sum(map(len, links)) / max(1, len(text)), "short_links": sum(len(t) <= 6 for t in links),
        "chapter_hits": len(CHAPTER.findall(text)), "article_hits": len(ARTICLE.findall(text)), "has_first_chapter_front": "第一章" in head, "has_first_article_front": "第一条" in head,
        "start_hit": bool(re.search("第一[章条]|总则", head)), "end_hit": bool(re.search("施行|附则|生效", tail)), "tail_penalty": bool(re.search("版权所有|备案|主办单位", tail)),
    }


def score(f: dict) -> float:
    if f["length"] < MIN_CANDIDATE:
        return -1.0
    return (
        f["length"] + 500 * f["n_headings"] + 30 * f["n_paragraphs"] - 5000 * f["link_density"] - 80 * f["short_links"] + 2000 * f["chapter_hits"] + 3000 * f["article_hits"] + 4500 * f["end_hit"] + 5500 * f["start_hit"]
        + 2000 * f["has_first_article_front"] + 2000 * f["has_first_chapter_front"] - 1500 * f["tail_penalty"]
    )


def select_content(root: Node) -> Node:
    """The best container; its body where no container is long enough (H4)."""
    scored = [(score(f), f["length"], c) for c in root.find(*CANDIDATES) if (f := features(c))]
    usable = [x for x in scored if x[0] > 0]
    if not usable:
        return (root.find("body") or [root])[0]
    best = max(x[0] for x in usable)
    near = sorted((x for x in usable if x[0] >= best * 0.98), key=lambda x: x[1])
    return near[0][2]


def table_rows(node: Node) -> list[list[str]]:
    """Cells of a table as a grid padded to its widest row; a cell that spans columns stands in the first (H6)."""
    rows = []
    for tr in node.find("tr"):
        row: list[str] = []
        for cell in (c for c in tr.children if isinstance(c, Node) and c.tag in {"td", "th"}):
            span = cell.attrs.get("colspan", "1")
            row += [cell.text()] + [""] * (max(1, min(50, int(span) if span.isdigit() else 1)) - 1)
        if any(row):
            rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def is_layout(node: Node, rows: list[list[str]]) -> bool:
    """A table that arranges the page: no header cells, and nested tables, one column or long cells (H5)."""
    cells = [c for r in rows for c in r]
    lay = 2 * bool([x for x in node.find("table") if x is not node]) + 2 * (max(map(len, rows), default=0) <= 1) + (sum(map(len, cells)) > 200 * max(1, len(cells)))
    data = 3 * bool(node.find("th", "thead", "caption")) + (len(rows) >= 3 and len(rows[0]) >= 2) + (node.attrs.get("border", "0") not in {"", "0"})
    return lay > data


def emit(node: Node) -> Iterator[tuple[str, str, int | None, list[list[str]] | None]]:
    """Blocks in reading order: type, text, heading level, table rows; loose text becomes UNKNOWN and is never lost (H7)."""
    loose = ""
    for c in [*node.children, Node("p")]:
        if isinstance(c, str) or c.tag not in BLOCKS and not any(x.tag in BLOCKS for x in c.walk()):
            loose += c if isinstance(c, str) else ("\n" if c.tag == "br" else c.text())
            continue
        if loose.strip():
            yield "UNKNOWN" if node.tag != "p" else "PARAGRAPH", re.sub(r"[ \t\r\n]+", " ", loose).strip(), None, None
        loose = ""
        text = c.text()
        if c.tag in HEADINGS:
            if text:
                yield "HEADING", text, HEADINGS[c.tag], None
        elif c.tag == "table":
            rows = table_rows(c)
            if is_layout(c, rows):
                yield from emit(c)
            elif rows:
                yield "TABLE", "\n".join(" | ".join(r) for r in rows), None, rows
        elif c.tag == "li":
            nested = [x for x in c.children if isinstance(x, Node) and x.tag in {"ul", "ol"}]
            own = Node("li", {}, [x for x in c.children if x not in nested]).text()
            if own:
                yield "LIST_ITEM", own, None, None
            for x in nested:
                yield from emit(x)
        elif c.tag == "p" and not any(x.tag in BLOCKS for x in c.walk() if x is not c):
            if text:
                yield "PARAGRAPH", text, None, None
        else:
            yield from emit(c)


def blocks(html: str) -> tuple[dict, list[tuple]]:
    """Metadata and blocks of a page; the title is put in front where the first three blocks lack it (H8)."""
    root = parse(html)
    meta: dict[str, str] = {}
    for m in root.find("meta"):
        name, value = m.attrs.get("name", "").strip().lower(), m.attrs.get("content", "").strip()
        key = {"pubdate": "publish_date", "publishdate": "publish_date", "contentsource": "source_org", "author": "source_org"}.get(name)
        if key and len(value) > len(meta.get(key, "")):
            meta[key] = value
    if "publish_date" not in meta and (times := root.find("time")):
        meta["publish_date"] = times[0].attrs.get("datetime") or times[0].text()
    titles = root.find("title")
    title = titles[0].text() if titles else ""
    cut = SITE_SUFFIX.sub("", title)
    meta["title"] = cut if 4 <= len(cut) <= 160 else title
    strip_furniture(root)
    out = list(emit(select_content(root)))
    if meta["title"] and not any(meta["title"] in t for _, t, _, _ in out[:3]):
        out.insert(0, ("HEADING", meta["title"], 1, None))
    return meta, out


def html_blocks(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """One row a block of each page: order, type, text, level; null pages have none."""
    kind = dict(pages.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, text in zip(batch.column(0), batch.column(1).to_pylist()):
                got = blocks(text)[1]
                ids += [i] * len(got)
                rows += [(k, t, x, level) for k, (t, x, level, _) in enumerate(got)]
            cols = [pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *cols], [id_column, "order", "type", "text", "level"])

    return pages.filter(F.col(html).isNotNull()).select(id_column, html).mapInArrow(run, f"{id_column} {kind}, order int, type string, text string, level int")
