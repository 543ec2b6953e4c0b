"""Element source: captured HTML to one row per element, in document order.

A small tree builder in mapInArrow stands in for a browser: void elements, raw text, implied end tags, and open formatting
elements that carry on into the next block, as HTML5 has them. What needs a renderer (boxes, position, z-index) is null;
an element counts as visible unless it or an ancestor is hidden by attribute, by type or by inline style.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# What must be equal for equal results.
SKIPPED = frozenset(("script", "style", "noscript", "template", "meta", "link", "head", "title", "base"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
FORMATTING = frozenset(("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"))
CLOSES_P = frozenset(
    ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
)
#: tag: (open tags it ends, tags that stop the search)
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "tbody", "thead"), ("table",)), "tfoot": (("tr", "td", "th", "tbody", "thead"), ("table",)),
}
LABELLIKE = re.compile("^(?:label|span|legend|strong|b|p|h[1-6])$")
CONTROL = frozenset(("input", "textarea", "select", "button", "option", "optgroup", "fieldset"))
PLAIN_NAME = re.compile("[^a-zA-Z0-9_-]")

ELEMENTS_DDL = (
    "page_id long, page_url string, doc_idx int, tag string, id string, name string, classes array<string>, attributes map<string,string>, "
    "text_content string, xpath string, css_selector string, iframe_path array<string>, shadow_path array<string>, "
    "computed struct<visible:boolean,enabled:boolean,bounding_box:struct<x:double,y:double,width:double,height:double>,checked:boolean,selected:boolean,readonly:boolean,required:boolean,focused:boolean,position:string,z_index:int,href:string>, "
    "dom_context struct<parent_tag:string,parent_id:string,sibling_index:int,nearby_label_text:string,tag_path:array<string>>, "
    "platform_signal struct<platform:string,control_id:string,control_type:string,is_control_root:boolean,component:string,is_component_host:boolean,aura_attributes:map<string,string>>"
)


class Node:
    __slots__ = ("attrs", "children", "index", "nth", "parent", "same", "tag", "texts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def whole_text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo.extend(reversed(n.children))
        return " ".join("".join(out).split())


class TreeBuilder(HTMLParser):
    """Builds a tree under one document node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.document = Node("#document", {}, None)
        self.open = [self.document]
        self.formatting: list[Node] = []  # open formatting elements in order

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        self.open.append(node)
        return node

    def _pop_to(self, node: Node) -> None:
        del self.open[self.open.index(node) :]

    def _end_open(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        for node in reversed(self.open[1:]):
            if node.tag in stops:
                return
            if node.tag in tags:
                self._pop_to(node)
                if tags == ("p",):
                    return

    def _carry_on(self) -> None:
        """Formatting elements that a block's end closed are opened again before further content."""
        for i, f in enumerate(self.formatting):
            if f not in self.open:
                self.formatting[i] = self._push(f.tag, f.attrs)

    def handle_starttag(self, tag, attrs):
        known = {k: v if v is not None else "" for k, v in reversed(attrs)}
        if tag in ("html", "body") and (held := next((n for n in self.open if n.tag == tag), None)):
            held.attrs = known | held.attrs
            return
        if tag == "body":
            self._end_open(("head",), ())
        if tag in CLOSES_P:
            self._end_open(("p",), ("table", "button"))
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        if tag == "a":
            for f in [f for f in self.formatting if f.tag == "a"]:
                self._close_formatting(f)
        if tag not in CLOSES_P and tag not in ENDS and tag not in SKIPPED and tag not in ("html", "body"):
            self._carry_on()
        node = self._push(tag, dict(reversed(known.items())))
        if tag in VOID:
            self.open.pop()
        elif tag in FORMATTING:
            self.formatting.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close_formatting(self, node: Node) -> None:
        self.formatting.remove(node)
        if node in self.open:
            self._pop_to(node)

    def handle_endtag(self, tag):
        if tag in FORMATTING:
            if held := [f for f in self.formatting if f.tag == tag]:
                self._close_formatting(held[-1])
            return
        for node in reversed(self.open[1:]):
            if node.tag == tag:
                if tag not in ("html", "body"):
                    self._pop_to(node)
                return
            if node.tag in ("table", "td", "th") and tag in ("p", "li", "div", "span"):
                return

    def handle_data(self, data):
        if data.strip() and self.open[-1].tag not in SKIPPED:
            self._carry_on()
        self.open[-1].children.append(data)


def css_name(text: str) -> str:
    return PLAIN_NAME.sub(lambda m: "\\" + m.group(), text)


def clean(text: str) -> str | None:
    return " ".join(text.split()) or None


def hidden(node: Node) -> bool:
    style = node.attrs.get("style", "").lower().replace(" ", "")
    return "hidden" in node.attrs or "display:none" in style or "visibility:hidden" in style or "visibility:collapse" in style or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")


class Describer:
    """Rows of one page. Unique ids and positions among siblings are looked up once for the page."""

    def __init__(self, html: str, url: str):
        builder = TreeBuilder()
        builder.feed(html)
        builder.close()
        self.root, self.by_id, self.labels, self.base = builder.document, {}, {}, url
        todo = [self.root]
        while todo:
            node = todo.pop()
            seen: dict[str, int] = {}
            kids = node.elements()
            for i, k in enumerate(kids):
                seen[k.tag] = seen.get(k.tag, 0) + 1
                k.index, k.nth = i, seen[k.tag]
            for k in kids:
                k.same = seen[k.tag]
                if k.attrs.get("id"):
                    self.by_id.setdefault(k.attrs["id"], []).append(k)
                if k.tag == "label" and k.attrs.get("for"):
                    self.labels.setdefault(k.attrs["for"], []).append(k)
                if k.tag == "base" and k.attrs.get("href"):
                    self.base = urljoin(url, k.attrs["href"])
            todo.extend(reversed(kids))

    def rows(self) -> Iterator[dict]:
        # (node, selector, xpath, tag path, invisible, disabled by a fieldset)
        todo = [(k, "", "/", [], False, False, None) for k in reversed(self.root.elements())]
        while todo:
            node, above, path_above, tags, unseen, disabled, label = todo.pop()
            if node.tag in SKIPPED:
                continue
            own_id = node.attrs.get("id")
            segment = css_name(node.tag) + (f":nth-of-type({node.nth})" if node.same > 1 else "")
            selector = f"{above} > {segment}" if above else segment
            path = f"{path_above.rstrip('/')}/{node.tag}[{node.nth}]"
            if own_id and len(self.by_id[own_id]) == 1:
                selector = "#" + css_name(own_id)
                if quoted := f'"{own_id}"' if '"' not in own_id else f"'{own_id}'" if "'" not in own_id else None:
                    path = f"//*[@id={quoted}]"
            tags = [*tags, node.tag]
            unseen = unseen or hidden(node)
            label = node if node.tag == "label" else label
            off = disabled or (node.tag in CONTROL and "disabled" in node.attrs)
            yield self.describe(node, selector, path, tags, unseen, off, label)
            below = off if node.tag in ("fieldset", "select", "optgroup") else disabled
            todo.extend((k, selector, path, tags, unseen, below, label) for k in reversed(node.elements()))

    def nearby(self, node: Node, label: Node | None) -> str | None:
        held = [*([label] if label is not None and label is not node else []), *self.labels.get(node.attrs.get("id") or "", [])] if node.tag in CONTROL else []
        if held and (t := clean(" ".join(x.whole_text() for x in held))):
            return t[:200]
        if by := node.attrs.get("aria-labelledby"):
            if t := clean(" ".join(self.by_id[i][0].whole_text() if i in self.by_id else "" for i in by.split())):
                return t[:200]
        before = [k for k in node.parent.elements()[: node.index]][-1:] if node.index else []
        if before and LABELLIKE.match(before[0].tag) and (t := clean(before[0].whole_text())) and len(t) <= 80:
            return t
        return None

    def describe(self, node: Node, selector: str, path: str, tags: list[str], unseen: bool, off: bool, label: Node | None) -> dict:
        a, kind = node.attrs, node.attrs.get("type", "").lower()
        secret = node.tag == "input" and kind == "password"
        parent = node.parent if node.parent is not self.root else None
        field = node.tag in ("input", "textarea")
        return {
            "tag": node.tag, "id": a.get("id") or None, "name": a.get("name"), "classes": list(dict.fromkeys(a.get("class", "").split())),
            "attributes": [(k, "[redacted]" if secret and k == "value" else v) for k, v in a.items() if k not in ("id", "class", "name")],
            "text_content": clean("".join(c for c in node.children if isinstance(c, str))), "xpath": path, "css_selector": selector, "iframe_path": ["main"], "shadow_path": [],
            "computed": {
                "visible": not unseen, "enabled": not off and a.get("aria-disabled") != "true", "bounding_box": None,
                "checked": "checked" in a if node.tag == "input" and kind in ("checkbox", "radio") else None, "selected": "selected" in a if node.tag == "option" else None,
                "readonly": "readonly" in a if field else None, "required": "required" in a if field or node.tag == "select" else None, "focused": False, "position": None, "z_index": None,
                "href": self.absolute(a["href"]) if node.tag in ("a", "area") and "href" in a else None,
            },
            "dom_context": {"parent_tag": parent.tag if parent else None, "parent_id": (parent.attrs.get("id") or None) if parent else None, "sibling_index": node.index, "nearby_label_text": self.nearby(node, label), "tag_path": tags},
            "platform_signal": component_signal(node),
        }

    def absolute(self, href: str) -> str | None:
        try:
            return urljoin(self.base, href.strip()) or None
        except ValueError:
            return None


def component_signal(node: Node) -> dict | None:
    """A component framework's marks that markup shows: data-aura-* attributes, and custom tags."""
    aura = {k: v for k, v in node.attrs.items() if k.startswith("data-aura-")}
    host = "-" in node.tag
    if not aura and not host:
        return None
    return {"platform": "salesforce", "control_id": None, "control_type": None, "is_control_root": None, "component": node.tag if host else None, "is_component_host": host, "aura_attributes": list(aura.items())}


def describe_html(html: str | None, url: str | None) -> list[dict]:
    return list(Describer(html, url or "").rows()) if html else []


def elements(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Elements of a table of captured pages, one row each. A page is parsed where it lies, and never leaves its task."""
    schema = to_arrow_schema(StructType.fromDDL(ELEMENTS_DDL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [{"page_id": page, "page_url": url, "doc_idx": i} | r for i, r in enumerate(describe_html(html, url))]
                if len(rows) > 5_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).mapInArrow(run, ELEMENTS_DDL)
