"""HTML pages to ordered blocks and links.

The tree comes from the standard library's tokenizer with implied end tags for the elements that have them; blocks are headings,
paragraphs, lists and tables in document order. One Arrow UDF per page, no shuffle. Null or empty HTML has no blocks; a page without headings gets
its title as first heading; unclosed and stray tags are repaired, not refused.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import resolve

# Element sets, names that mark page furniture (whole parts of a name, and parts that templates run together), labels of menus.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOISE_TAGS = {"script", "style", "noscript", "template", "svg", "iframe", "form", "button", "input", "select", "textarea", "nav", "header", "footer", "aside", "link", "meta", "img", "picture", "video", "audio", "map"}
INLINE = {"a", "b", "i", "u", "em", "strong", "span", "font", "small", "sub", "sup", "abbr", "code", "mark", "label", "time", "cite", "q", "s", "del", "ins", "big", "tt", "kbd", "samp", "var", "wbr", "br"}
NOISE_NAME = re.compile(r"(?:^|[-_\s])(?:nav|menu|sidebar|side-bar|breadcrumb|crumb|header|footer|banner|topbar|navbar|skip|social|share|cookie|popup|modal|search|pagination|pager|widget|advert|ads?)(?:$|[-_\s])", re.I)
NOISE_PART = re.compile(r"navigation|navbar|smoothmenu|mainmenu|submenu|megamenu|dropdownmenu|topnav|sidemenu|breadcrumb|pagebottom|bottom_section|copyright|sitemap|masterhead", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0", re.I)
NAV_LABEL = re.compile(r"(?:home|about(?:\s*us)?|contact(?:\s*us)?|sitemap|login|sign\s*in|faq|gallery|downloads?|quick\s*links|important\s*links|read\s*more|click\s*here)", re.I)
RANKS = {"head of department", "associate head of department", "professor", "associate professor", "assistant professor", "programmer", "technical staff", "administrative staff", "lecturer", "senior lecturer"}
RECORD = re.compile(r"Designation\s*:", re.I)
FIELD = re.compile(r"(Designation|Qualification|Specialization|Email|Research\s*Interest)\s*:\s*", re.I)
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = {"p": {"div", "section", "article", "main", "td", "th", "li", "body"}, "li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "thead": {"table"}, "tbody": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
BLOCK_STARTS = {"div", "section", "article", "main", "ul", "ol", "table", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dl", "form", "nav", "header", "footer", "aside"}
BLOCK = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("ordered", T.BooleanType()),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("caption", T.StringType()),
])


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def find(self, *tags: str):
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Node):
                if c.tag in tags:
                    yield c
                stack.extend(reversed(c.children))

    def text(self) -> str:
        """All text inside but that of noise below it."""
        out, stack = [], [self]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br":
                out.append(" ")
            elif c is self or not is_noise(c):
                stack.extend(reversed(c.children))
        return clean("".join(out))

    def kids(self, *tags: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.tag in tags]


def clean(s: str | None) -> str:
    return " ".join((s or "").split())


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close_implied(self, tag: str) -> None:
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK_STARTS else set())
        stop = SCOPE.get(tag, SCOPE["p"])
        at = len(self.open) - 1
        cut = None
        while at > 0 and self.open[at].tag not in stop:
            if self.open[at].tag in ends:
                cut = at
            at -= 1
        if cut is not None:
            del self.open[cut:]

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self._close_implied(tag)
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


def is_noise(n: Node) -> bool:
    a = n.attrs
    if n.tag in NOISE_TAGS or "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")):
        return True
    names = " ".join(filter(None, (a.get(k) for k in ("class", "id", "role"))))
    return bool(names) and bool(NOISE_NAME.search(names) or NOISE_PART.search(names))


def table_rows(n: Node) -> list[Node]:
    """Rows of a table itself: its own and those of its head and bodies."""
    return n.kids("tr") + [r for part in n.kids("thead", "tbody") for r in part.kids("tr")]


def is_data_table(n: Node) -> bool:
    """Whether a table holds data: no table inside, and a header cell or two rows of which one has two cells."""
    if any(True for _ in n.find("table")):
        return False
    rows = table_rows(n)
    return any(True for _ in n.find("th")) or (len(rows) >= 2 and max(len(r.kids("td", "th")) for r in rows) >= 2)


def table_block(n: Node) -> dict | None:
    """Headers from the head, else from a first row of nothing but header cells; rows without text are out, and so is a table without rows."""
    caption = next((c.text() for c in n.find("caption")), None)
    head = [c.text() for h in n.kids("thead") for c in h.find("td", "th")]
    body = [r for b in n.kids("tbody") for r in b.kids("tr")] or n.kids("tr")
    if not head and body and body[0].kids("th") and not body[0].kids("td"):
        head, body = [c.text() for c in body[0].kids("th")], body[1:]
    rows = [x for r in body if any(x := [c.text() for c in r.kids("td", "th")])]
    return {"kind": "table", "rows": rows, "headers": head, "caption": caption} if rows else None


def is_menu(n: Node) -> bool:
    """Whether a list is navigation: three items or more, four in five of them links, and a menu's label among them or all very short."""
    items = n.kids("li")
    texts = [(c, t) for c in items if (t := c.text())]
    links = sum(bool(a := clean("".join(x.text() for x in c.find("a")))) and len(a) >= 0.8 * len(t) for c, t in texts)
    if len(items) < 3 or links < max(3, int(0.8 * len(items))):
        return False
    return any(NAV_LABEL.fullmatch(t) for _, t in texts) or sum(len(t) for _, t in texts) / max(len(texts), 1) < 12


def list_block(n: Node) -> dict | None:
    texts = [t for c in n.kids("li") if (t := c.text())]
    if not texts or is_menu(n):
        return None
    if n.tag == "ol" and all(re.match(r"\d+\.", t) for t in texts):  # numbered by hand
        texts = [re.sub(r"^\d+\.\s*", "", t) for t in texts]
    return {"kind": "list", "items": texts, "ordered": n.tag == "ol"}


def walk(root: Node) -> list[dict]:
    """Blocks in document order. Elements wait on a stack of their own, so that no depth of nesting is too deep."""
    out: list[dict] = []

    def paragraph(text: str) -> None:
        if text:
            out.append({"kind": "paragraph", "text": text})

    stack: list = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            paragraph(clean(n))
        elif n.tag == "br":
            continue
        elif n is not root and is_noise(n):
            continue
        elif re.fullmatch(r"h[1-6]", n.tag):
            if t := n.text():
                out.append({"kind": "heading", "text": t, "level": int(n.tag[1])})
        elif n.tag in ("ul", "ol"):
            if b := list_block(n):
                out.append(b)
        elif n.tag == "table" and is_data_table(n):
            if b := table_block(n):
                out.append(b)
        elif n.tag == "p" or (n.tag != "table" and not any(isinstance(c, Node) and c.tag not in INLINE and not is_noise(c) for c in n.children)):
            paragraph(n.text())
        else:
            stack.extend(reversed(n.children))
    return out


def pick_root(tree: Node) -> Node:
    for test in (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("id") == "content", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "body"):
        stack = [tree]
        while stack:
            n = stack.pop()
            if test(n):
                return n
            stack.extend(x for x in reversed(n.children) if isinstance(x, Node))
    return tree


def page_title(tree: Node, url: str | None) -> str:
    for tag in ("title", "h1"):
        t = next((n.text() for n in tree.find(tag)), "")
        if t:
            return t
    return url or ""


def clean_title(t: str, suffixes: tuple[str, ...] = ()) -> str:
    """Without the site's suffix; of what is left with a bar, the part after the first one."""
    for s in suffixes:
        t = re.sub(rf"\s*\|\s*{re.escape(s)}\s*$", "", t, flags=re.I)
    t = t.strip(" |»-–—")
    return t.split("|", 1)[1].strip(" |»-–—") if "|" in t else t


def blocks_of(html: str | None, url: str | None = None, suffixes: tuple[str, ...] = ()) -> list[dict]:
    if not html:
        return []
    tree, out = parse(html), []
    for b in walk(pick_root(tree)):
        if b["kind"] == "paragraph" and out and out[-1]["kind"] == "paragraph":
            out[-1]["text"] += " " + b["text"]
        else:
            out.append(dict(b))
    if not any(b["kind"] == "heading" for b in out):
        t = page_title(tree, url)
        out.insert(0, {"kind": "heading", "text": clean_title(t, suffixes) or (url or ""), "level": 1})
    return out


def links_of(html: str | None, url: str | None) -> list[dict]:
    """Links with their resolved address, text, and the first cell of their table row as date label."""
    if not html:
        return []
    out = []

    stack: list[tuple[Node, str | None]] = [(parse(html), None)]
    while stack:
        n, label = stack.pop()
        if n.tag == "tr":
            first = next(iter(n.kids("td", "th")), None)
            label = first.text() if first else None
        if n.tag == "a" and n.attrs.get("href"):
            out.append({"href": n.attrs["href"], "url": resolve(url or "", n.attrs["href"]), "text": n.text(), "date_label": label})
        stack.extend((c, label) for c in reversed(n.children) if isinstance(c, Node))
    return out


LINK = T.StructType([T.StructField(n, T.StringType()) for n in ("href", "url", "text", "date_label")])


def html_blocks(df: DataFrame, id_col: str, html: str, url: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, pos, kind, text, level, items, ordered, rows, headers, caption``."""

    @F.pandas_udf(T.ArrayType(BLOCK))
    def run(h: pd.Series, u: pd.Series) -> pd.Series:
        full = {f.name: None for f in BLOCK.fields}
        return pd.Series([[{**full, **b} for b in blocks_of(x, y, suffixes)] for x, y in zip(h, u)])

    return df.select(id_col, F.posexplode(run(F.col(html), F.col(url))).alias("pos", "b")).select(id_col, "pos", "b.*")


def html_titles(df: DataFrame, id_col: str, html: str, url: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, title``: the page's title, else its first h1, cleaned of the site's suffix, else its address."""

    @F.pandas_udf("string")
    def run(h: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([clean_title(page_title(parse(x or ""), y), suffixes) or (y or "") for x, y in zip(h, u)])

    return df.select(id_col, run(F.col(html), F.col(url)).alias("title"))


def menus(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """``id_col, n_lists, n_menus``: lists of a page, and how many of them are navigation or inside page furniture."""

    def count(h: str | None) -> tuple[int, int]:
        n = m = 0
        stack = [(parse(h), False)] if h else []
        while stack:
            x, noise = stack.pop()
            noise = noise or (x.tag != "#root" and is_noise(x))
            if x.tag in ("ul", "ol"):
                n, m = n + 1, m + (noise or is_menu(x))
            stack.extend((c, noise) for c in x.children if isinstance(c, Node))
        return n, m

    @F.pandas_udf("struct<n_lists:int,n_menus:int>")
    def run(h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count(x) for x in h], columns=["n_lists", "n_menus"])

    return df.select(id_col, run(F.col(html)).alias("c")).select(id_col, "c.*")


def faculty_record(raw: str) -> str:
    """'name — Label: value — ...' of a staff record's flat text, fields without a value left out."""
    text = clean(raw)
    text = re.sub(r"\[dot\]", ".", re.sub(r"\[at\]", "@", text, flags=re.I), flags=re.I).strip()
    name, *rest = FIELD.split(text)
    pairs = [f"{label.strip()}: {value.strip()}" for label, value in zip(rest[::2], rest[1::2]) if value.strip()]
    return " — ".join([name.strip().rstrip("-–—").strip(), *pairs])


def faculty_blocks_of(html: str | None, department: str | None = None) -> list[dict]:
    """A staff directory: the title as first heading, rank rows as headings, one paragraph per record of the innermost table that holds any."""
    out = [{"kind": "heading", "text": f"{department or 'Faculty'} — Faculty", "level": 1}]
    if not html:
        return out
    has = lambda n: any(RECORD.search(c.text()) for c in n.find("td"))
    tables = [t for t in parse(html).find("table") if has(t)]
    best = next((t for t in tables if not any(has(x) for x in t.find("table"))), tables[0] if tables else None)
    if best is None:
        return out
    suffix = f" — Department: {department}" if department else ""
    for row in best.find("tr"):
        text = " ".join(t for c in row.find("td", "th") if (t := c.text()))
        if text.strip().lower() in RANKS:
            out.append({"kind": "heading", "text": text.title(), "level": 2})
        elif RECORD.search(text):
            out.append({"kind": "paragraph", "text": faculty_record(text) + suffix})
    for cell in best.kids("td"):  # cells outside any row
        if RECORD.search(text := cell.text()):
            out.append({"kind": "paragraph", "text": faculty_record(text) + suffix})
    return out


def faculty_blocks(df: DataFrame, id_col: str, html: str, department: str) -> DataFrame:
    """``id_col, pos, kind, text, level, ...`` of staff directories."""

    @F.pandas_udf(T.ArrayType(BLOCK))
    def run(h: pd.Series, d: pd.Series) -> pd.Series:
        full = {f.name: None for f in BLOCK.fields}
        return pd.Series([[{**full, **b} for b in faculty_blocks_of(x, y)] for x, y in zip(h, d)])

    return df.select(id_col, F.posexplode(run(F.col(html), F.col(department))).alias("pos", "b")).select(id_col, "pos", "b.*")


def html_links(df: DataFrame, id_col: str, html: str, url: str) -> DataFrame:
    @F.pandas_udf(T.ArrayType(LINK))
    def run(h: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([links_of(x, y) for x, y in zip(h, u)])

    return df.select(id_col, F.posexplode(run(F.col(html), F.col(url))).alias("pos", "l")).select(id_col, "pos", "l.*")


def labelled_fields(cell: Column, labels: list[str]) -> Column:
    """'name Label: value ...' to 'name — Label: value — ...' without empty values; [at] and [dot] are undone first."""
    x = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " ")), r"(?i)\[at\]", "@"), r"(?i)\[dot\]", ".")
    alt = "|".join(re.escape(s) for s in labels)
    parts = F.split(F.regexp_replace(x, rf"\s*\b({alt}):\s*", "\u0001$1\u0002"), "\u0001")
    name = F.trim(F.element_at(parts, 1))
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.trim(F.substring_index(p, "\u0002", -1)) != "")
    return F.array_join(F.concat(F.when(name == "", F.array().cast("array<string>")).otherwise(F.array(name)), F.transform(rest, lambda p: F.regexp_replace(F.trim(p), "\u0002", ": "))), " — ")
