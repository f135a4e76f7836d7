"""Pages to rows: classification and extraction."""

from __future__ import annotations

import weakref
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import drop_marker, strip
from ..session import ship

# What tells a captcha page, what a page must have one of, and names for what is missing.
CAPTCHA = ("驗證碼", "captcha", "verification", "security check", "請輸入驗證碼", "請完成驗證", "robot check", "human verification", "cloudflare", "security challenge", "checking your browser")
REQUIRED = ("全唐詩", "<h2>《<a", '<td class="ctext">', "詩")
ANONYMOUS, UNKNOWN = "佚名", "未知作者"
# Fixed patterns of the positional extraction.
HEADS = r"(?s)<table width='100%'>.*?<h2>《<a[^>]*>([^<]+)</a>》</h2>.*?<span[^>]*><b>\s*([^<]+)</b></span>.*?</table>"
BLOCKS = r'(?s)<table border="0">.*?</table>'
PARTS = r'(?s)<div id="comm[^"]*"></div>([^<]+)<p class="ctext"></p>'


def _any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def page_status(
    page: Column, found: Column, http: Column | None = None, error: Column | None = None, captcha: Sequence[str] = CAPTCHA, required: Sequence[str] = REQUIRED, blocked: Sequence[str] = (), none: str = "no_poems_found"
) -> Column:
    """The status of a fetched page: its transport error, http_error_<code>, blocked, captcha, invalid_page, ``none`` if nothing was ``found`` in it, or success."""
    ok = F.when(_any(F.lower(page), [w.lower() for w in blocked]), "blocked") if blocked else F.when(F.lit(False), "blocked")
    ok = ok.when(_any(F.lower(page), [w.lower() for w in captcha]), "captcha")
    if required:
        ok = ok.when(~_any(page, required), "invalid_page")
    ok = ok.when(found > 0, "success").otherwise(none)
    if http is not None:
        ok = F.when(http != 200, F.concat(F.lit("http_error_"), http.cast("string"))).otherwise(ok)
    if error is not None:
        ok = F.when(error.isNotNull(), error).otherwise(ok)
    return ok


def without_code(page: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(page, r"(?s)<script[^>]*>.*?</script>", ""), r"(?s)<style[^>]*>.*?</style>", "")


def positional(pages: DataFrame, key: str, page: str, heads: str = HEADS, blocks: str = BLOCKS, parts: str = PARTS) -> DataFrame:
    """(key, pos, title, author, content): the i-th head goes with the i-th block, so a missing block shifts those after it."""
    body = without_code(F.col(page))
    title = F.regexp_extract_all(body, F.lit(heads), F.lit(1))
    author = F.regexp_extract_all(body, F.lit(heads), F.lit(2))
    block = F.regexp_extract_all(body, F.lit(blocks), F.lit(0))
    rows = pages.select(key, F.posexplode(F.arrays_zip(title.alias("title"), author.alias("author"), block.alias("block"))).alias("pos", "r"))
    pieces = F.filter(F.transform(F.regexp_extract_all(F.col("r.block"), F.lit(parts), F.lit(1)), strip), lambda s: s != "")
    out = rows.where("r.title IS NOT NULL AND r.block IS NOT NULL").select(key, "pos", strip(F.col("r.title")).alias("title"), drop_marker(strip(F.col("r.author"))).alias("author"), F.array_join(pieces, "\n").alias("content"))
    return out.where("content <> ''")


def zip_matches(pages: DataFrame, key: str, page: str, left: str, right: str) -> DataFrame:
    """(key, pos, a, b): the i-th match of one pattern with the i-th of another, as far as both go."""
    body = without_code(F.col(page))
    a, b = F.regexp_extract_all(body, F.lit(left), F.lit(1)), F.regexp_extract_all(body, F.lit(right), F.lit(1))
    return pages.select(key, F.posexplode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("pos", "r")).where("r.a IS NOT NULL AND r.b IS NOT NULL").select(key, "pos", "r.a", "r.b")


# --- a small document tree -------------------------------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element.  It holds what is below it but only refers to its parent, so a page's tree goes as soon as its root does, without the garbage collector."""

    def __init__(self, tag: str, classes: str = "", href: str = "", parent: Node | None = None) -> None:
        self.tag, self.classes, self.href, self._parent = tag, classes, href, None if parent is None else weakref.ref(parent)
        self.children: list[Node | str] = []

    @property
    def parent(self) -> Node | None:
        return self._parent() if self._parent is not None else None

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def all(self, tag: str, classes: str | None = None) -> list[Node]:
        """Elements of a tag; with ``classes`` those whose class attribute is it, or has it as one class."""
        return [n for n in self.walk() if n.tag == tag and (classes is None or n.classes == classes or classes in n.classes.split())]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack.extend(reversed(c.children))
        return "".join(out)

    def up(self, tag: str) -> Node | None:
        node = self.parent
        while node is not None and node.tag != tag:
            node = node.parent
        return node

    def after(self, tag: str) -> Node | None:
        """The next sibling of a tag."""
        if self.parent is None:
            return None
        seen = False
        for c in self.parent.children:
            if seen and isinstance(c, Node) and c.tag == tag:
                return c
            seen = seen or c is self
        return None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = dict(attrs)
        node = Node(tag, known.get("class") or "", known.get("href") or "", self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def _verse(table: Node | None, cell: str, skip: str) -> str:
    """The cells of a table that hold text."""
    if table is None:
        return ""
    return "\n".join(t for c in table.all("td", cell) if (t := c.text().strip()) and not t.startswith(skip))


def titled_poems(page: str, author_class: str = "etext opt", cell: str = "ctext", skip: str = "打開字典", library: str = "電子圖書館") -> list[dict]:
    """Poems by their author marks: title in the mark's table, text in the table after it; pages without marks by their headings, anonymous."""
    root, out = parse(page), []
    pairs = [(t, a) for s in root.all("span", author_class) if (a := s.text().strip()) and a != library and (t := s.up("table")) is not None]
    for table, author in pairs:
        heading = next(iter(table.all("h2")), None)
        title = heading.text().strip() if heading else ""
        if title.startswith("《") and title.endswith("》") and title[1:-1] and (text := _verse(table.after("table"), cell, skip)):
            out.append({"title": title[1:-1], "author": author, "content": text})
    if out:
        return out
    for heading in root.all("h2"):
        title, table = heading.text().strip(), heading.up("table")
        if title.startswith("《") and title.endswith("》") and title[1:-1] and table is not None and (text := _verse(table.after("table"), cell, skip)):
            out.append({"title": title[1:-1], "author": ANONYMOUS, "content": text})
    return out


def row_poems(page: str, link: str = "") -> list[dict]:
    """Poems of table rows: title (and author, by a second link) in the first cell, text in the second; else links whose surroundings say more."""
    root, out = parse(page), []
    for row in root.all("tr"):
        cells = row.all("td")
        if len(cells) >= 2:
            links = cells[0].all("a")
            title = (links[0] if links else cells[0]).text().strip()
            text = cells[1].text().strip()
            if title and text:
                out.append({"title": title, "author": links[1].text().strip() if len(links) > 1 else UNKNOWN, "content": text})
    if out:
        return out
    for a in root.all("a"):
        title = a.text().strip()
        text = a.parent.text().strip() if a.parent is not None else ""
        if link in a.href and len(title) > 1 and len(text) > len(title):
            out.append({"title": title, "author": UNKNOWN, "content": text})
    return out


def extract(pages: DataFrame, key: str, page: str, method: str = "titled", **options: str) -> DataFrame:
    """(key, pos, title, author, content) by a walk over each page's document tree (Python; one page at a time is held)."""
    ship(pages.sparkSession)
    how = {"titled": titled_poems, "rows": row_poems}[method]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield batch.map(lambda p: how(p, **options) if p else [])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    found = F.pandas_udf("array<struct<title:string,author:string,content:string>>")(run)(F.col(page))
    return pages.select(key, F.posexplode(found).alias("pos", "r")).select(key, "pos", "r.*")
