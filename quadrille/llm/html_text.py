"""Main text of web pages by wrapper induction.

Pages of one host are made from one template. Their DOM trees are aligned by simple tree matching: two nodes match if
their tags agree, and the children of matching nodes are paired, in order, so that most nodes are matched.

1. Pages of a host are of one kind if they have the same frame: paths of sections, divisions, tables and the like, four
   deep, without what lies in an article. The pilots of a kind are ``PILOTS`` pages with different texts, and different
   articles if there are any, among the ``CANDIDATES`` least hashes of texts (documented bounds of each kind; a hot host
   or kind has no more than others, and copies count once). A kind with one pilot also gets those of the host's largest
   kinds.
2. Every page is aligned with its kind's pilots. Of both only names and hashes of texts are kept. A block whose node
   matches a pilot's node with the same text is constant: part of the template. Slots whose text varies are content.
3. Counts over all pages of the kind decide: a slot (path of tags and classes) whose matched blocks are constant in at
   least half of all alignments is template for all of them. Pages with equal texts are left out of each other's
   counts, and a host with a single page has no template.
4. Kinds of element that never hold the article (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
   styles, comments) are left out by tag, role, class or id.
5. If the page has an ``article`` or ``main``, only text in it counts, and it is judged block by block: a text is template
   of a slot if it is the same in at least half of the alignments of the pages that have it, and in ``LEAST``. Only pages
   with different articles are compared, those whose equal blocks hold less than ``ALIKE`` of the shorter one's
   characters, so copies of one article do not make it template. Other pages lose their template's slots. A page on
   which nothing but template stands keeps it.

Pilots and templates of all hosts are broadcast while they are at most ``BROADCAST_BYTES``, else joined by a shuffle.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a newline.

Defined results: null or empty html, or a page without text: empty text. Rows that repeat get equal results. A tag cut
off at the end of the page is dropped, open elements end with the page.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.checkpoints import saved

PILOTS, CANDIDATES = 3, 12
CONSTANT_SHARE = 0.5
LEAST, ALIKE = 3, 2 / 3
BROADCAST_BYTES = 16 << 20
#: Entries of a table of weights, and weights of pairs of nodes that are kept. They bound memory only. Tables of a
#: few entries are made without numpy.
TABLE, KEPT, FEW = 250_000, 1 << 20, 400
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = {k: re.compile(rf"</{k}\b[^>]*>?", re.I) for k in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", "option", "head", "title"}
_NEVER = {"nav", "footer", "header", "aside", "form", "script", "style", "noscript", "template", "iframe", "head", "title", "button", "select", "textarea", "input", "label", "dialog", "menu", "object", "svg", "canvas", "audio", "video", "map"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar", "alertdialog"}
_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|footer|header|masthead|sidebar\w*|aside|breadcrumbs?|cookie\w*|consent|notice|newsletter|popup|modal|comments?|respond|replies|reply|disqus|social|share\w*|related|widget\w*|login|signup|search\w*|pagination|pager|toolbar|skip\w*)(?=$|[\s_-])", re.I)
_FRAME = {"article", "center", "div", "fieldset", "main", "section", "table", "td"}
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: tag, name for slots, its parent, children and, for text, the text's blocks."""

    __slots__ = ("tag", "name", "parent", "children", "never", "article", "text")

    def __init__(self, tag: str, name: str = "", parent: Node | None = None, never: bool = False, article: bool = False, text: str = ""):
        self.tag, self.name, self.parent, self.never, self.article, self.text = tag, name or tag, parent, never, article, text
        self.children: list[Node] = []


def _closes(tag: str, open_tag: str) -> bool:
    """Whether an opening tag ends an open element of the other kind."""
    if open_tag == "p":
        return tag in _BLOCK and tag != "br"
    if open_tag in ("b", "i", "em", "strong", "a", "span", "u", "font", "small"):
        return False
    return (tag, open_tag) in {("li", "li"), ("dt", "dt"), ("dt", "dd"), ("dd", "dt"), ("dd", "dd"), ("tr", "tr"), ("td", "td"), ("td", "th"), ("th", "td"), ("th", "th"), ("tr", "td"), ("tr", "th"), ("option", "option")}


def parse(page: str) -> Node:
    """The page's tree. Text nodes have the tag '#' and a block's text; inline elements melt into the block around them."""
    root = at = Node("#root")
    words: list[str] = []

    def flush() -> None:
        if words:
            text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            words.clear()
            if text:
                at.children.append(Node("#", "#", at, at.never, at.article, text))

    i, n = 0, len(page)
    while i < n:
        j = page.find("<", i)
        if j < 0:
            words.append(page[i:])
            break
        if j > i:
            words.append(page[i:j])
        m = _TOKEN.match(page, j)
        if m is None:
            if page[j + 1 : j + 2].isalpha() or page[j + 1 : j + 2] in ("/", "!", "?"):
                k = page.find(">", j)
                if k < 0:
                    break
                i = k + 1
            else:
                words.append("<")
                i = j + 1
            continue
        i = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[4]:  # cut off by the end of the page
            break
        if m[1]:
            if tag in _BLOCK or tag in _NEVER:
                node = at
                while node is not None and node.tag != tag:
                    node = node.parent
                if node is not None and node.parent is not None:
                    flush()
                    at = node.parent
                elif tag == "p":
                    flush()
            continue
        if tag not in _BLOCK and tag not in _NEVER:
            continue
        flush()
        if tag == "br" or tag == "hr":
            continue
        while at.parent is not None and _closes(tag, at.tag):
            at = at.parent
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        marks = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        never = at.never or tag in _NEVER or attributes.get("role", "").lower() in _ROLES or bool(marks != " " and _NAMES.search(marks)) or "hidden" in (m[3] or "").split()
        node = Node(tag, f"{tag}.{attributes['class']}" if "class" in attributes else tag, at, never, at.article or tag in ("article", "main"))
        at.children.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(page, i)
            i = end.end() if end else n
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            at = node
    flush()
    return root


def blocks(root: Node) -> list[Node]:
    """The text nodes of the page's article, or of all its elements if it has none, but for elements that never hold one."""
    found: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "#":
            if not node.never:
                found.append(node)
        elif not node.never:
            stack += reversed(node.children)
    inside = [x for x in found if x.article]
    return inside or found


def slot(node: Node) -> str:
    """The path of names above a text node."""
    names, at = [], node.parent
    while at is not None and at.parent is not None:
        names.append(at.name)
        at = at.parent
    return "/".join(reversed(names))


def _mark(text: str) -> str:
    """12 hexadecimal digits of a hash, then those of the length."""
    return f"{_hash(text)}{len(text):x}"


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).hexdigest()


def outline(node: Node):
    """Names and marks of texts of the tree, without elements that never hold an article: [name, children] or a mark."""
    return _mark(node.text) if node.tag == "#" else [node.name, [outline(x) for x in node.children if not x.never]]


def kind_of(tree) -> str:
    """A hash of the frame of an outlined page: the paths of its sections and divisions, four deep."""
    found, stack = set(), [(tree, "", 0)]
    while stack:
        node, path, depth = stack.pop()
        for x in node[1]:
            if isinstance(x, list):
                tag = x[0].split(".", 1)[0]
                if tag in _FRAME:
                    where = f"{path}/{_DIGITS.sub('0', x[0])}"
                    found.add(where)
                    if depth < 3 and tag not in ("article", "main"):
                        stack.append((x, where, depth + 1))
                elif tag in ("html", "body"):
                    stack.append((x, path, depth))
    return _hash("\n".join(sorted(found)))


def _texts(tree) -> str:
    """A hash of the texts of an outlined page."""
    found, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += node[1]
        else:
            found.append(node)
    return _hash(" ".join(found))


def _outlined(page: str) -> tuple[str, str, str]:
    """(kind, hash of the texts, the outline with that hash, as JSON)."""
    tree = outline(parse(page))
    texts = _texts(tree)
    return kind_of(tree), texts, json.dumps([texts, tree], separators=(",", ":"))


def pilots_of(outlines: list[str]) -> list[str]:
    """Up to ``PILOTS`` of the outlines, none with the article of another."""
    found: list[tuple[str, set]] = []
    for o in sorted(outlines):
        article = article_of(json.loads(o)[1])
        if len(found) < PILOTS and not any(article and x and alike(article, x) for _, x in found):
            found.append((o, article))
    return [o for o, _ in found]


def matched(a, b) -> Iterator[tuple[str, bool, str]]:
    """(slot, same, text of the first) of the pairs of texts in two outlines by simple tree matching: the pairs of equally named nodes that
    keep parents and order and weigh most, where a pair weighs 1 and equal texts 1 more."""
    weights, stack = _Weights(), [(a, b, "")]
    while stack:
        x, y, path = stack.pop()
        for u, v in _pairs(x[1], y[1], weights):
            if isinstance(u, list):
                stack.append((u, v, f"{path}/{u[0]}" if path else u[0]))
            else:
                yield path, u == v, u


class _Weights:
    """Weights of the best matchings of subtrees of two outlines.

    Without a text in common, two subtrees weigh what their shapes (names only) do, which is worked out once per pair of
    shapes; other pairs are matched child by child. What is kept of them is bounded by ``KEPT``."""

    def __init__(self):
        self.shapes: dict = {}
        self.kinds: list = []
        self.facts: dict[int, tuple[int, frozenset]] = {}
        self.by_shape: dict[tuple[int, int], int] = {}
        self.by_node: dict[tuple[int, int], int] = {}

    def fact(self, root) -> tuple[int, frozenset]:
        """(shape, texts) of a subtree."""
        if id(root) not in self.facts:
            order, stack = [], [root]
            while stack:
                node = stack.pop()
                order.append(node)
                if isinstance(node, list):
                    stack += node[1]
            for node in reversed(order):  # children first
                if isinstance(node, list):
                    under = [self.facts[id(x)] for x in node[1]]
                    kind, texts = (node[0], tuple(x[0] for x in under)), frozenset().union(*(x[1] for x in under))
                else:
                    kind, texts = ("#", None), frozenset((node,))
                if kind not in self.shapes:
                    self.shapes[kind] = len(self.kinds)
                    self.kinds.append(kind)
                self.facts[id(node)] = self.shapes[kind], texts
        return self.facts[id(root)]

    def of(self, x, y) -> int:
        """The weight of a pair of subtrees, at once if they hardly branch."""
        above = 0
        while isinstance(x, list) and isinstance(y, list):
            if x[0] != y[0]:
                return above
            if not x[1] or not y[1]:
                return above + 1
            if len(x[1]) > 1 or len(y[1]) > 1:
                return above + self.of_nodes(x, y)
            above, x, y = above + 1, x[1][0], y[1][0]
        return above + (0 if isinstance(x, list) or isinstance(y, list) else 1 + (x == y))

    def of_shapes(self, s: int, t: int) -> int:
        (name, p), (other, q) = self.kinds[s], self.kinds[t]
        if name != other or (p is None) != (q is None):
            return 0
        if not p or not q:
            return 1
        if (s, t) not in self.by_shape:
            distinct, at = np.unique(np.array(q), return_inverse=True)
            rows = {x: np.array([self.of_shapes(x, int(y)) for y in distinct])[at] for x in set(p)}
            self.by_shape[s, t] = 1 + int(_heaviest((rows[x] for x in p), len(q))[-1])
        return self.by_shape[s, t]

    def of_nodes(self, x, y) -> int:
        (s, mine), (t, other) = self.fact(x), self.fact(y)
        if mine.isdisjoint(other):
            return self.of_shapes(s, t)
        if not isinstance(x, list) or not isinstance(y, list):
            return 2 if x == y else 0
        if x[0] != y[0]:
            return 0
        key = id(x), id(y)
        if key not in self.by_node:
            row = self.rows(x[1], y[1])
            found = 1 + int(_heaviest((row(i, 0, len(y[1])) for i in range(len(x[1]))), len(y[1]))[-1])
            if len(self.by_node) >= KEPT:
                self.by_node.clear()
            self.by_node[key] = found
        return self.by_node[key]

    def rows(self, p: list, q: list):
        """A function of i, low, high: the weights of p[i] with q[low:high]."""
        distinct, at = np.unique(np.array([self.fact(y)[0] for y in q], int), return_inverse=True)
        holders: dict[str, list[int]] = {}
        for j, y in enumerate(q):
            for text in self.fact(y)[1]:
                holders.setdefault(text, []).append(j)
        plain: dict[int, np.ndarray] = {}

        def row(i: int, low: int, high: int) -> np.ndarray:
            s, texts = self.fact(p[i])
            if s not in plain:
                plain[s] = np.array([self.of_shapes(s, int(t)) for t in distinct], int)
            w = plain[s][at[low:high]]
            for j in {j for text in texts for j in holders.get(text, ())}:
                if low <= j < high:
                    w[j - low] = self.of(p[i], q[j])
            return w

        return row


def _heaviest(rows, width: int) -> np.ndarray:
    """The weights of the best matchings of all rows with the first 0, 1, ... columns."""
    best = np.zeros(width + 1, int)
    for w in rows:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + w))
    return best


def _pairs(p: list, q: list, weights: _Weights) -> Iterator[tuple]:
    """The pairs of two rows of children that weigh most. Equal beginnings and ends belong to a best matching; tables of
    what lies between are halved until they have at most ``TABLE`` entries (Hirschberg)."""
    low, most = 0, min(len(p), len(q))
    while low < most and p[low] == q[low]:
        low += 1
    high = 0
    while high < most - low and p[-1 - high] == q[-1 - high]:
        high += 1
    yield from zip(p[:low], q[:low], strict=True)
    yield from zip(p[len(p) - high :], q[len(q) - high :], strict=True)
    p, q = p[low : len(p) - high], q[low : len(q) - high]
    if not p or not q:
        return
    if len(p) * len(q) <= FEW:
        small = [[0] * (len(q) + 1)]
        for x in p:
            above, line = small[-1], [0]
            for t, y in enumerate(q):
                line.append(max(above[t + 1], line[t], above[t] + weights.of(x, y)))
            small.append(line)
        yield from _traced(small, p, q)
        return
    row, stack = weights.rows(p, q), [(0, len(p), 0, len(q))]
    while stack:
        a, b, c, d = stack.pop()
        if a == b or c == d:
            continue
        if b - a > 1 and (b - a) * (d - c) > TABLE:
            m = (a + b) // 2
            first = _heaviest((row(i, c, d) for i in range(a, m)), d - c)
            last = _heaviest((row(i, c, d)[::-1] for i in range(b - 1, m - 1, -1)), d - c)
            k = c + int(np.argmax(first + last[::-1]))
            stack += (a, m, c, k), (m, b, k, d)
            continue
        table = [np.zeros(d - c + 1, int)]
        for i in range(a, b):
            w, above = row(i, c, d), table[-1]
            table.append(np.concatenate(([0], np.maximum.accumulate(np.maximum(above[1:], above[:-1] + w)))))
        yield from _traced(table, p[a:b], q[c:d])


def _traced(table, p: list, q: list) -> Iterator[tuple]:
    s, t = len(p), len(q)
    while s and t:
        if table[s][t] == table[s - 1][t]:
            s -= 1
        elif table[s][t] == table[s][t - 1]:
            t -= 1
        else:
            yield p[s - 1], q[t - 1]
            s, t = s - 1, t - 1


def article_of(tree) -> set[tuple[str, str]]:
    """(slot, mark) of the texts in the article or main of an outline."""
    found, stack = set(), [(tree, "", False)]
    while stack:
        node, path, inside = stack.pop()
        for x in node[1]:
            if isinstance(x, list):
                stack.append((x, f"{path}/{x[0]}" if path else x[0], inside or x[0].split(".", 1)[0] in ("article", "main")))
            elif inside:
                found.add((path, x))
    return found


def alike(a: set[tuple[str, str]], b: set[tuple[str, str]]) -> bool:
    """Whether two pages hold the same article: equal blocks have ``ALIKE`` of the shorter one's characters."""
    a, b = {x for _, x in a}, {x for _, x in b}
    chars = lambda marks: sum(int(x[12:], 16) for x in marks)
    return chars(a & b) >= ALIKE * min(chars(a), chars(b))


def block_key(where: str, mark: str) -> str:
    """A text in a slot, among slots: no name begins with #."""
    return f"#{mark} {where}"


def constant_slots(page: str, pilots: list[tuple]) -> dict[str, tuple[int, int]]:
    """slot: (text blocks equal to the pilot's, text blocks aligned), over pilots (hash of texts, outline, article) whose
    texts differ from the outlined page's.

    For pages with an article, block_key: (pilots with the block, pilots), over pilots with different articles."""
    counts: dict[str, tuple[int, int]] = {}
    mark, own = json.loads(page)
    theirs = [(tree, blocks_there) for other, tree, blocks_there in pilots if other != mark]
    if not theirs:
        return counts
    article = article_of(own)
    if not article:
        for other, _ in theirs:
            for where, same, _ in matched(own, other):
                a, b = counts.get(where, (0, 0))
                counts[where] = (a + same, b + 1)
        return counts
    shared = article & set().union(*(x for _, x in theirs))
    if shared:
        for other, blocks_there in theirs:
            if blocks_there and not alike(article, blocks_there):
                equal = {(where, x) for where, same, x in matched(own, other) if same}
                for block in shared:
                    a, b = counts.get(block_key(*block), (0, 0))
                    counts[block_key(*block)] = (a + (block in equal), b + 1)
    return counts


def framed(page: str) -> tuple[str, list]:
    """(kind, [whether the blocks are an article's, [slot, text] of each]) of a page."""
    root = parse(page)
    found = blocks(root)
    return kind_of(outline(root)), [any(x.article for x in found), [[slot(x), x.text] for x in found]]


def text_of(held: list, template: frozenset[str] = frozenset()) -> str:
    """The text of a page's blocks without the template: of an article its blocks, of other pages its slots."""
    article, found = held
    if template:
        found = [x for x in found if (block_key(x[0], _mark(x[1])) if article else x[0]) not in template] or found
    return "\n".join(text for _, text in found)


def main_text(page: str | None, template: frozenset[str] = frozenset()) -> str:
    """The page's text without the template."""
    return text_of(framed(page)[1], template) if page else ""


def host_of(url_col: str):
    return F.coalesce(F.regexp_extract(F.col(url_col), "^[^:]*://([^/?#]*)", 1), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: its id, url, text, n_chars (code points of the text)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    hosted = rows.withColumn("host", host_of("url"))

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_outlined(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[c] for x in found], pa.string()) for c in range(3))], names=["host", "kind", "texts", "o"])

    outlined = saved(hosted.where("html is not null and html <> ''").select("host", "html").mapInArrow(outlines, "host string, kind string, texts string, o string"))

    # pilots: the least hashes, merged in buckets so that no host lands in one task
    distinct = outlined.select("host", "kind", "texts").distinct()
    spread = distinct.withColumns({"k": F.xxhash64("texts", F.lit("pilot")), "b": F.pmod(F.xxhash64("texts"), F.lit(64))})
    least = lambda *by: F.row_number().over(Window.partitionBy("host", "kind", *by).orderBy("k", "texts"))
    chosen = saved(spread.withColumn("r", least("b")).where(F.col("r") <= CANDIDATES).withColumn("r", least()).where(F.col("r") <= CANDIDATES).select("host", "kind", "texts"))
    chosen = _small(chosen, F.octet_length("kind") + F.octet_length("texts"))
    drawn = outlined.join(chosen, ["host", "kind", "texts"], "left_semi").groupBy("host", "kind", "texts").agg(F.min("o").alias("o"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pilots_of(x) for x in b.column(2).to_pylist()], pa.list_(pa.string()))], names=["host", "kind", "own"])

    own = saved(drawn.groupBy("host", "kind").agg(F.collect_list("o").alias("os")).mapInArrow(pick, "host string, kind string, own array<string>"))
    large = own.join(distinct.groupBy("host", "kind").count(), ["host", "kind"]).withColumn("b", F.pmod(F.xxhash64("kind"), F.lit(64)))
    first = lambda *by: F.row_number().over(Window.partitionBy("host", *by).orderBy(F.desc("count"), "kind"))
    large = large.withColumn("r", first("b")).where(F.col("r") <= PILOTS).withColumn("r", first()).where(F.col("r") <= PILOTS)
    common = large.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("common"))
    pilots = own.join(common, "host").select("host", "kind", F.when(F.size("own") < 2, F.array_distinct(F.concat("own", "common"))).otherwise(F.col("own")).alias("pilots"))
    pilots = _small(saved(pilots), F.octet_length(F.array_join("pilots", "")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], list[int]] = {}
        read: dict[tuple[str, str], list[tuple]] = {}
        for b in batches:
            for i in range(0, b.num_rows, 128):
                for host, kind, page, others in zip(*(c.to_pylist() for c in b.slice(i, 128).columns), strict=True):
                    if (host, kind) not in read:
                        if len(read) >= 256:
                            read.clear()
                        read[host, kind] = [(mark, tree, article_of(tree)) for mark, tree in map(json.loads, others)]
                    for s, (same, n) in constant_slots(page, read[host, kind]).items():
                        c = held.setdefault((host, kind, s), [0, 0])
                        c[0] += same
                        c[1] += n
            if len(held) > 20_000:
                yield _counted(held)
                held = {}
        yield _counted(held)

    counts = outlined.select("host", "kind", "o").join(pilots, ["host", "kind"]).select("host", "kind", "o", "pilots").mapInArrow(align, "host string, kind string, slot string, same long, n long")
    template = counts.groupBy("host", "kind", "slot").agg(F.sum("same").alias("same"), F.sum("n").alias("n"))
    template = template.where((F.col("same") >= CONSTANT_SHARE * F.col("n")) & (~F.col("slot").startswith("#") | (F.col("same") >= LEAST)))
    template = saved(template.groupBy("host", "kind").agg(F.sort_array(F.collect_list("slot")).alias("template")))
    template = _small(template, F.octet_length(F.array_join("template", "")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                found = [framed(p) if p else (None, None) for p in part.column(3).to_pylist()]
                blocks_of = [x and json.dumps(x, separators=(",", ":"), ensure_ascii=False) for _, x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([x[0] for x in found], pa.string()), pa.array(blocks_of, pa.string())], names=["id", "url", "host", "kind", "blocks"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                texts = [text_of(json.loads(p), frozenset(t or ())) if p else "" for p, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    parts = hosted.select("id", "url", "host", "html").mapInArrow(split, f"id {kind}, url string, host string, kind string, blocks string")
    out = parts.join(template, ["host", "kind"], "left").select("id", "url", "blocks", "template")
    return out.mapInArrow(cut, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)


def _small(table: DataFrame, size) -> DataFrame:
    """The table, marked for a broadcast if its rows are few enough in bytes."""
    total = table.agg(F.sum(size + F.octet_length("host") + 64)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def _counted(held: dict[tuple[str, str, str], list[int]]) -> pa.RecordBatch:
    names = [pa.array([k[c] for k in held], pa.string()) for c in range(3)]
    return pa.RecordBatch.from_arrays([*names, *(pa.array([x[c] for x in held.values()], pa.int64()) for c in range(2))], names=["host", "kind", "slot", "same", "n"])
