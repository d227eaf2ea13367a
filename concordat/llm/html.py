"""Main text of web pages by wrapper induction.

Every page becomes a tree of its block elements with its runs of text as leaves; regions that by their tag or by a whole class,
id or role are no part of an article (menus, footers, sidebars, forms, adverts, notices, comments ...) are left out, but for forms and
named regions that hold the page's main article.  Where a page marks its article only that is read, unless it has under ``MARKED`` of the
text that is no template.  For each host one page is the pattern: of those with the most leaves that half of the host's distinct
pages have, by path and text, the shortest.  Simple tree matching aligns all pages of the host with it.  A leaf of the pattern
is template if nearly all distinct pages that have a leaf in its place, and half of the pages that have any, have the same text there;
every other leaf is content, and so is every leaf within a marked article.

The pattern of a host goes to its pages by a broadcast if all patterns together are under ``BROADCAST_BYTES``,
and else by a join that Spark may split where one host holds very many pages.

Defined results: null or empty html gives an empty text; a null url is a host of its own; markup that
is never closed is read to the end; repeated rows get equal texts; other columns are kept, but for one of the text's name, which
the text replaces; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import without
from concordat.llm.urls import host_of
from concordat.operators.graph import cut

#: A leaf is template if it is the same on this share of the distinct pages that have a leaf there, on this share of a host's pages, and on so many.
SHARE, SPREAD, PAGES = 0.8, 0.5, 2
#: A marked article with less of a page's text than this is not the whole of it.
MARKED = 0.5
BROADCAST_BYTES = 8 << 20
#: Elements nested deeper count as part of the one above, but for articles and the outermost region that may be left out.
DEPTH = 60

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
# Elements of HTML by what they mean for the text.
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset(
    "head script style textarea title noscript iframe xmp noframes template nav footer aside menu dialog button select "
    "option datalist svg math canvas object audio video map".split()
)
BLOCK = frozenset(
    "html body article main section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr caption "
    "figure figcaption address details summary hr center fieldset hgroup".split()
)
ENDS_P = BLOCK - frozenset("html body li dt dd tr thead tbody tfoot caption summary figcaption".split())
OWN_END = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "p": BLOCK - {"p"}}
# Words of class, id or role that name a region outside the article.
OUTSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs footer sidebar aside widget widgets related recommended comment comments commentlist reply replies respond "
    "disqus notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social toolbar pagination pager complementary contentinfo copyright disclaimer".split()
)
HEADERS = frozenset("header masthead topbar".split())
# Words that say nothing of a region beside one of the above, as in sidebar-left or related-posts.
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons col column container content footer form group header inner item items js left links list "
    "main outer page panel post posts primary right row secondary section site slot global top unit wrap wrapper articles stories".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("article", "children", "label", "soft", "text")

    def __init__(self, label: str, text: str = ""):
        self.label, self.text, self.children, self.article, self.soft = label, text, [], False, False


def _names(attributes: str) -> list[set[str]]:
    """The words of each class, id and role."""
    found = " ".join(a or b or c for _, a, b, c in _NAMED.findall(attributes))
    return [set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())) - {""} for x in found.split()]


def _is(names: list[set[str]], kind: frozenset[str]) -> bool:
    """Whether a whole name is of the kind: has a word of it, and others of it or neutral ones only."""
    return any(words & kind and all(w in kind or w in NEUTRAL or w.isdigit() for w in words) for words in names)


def parse(page: str) -> Node:
    """The tree of a page's article: block elements, and runs of text as leaves of the label ``#``."""
    root = parse_whole(page)
    root.children = chosen(root, set())
    return root


def weight(nodes: list[Node], drop: set[int]) -> int:
    return sum(len(x.text) for node in nodes for x in leaves(node) if id(x) not in drop)


def articles(node: Node) -> list[Node]:
    """The outermost marked articles."""
    found, todo = [], [node]
    while todo:
        node = todo.pop()
        if node.article:
            found.append(node)
        else:
            todo += reversed(node.children)
    return found


def chosen(root: Node, drop: set[int]) -> list[Node]:
    """The parts of a page to read: its marked articles if they hold enough of the text beside the leaves in drop, and else all of it."""
    marked = [x for x in articles(root) if weight([x], drop)]
    return marked if marked and weight(marked, drop) >= MARKED * weight([root], drop) else root.children


def _without_soft(root: Node) -> None:
    """Takes out the regions that may be left out, but for one that holds the main article."""

    def outside(node: Node, keep: set[int]) -> None:
        todo = [node]
        while todo:
            node = todo.pop()
            node.children = [x for x in node.children if not x.soft or id(x) in keep]
            todo += node.children

    paths, todo, soft = [], [(root, ())], False
    while todo:
        node, above = todo.pop()
        soft = soft or node.soft
        if node.article:
            paths.append((node, above))
        else:
            todo += [(x, (*above, x)) for x in node.children]
    if not soft and not any(any(x.soft for x in _below(a)) for a, _ in paths):
        return

    def kept(node: Node) -> int:
        """The text of node outside of soft regions."""
        return len(node.text) + sum(kept(x) for x in node.children if not x.soft)

    held = [(kept(a), [x for x in above if x.soft]) for a, above in paths]
    most = max(held, key=lambda x: x[0], default=(0, []))
    rest = kept(root)
    outside(root, {id(x) for x in most[1]} if most[1] and most[0] > rest else set())


def _below(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += node.children


def parse_whole(page: str) -> Node:
    """The tree of a page without regions outside of the article; marked articles are told by ``article``."""
    root = Node("root")
    # an open element: (tag, node that its text goes to, whether it is left out, whether it is in an article)
    stack: list[tuple[str, Node, bool, bool]] = [("", root, False, False)]
    words: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if text:
            stack[-1][1].children.append(Node("#", text))

    def close(index: int) -> None:
        flush()
        del stack[index:]

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if not stack[-1][2]:
            words.append(page[at : found.start() if found else size])
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        ends, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if ends:
            index = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if index:
                close(index)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1][2]:
                words.append(" ")  # other empty elements, such as img or wbr, part no word
            continue
        if tag in ("td", "th"):
            words.append(" ")
        if tag not in BLOCK and tag not in LEFT_OUT and tag != "form" and not attributes:
            continue
        if tag == "p" or tag in ENDS_P:
            index = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in BLOCK), 0)
            if index and stack[index][0] == "p":
                close(index)
        elif tag in OWN_END:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in OWN_END[tag]:
                    break
                if stack[i][0] == tag or {tag, stack[i][0]} == {"dt", "dd"}:
                    close(i)
                    break
        _, node, out, inside = stack[-1]
        names = _names(attributes) if attributes and tag not in HEADINGS else []
        article = tag in ("article", "main") or tag == "div" and _is(names, frozenset(("main",)))
        top = tag in ("html", "body", "article", "main")
        soft = tag == "form" or _is(names, OUTSIDE) and (not top or tag == "article" and inside)
        out = (
            out
            or tag in LEFT_OUT
            or (tag == "header" or _is(names, HEADERS)) and not inside and not top
            or bool(attributes) and bool(_HIDDEN.search(attributes))
        )
        if tag in BLOCK or out or soft:
            flush()
            # deeper than that, a region that may be left out and the article have nodes still, so that depth drops nothing
            if not out and (len(stack) < DEPTH or soft and not node.soft or article and not inside):
                child = Node(tag)
                child.article, child.soft = article and not inside, soft
                node.children.append(child)
                node = child
            stack.append((tag, node, out, inside or article))
    close(1)
    flush()
    _without_soft(root)
    return root


def leaves(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        if node.label == "#":
            yield node
        todo += reversed(node.children)


class _Matcher:
    """Simple tree matching of two trees.

    How well two subtrees match depends on their labels and on texts that both have, so that it is found once for subtrees which are alike in that.
    A shape is a subtree's labels with those of the shared texts that are frequent; two subtrees that share no other text match as their shapes do.
    Subtrees that share a rare text are told by classes, which hold all shared texts, and a rare text is in few of them.
    A row of the table over two lists of children is made by array operations from the row above; only every so many rows are kept, and those
    between are made again on the way back.
    """

    def __init__(self, a: Node, b: Node) -> None:
        here, there = Counter(x.text for x in leaves(a)), Counter(x.text for x in leaves(b))
        rare = math.isqrt(there.total()) + 16
        self.token = {text: k for k, text in enumerate(sorted(here.keys() & there.keys()))}
        self.often = {k for text, k in self.token.items() if there[text] > rare}
        self.numbers: dict[tuple, int] = {}
        #: (shape, class, rare shared texts) of a subtree
        self.kind: dict[int, tuple[int, int, frozenset[int]]] = {}
        self.by_shape: dict[tuple[int, int], int] = {}
        self.by_class: dict[tuple[int, int], int] = {}
        for root in (a, b):
            self._classify(root)

    def _classify(self, root: Node) -> None:
        todo, order = [root], []
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.children
        for node in reversed(order):
            below = [self.kind[id(x)] for x in node.children]
            token = self.token.get(node.text, -1) if node.label == "#" else -1
            often = token if token in self.often else -1
            shape = self.numbers.setdefault((node.label, often, *(k[0] for k in below)), len(self.numbers))
            whole = self.numbers.setdefault((node.label, token, None, *(k[1] for k in below)), len(self.numbers))
            tokens = frozenset().union(*(k[2] for k in below), () if token == often else (token,))
            self.kind[id(node)] = shape, whole, tokens

    def size(self, x: Node, y: Node, plain: bool = False) -> int:
        """The size of the largest match; plain: as if rare texts were not shared."""
        if x.label != y.label:
            return 0
        (shape_x, class_x, tokens_x), (shape_y, class_y, tokens_y) = self.kind[id(x)], self.kind[id(y)]
        plain = plain or tokens_x.isdisjoint(tokens_y)
        known, key = (self.by_shape, (shape_x, shape_y)) if plain else (self.by_class, (class_x, class_y))
        if key not in known:
            if x.label == "#":
                same = self.token.get(x.text, -1)
                known[key] = 1 + (x.text == y.text and (not plain or same in self.often))
            elif not x.children or not y.children:
                known[key] = 1
            elif len(x.children) == len(y.children) == 1:
                known[key] = 1 + self.size(x.children[0], y.children[0], plain)
            else:
                row = None
                for row in self._rows(x.children, y.children, plain):  # noqa: B007
                    pass
                known[key] = 1 + int(row[-1])
        return known[key]

    def _sizes(self, xs: list[Node], ys: list[Node], plain: bool = False) -> Iterator[np.ndarray]:
        """For each of xs its sizes with ys: by shape, and anew where a rare text is shared."""
        shapes = np.array([self.kind[id(y)][0] for y in ys])
        _, some, inverse = np.unique(shapes, return_index=True, return_inverse=True)
        held: dict[int, list[int]] = {}
        for j, y in enumerate(() if plain else ys):
            for token in self.kind[id(y)][2]:
                held.setdefault(token, []).append(j)
        known: dict[int, np.ndarray] = {}  # by shape, the sizes with one of each shape of ys
        for x in xs:
            shape, _, tokens = self.kind[id(x)]
            if shape not in known:
                known[shape] = np.array([self.size(x, ys[k], True) for k in some], np.int32)
            row = known[shape][inverse]
            for j in {j for token in tokens for j in held.get(token, ())}:
                row[j] = self.size(x, ys[j])
            yield row

    def _rows(self, xs: list[Node], ys: list[Node], plain: bool = False) -> Iterator[np.ndarray]:
        row = np.zeros(len(ys) + 1, np.int32)
        yield row
        for sizes in self._sizes(xs, ys, plain):
            row = _next(row, sizes)
            yield row

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The pairs of leaves of the largest match of two trees."""
        found, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            if x.label != y.label:
                continue
            if x.label == "#":
                found.append((x, y))
            elif len(x.children) == len(y.children) == 1:
                todo.append((x.children[0], y.children[0]))
            elif x.children and y.children:
                todo += self._children(x.children, y.children)
        return found

    def _children(self, xs: list[Node], ys: list[Node]) -> Iterator[tuple[Node, Node]]:
        step = math.isqrt(len(xs)) + 1
        kept = [row for i, row in enumerate(self._rows(xs, ys)) if i % step == 0]
        j = len(ys)
        for block in range(len(kept) - 1, -1, -1):
            rows = [kept[block]]
            for sizes in self._sizes(xs[block * step : (block + 1) * step], ys):
                rows.append(_next(rows[-1], sizes))
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield xs[block * step + i], ys[j]


def _next(above: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The table's row under above: the best of leaving out either child, and of matching the two."""
    row = np.empty_like(above)
    row[0] = 0
    np.maximum.accumulate(np.maximum(above[1:], above[:-1] + sizes), out=row[1:])
    return row


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: (size of the largest top-down, order-keeping match, its pairs of leaves)."""
    matcher = _Matcher(a, b)
    return matcher.size(a, b), matcher.pairs(a, b)


def paths(node: Node) -> list[int]:
    """The distinct leaves of a tree, each a hash of its labels from the root and its text."""
    found, todo = set(), [(node, "")]
    while todo:
        node, path = todo.pop()
        if node.label == "#":
            found.add(xxhash.xxh64_intdigest(f"{path}\0{node.text}") >> 1)
        todo += [(child, f"{path}/{child.label}") for child in node.children]
    return sorted(found)


def patterns(pages: DataFrame, html: str) -> DataFrame:
    """(host, pattern): the page of each host with most of the leaves that its pages share; of equal ones the shortest."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [paths(parse_whole(page.as_py())) for page in batch.column(3)]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_host", "id", "size", "leaves"])

    some = pages.where(F.length(html) > 0).withColumn("_id", F.xxhash64(html))
    seen = cut(some.select("_host", "_id", F.length(html), html).mapInArrow(listed, "_host string, id long, size int, leaves array<long>").distinct())
    sizes = seen.where(F.size("leaves") > 0).groupBy("_host").agg(F.count("*").alias("pages"))
    counted = seen.select("_host", F.explode("leaves").alias("leaf")).groupBy("_host", "leaf").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    common = counted.join(sizes, "_host").where(F.col("n") >= SPREAD * F.col("pages")).select("_host", "leaf")
    scores = seen.select("_host", "id", "size", F.explode("leaves").alias("leaf")).join(common, ["_host", "leaf"]).groupBy("_host", "id", "size").agg(F.count("*").alias("score"))
    best = scores.groupBy("_host").agg(F.min(F.struct((-F.col("score")).alias("score"), "size", "id")).alias("b")).select("_host", F.col("b.id").alias("_id"))
    best = cut(best)
    # one row a host: broadcast, so that the pages are not shuffled
    best = F.broadcast(best) if (best.agg(F.sum(F.octet_length("_host") + 8)).first()[0] or 0) <= BROADCAST_BYTES else best
    order = F.struct(F.length(html), F.col("_id"), F.col(html))
    return some.join(best, ["_host", "_id"], "left_semi").groupBy("_host").agg(F.min(order)[html].alias("_pattern"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", name: str = "text") -> DataFrame:
    """Adds the main text: its blocks in page order, joined by an empty line."""
    kept = without(pages, name)
    hosted = pages.select(*kept, host_of(F.col(url)).alias("_host"))
    found = cut(patterns(hosted, html))
    size = found.agg(F.coalesce(F.sum(F.octet_length("_pattern") + F.octet_length("_host")), F.lit(0))).first()[0]

    def given(right: DataFrame) -> DataFrame:
        return hosted.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, "_host", "left")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in batches:
            rows = []
            for host, page, pattern in zip(*(batch.column(i) for i in range(3)), strict=True):
                pattern = pattern.as_py()
                tree, model = parse_whole(page.as_py() or ""), known.get(pattern)
                if model is None:
                    model = known[pattern] = parse_whole(pattern)
                pairs = align(model, tree)[1]
                met, same = {id(x) for x, _ in pairs}, {id(x) for x, y in pairs if x.text == y.text}
                text = "\n\n".join(x.text for x in leaves(tree))
                slots = [k if id(x) in same else -1 - k for k, x in enumerate(leaves(model)) if id(x) in met]
                rows.append((host.as_py(), xxhash.xxh64_intdigest(text) >> 1, slots))
                if len(known) > 256:
                    known.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], ["_host", "page", "slots"]
            )

    # a slot of the pattern that a page has: its number where the text is the same, and else -1 less the number
    looked = given(found).where("_pattern is not null").select("_host", html, "_pattern").mapInArrow(seen, "_host string, page long, slots array<int>")
    distinct = cut(looked.groupBy("_host", "page").agg(F.min("slots").alias("slots")).where(F.size("slots") > 0))
    sizes = distinct.groupBy("_host").agg(F.count("*").alias("pages"))
    told = distinct.select("_host", F.explode("slots").alias("s")).select("_host", F.when(F.col("s") < 0, -1 - F.col("s")).otherwise(F.col("s")).alias("slot"), (F.col("s") >= 0).alias("same"))
    fixed = told.groupBy("_host", "slot").agg(F.count_if("same").alias("n"), F.count("*").alias("met")).where((F.col("n") >= PAGES) & (F.col("n") >= SHARE * F.col("met")))
    fixed = fixed.join(sizes, "_host").where(F.col("n") >= SPREAD * F.col("pages"))
    templates = found.join(fixed.groupBy("_host").agg(F.sort_array(F.collect_set("slot")).alias("_fixed")), "_host")

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField(name, T.StringType())])
    page_at = kept.index(html)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, pattern, slots in zip(batch.column(page_at), batch.column(len(kept)), batch.column(len(kept) + 1), strict=True):
                tree, drop = parse_whole(page.as_py() or ""), set()
                if fixed := set(slots.as_py() or ()):
                    model = parse_whole(pattern.as_py())
                    wanted = {id(x) for k, x in enumerate(leaves(model)) if k in fixed}
                    own = {id(x) for part in articles(tree) for x in leaves(part)}
                    drop = {id(y) for x, y in align(model, tree)[1] if id(x) in wanted and x.text == y.text and id(y) not in own}
                texts.append("\n\n".join(x.text for part in chosen(tree, drop) for x in leaves(part) if id(x) not in drop))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], schema.names)

    return given(templates).select(*kept, "_pattern", "_fixed").mapInArrow(read, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
