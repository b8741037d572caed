"""Main text of web pages by wrapper induction.

The pages of a host are grouped by layout (the paths of their containers, without the article's own elements), and those of a layout
are aligned with one page of it by simple tree matching. Nodes of that page whose text comes back unchanged on most of
the layout's pages are its template; slots whose text varies are content. What varies but is not the article by its
markup (menus, adverts, comments) is left out by role. Votes are counted over all pages; a page meets only its layout's
reference, and a layout's pages are spread over as many tasks as they fill.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts, text_of

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
HIDDEN = frozenset("head script style noscript template iframe svg math object embed nav header footer aside form button select option textarea input dialog menu title canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption dd dt li option optgroup tbody td tfoot th thead tr html body legend summary figcaption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
CONTAINERS = frozenset("body article center details div fieldset main section table td".split())
SCOPE = frozenset("ul ol dl table select body html div article section main aside nav footer header td th".split())
# Words of class and id attributes that mark what isn't article, and words that name a container of it.
ROLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs header footer masthead sidebar widget widgets related recommended recommendations share sharing social comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search pagination pager toolbar skip copyright".split()
)
BOX_WORDS = frozenset("site page main global top bottom left right inner outer box block area bar panel section wrap wrapper container content row col column list item items link links button buttons post posts article articles form thread count text title icon icons media unit slot label group holder side reader user policy".split())
ROLES = frozenset("navigation banner search form dialog alert alertdialog complementary contentinfo menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A tag whose attributes hold no < or >; what it doesn't match is read step by step.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>\"']*(?:(?:\"[^<>\"]*\"|'[^<>']*')[^<>\"']*)*)>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"""([^\s=\"'/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
COUNTED = frozenset({"p", "article"}.union(*CLOSES.values()))
TELLING = frozenset("class id role hidden aria-hidden style".split())
WHITE = re.compile(r"[ \t\n\r\f\v   -     　\x85]+")


class Node:
    __slots__ = ("boiler", "children", "label", "number", "shape", "size", "tag")

    def __init__(self, tag: str, label: str, boiler: bool) -> None:
        self.tag, self.label, self.boiler, self.children, self.number, self.shape, self.size = tag, label, boiler, [], -1, -1, 1


def ruled_out(value: str) -> bool:
    """Whether a class or id names a part that isn't article: one of its names consists of role words, or of these and words for
    boxes (`cookie-notice`, `share_buttons`; not `related-work`)."""
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = [w for w in re.split(r"[_\W]+|\d+", name) if w]
        if any(w in ROLE_WORDS for w in words) and all(w in ROLE_WORDS or w in BOX_WORDS for w in words):
            return True
    return False


def boilerplate(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """The label that must agree for nodes to match (tag and class), and whether the role rules the node out. Headings are never ruled
    out by name, nor is an article's own header."""
    out, label = tag in HIDDEN and not (tag == "header" and in_article), tag
    for name, value in ATTR.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name not in TELLING:
            continue
        if name in ("class", "id"):
            label += f".{value}" if name == "class" else ""
            if tag == "article":
                out |= bool(re.search(r"\b(?:comments?|repl(?:y|ies))\b", value, re.I))
            elif tag not in HEADINGS and tag not in ("html", "body", "main", "header"):
                out |= ruled_out(value)
        elif name == "role":
            out |= value.lower() in ROLES and tag not in ("html", "body", "main", "article")
        else:
            out |= name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(re.search(r"display\s*:\s*none", value, re.I))
    return label, out


@lru_cache(1 << 14)
def opening(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """boilerplate() of short attributes, which repeat."""
    return boilerplate(tag, attributes, in_article)


def parse(page: str) -> Node:
    """The tree of a page; texts are children of type str. Unclosed elements end where a browser would about end them. The time is linear
    in the page's length, also where tags, quotes or comments are never closed, but for end tags that no element nearby has."""
    root = Node("#root", "#root", False)
    stack, opened, find, match = [root], dict.fromkeys(COUNTED, 0), page.find, TAG.match
    begin, at, size, closed = 0, 0, len(page), {'"': True, "'": True}

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    while (at := find("<", at)) >= 0:
        if m := match(page, at):
            end_tag, tag, attributes = m.groups()
            to = m.end()
        elif page.startswith("<!--", at):
            to, end_tag, tag = find("-->", at + 4), "", ""
            to = size if to < 0 else to + 3
        elif find(">", at) < 0:
            break
        elif page.startswith(("<!", "<?"), at):
            to, end_tag, tag = find(">", at) + 1, "", ""
        elif m := NAME.match(page, at):
            to = m.end()
            while (x := STOP.search(page, to)) and x[0] != ">":
                quote = find(x[0], x.end()) if closed[x[0]] else -1
                closed[x[0]] &= quote >= 0
                to = quote + 1 if quote >= 0 else x.end()
            if x is None:
                break
            end_tag, tag, attributes, to = m[1], m[2], page[m.end() : x.start()], x.end()
        else:
            at += 1
            continue
        if at > begin:
            stack[-1].children.append(page[begin:at])
        at = begin = to
        if not tag:
            continue
        tag = tag.lower()
        if end_tag:
            if stack[-1].tag == tag:
                opened[tag] -= 1
                stack.pop()
                continue
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("article", "main", "body", "td", "th") and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in CLOSES and any(opened[x] for x in CLOSES[tag]) else ():
            if stack[i].tag in CLOSES[tag]:
                close(i)
                break
            if stack[i].tag in SCOPE:
                break
        label, boiler = opening(tag, attributes, opened["article"] > 0) if len(attributes) < 200 else boilerplate(tag, attributes, opened["article"] > 0)
        node = Node(tag, label, boiler)
        stack[-1].children.append(node)
        if tag in RAW:
            shut = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            node.children.append(page[at : shut.start() if shut else size])
            at = begin = shut.end() if shut else size
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    if begin < size:
        stack[-1].children.append(page[begin:])
    return root


def units(node: Node) -> Iterator[tuple[Node, str]]:
    """(block, text) of a tree in page order: text that directly belongs to one block element, between its inner blocks."""
    parts: list[str] = []
    stack = [(node, iter(node.children))]  # open elements; the text collected belongs to the innermost block of these
    blocks = [node]
    while stack:
        inside, rest = stack[-1]
        for x in rest:
            if isinstance(x, str):
                parts.append(x)
            elif x.boiler or x.tag == "br":
                parts.append(" ")
            else:
                if x.tag in BLOCK:
                    yield blocks[-1], "".join(parts)
                    parts.clear()
                    blocks.append(x)
                stack.append((x, iter(x.children)))
                break
        else:
            stack.pop()
            if inside.tag in BLOCK and inside is not node:
                yield blocks.pop(), "".join(parts)
                parts.clear()
    yield node, "".join(parts)


def clean(text: str) -> str:
    return WHITE.sub(" ", html.unescape(text) if "&" in text else text).strip(" ")


def skeleton(node: Node) -> Node:
    """A tree of block elements only, numbered in page order, for matching."""
    root = Node("#root", "#root", False)
    root.number = node.number = count = 0
    stack = [(root, iter(node.children))]
    while stack:
        own, rest = stack[-1]
        for x in rest:
            if isinstance(x, str) or x.boiler:
                continue
            into = own
            if x.tag in BLOCK:
                into = Node(x.tag, x.label, False)
                into.number = x.number = count = count + 1
                own.children.append(into)
            stack.append((into, iter(x.children)))
            break
        else:
            stack.pop()
    return root


def in_order(root: Node) -> list[Node]:
    """The nodes of a skeleton, parents first, in page order."""
    made, todo = [], [root]
    while todo:
        made.append(node := todo.pop())
        todo += reversed(node.children)
    return made


def measure(root: Node, known: dict[tuple, int]) -> Node:
    """Gives each node of a skeleton its size and the number of its shape; equal subtrees have equal numbers."""
    for node in reversed(in_order(root)):
        node.size = 1 + sum(x.size for x in node.children)
        node.shape = known.setdefault((node.label, *(x.shape for x in node.children)), len(known))
    return root


def mark_of(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def layout(root: Node) -> tuple[int, int]:
    """Hashes of the paths of a page's containers, and of those of its outer three levels: pages of one layout agree in the first
    whatever their articles hold, as what lies in an article or main element doesn't count."""
    paths: set[str] = set()
    outer: set[str] = set()
    todo = [(root, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        for x in node.children:
            if isinstance(x, str) or x.boiler:
                continue
            own = x.tag in CONTAINERS
            at = f"{path}/{x.label}" if own else path
            if own:
                paths.add(at)
                if depth < 3:
                    outer.add(at)
            if x.tag not in ("article", "main"):
                todo.append((x, at, depth + own))
    return mark_of("\n".join(sorted(paths))), mark_of("\n".join(sorted(outer)))


def even(x: list[Node], y: list[Node], same, reach: int = 50) -> list[tuple[int, int]]:
    """Pairs of two long lists in order, each with the next that is the same, at most `reach` further on."""
    pairs, j = [], 0
    for i in range(len(x)):
        for k in range(j, min(j + reach, len(y))):
            if same(x[i], y[k]):
                pairs.append((i, k))
                j = k + 1
                break
    return pairs


def matching(a: Node, b: Node, most_cells: int = 40_000) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most pairs of nodes with equal labels that keep order and ancestry, and those pairs.

    Equal subtrees at the ends of two child lists are paired at once, which loses nothing, as they can't count for more elsewhere. What
    is left of two lists is aligned by the table of the method, or, where that has more than most_cells cells, in order, with the
    best counterpart near by; so no node is left out for length and the cost stays in proportion. No recursion, so any depth goes."""
    if a.label != b.label:
        return 0, []
    known: dict[tuple, int] = {}
    measure(a, known)
    measure(b, known)
    problems: list[tuple] = []  # (a, b, pairs of equal subtrees, the rest of both lists, pairs chosen in order or None)
    todo, cells = [(a, b)], 0
    while todo:
        p, q = todo.pop()
        x, y, equal = p.children, q.children, []
        if p.shape == q.shape:
            problems.append((p, q, None, (), (), None))
            continue
        i, m, n = 0, len(x), len(y)
        while i < min(m, n) and x[i].shape == y[i].shape:
            equal.append((x[i], y[i]))
            i += 1
        while min(m, n) > i and x[m - 1].shape == y[n - 1].shape:
            m, n = m - 1, n - 1
            equal.append((x[m], y[n]))
        x, y, chosen = x[i:m], y[i:n], None
        cells += len(x) * len(y)
        if len(x) * len(y) > most_cells or cells > 20 * most_cells:
            chosen, i, j = [], 0, 0
            for u, v in [*even(x, y, lambda u, v: u.shape == v.shape), (len(x), len(y))]:  # equal subtrees first, then between them
                chosen += [(i + s, j + t) for s, t in even(x[i:u], y[j:v], lambda u, v: u.label == v.label)]
                chosen += [(u, v)] if u < len(x) else []
                i, j = u + 1, v + 1
            todo += [(x[u], y[v]) for u, v in chosen]
        else:
            todo += [(u, v) for u in x for v in y if u.label == v.label]
        problems.append((p, q, equal, x, y, chosen))
    weight: dict[tuple[int, int], int] = {}
    picked: dict[tuple[int, int], list[tuple[Node, Node]]] = {}
    for p, q, equal, x, y, chosen in reversed(problems):
        key = (id(p), id(q))
        if equal is None:
            weight[key] = p.size
            continue
        total = 1 + sum(u.size for u, _ in equal)
        if chosen is not None:
            pairs = [(x[u], y[v]) for u, v in chosen]
            total += sum(weight[id(u), id(v)] for u, v in pairs)
        else:
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i, u in enumerate(x):
                row, above = best[i + 1], best[i]
                for j, v in enumerate(y):
                    row[j + 1] = max(above[j + 1], row[j], above[j] + weight[id(u), id(v)] if u.label == v.label else 0)
            total += best[-1][-1]
            pairs, i, j = [], len(x), len(y)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((x[i], y[j]))
        weight[key], picked[key] = total, pairs + equal
    out, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        if p.shape == q.shape:
            out += [(u.number, v.number) for u, v in zip(in_order(p), in_order(q), strict=True)]
        else:
            out.append((p.number, q.number))
            todo += picked[id(p), id(q)]
    return weight[id(a), id(b)], out


def main_part(root: Node) -> list[Node]:
    """The outermost article or main elements that aren't ruled out, or the whole page."""
    found: list[Node] = []
    todo = [root]
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main"):
            found.append(x)
        else:
            todo += [y for y in reversed(x.children) if not isinstance(y, str) and not y.boiler]
    return [y for x in found for y in (articles(x) or [x] if x.tag == "main" else [x])] if found else [root]


def articles(main: Node) -> list[Node]:
    found: list[Node] = []
    todo = list(reversed(main.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.boiler:
            continue
        if x.tag == "article":
            found.append(x)
        else:
            todo += reversed(x.children)
    return found


class Aligner:
    """Pages against the reference of their layout. Structures repeat, so what was matched once is kept, for some pages' worth."""

    def __init__(self, most: int = 2000) -> None:
        self.references: dict[str, tuple[Node, bytes, dict[int, str]]] = {}
        self.found: dict[tuple[bytes, bytes], dict[int, int]] = {}
        self.most = most

    @staticmethod
    def shape(root: Node) -> bytes:
        """A digest of the labels and the sizes of all child lists in page order, which determine the tree."""
        return blake2b("\n".join(f"{len(x.children)} {x.label}" for x in in_order(root)).encode("utf-8", "replace"), digest_size=16).digest()

    @staticmethod
    def texts(root: Node) -> dict[int, str]:
        made: dict[int, list[str]] = {}
        for block, text in units(root):
            made.setdefault(block.number, []).append(text)
        return {k: clean(" ".join(v)) for k, v in made.items()}

    def reference(self, page: str) -> tuple[Node, bytes, dict[int, str]]:
        if page not in self.references:
            if len(self.references) >= self.most:
                self.references.clear()
            root = parse(page)
            bones = skeleton(root)
            self.references[page] = bones, self.shape(bones), self.texts(root)
        return self.references[page]

    def align(self, root: Node, page: str) -> dict[int, int]:
        """The number of the reference's node for each block of the page."""
        bones, shape, _ = self.reference(page)
        own = skeleton(root)
        key = (own_shape := self.shape(own)), shape
        if own_shape == shape:
            return {}
        if key not in self.found:
            if len(self.found) >= self.most:
                self.found.clear()
            self.found[key] = dict(matching(own, bones)[1])
        return self.found[key]


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 5, share: float = 0.6, part_pages: int = 5000) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row: the page's article, blocks joined by one space.

    Template: blocks whose text is the same as in the layout's reference page on at least `share` of the layout's pages, with
    least_pages or more that differ; equal pages count once, and the article's own blocks are
    template only where other blocks of it vary. A layout of fewer pages takes the template of the host's most frequent layout
    with the same outer containers, or else of its most frequent one; where no layout of a host has least_pages, all of the
    host's pages vote on the most frequent. Null html: empty text. Null and malformed urls share one host. Null ids
    and repeated rows are kept. A page without any article has the rest of its body. An empty table gives no rows; other
    columns are ignored. A page is one row, so memory follows the longest page and its layout's reference. The hashes of the
    reference pages, one per layout of least_pages, go through the driver.
    """
    n_parts = parts(pages.count(), part_pages)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.withColumn("mark", F.xxhash64("html")).withColumn("part", F.pmod("mark", F.lit(n_parts)))

    def lay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layout(parse(page.as_py())) for page in batch.column("html")]
            rest = [(n, batch.column(n)) for n in batch.schema.names if n != "html" or "page_id" in batch.schema.names]
            columns = [*rest, ("layout", pa.array([x[0] for x in found], pa.int64())), ("outer", pa.array([x[1] for x in found], pa.int64()))]
            yield pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])

    seen = cut(rows.filter(F.col("html") != "").select("host", "mark", "part", "html").mapInArrow(lay, "host string, mark bigint, part bigint, layout bigint, outer bigint").distinct())
    layouts = seen.groupBy("host", "layout", "outer").agg(F.countDistinct("mark").alias("n"), F.min("mark").alias("first"))
    near = layouts.filter(F.col("n") >= least_pages).groupBy("host", "outer").agg(F.max_by("layout", F.struct("n", "layout")).alias("_near"))
    most = layouts.groupBy("host").agg(F.max(F.struct("n", "layout")).alias("_most"))
    frequent = F.col("n") >= least_pages
    target = F.when(frequent, F.col("layout")).otherwise(F.coalesce("_near", "_most.layout"))
    # pages of a rare layout have no vote on the template that they borrow
    chosen = layouts.join(near, ["host", "outer"], "left").join(most, "host").select("host", "layout", target.alias("target"), (frequent | (F.col("_most.n") < least_pages)).alias("votes"))
    first = chosen.select("host", F.col("target").alias("layout")).distinct().join(layouts.groupBy("host", "layout").agg(F.min("first").alias("mark")), ["host", "layout"])
    reference = rows.select("host", "mark", "html").join(F.broadcast(first), ["host", "mark"]).groupBy("host", F.col("layout").alias("target")).agg(F.min("html").alias("reference"))
    # a layout's pages go to as many tasks as they fill, each with a copy of the reference
    spread = seen.select("host", "layout", "part").distinct().join(chosen, ["host", "layout"]).join(reference, ["host", "target"])
    rows = rows.select("page_id", "url", "html", "host", "part").mapInArrow(lay, "page_id bigint, url string, html string, host string, part bigint, layout bigint, outer bigint").drop("outer")

    def vote(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner()
        for batch in batches:
            out = []
            for host, page, reference, target, votes in zip(batch["host"], batch["html"], batch["reference"], batch["target"], batch["votes"], strict=True):
                if not page or reference is None or votes != "y":
                    continue
                root = parse(page)
                known = aligner.reference(reference)[2]
                places = aligner.align(root, reference)
                texts = aligner.texts(root)
                same = [to for number, text in texts.items() if text and known.get(to := places.get(number, number) if places else number) == text]
                out.append((host, target, mark_of(page), [-1, *same]))
            yield pd.DataFrame(out, columns=["host", "target", "mark", "same"])

    # as texts, since the column has nulls
    both = rows.join(spread.withColumn("target", F.col("target").cast("string")).withColumn("votes", F.when(F.col("votes"), "y")), ["host", "layout", "part"], "left")
    votes = both.select("host", "html", "reference", "target", "votes", "page_id", "url").mapInPandas(vote, "host string, target string, mark bigint, same array<int>")
    # both joins keep all rows, so that their exchange of pages is one; node -1 stands for the page itself
    counts = votes.select("host", "target", "mark", F.explode("same").alias("node")).distinct().groupBy("host", "target", "node").agg(F.count(F.lit(1)).alias("n"))
    per_layout = counts.groupBy("host", "target").agg(F.max(F.when(F.col("node") == -1, F.col("n"))).alias("n_pages"), F.collect_list(F.struct("node", "n")).alias("nodes"))
    fixed = F.transform(F.filter("nodes", lambda x: (x["node"] >= 0) & (x["n"] >= share * F.col("n_pages"))), lambda x: x["node"])
    template = per_layout.filter(F.col("n_pages") >= least_pages).select("host", F.col("target").cast("long").alias("target"), fixed.alias("template"))

    def extract(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner()
        for batch in batches:
            texts = []
            for page, reference, template in zip(batch["html"], batch["reference"], batch["template"], strict=True):
                root = parse(page)
                fixed: set[int] = set()
                if template is not None and len(template) and reference:
                    places, own = aligner.align(root, reference), set(map(int, template))
                    known = aligner.reference(reference)[2]
                    fixed = {number for number, text in aligner.texts(root).items() if (to := places.get(number, number) if places else number) in own and known.get(to) == text}
                parts = [(block.number, text) for top in main_part(root) for block, raw in units(top) if (text := clean(raw))]
                kept = [text for number, text in parts if number not in fixed]
                texts.append(" ".join(kept or [text for _, text in parts] if fixed and not kept else kept))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})

    known = spread.join(template, ["host", "target"], "left")
    found = rows.join(known, ["host", "layout", "part"], "left").select("page_id", "url", "html", "reference", "template").mapInPandas(extract, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
