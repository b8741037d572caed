import itertools
import random
import time

import pytest

from scriptloom.llm.wrapper_induction import Node, clean, extract_main_text, main_part, matching, parse, ruled_out, skeleton, units


def test_each_layout_has_its_template(spark):
    kinds = ["<div class='a'><p>Fixed one</p><div><p>{0}</p></div></div>", "<section><div class='b'><p>Fixed two</p></div><p>{0}</p></section>", "<div><div><p>Fixed three</p><p>{0}</p></div></div>"]
    rows = [(100 * k + i, "http://h.org/x", f"<body>{page.format(f'Body w{k}x{i}')}</body>") for k, page in enumerate(kinds) for i in range(8)]
    rows += [(900, "http://h.org/odd", "<body><table><tr><td>Not found</td></tr></table></body>"), (901, "http://h.org/rare", "<body><div class='a'><p>Fixed one</p><div><p>Rare</p></div></div><div>Aside</div></body>")]
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), part_pages=5).collect()}
    assert [found[100 * k + 3] for k in range(3)] == [f"Body w{k}x3" for k in range(3)]
    assert found[900] == "Not found" and len(found) == 26


def text(page):
    return " ".join(t for top in main_part(parse(page)) for _, raw in units(top) if (t := clean(raw)))


def tree(rng, depth):
    node = Node("div", rng.choice("ab"), False)
    node.children = [tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    return node


def numbered(root):
    for i, x in enumerate(walk(root)):
        x.number = i
    return root


def walk(node):
    yield node
    for x in node.children:
        yield from walk(x)


def brute(a, b):
    """The most pairs, over all ways to pick children in order."""
    if a.label != b.label:
        return 0
    best = 0
    for k in range(min(len(a.children), len(b.children)) + 1):
        for x in itertools.combinations(a.children, k):
            for y in itertools.combinations(b.children, k):
                parts = [brute(u, v) for u, v in zip(x, y, strict=True)]
                best = max(best, sum(parts)) if all(parts) else best
    return best + 1


@pytest.mark.parametrize("seed", range(40))
def test_tree_matching_against_brute_force(seed):
    rng = random.Random(seed)
    a, b = numbered(tree(rng, 3)), numbered(tree(rng, 3))
    a.label = b.label = "r"
    n, pairs = matching(a, b)
    assert n == brute(a, b) == len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
    x, y = list(walk(a)), list(walk(b))
    assert all(x[i].label == y[j].label for i, j in pairs)
    assert all((i < k) == (j < m) for (i, j), (k, m) in itertools.combinations(pairs, 2))


def test_long_lists_and_deep_pages():
    start = time.time()
    a, b = (skeleton(parse("<ul>" + part * 20_000)) for part in ("<li>x<li><p>y</p>", "<li><p>x</p><li>z<li><div>q</div>"))
    n, pairs = matching(a, b)
    assert n == len(pairs) > 40_000
    assert matching(*(skeleton(parse("<div>" * n + "<p>x</p>")) for n in (100_000, 99_990)))[0] > 99_990
    assert text("<div>" * 100_000 + "deep" + "</b>" * 1000) == "deep"
    for broken in ("<a ", '<a "', "<a '", "<!-- ", "<script>", "<p", "</"):
        parse(broken * 50_000 + "<b>")
    assert time.time() - start < 60


def test_an_article_keeps_its_sections():
    page = """<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><h2 id="discussion">Discussion</h2><p id="notice-period">N</p><section class="related-work"><p>Work</p></section><section id="comments"><p>reader</p></section>
    <div class="share-buttons">share</div><aside>advert</aside><footer>by us</footer></article><footer>F</footer>"""
    assert text(page) == "Title Discussion N Work"
    assert [x for x in ("ad", "adBox", "cookie-notice", "col sidebar-left", "related-posts", "related-work", "address", "shadow", "notice-period", "header-image-story") if ruled_out(x)] == ["ad", "adBox", "cookie-notice", "col sidebar-left", "related-posts"]
