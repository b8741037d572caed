import numpy as np
from pyspark.sql import functions as F

from scriptloom.llm.permutation_index import Pivots, nearest_neighbours, usable, visits
from scriptloom.llm.wrapper_induction import extract_main_text, matching, parse, skeleton

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, x[i].tolist()) for i in range(60)] + [(100, None), (101, [0.0] * 8), (102, [NAN] + [1.0] * 7), (103, [INF] * 8), (104, [None] + [1.0] * 7), (105, [1.0, 2.0]), (None, [1.0] * 8), (7, x[7].tolist())]
    df = frame(spark, rows)
    found = nearest_neighbours(df, df.filter(F.col("vec_id") % 20 == 0), k=5, index_rows=16, query_rows=2).collect()
    y = x.astype(np.float64)
    for q in (0, 20, 40):
        score = (y * y[q]).sum(1)
        best = sorted((i for i in range(60) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [(r.rank, r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [(n, i, score[i]) for n, i in enumerate(best, 1)]
    assert {r.query_id for r in found} == {0, 20, 40}
    assert nearest_neighbours(df.limit(0)).count() == 0


def test_recall_with_unequal_lengths(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64)) * rng.uniform(0.7, 1.3, (6000, 1))
    df = frame(spark, [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())])
    found = {}
    for r in nearest_neighbours(df, df.filter("vec_id % 200 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    y = x.astype(np.float32).astype(np.float64)
    hits = []
    for q in range(0, 6000, 200):
        score = y @ y[q]
        score[q] = -np.inf
        hits.append(len(found[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_clusters_and_copies_need_few_visits(spark):
    """A third of the vectors are copies of one; the others lie in clusters. Files of more than index_rows vectors are dealt out."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(80, 24))
    x = centers[rng.integers(80, size=3000)] + 0.15 * rng.normal(size=(3000, 24))
    x[::3] = x[0]
    x = x.astype(np.float32)
    df = frame(spark, [(i, v) for i, v in enumerate(x.tolist())])
    vectors = usable(df, "vec_id", "embedding")
    y = x.astype(np.float64)
    pivots = Pivots(y[:512], 128, np.sqrt((y * y).sum(1)).max() * (1 + 1e-12))
    assert visits(vectors, vectors.filter("vec_id % 100 = 0").collect(), pivots, 2, 20, 0.97) < 30
    found = {}
    for r in nearest_neighbours(df, df.filter("vec_id % 50 = 0"), index_rows=300, query_rows=7).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = []
    for q in range(0, 3000, 50):
        score = (y * y[q]).sum(1)
        best = sorted((i for i in range(3000) if i != q), key=lambda i: (-score[i], i))[:20]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21)) and all(g[2] == score[g[1]] for g in got)
        hits.append(len({g[1] for g in got} & set(best)) / 20)
    assert np.mean(hits) >= 0.9


def test_nothing_usable(spark):
    df = frame(spark, [(1, None), (2, [0.0, 0.0]), (3, [NAN, 1.0]), (None, [1.0, 1.0])])
    assert nearest_neighbours(df).columns == ["query_id", "rank", "vec_id", "score"]
    assert nearest_neighbours(df).count() == 0
    good = frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])])
    assert nearest_neighbours(good, df).count() == 0 and nearest_neighbours(df, good).count() == 0
    assert [(r.query_id, r.vec_id) for r in nearest_neighbours(good).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    assert nearest_neighbours(good.limit(1)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header>H</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar">side</div>{0}<section id="comments"><article class="comment">reader says</article></section><form><button>Go</button></form><footer>F</footer></body></html>"""


def test_article_of_odd_pages(spark):
    article = "<article><h1>Title &amp; more</h1><p>One <b>two</b>\n three<br>four<p>Five&nbsp;six<aside>advert</aside><ul><li>a<li>b</ul></article>"
    same = "<article><p>Share this page</p><p>Body {0} here</p></article>"
    rows = [(1, "http://x.org/a", PAGE.format(article)), (2, "http://y.org", None), (3, None, ""), (4, "not a url", "<p>bare <i>text</i> only"), (5, "http://x.org/b", "<main><div>in main</div></main>"), (None, "http://x.org/c", "<article>unclosed"), (1, "http://x.org/a", PAGE.format(article))]
    rows += [(100 + i, "https://t.example/p", PAGE.format(same.format(f"w{i}"))) for i in range(8)]
    found = {r.page_id: r for r in extract_main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string"), part_pages=3).collect()}
    assert found[1].text == "Title & more One two three four Five six a b" and found[1].n_chars == len(found[1].text)
    assert found[2].text == "" and found[3].text == "" and found[4].text == "bare text only" and found[5].text == "in main" and found[None].text == "unclosed"
    assert found[103].text == "Body w3 here"
    assert extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_copies_are_not_a_template(spark):
    rows = [(i, "https://t.example/p", "<article><p>The same article</p></article>") for i in range(30)]
    assert {r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()} == {"The same article"}


def test_tree_matching():
    a, b = (skeleton(parse(x)) for x in ("<body><div><p>1</p><p>2</p></div><ul><li>x</ul>", "<body><p>0</p><div><p>1</p></div><ul><li>x<li>y</ul>"))
    n, pairs = matching(a, b)
    assert n == 6 and len(pairs) == 6
