"""Knowledge pages: validity, main text, titles, crawl table, excerpts, digests, usage."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as T
from ..plans.keep import kept
from .chunking import word_windows
from .matching import cosine
from .postings import parts_of, posted, shared_words


def with_validity(pages: DataFrame) -> DataFrame:
    """Adds is_valid and error: scheme and host must both be there."""
    ok = (F.coalesce(F.try_parse_url("url", F.lit("PROTOCOL")), F.lit("")) != "") & (F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")) != "")
    return pages.withColumns({"is_valid": ok, "error": F.when(~ok, F.concat(F.lit("Invalid URL: "), F.coalesce("url", F.lit(""))))})


class _Text(HTMLParser):
    """Text of the parts of a page by container: main, article, content divs, body."""

    OUT = {"script", "style", "nav", "footer", "header", "aside"}  # noqa: RUF012

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []
        self.hidden, self.found, self.title, self.done = 0, {"main": [], "article": [], "div": [], "body": []}, [], set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "img", "meta", "link", "hr", "input", "source", "area", "base", "col", "embed", "track", "wbr"):
            return
        kind = tag if tag in ("main", "article", "body") else "div" if tag == "div" and re.search("content|main|article", dict(attrs).get("class") or "", re.I) else None
        if kind and (kind in self.done or any(k == kind for _, k in self.stack)):
            kind = None
        self.stack.append((tag, kind))
        self.hidden += tag in self.OUT

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, kind = self.stack.pop()
                self.hidden -= t in self.OUT
                if kind:
                    self.done.add(kind)
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "title":
            self.title.append(data)
        elif not self.hidden:
            for kind in {k for _, k in self.stack if k}:
                self.found[kind].append(data)


def page_text(html: str | None) -> tuple[str, str]:
    """(title, text): of main, else article, else the first content div, else the body; the whole of it."""
    p = _Text()
    p.feed(html or "")
    p.close()
    best = next((p.found[k] for k in ("main", "article", "div", "body") if k in p.done or p.found[k]), [])
    return " ".join("".join(p.title).split()), " ".join(" ".join(best).split())


def contents(pages: DataFrame) -> DataFrame:
    """(url, title, content) of pages (url, html)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [page_text(h) for h in batch["html"]]
            yield pd.DataFrame({"url": batch["url"], "title": [t for t, _ in made], "content": [c for _, c in made]})

    return pages.select("url", "html").mapInPandas(run, "url string, title string, content string")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def url_title(url: Column) -> Column:
    """The last part of the path without extension, in title case; the host without a path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    name = F.regexp_replace(last, r"\.[^.]*$", "")
    return F.when(name == "", F.try_parse_url(url, F.lit("HOST"))).otherwise(T.title_from(name))


def still_to_fetch(urls: DataFrame, crawled: DataFrame, now: Column, ttl: int = 86400) -> DataFrame:
    """URLs without a good row younger than ttl seconds. crawled: url, fetched_at, error; the key is md5(url)."""
    fresh = latest(crawled).filter(F.col("error").isNull() & (F.unix_timestamp(now) - F.unix_timestamp("fetched_at") < ttl))
    return urls.filter("url IS NOT NULL AND trim(url) != ''").select("url").distinct().withColumn("key", F.md5("url")).join(fresh.select("key"), "key", "left_anti")


def latest(crawled: DataFrame) -> DataFrame:
    """The newest row per key; of rows of one time one without error, then the greatest."""
    newest = F.max(F.struct("fetched_at", F.col("error").isNull().alias("good"), F.struct(*crawled.columns).alias("r")))
    return crawled.withColumn("key", F.md5("url")).groupBy("key").agg(newest.alias("n")).select("key", "n.r.*")


def typed(pages: DataFrame) -> DataFrame:
    """Adds type: error, pdf, text or web; rows without a url go."""
    path = F.lower(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")))
    kind = F.when(F.col("error").isNotNull(), "error").when(F.endswith(path, F.lit(".pdf")), "pdf").when(F.endswith(path, F.lit(".txt")) | F.endswith(path, F.lit(".md")), "text").otherwise("web")
    return pages.filter("url IS NOT NULL AND trim(url) != ''").withColumn("type", kind)


def split_words(queries: DataFrame, common: DataFrame, least: float) -> DataFrame:
    """(query_id, n, word, rare) of the words that any window has (common: word, windows). Windows that score above `least` hold at least
    c of a query's n words, so one of its all but c - 1 rarest at least: these find windows, the others are looked up."""
    own = queries.select("query_id", F.array_distinct(T.words(F.lower("text"))).alias("w"))
    need = own.select("query_id", F.size("w").alias("n"), F.explode("w").alias("word")).join(common, "word")
    of_query = Window.partitionBy("query_id")
    place, here = F.row_number().over(of_query.orderBy("windows", "word")), F.count(F.lit(1)).over(of_query)
    return need.withColumn("rare", place <= here - F.floor(F.col("n") * least + 1e-9)).select("query_id", "n", "word", "rare")


def found_windows(windows: DataFrame, queries: DataFrame, parts: int, per_source: int, top: int, least: float, block: int = 512) -> DataFrame:
    """(query_id, url, window_index, _said, score): of each part of the windows those that a query can have among its best. Blocks of queries meet
    parts of windows inside tasks, over postings of the queries' words; what is best of all is best of its part too, so no pair of a query and
    a window is a row before it is among the best few of its part."""
    blocks = max(1, -(-queries.count() // block))
    place = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = queries.select("query_id", F.array_distinct(T.words(F.lower("text"))).alias("w")).filter("size(w) > 0")
    left = own.withColumn("_block", F.pmod(F.hash("query_id"), F.lit(blocks))).withColumn("_part", place(parts))
    right = windows.select("url", "window_index", F.lower("window").alias("low"), F.md5("window").alias("_said")).withColumn("_of_part", F.pmod(F.hash("url", "window_index"), F.lit(parts))).withColumn("_of_block", place(blocks))
    schema = K.StructType([own.schema["query_id"], windows.schema["url"], windows.schema["window_index"], K.StructField("_said", K.StringType()), K.StructField("score", K.DoubleType())])
    kinds = to_arrow_schema(schema)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        lists, ids = a.column("w").to_pylist(), a.column("query_id").to_pylist()
        index, best = posted(lists), [[] for _ in lists]
        # so many words a window must hold: those of the last that is among the best so far
        need = np.array([next(k for k in range(1, len(w) + 2) if k / len(w) > least) for w in lists], np.int64)
        at, step = 0, 64
        while lists and at < b.num_rows:
            few = b.slice(at, step)
            urls, places, lows, said = (few.column(c).to_pylist() for c in ("url", "window_index", "low", "_said"))
            found = shared_words([set(x.split(" ")) for x in lows], index, len(lists))
            hit = found >= need
            for q in np.nonzero(hit.any(axis=0))[0]:
                able = sorted(best[q] + [(-int(found[i, q]), urls[i], places[i], said[i]) for i in np.nonzero(hit[:, q])[0]])
                taken, made = Counter(), []
                for one in able:
                    if taken[one[1]] < per_source:
                        taken[one[1]] += 1
                        made.append(one)
                        if len(made) == top:
                            need[q] = -one[0]
                            break
                best[q] = made
            at, step = at + step, 1024
        rows = [(ids[q], url, i, said, -k / len(lists[q])) for q, made in enumerate(best) for k, url, i, said in made]
        return pa.table([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(kinds)], schema=kinds)

    return left.groupBy("_part", "_block").cogroup(right.groupBy("_of_part", "_of_block")).applyInArrow(meet, schema)


def excerpts(sources: DataFrame, queries: DataFrame, size: int = 500, per_source: int = 3, top: int = 5, least: float = 0.1) -> DataFrame:
    """(query_id, url, window_index, window, score, rank): windows of the sources that share words with a query (query_id, text): the share of
    its words found, above `least`; the best few of each source, then of all. Sources may share a url, then windows are told apart by what they
    say. Windows are made once for the search, and once more of the sources found, for their texts."""
    sources = sources.filter("url IS NOT NULL").select("url", "content")
    parts = parts_of(sources.agg(F.sum(F.length("content"))).first()[0] or 0)
    best = kept(best_excerpts(found_windows(word_windows(sources, "url", "content", size), queries, parts, per_source, top, least), per_source, top, least, "_said"))
    urls = best.select("url").distinct()
    said = word_windows(sources.join(F.broadcast(urls) if urls.count() <= 100_000 else urls, "url", "left_semi"), "url", "content", size).withColumn("_said", F.md5("window")).distinct()
    return best.join(said, ["url", "window_index", "_said"]).select("query_id", "url", "window_index", "window", "score", "rank")


def best_excerpts(hits: DataFrame, per_source: int, top: int, least: float, *then: str | Column) -> DataFrame:
    """Of (query_id, url, window_index, score) the best few of each source above the limit, then of all, ranked; ties by url, place and what else is named."""
    score = F.desc(F.round("score", 9))
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "url").orderBy(score, "window_index", *then))).filter((F.col("_r") <= per_source) & (F.col("score") > least))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score, "url", "window_index", *then))).filter(F.col("rank") <= top)


def near_excerpts(windows: DataFrame, queries: DataFrame, given: DataFrame, per_source: int = 3, top: int = 5, least: float = 0.1) -> DataFrame:
    """(query_id, url, window_index, window, score, rank): as excerpts, with the cosine of vectors in place of shared words. windows: url,
    window_index, window, embedding; queries: query_id, embedding; given: query_id, url, the sources that a query was given. A query
    meets the windows of its own sources only; a missing or zero vector scores 0. Sources may share a url, then windows are told apart by
    what they say. Texts join after the ranks are known."""
    windows = windows.withColumn("_said", F.coalesce(F.md5("window"), F.lit("")))
    asked = given.select("query_id", "url").distinct().join(queries.select("query_id", F.col("embedding").alias("qv")), "query_id")
    hits = asked.join(windows.select("url", "window_index", "_said", F.col("embedding").alias("wv")), "url").withColumn("score", cosine(F.col("qv"), F.col("wv"))).drop("qv", "wv")
    best = best_excerpts(hits, per_source, top, least, "_said", F.desc("score"))
    return best.join(windows.select("url", "window_index", "_said", "window").distinct(), ["url", "window_index", "_said"]).select("query_id", "url", "window_index", "window", "score", "rank")


def digest(pages: DataFrame, most: int = 2000) -> DataFrame:
    """(url, summary) of pages without error."""
    cut = F.when(F.length("content") > most, F.concat(F.left("content", F.lit(most)), F.lit("..."))).otherwise(F.col("content"))
    return pages.filter("error IS NULL").select("url", F.concat(F.lit("Source: "), F.coalesce("title", F.lit("")), F.lit("\nURL: "), "url", F.lit("\n\n"), cut).alias("summary"))


def usage(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: pages fetched without error, distinct excerpts cited (by their first 100 characters), and their rate."""
    cited = sources.filter("type = 'knowledge'").agg(F.countDistinct(F.left("excerpt", F.lit(100))).alias("cited"))
    fetched = pages.agg(F.count_if(F.col("error").isNull()).alias("fetched"))
    return fetched.join(cited, how="left").withColumn("rate", F.when(F.col("fetched") > 0, F.col("cited") / F.col("fetched")).otherwise(0.0))
