"""Self-join of documents on the Jaccard similarity of their word n-grams, by vertical partitioning.

The n-grams have a global order, rare before frequent. Two sets that are similar enough share an n-gram in the first
part of both, so only n-grams there that other documents have lead to candidates; how many documents have an
n-gram is counted over all of them by exchanging packed hashes (see blocks). The candidates are compared by
cutting the order of hashes into fragments: each fragment of a pair gives a partial overlap, and the sums per
pair decide. Pairs come in two rounds. In the first each n-gram links its documents of one size band to one of
them, so a group of copies gives as many pairs as documents. In the second all remaining candidates in different
components follow, so no link between components is missed; long lists are dealt into blocks there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import cut
from .components import components
from .substring_dedup import Words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SETS = "doc_id bigint, k bigint, digest binary, n bigint, prefix array<struct<h: bigint, at: int>>, grams binary"
SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("prefix", pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))), ("grams", pa.binary())])


def gram_sets(block: B.Block, size: int) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text of a block, hashed and sorted; of a text with fewer words, all its words as one."""
    block.bytes = LOWER[block.bytes]
    words = Words(block)
    made = B.windows(words.hashes, size, B.WORD_M)
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(made[a : b - size + 1])
        elif b > a:  # the count keeps it apart from longer ones
            yield B.mixed(B.windows(words.hashes[a:b], b - a, B.WORD_M) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def cells(grams: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit cell of each n-gram; documents are counted per cell, which can only raise a count."""
    return B.dealt(grams, n_buckets).astype(np.int64), (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)


def least_overlap(a, b, percent: int):
    """The least size of an intersection that links sets of sizes a and b (columns)."""
    return F.ceil((percent * (a + b)) / F.lit(100 + percent) - F.lit(1e-9))


def rare_sets(base: DataFrame, n_blocks: int, size: int, percent: int) -> DataFrame:
    """(doc_id, k, digest, n, prefix, grams), one row per row of base; the last two only for the first of each distinct text, and
    only if it may link with others: the n-grams of its prefix that other documents have, and its set."""
    n_buckets = max(1, n_blocks // 4)

    def tell(docs: pa.Table, replies: pa.Table) -> pa.Table:
        """Per bucket the cells that the block has, sorted, with the number of its documents, up to 65535."""
        if not docs.num_rows:
            return B.send(0, 1, np.empty(0, np.uint64))
        block = B.Block(docs, replies)
        bucket, cell = cells(np.concatenate([*(s for s, own in zip(gram_sets(block, size), block.first.tolist(), strict=True) if own), np.empty(0, np.uint64)]), n_buckets)
        both, n = np.unique(bucket.astype(np.uint64) << np.uint64(32) | cell.astype(np.uint64), return_counts=True)
        n = np.minimum(n, 65535).astype(np.uint16)
        rows = []
        edges = np.searchsorted(both, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(32)).tolist()
        for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            if j > i:
                many = n[i:j] > 1
                at = np.flatnonzero(many).astype(np.uint32)
                rows.append((b, block.number, both[i:j].astype(np.uint32).tobytes(), at.tobytes(), b"", n[i:j][many].tobytes()))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), B.SENT_ARROW, strict=True)] if rows else [pa.array([], f.type) for f in B.SENT_ARROW], schema=B.SENT_ARROW)

    def count(sent: pa.Table) -> pa.Table:
        """Tells each block which of its cells occur in two documents or more, and in how many, up to 65535."""
        packed = [[np.frombuffer(x, t) for x in sent[c].to_pylist()] for c, t in (("h", np.uint32), ("g", np.uint32), ("n", np.uint16))]
        weights = []
        for cell, at, n in zip(*packed, strict=True):
            w = np.ones(len(cell), np.int64)
            w[at] = n
            weights.append(w)
        cell = np.concatenate(packed[0])
        _, back = np.unique(cell, return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(weights))[back]
        rows, i, bucket = [], 0, sent["bucket"][0].as_py()
        for block, own in zip(sent["block"].to_pylist(), packed[0], strict=True):
            n = total[i : i + len(own)]
            i += len(own)
            some = n >= 2
            rows.append((block, B.LONGER, own[some].tobytes() + np.minimum(n[some], 65535).astype(np.uint16).tobytes(), bucket))
        return B.replies(rows)

    def choose(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in SETS_ARROW], schema=SETS_ARROW)
        counts = {}
        told = replies.filter(pc.equal(replies["kind"], B.LONGER))
        for data, bucket in zip(told["data"].to_pylist(), told["n"].to_pylist(), strict=True):
            k = len(data) // 6
            counts[bucket] = (np.frombuffer(data, np.uint32, k), np.frombuffer(data, np.uint16, k, 4 * k))
        block = B.Block(docs, replies.filter(pc.equal(replies["kind"], B.COPY)))
        sets = list(gram_sets(block, size))
        every = np.concatenate([*sets, np.empty(0, np.uint64)])
        bucket, cell = cells(every, n_buckets)
        n = np.ones(len(every), np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1)).tolist()
        for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            if j > i and b in counts and len(counts[b][0]):
                own, many = counts[b]
                at = np.minimum(np.searchsorted(own, cell[order[i:j]]), len(own) - 1)
                n[order[i:j]] = np.where(own[at] == cell[order[i:j]], many[at], 1)
        prefixes, at = [], 0
        for i, grams in enumerate(sets):
            many = n[at : at + len(grams)]
            at += len(grams)
            first = np.lexsort((grams, many))[: len(grams) - -(-percent * len(grams) // 100) + 1]
            shared = np.flatnonzero(many[first] > 1) if len(grams) and block.first[i] else ()
            prefixes.append([{"h": h, "at": p} for h, p in zip(grams[first[shared]].view(np.int64).tolist(), shared.tolist(), strict=True)] if len(shared) else None)
        seen, rows = set(), []
        for i, doc_id, k, digest in zip(block.rows.tolist(), *(docs[c].to_pylist() for c in ("doc_id", "k", "digest")), strict=True):
            own = prefixes[i] if i not in seen else None
            seen.add(i)
            rows.append((doc_id, k, digest, len(sets[i]), own, sets[i].tobytes() if own else None))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SETS_ARROW, strict=True)], schema=SETS_ARROW)

    copies = B.copies(base.filter("doc_id IS NOT NULL"))
    counted = B.with_replies(base, copies, tell, B.SENT).groupBy("bucket").applyInArrow(count, B.REPLY)
    return cut(B.with_replies(base, copies.unionByName(counted), choose, SETS))


def overlaps(pairs: DataFrame, sets: DataFrame, fragments: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps of the fragments are counted one by one and summed per pair."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, n, tag, grams in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                grams = np.frombuffer(grams, np.uint64)
                edges = [*np.searchsorted(grams, np.arange(1, fragments, dtype=np.uint64) * np.uint64(2**64 // fragments)).tolist(), len(grams)]
                rows += [(k, n, tag, f, grams[i:j].tobytes()) for f, (i, j) in enumerate(zip([0, *edges], edges, strict=False)) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()))], names=["k", "n", "digest", "fragment", "grams"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(made, pa.int64())], names=["a", "b", "na", "nb", "da", "db", "part"])

    cut_up = sets.select("k", "n", "digest", "grams").mapInArrow(split, "k bigint, n bigint, digest binary, fragment int, grams binary")
    left = pairs.join(cut_up.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("digest").alias("da"), "fragment", F.col("grams").alias("x")), "a")
    right = cut_up.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("digest").alias("db"), "fragment", F.col("grams").alias("y"))
    both = left.join(right, ["b", "fragment"]).select("a", "b", "na", "nb", "da", "db", "x", "y")
    partial = both.mapInArrow(count, "a bigint, b bigint, na bigint, nb bigint, da binary, db binary, part bigint")
    total = partial.groupBy("a", "b", "na", "nb", "da", "db").agg(F.sum("part").alias("both"))
    return total.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct()


def linked(sets: DataFrame, fragments: int, percent: int, list_rows: int = 1000) -> DataFrame:
    """Links between texts, enough for the components: (a, b) by key. list_rows: documents of one n-gram that meet in a task."""
    posted = sets.select("k", "n", "digest", F.explode("prefix").alias("p")).select("k", "n", "digest", F.col("p.h").alias("h"), F.col("p.at").alias("at"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    hubs = posted.withColumn("band", band)
    near = hubs.groupBy("h", "band").agg(F.min("k").alias("a"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    stars = hubs.join(near, ["h", "band"]).filter("k != a").select("a", F.col("k").alias("b")).distinct()
    first = cut(overlaps(stars, sets, fragments, percent))
    label = components(first)
    labelled = posted.join(label, posted.k == label.node, "left").select("k", "n", "digest", "h", "at", F.coalesce("component", "k").alias("component"))
    # a long list is dealt into blocks that meet pair by pair, each pair of blocks in a task of its own
    mixed = labelled.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many")).filter("low < high").select("h", F.ceil(F.col("many") / list_rows).cast("int").alias("blocks"))
    mine = sets.select("k", "digest", F.transform("prefix", lambda x: x["h"]).alias("mine"))
    own = F.pmod(F.xxhash64("k", "digest"), F.col("blocks")).cast("int")
    open_lists = labelled.withColumn("band", band).join(mixed, "h").withColumn("own", own).join(mine, ["k", "digest"])
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # sizes that can link lie in the same band or in neighbours
    left = open_lists.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).withColumns({"first": F.col("own"), "second": F.explode(every)})
    right = open_lists.withColumns({"second": F.col("own"), "first": F.explode(every)})
    names = ["k", "n", "at", "component", "mine"]
    x = left.select("h", "band", "first", "second", *[F.col(c).alias(f"{c}_a") for c in names])
    y = right.select("h", "band", "first", "second", *[F.col(c).alias(f"{c}_b") for c in names])
    need = least_overlap(F.col("n_a"), F.col("n_b"), percent)
    fits = (
        (F.col("k_a") < F.col("k_b")) & (F.col("component_a") != F.col("component_b"))
        & (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
        & (F.col("at_a") <= F.col("n_a") - need) & (F.col("at_b") <= F.col("n_b") - need)
        & (F.get(F.array_intersect("mine_a", "mine_b"), F.lit(0)) == F.col("h"))
    )
    rest = x.join(y, ["h", "band", "first", "second"]).filter(fits).select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct()
    return first.union(overlaps(rest, sets, fragments, percent))


def same_text(texts: DataFrame, salts: int = 64) -> DataFrame:
    """Links (a, b) that hold the keys of each text (k, digest) together: a key with the least of its salt, and those with the least of
    all. However many copies a text has, no task gets more than its share of a salt."""
    dealt = texts.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int"))
    low = dealt.groupBy("digest", "salt").agg(F.min("k").alias("a"), F.max("k").alias("top"))
    near = dealt.join(low.filter("a < top").drop("top"), ["digest", "salt"]).filter("k != a").select("a", F.col("k").alias("b"))
    least = low.groupBy("digest").agg(F.min("a").alias("least"), F.max("a").alias("most")).filter("least < most").drop("most")
    far = low.join(least, "digest").filter("a != least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return near.union(far).distinct()


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, fragments: int = 8, block_bytes: int = 4 << 20, list_rows: int = 1000) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row: texts link when their sets of word n-grams (A-Z in lower case; a
    text with fewer words is one n-gram of all) have a Jaccard similarity of percent or more; component_id is the
    smallest id reachable by links.

    Null text and text without words: n_shingles 0 and a component of its own. Rows with a null id take no part in links
    and have no component. Rows that repeat an id are one document, all texts under it included. Equal texts are
    compared once and joined to their class. An empty table gives no rows; other columns are ignored. Sets are
    cut into fragments, so a task holds a block of documents, fragments of a batch of pairs, or list_rows documents of one n-gram twice.
    """
    base, n_blocks = B.text_blocks(docs, id_col, text_col, block_bytes)

    sets = rare_sets(base, n_blocks, size, percent)
    links = linked(sets.filter("grams IS NOT NULL").select("k", "digest", "n", "prefix", "grams"), fragments, percent, list_rows)
    some = sets.filter("n > 0 AND doc_id IS NOT NULL").select("k", "digest")
    label = components(links.union(same_text(some)))
    found = sets.select("doc_id", "n").join(label, sets.doc_id == label.node, "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
