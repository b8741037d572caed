"""Grounding: each step against the sentences, pages and screens it can come from, by inverted-index joins."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.pandas.types import to_arrow_schema

from .. import lexicon as L
from ..config import Matching
from ..functions import text as T
from ..plans.keep import kept
from .cleaning import alike, similarity
from .postings import most_matched, numbered, parts_of, posted, rare_counts, shared_words

KEYS = ["transcript_id", "step_index"]
SOURCE = ["transcript_id", "step_index", "type", "excerpt", "sentence_index", "screenshot_ref", "ui_elements", "confidence"]


def search_text(steps: DataFrame) -> Column:
    return F.concat_ws(" ", "title", F.concat_ws(" ", "summary", "details"), F.array_join("actions", " "))


def candidates(steps: DataFrame, sentences: DataFrame, least: int = 3) -> DataFrame:
    """(keys, sentence_index, shared, n_step, n_sentence, word_overlap): pairs of one transcript with enough words in common."""
    own = steps.select(*KEYS, T.match_words(search_text(steps), True).alias("w"))
    told = sentences.select("transcript_id", "sentence_index", T.match_words(F.col("text"), False).alias("w"))
    left = own.select(*KEYS, F.size("w").alias("n_step"), F.explode("w").alias("word"))
    right = told.select("transcript_id", "sentence_index", F.size("w").alias("n_sentence"), F.explode("w").alias("word"))
    pairs = left.join(right, ["transcript_id", "word"]).groupBy(*KEYS, "sentence_index", "n_step", "n_sentence").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    return pairs.withColumn("word_overlap", F.col("shared") / (F.col("n_step") + F.col("n_sentence") - F.col("shared")))


def every_candidate(steps: DataFrame, texts: DataFrame, members: DataFrame, least: int = 3) -> DataFrame:
    """`candidates` of all sentences: a step meets each text (transcript_id, sentence_index, text) once, what they share holds for each of its members
    (transcript_id, sentence_index, text_index). Pairs of steps and sentences are made by the last join and shuffled nowhere."""
    met = candidates(steps, texts, least).withColumnRenamed("sentence_index", "text_index").join(members, ["transcript_id", "text_index"])
    return met.select(*KEYS, "sentence_index", "shared", "n_step", "n_sentence", "word_overlap")


def scored(steps: DataFrame, sentences: DataFrame, config: Matching = Matching()) -> DataFrame:
    """Candidates with keyword_score, phrase_score, char_similarity and semantic_score (0 where their weight is 0, the last also where no
    vectors are given), base_score (the weighted sum and the bonus for a bare verb), and technical. Vectors: columns `embedding`
    on both sides. What depends on one side alone is worked out before the sides meet; texts meet only where a part needs them."""
    c = config.normalised()
    vectors = "embedding" in steps.columns and "embedding" in sentences.columns
    with_text = bool(c.keyword or c.phrase or c.char)
    bare = F.filter(T.literals(L.BARE_VERBS), lambda v: F.array_contains(F.col("actions"), v))
    wanted = [F.lower(search_text(steps)).alias("wanted"), T.match_words(search_text(steps), True).alias("words")] if with_text else []
    s = steps.select(*KEYS, bare.alias("bare"), *wanted, *([F.col("embedding").alias("sv")] if vectors else []))
    low = F.lower("text")
    t = sentences.select("transcript_id", "sentence_index", T.found(low, L.BARE_VERBS).alias("held"), T.technical_score(F.col("text")).alias("technical"), *([low.alias("low")] if with_text else []), *([F.col("embedding").alias("tv")] if vectors else []))
    rows = candidates(steps, sentences, c.min_words).join(s, KEYS).join(t, ["transcript_id", "sentence_index"])
    key = F.filter("words", lambda w: F.length(w) > 4)
    keyword = F.when(F.size(key) > 0, F.size(F.filter(key, lambda w: F.contains("low", w))) / F.size(key)).otherwise(0.0) if c.keyword else F.lit(0.0)
    rows = rows.withColumn("keyword_score", keyword).withColumn("phrase_score", phrase_score(F.col("words"), F.col("low")) if c.phrase else F.lit(0.0))
    rows = rows.withColumn("char_similarity", similarity("wanted", "low") if c.char else F.lit(0.0)).withColumn("semantic_score", cosine(F.col("sv"), F.col("tv")) if vectors else F.lit(0.0))
    base = F.col("word_overlap") * c.word + F.col("keyword_score") * c.keyword + F.col("phrase_score") * c.phrase + F.col("semantic_score") * c.semantic + F.col("char_similarity") * c.char
    return rows.withColumn("base_score", base + F.when(F.arrays_overlap("bare", "held"), 0.1).otherwise(0.0)).drop("wanted", "words", "low", "bare", "held", "sv", "tv")


def phrase_score(words: Column, low: Column) -> Column:
    """0.2 for each pair of neighbouring words over three characters that the sentence holds, 0.6 at most; neighbours in text order."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b")))
    hits = F.filter(pairs, lambda p: (F.length(p["a"]) > 3) & (F.length(p["b"]) > 3) & F.contains(low, F.concat(p["a"], F.lit(" "), p["b"])))
    return F.least(F.lit(0.6), F.size(hits) * 0.2)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors between 0 and 1; 0 for missing or zero ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(norm > 0, T.clamped(dot(a, b) / norm)).otherwise(0.0), F.lit(0.0))


def adjusted(base: Column, technical: Column, uses: Column) -> Column:
    """Score after the penalty for earlier uses and the boost for technical sentences."""
    x = base * (1.0 - F.least(F.lit(0.6), (uses + 1) * 0.15))
    return F.least(F.lit(1.0), F.when(x >= 0.10, x + technical * 0.2).otherwise(x))


def reused(rows: DataFrame, config: Matching, most: int = 200_000) -> DataFrame:
    """The best sentences of each step where earlier choices count: (keys, sentence_index, base_score, technical, confidence) for candidates
    without the last. All steps choose at once, uses by earlier steps are counted, and all choose again until nothing changes. Up to the first
    step of a transcript that chose otherwise than before, steps have seen final choices only, so they are final too: their uses
    are kept as a number and the rows leave the rounds. Windows run over the steps of one sentence and the sentences of one step."""
    active = kept(rows.withColumns({"_held": F.lit(0).cast("long"), "_was": F.lit(False)}))
    done = []
    while True:
        of_sentence, of_step = Window.partitionBy("transcript_id", "sentence_index"), Window.partitionBy(*KEYS)
        uses = F.coalesce(F.sum(F.col("_was").cast("long")).over(of_sentence.orderBy("step_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_held")
        made = active.withColumn("confidence", adjusted(F.col("base_score"), F.col("technical"), uses))
        rank = F.row_number().over(of_step.orderBy(F.desc(F.round("confidence", 9)), "sentence_index"))
        made = kept(made.withColumn("_now", (F.col("confidence") >= config.min_score) & (rank <= config.top)))
        first = kept(made.filter("_now != _was").groupBy("transcript_id").agg(F.min("step_index").alias("_first_change")))
        n = first.count()
        if not n:
            done.append(made)
            break
        # one row per transcript that still changes; beyond `most` a shuffle, of which a frequent transcript is split at run time
        told = made.join(F.broadcast(first) if n <= most else first, "transcript_id", "left").withColumn("_final", F.coalesce(F.col("step_index") <= F.col("_first_change"), F.lit(True)))
        done.append(told.filter("_final").select(*made.columns))
        held = F.col("_held") + F.sum((F.col("_now") & F.col("_final")).cast("long")).over(of_sentence)
        active = kept(told.withColumn("_held", held).filter("NOT _final").select(*rows.columns, "_held", F.col("_now").alias("_was")))
    every = done[0]
    for other in done[1:]:
        every = every.unionByName(other)
    return every.filter("_now").select(*rows.columns, "confidence")


def chosen_in_order(rows: DataFrame, places: DataFrame, config: Matching) -> DataFrame:
    """As `reused`, for sentences that are scored by their text: rows (keys, text_id, base_score, technical) and places (transcript_id, text_id,
    sentence_index). Places of a text with as many uses differ for a step by their order alone, so a step looks at the first few of each number of
    uses. Rows pass in the order of their steps; a task keeps the uses of one transcript, nothing else. Of a text's places as many can be
    taken as all steps together take."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["transcript_id", "step_index", "sentence_index", "base_score", "technical", "confidence"]
        kinds = pa.schema([("transcript_id", pa.string()), ("step_index", pa.int64()), ("sentence_index", pa.int64()), ("base_score", pa.float64()), ("technical", pa.float64()), ("confidence", pa.float64())])
        scores: dict[tuple[float, float, int], tuple[float, float]] = {}

        def score(base: float, technical: float, uses: int) -> tuple[float, float]:
            """(minus the rounded score, the score)"""
            if (base, technical, uses) not in scores:
                value = base * (1.0 - min(0.6, (uses + 1) * 0.15))
                value = min(1.0, value + technical * 0.2 if value >= 0.10 else value)
                if len(scores) > 100_000:
                    scores.clear()
                scores[base, technical, uses] = -float(Decimal(repr(value)).quantize(Decimal("1e-9"), ROUND_HALF_UP)), value
            return scores[base, technical, uses]

        def settled(step: list[tuple], free: dict[str, list[list[int]]]) -> list[tuple]:
            able = []
            for text, base, technical in step:
                for uses, held in enumerate(free[text]):
                    order, value = score(base, technical, uses)
                    if held and value >= config.min_score:
                        able += [(order, s, text, uses, base, technical, value) for s in heapq.nsmallest(config.top, held)]
            best = sorted(able)[: config.top]
            for _, s, text, uses, *_ in best:
                held = free[text][uses]
                if held[0] == s:
                    heapq.heappop(held)
                else:
                    held.remove(s)
                    heapq.heapify(held)
                # from the fourth use on nothing changes
                heapq.heappush(free[text][min(uses + 1, 3)], s)
            return [(s, base, technical, value) for _, s, _, _, base, technical, value in best]

        now, at, step, free, out = None, None, [], {}, []
        for batch in batches:
            for t, i, text, base, technical, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, i) != (now, at):
                    if step:
                        out += [(now, at, *x) for x in settled(step, free)]
                    if t != now:
                        free = {}
                    now, at, step = t, i, []
                if places is not None:
                    free[text] = [places, [], [], []]
                else:
                    step.append((text, base, technical))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if step:
            out = [(now, at, *x) for x in settled(step, free)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    most = rows.groupBy("transcript_id").agg((F.countDistinct("step_index") * config.top).alias("_most"))
    order = F.row_number().over(Window.partitionBy("transcript_id", "text_id").orderBy("sentence_index"))
    able = places.withColumn("_n", order).join(most, "transcript_id").filter("_n <= _most").groupBy("transcript_id", "text_id").agg(F.sort_array(F.collect_list(F.col("sentence_index").cast("long"))).alias("places"))
    own = rows.select("transcript_id", F.col("step_index").cast("long").alias("step_index"), "text_id", F.col("base_score").cast("double").alias("base_score"), F.col("technical").cast("double").alias("technical"), F.lit(None).cast("array<bigint>").alias("places"))
    heads = able.select("transcript_id", F.lit(-1).cast("long").alias("step_index"), "text_id", F.lit(0.0).alias("base_score"), F.lit(0.0).alias("technical"), "places")
    made = own.unionByName(heads).repartition("transcript_id").sortWithinPartitions("transcript_id", "step_index", "text_id")
    made = made.mapInArrow(run, "transcript_id string, step_index bigint, sentence_index bigint, base_score double, technical double, confidence double")
    return made.withColumns({c: F.col(c).cast(dict(rows.dtypes)[c] if c in rows.columns else dict(places.dtypes)[c]) for c in ("step_index", "sentence_index")})


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows, their lengths): a missing vector, or one that lacks a component, is zero, so its cosine is 0."""
    own = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = own.value_lengths().to_numpy(zero_copy_only=False)
    if len(own) and not own.null_count and len(set(lengths)) == 1 and not (flat := own.flatten()).null_count:
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1), lengths
    rows = [x if x and None not in x else None for x in own.to_pylist()]
    lengths = np.array([len(x) if x else -1 for x in rows], np.int64)
    made = np.zeros((len(rows), max(1, lengths.max(initial=1))))
    for i, x in enumerate(rows):
        if x:
            made[i, : len(x)] = x
    return made, lengths


def cosines(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """`cosine` of all pairs, up to rounding; also of vectors whose lengths differ and of such that aren't finite, as it stands there."""
    (x, n), (y, m) = a, b
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) if v.shape[1] < width else v for v in (x, y))
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.outer(np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)))
        some = (norm > 0) | np.isnan(norm)
        made = np.where(some, x @ y.T / norm, 0.0)
    made = np.clip(np.where(np.isnan(made), 1.0, made), 0.0, 1.0)
    return np.where(n[:, None] == m[None, :], made, some.astype(np.float64))


def firsts(score: np.ndarray, top: int) -> np.ndarray:
    """Which columns of each row are among its best, the first of equals; columns are in order."""
    if score.shape[1] <= top:
        return np.ones(score.shape, bool)
    last = np.partition(score, -top, axis=1)[:, -top][:, None]
    above, equal = score > last, score == last
    return above | (equal & (np.cumsum(equal, axis=1) <= top - above.sum(axis=1)[:, None]))


def attached(rows: DataFrame, vectors: DataFrame | None, wide: bool, **columns: str) -> DataFrame:
    """Rows with the vectors that some of their columns name (new name = column); with no table of vectors the columns hold them themselves. Up to 16
    million components the table goes to the rows (else the rows are shuffled by the vectors' ids), which then stay in their parts and order."""
    for new, old in columns.items():
        if vectors is None:
            rows = rows.withColumnRenamed(old, new)
        else:
            own = vectors.select(F.col("vector_id").alias(old), F.col("embedding").alias(new))
            rows = rows.join(own if wide else F.broadcast(own), old).drop(old)
    return rows


def near_rows(steps: DataFrame, sentences: DataFrame, config: Matching, block: int = 4096, side: int = 8192, vectors: DataFrame | None = None) -> DataFrame:
    """The rows of `scored` that can be among the best of a step, where both sides have vectors. A step meets each text once for its words; the
    places of a text differ by their vectors alone, so blocks of steps meet blocks of places as matrices, and of each text and block only
    the best few of a step go on. What is left gets its exact score. With `vectors` (vector_id, embedding) both sides have a vector_id in place of an
    embedding; then ids are shuffled, not vectors."""
    c = config.normalised()
    v = "embedding" if vectors is None else "vector_id"
    if vectors is not None:
        steps, sentences = (rows.join(vectors.select("vector_id"), "vector_id", "left_semi") for rows in (steps, sentences))
    wide = vectors is not None and (vectors.agg(F.sum(F.size("embedding"))).first()[0] or 0) > 16_000_000
    same = Window.partitionBy("transcript_id", "text").orderBy("sentence_index")
    told = {"_text": F.min("sentence_index").over(same), "_block": F.floor((F.row_number().over(same) - 1) / block)}
    own = sentences.select("transcript_id", "sentence_index", "text", v).withColumns(told)
    own = kept(own.withColumn("text", F.when(F.col("_text") == F.col("sentence_index"), F.col("text"))))
    texts = own.filter("sentence_index = _text").select("transcript_id", "sentence_index", "text")
    words = kept(scored(steps.drop(v), texts, config).withColumnRenamed("sentence_index", "_text"))
    asked = words.select(*KEYS, "_text", "base_score", "technical", F.floor(F.col("step_index") / side).alias("_side")).join(steps.select(*KEYS, F.col(v).alias("v")), KEYS)
    places = own.select("transcript_id", "_text", "sentence_index", F.col(v).alias("w"), "_block")
    met = ["transcript_id", "_text", "_side", "_block"]
    blocks = places.groupBy("transcript_id", "_text").agg(F.max("_block").alias("_last"))
    sides = words.select("transcript_id", "_text", F.floor(F.col("step_index") / side).alias("_side")).distinct()
    left = asked.join(blocks, ["transcript_id", "_text"]).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).select(*met, "step_index", "base_score", "technical", "v")
    right = places.join(sides, ["transcript_id", "_text"]).select(*[F.col(k).alias(f"_of{k}") for k in met], "sentence_index", "w")
    if vectors is not None:
        # dealt by number and in order before vectors join, as rows without them are too small for their size to tell what a task holds
        parts = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.count() // 200_000 + 1)
        dealt = lambda rows, keys: rows.repartition(parts, *keys).sortWithinPartitions(*keys)
        if wide:
            left, right = dealt(attached(left, vectors, wide, v_="v"), met), dealt(attached(right, vectors, wide, w_="w"), [f"_of{k}" for k in met])
        else:
            left, right = attached(dealt(left, met), vectors, wide, v_="v"), attached(dealt(right, [f"_of{k}" for k in met]), vectors, wide, w_="w")
    else:
        left, right = left.withColumnRenamed("v", "v_"), right.withColumnRenamed("w", "w_")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = {"step_index": [], "sentence_index": [], "_near": []}
        if a.num_rows and b.num_rows:
            b = b.sort_by("sentence_index")
            w, at = matrix(b.column("w_")), b.column("sentence_index").to_numpy()
            for few in (a.slice(k, 512) for k in range(0, a.num_rows, 512)):
                base, technical = (few.column(k).to_numpy()[:, None] for k in ("base_score", "technical"))
                x = (base + cosines(matrix(few.column("v_")), w) * c.semantic) * 0.85
                near = np.minimum(1.0, np.where(x >= 0.10 - 1e-12, x + technical * 0.2, x))
                # the exact score is rounded to nine digits: on either side of a limit
                able = firsts(np.round(near - 1e-12, 9), config.top) | firsts(np.round(near + 1e-12, 9), config.top)
                i, j = np.nonzero(able & (near >= config.min_score - 1e-9))
                for name, values in (("step_index", few.column("step_index").to_numpy()[i]), ("sentence_index", at[j]), ("_near", near[i, j])):
                    found[name].append(values)
        made = {k: np.concatenate(x) if x else [] for k, x in found.items()}
        n = len(made["_near"])
        same = {k: pa.array([a.column(k)[0].as_py()] * n if n else [], t) for k, t in (("transcript_id", pa.string()), ("_text", pa.int64()))}
        return pa.table(same | {"step_index": pa.array(made["step_index"], pa.int64()), "sentence_index": pa.array(made["sentence_index"], pa.int64()), "_near": pa.array(made["_near"], pa.float64())})

    hits = left.groupBy(*met).cogroup(right.groupBy(*[f"_of{k}" for k in met])).applyInArrow(meet, "transcript_id string, _text long, step_index long, sentence_index long, _near double")
    of_step = Window.partitionBy(*KEYS)
    hits = hits.withColumn("_r", F.row_number().over(of_step.orderBy(F.desc("_near")))).withColumn("_last", F.max(F.when(F.col("_r") == config.top, F.col("_near"))).over(of_step))
    hits = hits.filter(F.col("_last").isNull() | (F.col("_near") >= F.col("_last") - 1e-8)).select(*KEYS, "_text", "sentence_index")
    rows = hits.join(words, [*KEYS, "_text"]).join(steps.select(*KEYS, F.col(v).alias("s")), KEYS).join(own.select("transcript_id", "sentence_index", F.col(v).alias("t")), ["transcript_id", "sentence_index"])
    rows = attached(rows, vectors, wide, sv="s", tv="t").withColumn("semantic_score", cosine(F.col("sv"), F.col("tv")))
    parts = F.col("word_overlap") * c.word + F.col("keyword_score") * c.keyword + F.col("phrase_score") * c.phrase
    bare = F.when(F.col("base_score") - (parts + F.col("char_similarity") * c.char) > 0.05, 0.1).otherwise(0.0)
    base = parts + F.col("semantic_score") * c.semantic + F.col("char_similarity") * c.char + bare
    return rows.withColumn("base_score", base).drop("sv", "tv", "_text")


def transcript_sources(steps: DataFrame, sentences: DataFrame, config: Matching = Matching(), reuse: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """Source rows, the best `top` sentences per step. With reuse, a sentence that an earlier step of the transcript chose counts less: the
    independent part of the score is worked out for all, pairs that can't reach the limit even unused are dropped, and
    `reused` settles the few rows left. Without it, sentences of one text are scored once: of their
    places the first `top` alone can be among the best. Vectors are columns `embedding` of both sides, or a table (vector_id, embedding)
    and columns `vector_id`."""
    if reuse and vectors is not None:
        steps, sentences, vectors = steps.join(vectors, "vector_id"), sentences.join(vectors, "vector_id"), None
    once = not reuse and "embedding" not in sentences.columns and vectors is None
    if reuse and "embedding" not in sentences.columns:
        return reused_sources(steps, sentences, config)
    if once:
        same = Window.partitionBy("transcript_id", "text").orderBy("sentence_index")
        told = sentences.select("transcript_id", "sentence_index", "text").withColumns({"_place": F.row_number().over(same), "_first": F.min("sentence_index").over(same)}).filter(F.col("_place") <= config.top)
        places = told.select("transcript_id", F.col("_first"), F.col("sentence_index").alias("_own"))
        sentences = told.filter("_place = 1").select("transcript_id", "sentence_index", "text")
    both = vectors is not None or "embedding" in steps.columns and "embedding" in sentences.columns
    rows = near_rows(steps, sentences, config, vectors=vectors) if both and not reuse else scored(steps, sentences, config)
    fresh = rows.withColumn("confidence", adjusted(F.col("base_score"), F.col("technical"), F.lit(0))).filter(F.col("confidence") >= config.min_score)
    if once:
        fresh = fresh.withColumnRenamed("sentence_index", "_first").join(places, ["transcript_id", "_first"]).withColumnRenamed("_own", "sentence_index")
    if not reuse:
        best = fresh.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc(F.round("confidence", 9)), "sentence_index"))).filter(F.col("_r") <= config.top)
    else:
        best = reused(fresh.select("transcript_id", "step_index", "sentence_index", "base_score", "technical"), config)
    text = sentences.select("transcript_id", F.col("sentence_index").alias("_first"), F.col("text").alias("excerpt"))
    best = best if once else best.withColumn("_first", F.col("sentence_index"))
    return as_sources(best.join(text, ["transcript_id", "_first"]), "transcript")


def reused_sources(steps: DataFrame, sentences: DataFrame, config: Matching) -> DataFrame:
    """Sources with reuse where no vectors tell sentences of one text apart: a step is scored against each text once."""
    own = sentences.select("transcript_id", "sentence_index", "text", F.min("sentence_index").over(Window.partitionBy("transcript_id", "text")).alias("text_id"))
    own = kept(own.withColumn("text", F.when(F.col("text_id") == F.col("sentence_index"), F.col("text"))))
    texts = own.filter("text IS NOT NULL").select("transcript_id", "sentence_index", "text")
    rows = scored(steps, texts, config).filter(adjusted(F.col("base_score"), F.col("technical"), F.lit(0)) >= config.min_score)
    rows = kept(rows.select("transcript_id", "step_index", F.col("sentence_index").alias("text_id"), "base_score", "technical"))
    places = own.select("transcript_id", "text_id", "sentence_index")
    best = chosen_in_order(rows, places, config).join(places, ["transcript_id", "sentence_index"])
    return as_sources(best.join(texts.select("transcript_id", F.col("sentence_index").alias("text_id"), F.col("text").alias("excerpt")), ["transcript_id", "text_id"]), "transcript")


def as_sources(rows: DataFrame, kind: str) -> DataFrame:
    """Source rows of one type; values that the type lacks are null."""
    kinds = {"type": "string", "excerpt": "string", "sentence_index": "int", "screenshot_ref": "string", "ui_elements": "array<string>", "confidence": "double"}
    made = rows.withColumn("type", F.lit(kind))
    return made.select(*KEYS, *[(F.col(c) if c in made.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def knowledge_sources(steps: DataFrame, pages: DataFrame, top: int = 3, least: float = 0.2, block: int = 512) -> DataFrame:
    """Pages (url, title, content, error) that share words with a step: 0.6 of the Jaccard similarity and 0.4 of that of the characters of
    the first 2000; the best three. Blocks of steps meet parts of pages inside tasks, over postings of the steps' words and grams; the characters are
    compared only where a bound says that a page can be among the best of its part. Pages may share a url."""
    pages = pages.filter("error IS NULL AND content != ''")
    parts, blocks = parts_of(pages.agg(F.sum(F.length("content"))).first()[0] or 0), max(1, -(-steps.count() // block))
    place = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = steps.select(*KEYS, F.lower(search_text(steps)).alias("wanted"), T.match_words(search_text(steps), True).alias("w")).filter("size(w) > 0")
    left = own.withColumn("_block", F.pmod(F.hash(*KEYS), F.lit(blocks))).withColumn("_part", place(parts))
    excerpt = F.concat(F.lit("["), "title", F.lit("]("), "url", F.lit(")\n"), F.left("content", F.lit(300)))
    right = pages.select("url", excerpt.alias("excerpt"), F.lower(F.left("content", F.lit(2000))).alias("shown"), T.match_words(F.col("content"), False).alias("v"))
    right = right.withColumn("_of_part", F.pmod(F.hash("url", "shown"), F.lit(parts))).withColumn("_of_block", place(blocks))
    schema = K.StructType([*(own.schema[k] for k in KEYS), *(right.schema[c] for c in ("url", "excerpt")), K.StructField("confidence", K.DoubleType())])
    kinds = to_arrow_schema(schema)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        wanted, words = a.column("wanted").to_pylist(), a.column("w").to_pylist()
        by_word, by_gram, n, long = posted(words), posted([numbered(x) for x in wanted]), np.array([len(w) for w in words]), np.array([len(x) for x in wanted])
        letters = {c: i for i, c in enumerate(sorted(set("".join(wanted))))}
        counts = np.zeros((len(letters), len(wanted)), np.int32)
        for i, x in enumerate(wanted):
            for c, k in Counter(x).items():
                counts[letters[c], i] = k
        best, floor = [[] for _ in wanted], np.full(len(wanted), least)
        for at in range(0, b.num_rows if wanted else 0, 256):
            urls, excerpts, shown, vs = (b.slice(at, 256).column(c).to_pylist() for c in ("url", "excerpt", "shown", "v"))
            both, grams = shared_words(vs, by_word, len(wanted)), shared_words([numbered(x) for x in shown], by_gram, len(wanted))
            common, seeds = np.zeros(both.shape, np.int64), np.zeros(both.shape, np.int64)
            for j, x in enumerate(shown):
                have = Counter(x)
                for into, of in ((common, have), (seeds, rare_counts(have, len(x)))):
                    met = [(letters[c], k) for c, k in of.items() if c in letters]
                    if met:
                        into[j] = np.minimum(counts[[c for c, _ in met]], np.array([[k] for _, k in met])).sum(axis=0)
            overlap = both / (n + np.array([[len(v)] for v in vs]) - both)
            bound = 0.6 * overlap + 0.4 * (2.0 * most_matched(common, seeds, grams) / (long + np.array([[len(x)] for x in shown])))
            for j in np.nonzero(((both > 0) & (bound >= floor - 1e-9)).any(axis=1))[0]:
                exact = SequenceMatcher(None, "", shown[j])
                for i in np.nonzero((both[j] > 0) & (bound[j] >= floor - 1e-9))[0]:
                    exact.set_seq1(wanted[i])
                    value = 0.6 * float(overlap[j, i]) + 0.4 * exact.ratio()
                    if value >= least:
                        best[i] = sorted([*best[i], (-value, urls[j] or "", excerpts[j] or "", j + at)])[:top]
                        if len(best[i]) == top:
                            floor[i] = -best[i][-1][0]
        rows = [(i, j, -value) for i, made in enumerate(best) for value, *_, j in made]
        of_step, of_page = (pa.array([r[c] for r in rows], pa.int64()) for c in (0, 1))
        columns = [*(a.column(k).take(of_step) for k in KEYS), *(b.column(c).take(of_page) for c in ("url", "excerpt")), pa.array([r[2] for r in rows], pa.float64())]
        return pa.table([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    rows = left.groupBy("_part", "_block").cogroup(right.groupBy("_of_part", "_of_block")).applyInArrow(meet, schema)
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("confidence"), "url", "excerpt"))).filter(F.col("_r") <= top)
    return as_sources(rows, "knowledge")


def page_overlaps(wanted: DataFrame, pages: DataFrame, top: int = 3, block: int = 2048) -> DataFrame:
    """(keys, confidence, times): the best few pages (transcript_id, v) of a step's transcript by 0.6 of the Jaccard similarity of their words and the
    step's (keys, w); the last of them stands for all that are no better, `times` in all. Only words that both sides of a transcript have tell
    steps and pages apart: steps that have the same of them, and as many in all, meet the pages once, in blocks, as matrices inside tasks, so pairs of
    steps and pages are never rows."""
    pages = kept(pages.select("transcript_id", "v")).withColumn("_page", F.monotonically_increasing_id())  # equal rows stay apart
    used = wanted.select("transcript_id", F.explode("w").alias("word")).distinct()
    words = pages.select("transcript_id", "_page", F.size("v").alias("m"), F.explode("v").alias("word")).join(used, ["transcript_id", "word"])
    words = kept(words.groupBy("transcript_id", "_page", "m").agg(F.collect_list("word").alias("v")))
    told = words.select("transcript_id", F.explode("v").alias("word")).distinct()
    own = wanted.select(*KEYS, F.size("w").alias("n"), F.explode("w").alias("word")).join(told, ["transcript_id", "word"])
    own = kept(own.groupBy(*KEYS, "n").agg(F.sort_array(F.collect_list("word")).alias("w")))
    right = words.withColumn("_of_block", F.floor((F.row_number().over(Window.partitionBy("transcript_id").orderBy("_page")) - 1) / block)).select(F.col("transcript_id").alias("_of"), "_of_block", "m", "v")
    blocks = words.groupBy("transcript_id").agg(F.floor((F.count(F.lit(1)) - 1) / block).alias("_last"))
    left = own.select("transcript_id", "n", "w").distinct().join(blocks, "transcript_id").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).select("transcript_id", "_block", "n", "w")
    schema = K.StructType([*(left.schema[c] for c in ("transcript_id", "n", "w")), K.StructField("met", K.LongType()), K.StructField("best", K.ArrayType(K.DoubleType()))])
    kinds = to_arrow_schema(schema)

    def held(lists: list[list[str]], number: dict[str, int]) -> np.ndarray:
        made = np.zeros((len(lists), len(number)), np.float32)
        for i, own in enumerate(lists):
            made[i, [number[w] for w in own if w in number]] = 1
        return made

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        met, best = [], []
        if a.num_rows and b.num_rows:
            pages = b.column("v").to_pylist()
            number = {w: i for i, w in enumerate(dict.fromkeys(w for v in pages for w in v))}
            of_page, m = held(pages, number), b.column("m").to_numpy().astype(np.int64)
            for few in (a.slice(k, 512) for k in range(0, a.num_rows, 512)):
                both = np.rint(held(few.column("w").to_pylist(), number) @ of_page.T).astype(np.int64)
                value = 0.6 * both / (few.column("n").to_numpy().astype(np.int64)[:, None] + m - both)
                value = -np.sort(np.partition(-value, top - 1, axis=1)[:, :top] if len(m) > top else -value, axis=1)
                met += (both > 0).sum(axis=1).tolist()
                best += [[x for x in row if x > 0] for row in value.tolist()]
        else:
            a = a.slice(0, 0)
        return pa.table([*(a.column(c).cast(kinds.field(c).type) for c in ("transcript_id", "n", "w")), pa.array(met, pa.int64()), pa.array(best, pa.list_(pa.float64()))], schema=kinds)

    found = left.groupBy("transcript_id", "_block").cogroup(right.groupBy("_of", "_of_block")).applyInArrow(meet, schema)
    found = found.groupBy("transcript_id", "n", "w").agg(F.sum("met").alias("met"), F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, top).alias("best"))
    rows = own.join(found, ["transcript_id", "n", "w"]).select(*KEYS, "met", F.posexplode("best").alias("_place", "confidence"))
    return rows.select(*KEYS, "confidence", F.when(F.col("_place") == top - 1, F.col("met") - (top - 1)).otherwise(1).alias("times"))


def action_patterns(steps: DataFrame) -> DataFrame:
    """(keys, verb, target): the first listed verb that an action holds, and what follows it without articles."""
    low = F.lower("action")
    verb = F.get(T.found(low, L.PATTERN_VERBS), F.lit(0))
    rows = steps.select(*KEYS, F.posexplode("actions").alias("pos", "action")).withColumn("verb", verb).filter("verb IS NOT NULL")
    target = F.trim(F.substr(low, F.instr(low, F.col("verb")) + F.length("verb")))
    for article in ("the ", "a ", "an "):
        target = F.replace(target, F.lit(article), F.lit(""))
    return rows.withColumn("target", target).filter("target != ''").select(*KEYS, "pos", "verb", "target")


def screen_sources(steps: DataFrame, screens: DataFrame, top: int = 3) -> DataFrame:
    """Screens (transcript_id, filename, content, ui_elements array<struct<text, type>>) of the step's transcript: 0.8 where an action's target
    contains an element's text or the reverse, else the likeness of the whole screen from 0.4; the best three."""
    elements = screens.select("transcript_id", "filename", F.explode("ui_elements").alias("e")).select("transcript_id", "filename", F.lower("e.text").alias("element")).filter("element != ''")
    hit = action_patterns(steps).join(elements, "transcript_id").filter(F.contains("target", F.col("element")) | F.contains("element", F.col("target")))
    by_element = hit.groupBy(*KEYS, "filename").agg(F.sort_array(F.collect_set("element")).alias("ui_elements")).withColumn("confidence", F.lit(0.8))
    own = steps.select(*KEYS, F.lower(search_text(steps)).alias("wanted"))
    whole = own.join(screens.select("transcript_id", "filename", F.lower("content").alias("shown")), "transcript_id").withColumn("confidence", alike(F.col("wanted"), F.col("shown"), 0.4)).filter("confidence >= 0.4")
    both = by_element.unionByName(whole.select(*KEYS, "filename", F.array().cast("array<string>").alias("ui_elements"), "confidence"))
    best = both.groupBy(*KEYS, "filename").agg(F.max_by(F.struct("ui_elements", "confidence"), "confidence").alias("b")).select(*KEYS, "filename", "b.*")
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("confidence"), "filename"))).filter(F.col("_r") <= top)
    return as_sources(best.withColumnRenamed("filename", "screenshot_ref"), "visual")


def all_sources(*kinds: DataFrame) -> DataFrame:
    made = kinds[0]
    for other in kinds[1:]:
        made = made.unionByName(other, allowMissingColumns=True)
    return made
