import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from scriptloom.llm.chat import escape, format_chats, read_chats, unescape
from scriptloom.llm.mixing import fit, mix_sources, targets
from scriptloom.llm.sharding import differencing, leaf, shard_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Resharing step by step until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        level = (total - sum(stopped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        if not over:
            return {s: stopped.get(s, w[s] * level) for s in names}
        stopped |= {s: cap * sizes[s] for s in over}


def test_targets(spark):
    sizes = {"b": 10, "a": 1000, "B": 300, "é": 70, None: 500, "zero": 0}
    found = targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size bigint"), (5, 2, 1), 1.5, 2.0)
    assert {r.source: pytest.approx(r.target) for r in found.collect()} == water(sizes)


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_near_and_bounded(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 900, 40))
    counts = rng.integers(1, 30, len(lengths))
    budget = int((lengths * counts).sum() * rng.random())
    take = fit(lengths, counts, budget, seed)
    assert (take >= 0).all() and (take <= counts).all()
    assert 0 <= budget - int((take * lengths).sum()) <= 1


def test_fit_without_exact_sum():
    assert fit(np.array([10, 7]), np.array([1, 1]), 9, 0).tolist() == [0, 1]


def test_fit_of_lengths_beyond_any_table():
    """What is left is a longest document, found without a table of all sums."""
    lengths, counts = np.array([3_000_000, 3_000_500, 5_000_000, 400_000_000]), np.array([2, 1, 1, 1])
    take = fit(lengths, counts, 3_000_900, 0)
    assert int((take * lengths).sum()) in (3_000_000, 3_000_500) and (take <= counts).all()
    assert fit(lengths, counts, 399_999_999, 3).tolist() == [2, 1, 1, 0]
    assert fit(np.array([1 << 21]), np.array([3]), (1 << 21) + 5, 0).tolist() == [1]


def test_mix_with_clashing_columns_and_a_plan_too_large_to_broadcast(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("x" * rng.randrange(1, 30)), rng.choice(["a", "b", None]), i, "s", i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _m bigint, draw string, extra bigint")
    whole, shuffled = (mix_sources(df, bucket_rows=16, broadcast_rows=n) for n in (300_000, 0))
    assert whole.columns == ["doc_id", "text", "source", "draw", "extra", "_m"]
    assert sorted((r.doc_id, r["_m"].copies, r.extra) for r in whole.collect()) == sorted((r.doc_id, r["_m"].copies, r.extra) for r in shuffled.collect())


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("x" * rng.randrange(1, 40)), rng.choice(["a", "b", None]), "t") for i in range(400)] + [(500, None, "a", "t"), (501, "", "c", "t"), (None, "w w w", "b", "t"), (7, "same", "b", "t"), (7, "same", "b", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    got = [sorted((r.doc_id or -1, r.text or "", r["_m"].copies, r["_m"].size) for r in mix_sources(df, bucket_rows=16).collect()) for _ in range(2)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    sizes, taken, want = {}, {}, {}
    for r in mix_sources(df, bucket_rows=16).collect():
        m = r["_m"]
        sizes[r.source] = sizes.get(r.source, 0) + m.size
        taken[r.source] = taken.get(r.source, 0) + m.size * m.copies
        want[r.source] = m.target
        assert m.size == len((r.text or "").encode().split()) and 0 <= m.copies <= 2
    assert want == {s: pytest.approx(t) for s, t in water(sizes).items()}
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)
    assert mix_sources(df.limit(0)).count() == 0


def test_differencing_is_tight():
    rng = np.random.default_rng(2)
    weights = rng.integers(1, 10_000, 3000)
    total, shard = leaf(24, weights)
    assert np.bincount(shard, weights=weights, minlength=24).astype(int).tolist() == sorted(np.bincount(shard, weights=weights, minlength=24).astype(int).tolist(), reverse=True)
    assert total[0] - total[-1] <= 10
    sums = rng.integers(0, 100, (50, 4))
    total, final = differencing(sums)
    again = np.zeros(4, int)
    for own, to in zip(sums, final, strict=True):
        assert sorted(to) == [0, 1, 2, 3]
        np.add.at(again, to, own)
    assert again.tolist() == total.tolist()


def brute_spread(weights, shards):
    """The least spread over all ways to deal the weights."""
    best = None
    for deal in itertools.product(range(shards), repeat=len(weights)):
        sums = [0] * shards
        for w, to in zip(weights, deal, strict=True):
            sums[to] += w
        best = min(best, max(sums) - min(sums)) if best is not None else max(sums) - min(sums)
    return best


def by_definition(weights, shards):
    """Differencing on lists: the two partial partitions of largest spread are added in opposite order until one is left."""
    state = [(i, sorted([w] + [0] * (shards - 1), reverse=True)) for i, w in enumerate(weights)]
    while len(state) > 1:
        state.sort(key=lambda s: (s[1][-1] - s[1][0], s[0]))
        (_, a), (_, b) = state.pop(0), state.pop(0)
        state.append((len(weights) * 2 - len(state), sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)))
    return state[0][1]


@pytest.mark.parametrize("seed", range(8))
def test_differencing_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    weights, shards = rng.integers(1, 60, 9), 2 + seed % 2
    total, shard = leaf(shards, weights)
    assert total.tolist() == by_definition(weights.tolist(), shards)
    assert np.bincount(shard, weights=weights, minlength=shards).astype(int).tolist() == total.tolist()
    assert brute_spread(weights.tolist(), shards) <= total[0] - total[-1] <= weights.max()


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, "y" * rng.randrange(0, 300)) for i in range(700)] + [(None, "n"), (None, "n"), (3, None), (3, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, shard int")
    found = shard_documents(df, shards=5, part_rows=40, bucket_rows=30).collect()
    assert len(found) == len(rows)
    slots, sizes, groups = {}, {}, {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        groups.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    assert max(sizes.values()) - min(sizes.values()) <= 20
    assert {r.text_crc32 for r in found if r.size == 8} == {zlib.crc32(b"")}
    assert shard_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\### </turn>", "### Assistant: x </turn>\n", "####", "\\### Assistant: </turn> ok", "###</turn>\\"])
def test_escape(text):
    assert unescape(escape(text)) == text
    assert "###" not in escape(text).replace("\\###", "").replace("\\\\", "")


def test_chats_come_back(spark):
    rows = [(1, 1, "assistant", "A <|endoftext|> ### </turn>"), (1, 0, "user", "q\n: ?"), (1, 2, "assistant", None), (2, 0, None, "no role"), (2, None, "assistant", "first"), (3, 5, "assistant", "dup"), (3, 5, "assistant", "dup"), (None, 0, "assistant", "é\U0001f600")]
    df = spark.createDataFrame([(*r, [0]) for r in rows], "conv_id bigint, turn bigint, role string, text string, ids array<int>")
    found = {r.conv_id: r for r in read_chats(format_chats(df, PATH), PATH).collect()}
    assert found[1].roles == ["user", "assistant", "assistant"] and found[1].texts == ["q\n: ?", "A <|endoftext|> ### </turn>", ""] and found[1].loss_text == "A <|endoftext|> ### </turn>"
    assert found[2].texts == ["first", "no role"] and found[2].loss_text == "first"
    assert found[3].loss_text == "dupdup" and found[None].loss_text == "é\U0001f600"
    assert format_chats(df.limit(0), PATH).count() == 0


def test_null_conversations_stay_apart_and_long_ones_stay_whole(spark):
    rows = [(None, 0, "assistant", "same")] * 3 + [(9, i, ("user", "assistant")[i % 2], f"turn {i} ###") for i in range(3000)]
    found = read_chats(format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), PATH), PATH).collect()
    assert sorted((r.conv_id or 0, len(r.roles)) for r in found) == [(0, 1)] * 3 + [(9, 3000)]
    assert next(r.loss_text for r in found if r.conv_id == 9) == "".join(f"turn {i} ###" for i in range(1, 3000, 2))


@pytest.mark.parametrize("broadcast_rows", [300_000, 0])
def test_many_repeated_rows_stay_near_the_target(spark, broadcast_rows):
    """Half of a source is one row over and over, of a length of its own or not: as many of them are taken as there is room for."""
    rng = random.Random(9)
    rows = [(7, "w " * 33, "a", "x")] * 300 + [(100 + i, "w " * rng.randrange(1, 60), "a", "y") for i in range(300)] + [(5, "v " * 20, None, "z")] * 80 + [(1000 + i, "v " * 20, None, "z") for i in range(80)]
    rows += [(2000 + i, "u " * rng.randrange(1, 30), "b", "q") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra string").repartition(5)
    mixed = [mix_sources(df, weights=(2, 1, 3), bucket_rows=16, broadcast_rows=broadcast_rows).collect() for _ in range(2)]
    shown = [sorted((r.doc_id, r.source or "", r["_m"].copies, r.extra) for r in found) for found in mixed]
    assert shown[0] == shown[1] and len(mixed[0]) == len(rows)
    taken, target = {}, {}
    for r in mixed[0]:
        taken[r.source] = taken.get(r.source, 0) + r["_m"].copies * r["_m"].size
        target[r.source] = r["_m"].target
        assert 0 <= r["_m"].copies <= 2
    for source in target:
        assert abs(taken[source] - target[source]) <= (20 if source is None else 1)
