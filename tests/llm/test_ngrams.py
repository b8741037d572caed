import random

import pytest

from scriptloom.llm.components import components
from scriptloom.llm.ngram_join import ngram_components


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([40, 120, 300]))] for _ in range(12)]
    rows = []
    for w in base:
        for _ in range(rng.choice([1, 2, 14])):
            own = list(w)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rows += [rows[0].upper(), rows[0], rows[1], "two words", "Two words", "two words x", "one", "", "  ", None, "common " * 50]
    return [(i * 3 % 101, t) for i, t in enumerate(rows)]


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()).split()
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in sets)


@pytest.mark.parametrize("size,percent,block_bytes", [(3, 90, 1 << 22), (5, 80, 3000)])
def test_against_brute_force(spark, size, percent, block_bytes):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id bigint, text string, component_id string, n int")
    found = ngram_components(df, size=size, percent=percent, fragments=3, block_bytes=block_bytes, list_rows=2 if percent == 80 else 1000).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, size, percent)


def test_null_and_repeated_ids(spark):
    t = " ".join(f"q{i}" for i in range(40))
    df = spark.createDataFrame([(None, t), (4, t), (2, t), (2, t), (9, "else where now")], "doc_id bigint, text string")
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_components(df).collect())
    assert found == [(0, 0), (2, 2), (2, 2), (4, 2), (9, 9)]
    assert ngram_components(df.limit(0)).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links).collect()}
    assert set(found.values()) == {0, 100} and found[40] == 0 and len(found) == 43
