"""All five stages over some hundred documents, each against plain Python over its own input."""

import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


def quality(rows):
    """Lines in over 20 distinct texts and a tenth of a host's texts go; short, repetitive and depleted documents go."""
    texts, holding = defaultdict(set), defaultdict(set)
    for _, text, _, host, _ in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if line.strip(BLANK):
                holding[host, line.strip(BLANK).lower()].add(text or "")
    common = {k for k, v in holding.items() if len(v) > 20 and len(v) > 0.1 * len(texts[k[0]])}
    kept = []
    for i, text, lang, host, _ in rows:
        words = WORD.findall(text or "")
        windows = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        often = Counter(windows)
        repeated = {j + k for j, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        gone = lambda line, host=host: bool(line.strip(BLANK)) and (host, line.strip(BLANK).lower()) in common
        size = lambda lines: sum(len("".join(WORD.findall(x))) for x in lines)
        lines = (text or "").split("\n")
        lost = size([x for x in lines if gone(x)])
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and 100 * lost <= 50 * size(lines):
            left = "\n".join(x for x in lines if not gone(x))
            kept.append((i, left, lang, host, len(left)))
    return kept


def near_duplicates(rows):
    """Of documents that links of 80 % of five-word shingles join, the one of least id."""
    sets = {}
    for i, text, *_ in rows:
        words = [w for w in WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))]
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def repeated_passages(rows):
    """Bytes of strings of 200 that start anywhere else go."""
    data = [(r, r[1].encode()) for r in rows]
    often = Counter(d[j : j + 200] for _, d in data for j in range(len(d) - 199))
    made = []
    for (i, _, lang, host, _), d in data:
        gone = [False] * len(d)
        last = 0
        for j in range(len(d) - 199):
            if often[d[j : j + 200]] > 1:
                for k in range(max(j, last), j + 200):
                    gone[k] = True
                last = j + 200
        edges = [0, *(k for k in range(1, len(d)) if gone[k] != gone[k - 1]), len(d)]
        text = "".join(d[a:b].decode("utf-8", "ignore") for a, b in pairwise(edges) if b > a and not gone[a])
        made.append((i, text, lang, host, len(text)))
    return made


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while len(stopped) < len(names):
        level = (total - sum(stopped.values())) / sum(w[s] for s in names if s not in stopped)
        more = {s: cap * sizes[s] for s in names if s not in stopped and w[s] * level > cap * sizes[s]}
        if not more:
            return stopped | {s: w[s] * level for s in names if s not in stopped}
        stopped |= more
    return stopped


def documents(spark):
    rng = random.Random(12)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    passage = own(70) + " é漢 " + own(20)
    for k in range(60):
        text = f"{own(40)}\nShared footer of the host\n{own(40)}"
        text = text.replace(" ", f" {passage} ", 1) if k % 6 == 0 else text
        rows.append((10_000 + k, text, "en", "made", len(text)))
        if k % 10 == 0:  # a chain of near copies, one of exact copies
            words = text.split(" ")
            rows.append((20_000 + k, " ".join([*words[:30], "changed", *words[31:]]), "en", "made", 0))
            rows.append((30_000 + k, text, "fr", "other", len(text)))
    rows.append((40_000, "Shared footer of the host\n" * 60, "en", "made", 0))
    rows.append((40_001, None, "en", None, None))
    return rows


def test_every_stage_equals_plain_python(spark):
    stages = dict(corpus_pipeline.STAGES)
    rows = documents(spark)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, plain in (("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages)):
        found = [tuple(r) for r in stages[name](spark, df, "").collect()]
        want = plain(rows)
        assert sorted(found, key=str) == sorted(want, key=str), name
        assert 0 < len(found) <= len(rows) and found != rows
        rows = found
        df = spark.createDataFrame(rows, df.schema)
    assert not any("Shared footer" in r[1] for r in rows if r[3] == "made")

    mixed = [tuple(r) for r in stages["source_mix"](spark, df, "").collect()]
    size = lambda r: len(WORD.findall(r[1]))
    assert set(mixed) <= set(rows) and max(Counter(mixed).values()) <= 2
    whole, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        whole[r[3]] += size(r)
    for r in mixed:
        taken[r[3]] += size(r)
    for source, target in targets(whole).items():
        least = min((size(r) for r in rows if r[3] == source and size(r)), default=0)
        assert target - max(2, least) <= taken[source] <= target + 1, source

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    coded = [(r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in stages["tokens"](spark, spark.createDataFrame(mixed, df.schema), "").collect()]
    want = []
    for r in mixed:
        ids = library.encode(r[1], add_special_tokens=False).ids
        want.append((r[0], r[3], len(ids), tuple(ids)))
    assert sorted(coded, key=str) == sorted(want, key=str)
