"""Bounds of the similarity of characters, and pages against steps by them, against plain Python."""

import random
from difflib import SequenceMatcher

from scriptloom import lexicon as L
from scriptloom.operators import matching
from scriptloom.operators.postings import most_alike, ratio_from


def texts(rng, n):
    common = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8))) for _ in range(40)]
    return [" ".join(rng.choice(common) if rng.random() < 0.9 else rng.choice(["x1", "Quartz?", "é漢", "ZZ top"]) for _ in range(rng.choice((1, 8, 35, 60, 400)))) for _ in range(n)]


def test_no_text_is_more_alike_than_its_bound(spark):
    rng = random.Random(7)
    own = ["", "a", "ab" * 150, *texts(rng, 30)]
    pairs = [(x, y) for x in own for y in own] + [(x, x[: len(x) // 2] + y + x[len(x) // 3 :]) for x in own for y in own[:6]]
    assert all(SequenceMatcher(None, x, y).ratio() <= most_alike(x, y) + 1e-12 for x, y in pairs)
    assert all(ratio_from(x, y, t) == (r if (r := SequenceMatcher(None, x, y).ratio()) >= t else 0.0) for x, y in pairs[::3] for t in (0.4, 0.9))
    # random words are told apart without being compared
    assert sum(most_alike(x, y) < 0.6 for x, y in pairs) > len(pairs) / 4


def test_pages_of_one_url_stay_apart(spark):
    """As all pairs of steps and pages, also where pages share a url: these were added up and multiplied by a join."""
    rng = random.Random(9)
    own = texts(rng, 12)
    pages = [(f"u{i % 17}", f"t{i}", (rng.choice(own) if i % 2 else "") + x, None) for i, x in enumerate(texts(rng, 50))] + [("u1", "e", own[0], "timeout"), ("u2", "n", None, None), ("u3", "b", "", None)]
    steps = [(str(i), i % 3, f"Step {i}", x[:50], x, ["Open it"]) for i, x in enumerate(own)]
    words = lambda t, stops: {w for w in (x.strip(L.PUNCTUATION) for x in t.lower().split()) if len(w) > 2 and not (stops and w in L.MATCH_STOPS)}
    want = []
    for t, i, title, summary, details, actions in steps:
        text = f"{title} {summary} {details} {' '.join(actions)}"
        w, hits = words(text, True), []
        for url, name, content, error in pages:
            v = words(content or "", False)
            if error is None and content and w & v:
                value = 0.6 * (len(w & v) / len(w | v)) + 0.4 * SequenceMatcher(None, text.lower(), content[:2000].lower()).ratio()
                if value >= 0.2:
                    hits.append((-value, url, f"[{name}]({url})\n{content[:300]}"))
        want += [(t, i, round(-x, 9), e) for x, _, e in sorted(hits)[:3]]
    df = spark.createDataFrame(steps, "transcript_id string, step_index int, title string, summary string, details string, actions array<string>")
    for block in (512, 5):
        found = matching.knowledge_sources(df, spark.createDataFrame(pages, "url string, title string, content string, error string"), block=block).collect()
        assert sorted((r.transcript_id, r.step_index, round(r.confidence, 9), r.excerpt) for r in found) == sorted(want)
    assert len(want) > 20
