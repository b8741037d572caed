"""Blocks of few texts against many inside a task: postings of words, and how alike two texts can be at most."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Hashable, Iterable
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import numpy as np

Index = tuple[dict[Hashable, int], np.ndarray, np.ndarray]
#: characters of a gram
GRAM = 5


def posted(lists: list[Iterable[Hashable]]) -> Index:
    """(number of each word, where its postings begin, postings): which of the lists hold a word."""
    of: dict[Hashable, list[int]] = {}
    for i, own in enumerate(lists):
        for word in own:
            of.setdefault(word, []).append(i)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in of.values()])]).astype(np.int64)
    return {word: i for i, word in enumerate(of)}, starts, np.array([i for x in of.values() for i in x], np.int64)


def shared_words(texts: list[Iterable[Hashable]], index: Index, width: int) -> np.ndarray:
    """How many words each of the texts (its distinct words) has in common with each of the posted lists."""
    numbers, starts, flat = index
    met = [[numbers[w] for w in own if w in numbers] for own in texts]
    word, row = np.array([w for x in met for w in x], np.int64), np.repeat(np.arange(len(met)), [len(x) for x in met])
    n = starts[word + 1] - starts[word]
    at = np.repeat(starts[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.bincount(np.repeat(row, n) * width + flat[at], minlength=len(met) * width).reshape(len(met), width)


def parts_of(chars: int, most: int = 32 << 20) -> int:
    """How many parts texts of so many characters are dealt into: of `most` at most, and 64 where that leaves a million to each."""
    return max(1, -(-chars // most), min(64, chars >> 20))


def numbered(text: str) -> list[tuple[str, int]]:
    """The grams of a text with a number for each repeat."""
    seen: dict[str, int] = {}
    made = []
    for i in range(len(text) - GRAM + 1):
        gram = text[i : i + GRAM]
        seen[gram] = n = seen.get(gram, 0) + 1
        made.append((gram, n))
    return made


def most_matched(common: np.ndarray | int, seeds: np.ndarray | int, grams: np.ndarray | int) -> np.ndarray:
    """How many characters of two texts a, b difflib's SequenceMatcher can match at most, from what they share (with repeats): characters, characters
    that it doesn't take for frequent ones of b, and grams. Every block but one at the start of both holds one of the seeds, and a block of k
    characters holds k - GRAM + 1 grams."""
    return np.minimum(common, grams + (GRAM - 1) * (seeds + 1))


def rare_counts(count: dict[str, int], length: int) -> dict[str, int]:
    """The characters of b that SequenceMatcher doesn't take for frequent ones."""
    return {c: n for c, n in count.items() if length < 200 or n <= length // 100 + 1}


@lru_cache(maxsize=512)
def profile(text: str) -> tuple[Counter, dict[str, int], Counter]:
    """Characters, those that SequenceMatcher doesn't take for frequent ones, grams."""
    count = Counter(text)
    return count, rare_counts(count, len(text)), Counter([text[i : i + GRAM] for i in range(len(text) - GRAM + 1)])


@lru_cache(maxsize=64)
def matcher(b: str) -> SequenceMatcher:
    return SequenceMatcher(None, "", b)


def most_alike(a: str, b: str) -> float:
    """What SequenceMatcher(None, a, b).ratio() can be at most."""
    if not a and not b:
        return 1.0
    (x, _, g), (y, rare, h) = profile(a), profile(b)
    common, seeds = (sum(min(n, x[c]) for c, n in own.items()) for own in (y, rare))
    grams = sum(min(g[c], h[c]) for c in g.keys() & h.keys())
    return 2.0 * float(most_matched(common, seeds, grams)) / (len(a) + len(b))


def ratio_from(a: str, b: str, least: float) -> float:
    """SequenceMatcher(None, a, b).ratio() where it is `least` or more, else 0. Its blocks are found as there; once those found and what is left
    between them can't be enough, the rest isn't looked at."""
    if not a and not b:
        return 1.0 if least <= 1.0 else 0.0
    if most_alike(a, b) < least - 1e-9:
        return 0.0
    m, both = matcher(b), len(a) + len(b)
    m.set_seq1(a)
    # up to each place of b, the grams that a has and the seeds: a range can't match more than these allow, as in most_matched
    (x, _, g), (_, rare, _) = profile(a), profile(b)
    grams = [0, *accumulate(b[i : i + GRAM] in g for i in range(len(b)))]
    seeds = [0, *accumulate(c in rare and c in x for c in b)]

    def room(alo: int, ahi: int, blo: int, bhi: int) -> int:
        return min(ahi - alo, bhi - blo, grams[max(blo, bhi - GRAM + 1)] - grams[blo] + (GRAM - 1) * (seeds[bhi] - seeds[blo] + 1))

    first = (0, len(a), 0, len(b))
    matched, possible, ranges = 0, room(*first), deque([first])
    while ranges:
        if 2.0 * possible / both < least - 1e-9:
            return 0.0
        part = alo, ahi, blo, bhi = ranges.popleft()
        i, j, k = m.find_longest_match(*part)
        possible -= room(*part)
        if k:
            matched, possible = matched + k, possible + k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    possible += room(*part)
                    ranges.append(part)
    ratio = 2.0 * matched / both
    return ratio if ratio >= least else 0.0
