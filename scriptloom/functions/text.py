"""Text rules as columns; all of them run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L

STAMP = r"\d{1,2}:\d{2}:\d{2}(?:\.\d{3})?"
STAMP_PREFIX = rf"^(?:\[{STAMP}\]\s*|\({STAMP}\)\s*|<{STAMP}>?\s*|{STAMP}\s*-\s*|{STAMP}\s+)"
NAME = r"Speaker\s*\d*|[A-Z][a-z]+"
SPEAKER_PREFIX = rf"(?i)^(?:(Speaker\s*\d*)\s*:\s*|([A-Z][a-z]+)\s*:\s*|\[({NAME})\]\s*:\s*|>>\s*({NAME})\s*:\s*|\*\*({NAME})\*\*\s*:\s*)"


def words(text: Column) -> Column:
    """Words between white space; none for blank text."""
    t = F.btrim(text, F.lit(" \t\n\r\f\x0b"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(words(text)))


def literals(items: Iterable[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def found(text: Column, items: list[str]) -> Column:
    """Those of the words that the text contains anywhere, in list order."""
    return F.filter(literals(items), lambda w: F.contains(text, w))


def n_found(text: Column, items: list[str]) -> Column:
    return sum((F.contains(text, F.lit(x)).cast("int") for x in items[1:]), F.contains(text, F.lit(items[0])).cast("int"))


def quoted(items: Iterable[str]) -> str:
    return "|".join(sorted((re.escape(x).replace(r"\ ", " ") for x in items), key=len, reverse=True))


def without_webvtt(text: Column) -> Column:
    for pattern in (r"(?i)WEBVTT\s*", r"(?i)NOTE\s+[^\n]*\n", r"(?i)STYLE\s+[^\n]*\n", r"<v\s+[^>]+>", r"</v>"):
        text = F.regexp_replace(text, pattern, "")
    return text


def without_stamps(text: Column) -> Column:
    for pattern in (rf"\[{STAMP}\]", rf"\({STAMP}\)", rf"<{STAMP}>", rf"{STAMP}\s*-\s*", rf"^{STAMP}\s+"):
        text = F.regexp_replace(text, pattern, "")
    return text


def without_speakers(text: Column) -> Column:
    """Labels at the start of each line; white space after one doesn't reach into the next line."""
    blank = r"[ \t]*"
    for pattern in (rf"^(?:{NAME}){blank}:{blank}", rf"^\[(?:{NAME})\]{blank}:{blank}", rf"^>>{blank}(?:{NAME}){blank}:{blank}", rf"^\*\*(?:{NAME})\*\*{blank}:{blank}"):
        text = F.regexp_replace(text, f"(?im){pattern}", "")
    return text


def without_tags(text: Column) -> Column:
    """Known tags, then any bracketed words that aren't visual markers."""
    text = F.regexp_replace(text, "|".join(map(re.escape, L.TAGS)), "")
    text = F.regexp_replace(text, rf"(?i)\[(?!(?:{'|'.join(L.VISUAL)}))[\w\s]+\]", "")
    return F.regexp_replace(text, r"\([\w\s]+\)", "")


def without_fillers(text: Column, custom: Iterable[str] = ()) -> Column:
    return F.regexp_replace(text, rf"(?iU)\b(?:{quoted([*L.FILLERS, *(x.lower() for x in custom)])})\b", "")


def without_templates(text: Column) -> Column:
    for pattern in L.TEMPLATES:
        text = F.regexp_replace(text, f"(?i){pattern}", "")
    return text


def repaired_punctuation(text: Column) -> Column:
    text = F.regexp_replace(text, r"([.!?,;:])([A-Za-z])", "$1 $2")
    text = F.regexp_replace(text, r"\s+([.!?,;:])", "$1")
    return F.regexp_replace(text, r"([.!?]){2,}", "$1")


def tidy_space(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, " +", " "), r"\n{3,}", "\n\n")
    return F.btrim(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), "\n"), F.lit(" \t\r\n"))


def cleaned(text: Column, custom_fillers: Iterable[str] = ()) -> Column:
    """The whole chain without the removal of near-duplicate sentences (cleaning.merged_duplicates)."""
    return tidy_space(repaired_punctuation(without_templates(without_fillers(without_tags(without_speakers(without_stamps(without_webvtt(text)))), custom_fillers))))


def stamp_prefix(line: Column) -> Column:
    return F.regexp_extract(line, STAMP_PREFIX, 0)


def stamp_seconds(line: Column) -> Column:
    """Seconds of the stamp at the line's start; null without one. Milliseconds are dropped."""
    p = stamp_prefix(line)
    h, m, s = (F.regexp_extract(p, r"(\d{1,2}):(\d{2}):(\d{2})", i).cast("double") for i in (1, 2, 3))
    return F.when(p != "", h * 3600 + m * 60 + s)


def after_prefix(line: Column, prefix: Column) -> Column:
    return F.substr(line, F.length(prefix) + 1)


def speaker_name(line: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(line, SPEAKER_PREFIX, i), F.lit("")) for i in range(1, 6)])


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after . ! or ? before white space and a capital; those of three characters or fewer go."""
    parts = F.split(F.regexp_replace(text, r"([.!?]+)\s+(?=[A-Z])", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: F.length(x) > 3)


def is_question(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.endswith(F.trim(text), F.lit("?")) | F.rlike(t, F.lit(f"^(?:{'|'.join(L.QUESTION_WORDS)})( |$)"))


def is_transition(text: Column) -> Column:
    return F.rlike(text, F.lit("(?i)" + "|".join(L.TRANSITIONS)))


def has_emphasis(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\b[A-Z]{3,}\b")) | F.rlike(text, F.lit(r"\*\*[^*]+\*\*|__[^_]+__|[*_][^*_]+[*_]"))


def keywords(text: Column) -> Column:
    return F.array_distinct(F.filter(words(F.lower(text)), lambda w: (F.length(w) > 3) & ~w.isin(L.KEYWORD_STOPS)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def match_words(text: Column, stops: bool) -> Column:
    """Distinct lower-case words of more than two characters without outer punctuation, in text order."""
    own = F.transform(words(F.lower(text)), lambda w: F.btrim(w, F.lit(L.PUNCTUATION)))
    return F.array_distinct(F.filter(own, lambda w: (F.length(w) > 2) & ~w.isin(L.MATCH_STOPS) if stops else F.length(w) > 2))


def technical_score(sentence: Column) -> Column:
    s = F.lower(sentence)
    padded = F.concat(F.lit(" "), s, F.lit(" "))
    score = sum((F.contains(padded, F.lit(f" {k} ")).cast("double") * 0.15 for k in L.CODE_WORDS), F.lit(0.0))
    score += n_found(s, L.TECHNICAL_TERMS) * 0.10
    for pattern, weight in ((r"\d+", 0.05), (r"https?://|www\.", 0.10), (r"\d+%", 0.08), (r"\d+\s*(ms|kb|mb|gb|tb|rpm|dpi|px)", 0.12)):
        score += F.rlike(s, F.lit(pattern)).cast("double") * weight
    score += F.least(F.lit(0.15), (F.length(sentence) - F.length(F.translate(sentence, "\"'`", ""))) * 0.05)
    score += (n_found(s, L.TECHNICAL_VERBS) > 0).cast("double") * 0.06
    score += F.rlike(s, F.lit(r"\[screen\s+shows|\[diagram|\[code|\[architecture")).cast("double") * 0.10
    n = word_count(sentence)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n < 5, score * 0.5).when(n > 15, score + 0.05).otherwise(score)))


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def title_from(name: Column) -> Column:
    return F.initcap(F.translate(name, "_-", "  "))


def _text(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def _with_rest(n: Column, unit: str, rest: Column, rest_unit: str) -> Column:
    return F.concat(_text(n), F.lit(unit), F.when(rest > 0, F.concat(F.lit(" "), _text(rest), F.lit(rest_unit))).otherwise(""))


def duration_text(seconds: Column) -> Column:
    """`just now`, `n secs`, `m min s sec`, `h hr m min`, `d days h hr`; a zero rest is left out."""
    s = F.abs(seconds)
    minutes = F.floor(s / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(s < 1, "just now").when(s < 60, F.concat(_text(F.round(s)), F.lit(" secs")))
        .when(minutes < 60, _with_rest(minutes, " min", F.round(s % 60), " sec"))
        .when(hours < 24, _with_rest(hours, " hr", minutes % 60, " min"))
        .otherwise(F.concat(_text(days), F.when(days == 1, " day").otherwise(" days"), F.when(hours % 24 > 0, F.concat(F.lit(" "), _text(hours % 24), F.lit(" hr"))).otherwise("")))
    )


def relative_text(seconds: Column) -> Column:
    """How long ago, for an age in seconds; `just now` under 5 seconds and for the future."""
    s = F.floor(seconds)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(_text(F.floor(n)), F.lit(f" {unit}"), F.when(F.floor(n) == 1, "").otherwise("s"), F.lit(" ago"))

    return F.when(s < 5, "just now").when(s < 60, F.concat(_text(s), F.lit(" secs ago"))).when(s < 3600, ago(s / 60, "min")).when(s < 86400, ago(s / 3600, "hr")).otherwise(ago(s / 86400, "day"))


def ui_class(text: Column) -> Column:
    low, n = F.lower(text), F.length(text)
    return (
        F.when(n_found(low, L.BUTTONS) > 0, "button")
        .when(F.contains(text, F.lit("...")) | F.contains(text, F.lit("▶")) | F.contains(text, F.lit(">")), "menu_item")
        .when((n < 30) & ~F.endswith(text, F.lit(".")), "label").when(n > 50, "content").otherwise("text")
    )


def band(x: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    made = F.when(x >= steps[0][0], steps[0][1])
    for low, name in steps[1:]:
        made = made.when(x >= low, name)
    return made.otherwise(rest)
