"""SQL twins of the queries, written apart from them, for an engine with the tables as views."""

from __future__ import annotations

from . import lexicon as L


def q(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def hits(text: str, items) -> str:
    """How many of the words the text holds."""
    return f"len(list_filter([{q(items)}], lambda w: contains({text}, w)))"


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


S = r"\d{1,2}:\d{2}:\d{2}(?:\.\d{3})?"
STAMP = rx(rf"^(?:\[{S}\]\s*|\({S}\)\s*|<{S}>?\s*|{S}\s*-\s*|{S}\s+)")
N = r"Speaker\s*\d*|[A-Z][a-z]+"
NAME = rx(rf"(?i)^(?:(Speaker\s*\d*)\s*:\s*|([A-Z][a-z]+)\s*:\s*|\[({N})\]\s*:\s*|>>\s*({N})\s*:\s*|\*\*({N})\*\*\s*:\s*)")

LINES = """
le AS (SELECT *, CAST(floor((minute(ts) * 60 + floor(second(ts))) / 6) AS INT) AS sec FROM events),
lines AS (
  SELECT CAST(CAST(ts AS DATE) AS STRING) || '-' || lpad(CAST(hour(ts) AS STRING), 2, '0') AS transcript_id,
    row_number() OVER (PARTITION BY CAST(ts AS DATE), hour(ts) ORDER BY ts, event_id) - 1 AS line_no,
    '[00:' || lpad(CAST(CAST(floor(sec / 60) AS INT) AS STRING), 2, '0') || ':' || lpad(CAST(sec % 60 AS STRING), 2, '0') || '] Speaker ' || CASE WHEN user_id % 5 = 0 THEN '2' ELSE '1' END || ': '
    || CASE event_type WHEN 'click' THEN 'Click the Create button. Then select the region from the list.'
       WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'What does the overview page show? Is it the same for everyone?' ELSE 'Open the overview page and check the settings.' END
       WHEN 'signup' THEN 'Enter your name and save the form. The form keeps the name.'
       WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'Now let''s look at the ERROR page. Reset the password again.' ELSE 'The ERROR page is empty.' END
       ELSE 'That was really helpful. Thanks!' END AS line
  FROM le)"""

CHAT = "lines AS (SELECT CAST(conv_id AS STRING) AS transcript_id, turn AS line_no, upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text AS line FROM conversations)"

CUT = r"string_split(regexp_replace({t}, '([.!?]+)\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"


def sentence_list(text: str) -> str:
    return f"list_filter(list_transform({CUT.format(t=text)}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 3)"


SENTENCES = f"""
p1 AS (SELECT transcript_id, line_no, trim(line, ' ' || chr(9) || chr(13)) AS l, regexp_extract(trim(line, ' ' || chr(9) || chr(13)), {STAMP}, 0) AS p FROM lines),
p2 AS (SELECT transcript_id, line_no, CASE WHEN p <> '' THEN CAST(regexp_extract(p, '(\\d{{1,2}}):(\\d{{2}}):(\\d{{2}})', 1) AS DOUBLE) * 3600 + CAST(regexp_extract(p, '(\\d{{1,2}}):(\\d{{2}}):(\\d{{2}})', 2) AS DOUBLE) * 60
         + CAST(regexp_extract(p, '(\\d{{1,2}}):(\\d{{2}}):(\\d{{2}})', 3) AS DOUBLE) END AS timestamp, substr(l, length(p) + 1) AS r FROM p1 WHERE l <> ''),
p3 AS (SELECT transcript_id, line_no, timestamp, coalesce({", ".join(f"nullif(regexp_extract(r, {NAME}, {i}), '')" for i in range(1, 6))}) AS speaker, substr(r, length(regexp_extract(r, {NAME}, 0)) + 1) AS r FROM p2),
p4 AS (SELECT transcript_id, line_no, timestamp, speaker, {sentence_list("r")} AS parts FROM p3),
p5 AS (SELECT transcript_id, line_no, timestamp, speaker, unnest(parts) AS text, generate_subscripts(parts, 1) AS pos FROM p4),
p6 AS (SELECT transcript_id, timestamp, speaker, text, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY line_no, pos) - 1 AS INT) AS sentence_index FROM p5),
p7 AS (SELECT *, (ends_with(trim(text), '?') OR regexp_matches(lower(trim(text)), '^({"|".join(L.QUESTION_WORDS)})( |$)')) AS is_question,
         regexp_matches(text, {rx("(?i)" + "|".join(L.TRANSITIONS))}) AS is_transition,
         (regexp_matches(text, '\\b[A-Z]{{3,}}\\b') OR regexp_matches(text, '\\*\\*[^*]+\\*\\*|__[^_]+__|[*_][^*_]+[*_]')) AS has_emphasis,
         lag(timestamp) OVER o AS pts, lag(speaker) OVER o AS psp, count(*) OVER (PARTITION BY transcript_id, speaker) AS sn, min(sentence_index) OVER (PARTITION BY transcript_id, speaker) AS sf
       FROM p6 WINDOW o AS (PARTITION BY transcript_id ORDER BY sentence_index)),
pr AS (SELECT transcript_id, speaker AS main FROM (SELECT transcript_id, speaker, row_number() OVER (PARTITION BY transcript_id ORDER BY sn DESC, sf) AS k FROM p7 WHERE speaker IS NOT NULL) WHERE k = 1),
sentences AS (SELECT p7.transcript_id, sentence_index, timestamp, speaker, text, is_question, is_transition, has_emphasis, coalesce(timestamp <> 0 AND pts <> 0 AND timestamp - pts > 90, false) AS follows_long_pause,
         coalesce(speaker <> psp, false) AS speaker_changed, CASE WHEN speaker IS NULL THEN NULL WHEN speaker = main THEN 'instructor' ELSE 'participant' END AS speaker_role
       FROM p7 LEFT JOIN pr ON p7.transcript_id = pr.transcript_id)"""

KW = f"list_distinct(list_filter(regexp_split_to_array(trim(lower({{t}})), '\\s+'), lambda w: length(w) > 3 AND NOT list_contains([{q(L.KEYWORD_STOPS)}], w)))"

SCORES = f"""
b1 AS (SELECT *, lag(timestamp) OVER o AS lts, lag(speaker_role) OVER o AS lrole, {KW.format(t="text")} AS kw, lag({KW.format(t="text")}) OVER o AS lkw FROM sentences WINDOW o AS (PARTITION BY transcript_id ORDER BY sentence_index)),
b2 AS (SELECT *, CASE WHEN timestamp IS NULL OR lts IS NULL THEN 0.0 WHEN follows_long_pause THEN 1.0 ELSE least(CAST((timestamp - lts) AS DOUBLE) / 90, 1.0) END AS gap_score,
         CASE WHEN NOT speaker_changed THEN 0.0 WHEN lrole = 'participant' AND speaker_role = 'instructor' THEN 1.0 WHEN is_transition THEN 0.8 ELSE 0.3 END AS speaker_score,
         CASE WHEN is_transition THEN 1.0 ELSE 0.0 END AS transition_score,
         CASE WHEN lkw IS NULL OR len(lkw) = 0 OR len(kw) = 0 THEN 0.5 ELSE 1.0 - CAST(len(list_intersect(kw, lkw)) AS DOUBLE) / len(list_distinct(list_concat(kw, lkw))) END AS dissimilarity FROM b1),
b3 AS (SELECT *, least(1.0, CAST(gap_score AS DOUBLE) * CAST(0.35 AS DOUBLE) + CAST(speaker_score AS DOUBLE) * CAST(0.25 AS DOUBLE) + CAST(transition_score AS DOUBLE) * CAST(0.30 AS DOUBLE)) AS boundary_score FROM b2),
scored AS (SELECT *, sentence_index = 0 OR boundary_score > CAST(0.4 AS DOUBLE) OR coalesce(follows_long_pause AND timestamp <> 0, false) OR (is_transition AND boundary_score >= CAST(0.3 AS DOUBLE)) AS is_boundary FROM b3)"""

SEGMENTS = """
g1 AS (SELECT *, sum(CAST(is_boundary AS INT)) OVER (PARTITION BY transcript_id ORDER BY sentence_index) AS s0 FROM scored),
g2 AS (SELECT *, count(*) OVER (PARTITION BY transcript_id, s0) AS z0 FROM g1),
g3 AS (SELECT *, sum(CAST(is_boundary AND (sentence_index = 0 OR z0 >= 2) AS INT)) OVER (PARTITION BY transcript_id ORDER BY sentence_index) - 1 AS s1 FROM g2),
g4 AS (SELECT *, count(*) OVER (PARTITION BY transcript_id, s1) AS z1, row_number() OVER (PARTITION BY transcript_id, s1 ORDER BY sentence_index) - 1 AS pos, max(s1) OVER (PARTITION BY transcript_id) + 1 AS n FROM g3),
big AS (SELECT transcript_id, s1 AS largest FROM (SELECT DISTINCT transcript_id, s1, z1, dense_rank() OVER (PARTITION BY transcript_id ORDER BY z1 DESC, s1) AS k FROM g4) WHERE k = 1),
g5 AS (SELECT g4.*, n < 3 AND s1 = largest AND z1 >= 2 AS fallback_split, 4 - n AS parts FROM g4 JOIN big ON g4.transcript_id = big.transcript_id),
g6 AS (SELECT *, CASE WHEN fallback_split THEN least(floor(pos / greatest(2, floor(z1 / parts))), parts - 1) ELSE 0 END AS part FROM g5),
rowz AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY transcript_id ORDER BY s1, part) - 1 AS INT) AS segment_id FROM g6),
who AS (SELECT transcript_id, segment_id, speaker AS primary_speaker FROM (SELECT transcript_id, segment_id, speaker, row_number() OVER (PARTITION BY transcript_id, segment_id ORDER BY count(*) DESC, min(sentence_index)) AS k
        FROM rowz WHERE speaker IS NOT NULL GROUP BY transcript_id, segment_id, speaker) WHERE k = 1),
texts AS (SELECT transcript_id, segment_id, string_agg(text, ' ' ORDER BY sentence_index) AS text, count(*) AS n FROM rowz GROUP BY ALL)"""

BASE = f"WITH {LINES}, {SENTENCES}"
SEG = f"{BASE}, {SCORES}, {SEGMENTS}"

COH = f"""
k1 AS (SELECT transcript_id, segment_id, sentence_index, {KW.format(t="text")} AS kw FROM rowz),
k2 AS (SELECT a.transcript_id, a.segment_id, avg(CAST(len(list_intersect(a.kw, b.kw)) AS DOUBLE) / len(list_distinct(list_concat(a.kw, b.kw)))) AS c
       FROM k1 a JOIN k1 b ON a.transcript_id = b.transcript_id AND a.segment_id = b.segment_id AND a.sentence_index < b.sentence_index WHERE len(a.kw) > 0 AND len(b.kw) > 0 GROUP BY ALL),
coh AS (SELECT t.transcript_id, t.segment_id, CASE WHEN n = 1 THEN 1.0 ELSE coalesce(c, 0.5) END AS coherence FROM texts t LEFT JOIN k2 ON t.transcript_id = k2.transcript_id AND t.segment_id = k2.segment_id)"""

RANK = f"""{COH},
i1 AS (SELECT transcript_id, segment_id, count(*) AS n_sentences, count_if(list_has_any(regexp_split_to_array(trim(lower(text)), '\\s+')[1:2], [{q(L.RANK_VERBS)}])) AS imp FROM rowz GROUP BY ALL),
i2 AS (SELECT i1.*, {hits("lower(text)", L.RANK_VERBS)} AS verbs, {hits("lower(text)", L.SEQUENCE_WORDS)} AS sq, coherence FROM i1 JOIN texts t USING (transcript_id, segment_id) JOIN coh USING (transcript_id, segment_id)),
i3 AS (SELECT *, least(1.0, least(1.0, CAST(verbs AS DOUBLE) / (n_sentences * 2)) * 0.5 + CAST(imp AS DOUBLE) / n_sentences * 0.3 + least(1.0, sq / greatest(1.0, CAST(n_sentences AS DOUBLE) / 3)) * 0.2) AS procedural, least(1.0, CAST(verbs AS DOUBLE) / n_sentences / 3) AS action_density FROM i2),
ranked AS (SELECT *, procedural * 0.4 + action_density * 0.3 + coherence * 0.3 AS importance FROM i3)"""

STEPS = f"""
steps AS (SELECT transcript_id, segment_id AS step_index, 'Step ' || CAST(segment_id + 1 AS STRING) || ': Process from transcript' AS title, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS summary, text AS details,
          {sentence_list("text")} AS actions FROM texts),
st AS (SELECT *, len(actions) AS na, len(actions) / 10.0 AS conf FROM steps)"""

P = ".,!?;:()[]{}\"''"


def match_words(text: str, stop: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(trim(lower({text})), '\\s+'), lambda w: trim(w, '{P}')), lambda w: length(w) > 2{stop}))"


STOP = f" AND NOT list_contains([{q(L.MATCH_STOPS)}], w)"
MATCH = f"""
ms AS (SELECT transcript_id, step_index, actions, {match_words("title || ' ' || summary || ' ' || details || ' ' || array_to_string(actions, ' ')", STOP)} AS w FROM st),
mt AS (SELECT transcript_id, sentence_index, text, {match_words("text", "")} AS v FROM sentences),
cand AS (SELECT ms.transcript_id, step_index, sentence_index, len(list_intersect(w, v)) AS shared, len(w) AS n_step, len(v) AS n_sentence, actions, text FROM ms JOIN mt ON ms.transcript_id = mt.transcript_id WHERE len(list_intersect(w, v)) >= 3)"""


def technical(t: str) -> str:
    low = f"lower({t})"
    code = " + ".join(f"CASE WHEN contains(' ' || {low} || ' ', ' {k} ') THEN 0.15 ELSE 0 END" for k in L.CODE_WORDS)
    words = f"len(regexp_split_to_array(trim({t}), '\\s+'))"
    rest = " + ".join(f"CASE WHEN regexp_matches({low}, {rx(p)}) THEN {w} ELSE 0 END" for p, w in ((r"\d+", 0.05), (r"https?://|www\.", 0.10), (r"\d+%", 0.08), (r"\d+\s*(ms|kb|mb|gb|tb|rpm|dpi|px)", 0.12), (r"\[screen\s+shows|\[diagram|\[code|\[architecture", 0.10)))
    quotes = f"least(0.15, (length({t}) - length(replace(replace(replace({t}, '\"', ''), '''', ''), '`', ''))) * 0.05)"
    score = f"CAST({code} + {hits(low, L.TECHNICAL_TERMS)} * 0.10 + {rest} + {quotes} + CASE WHEN {hits(low, L.TECHNICAL_VERBS)} > 0 THEN 0.06 ELSE 0 END AS DOUBLE)"
    return f"greatest(0.0, least(1.0, CASE WHEN {words} < 5 THEN {score} * 0.5 WHEN {words} > 15 THEN {score} + 0.05 ELSE {score} END))"


SOURCES = f"""{MATCH},
so1 AS (SELECT *, CAST(shared AS DOUBLE) / (n_step + n_sentence - shared) * 0.5 + CASE WHEN len(list_filter([{q(L.BARE_VERBS)}], lambda v: list_contains(actions, v) AND contains(lower(text), v))) > 0 THEN 0.1 ELSE 0 END AS base, {technical("text")} AS tech FROM cand),
so2 AS (SELECT *, CAST(base * 0.85 AS DOUBLE) AS x FROM so1),
so3 AS (SELECT *, least(1.0, CASE WHEN x >= 0.1 THEN x + tech * 0.2 ELSE x END) AS confidence FROM so2),
sources AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, step_index ORDER BY round(confidence, 9) DESC, sentence_index) AS rn FROM so3 WHERE confidence >= 0.15) WHERE rn <= 5),
conf AS (SELECT transcript_id, step_index, count(*) AS n, max(CASE WHEN rn = 1 THEN confidence ELSE 0 END) AS c1, max(CASE WHEN rn = 2 THEN confidence ELSE 0 END) AS c2, max(CASE WHEN rn = 3 THEN confidence ELSE 0 END) AS c3 FROM sources GROUP BY ALL),
confidence AS (SELECT transcript_id, step_index, n, least(1.0, CASE WHEN n = 1 THEN c1 WHEN n = 2 THEN c1 * 0.6 + c2 * 0.4 ELSE c1 * 0.5 + c2 * 0.3 + c3 * 0.2 END
          * CASE WHEN n >= 4 THEN 1.25 WHEN n = 3 THEN 1.15 WHEN n = 2 THEN 1.08 ELSE 1.0 END * CASE WHEN c1 > 0.5 THEN 1.1 ELSE 1.0 END) AS confidence FROM conf)"""

GENERIC = rx("|".join(L.GENERIC_TITLES))
REPEATS = "len(actions) - len(list_distinct(list_transform(actions, lambda a: lower(trim(a)))))"
CHECKED = f"""
v1 AS (SELECT *, list_filter([CASE WHEN na < 3 THEN 'insufficient_actions' END, CASE WHEN na > 15 THEN 'too_many_actions' END, CASE WHEN length(title) < 10 THEN 'short_title' END, CASE WHEN regexp_matches(lower(trim(title)), {GENERIC}) THEN 'generic_title' END,
         CASE WHEN length(details) < 20 THEN 'insufficient_details' END, CASE WHEN conf < MINC THEN 'very_low_confidence' WHEN conf < 0.4 THEN 'low_confidence' END, CASE WHEN {REPEATS} > 0 THEN 'duplicate_actions' END], lambda x: x IS NOT NULL) AS issues FROM st),
v2 AS (SELECT *, len(list_filter(issues, lambda x: x IN ('insufficient_actions', 'very_low_confidence'))) AS n_errors, list_contains(issues, 'duplicate_actions') AS has_duplicates,
         greatest(0.0, least(1.0, CASE WHEN na >= 3 THEN least(1.0, na / 6.0) ELSE na / 3.0 END * 0.4 + CASE WHEN length(title) >= 10 THEN least(1.0, length(title) / 100.0) ELSE length(title) / 10.0 END * 0.2
           + CASE WHEN length(details) >= 20 THEN least(1.0, length(details) / 60.0) ELSE length(details) / 20.0 END * 0.2 + conf * 0.2)) AS quality FROM v1)"""
VERBS = f"""
av AS (SELECT transcript_id, step_index, unnest(actions) AS action FROM st),
aw AS (SELECT *, trim(lower(regexp_split_to_array(trim(action), '\\s+')[1]), '{P}') AS verb FROM av),
ax AS (SELECT *, CASE WHEN trim(action) = '' THEN 'empty' WHEN verb IN ({q(L.WEAK_VERBS)}) THEN 'weak' WHEN verb IN ({q(L.STRONG_VERBS)}) THEN 'strong' ELSE 'unknown' END AS class FROM aw),
ay AS (SELECT transcript_id, step_index, count_if(class IN ('weak', 'empty')) AS n_weak, count_if(class = 'strong') AS n_strong, count_if(class = 'unknown') AS n_unknown FROM ax GROUP BY ALL),
az AS (SELECT st.transcript_id, st.step_index, na AS n_actions, coalesce(n_weak, 0) AS n_weak, coalesce(n_strong, 0) AS n_strong, len(regexp_split_to_array(trim(details), '\\s+')) AS content_words,
         coalesce(n_unknown, 0) + 1 + CAST(lower(trim(summary)) = lower(trim(title)) AS INT) AS n_warnings FROM st LEFT JOIN ay ON st.transcript_id = ay.transcript_id AND st.step_index = ay.step_index),
checks AS (SELECT *, n_actions BETWEEN 3 AND 6 AND n_weak = 0 AND content_words >= 50 AS passed FROM az)"""

DOCS = "docs AS (SELECT CAST(doc_id AS STRING) AS transcript_id, text FROM documents)"
CHUNKS = f"""{DOCS},
c1 AS (SELECT transcript_id, {sentence_list("text")} AS parts FROM docs),
c2 AS (SELECT transcript_id, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM c1),
c3 AS (SELECT *, CASE WHEN n <= 8 THEN 1 ELSE greatest(2, least(20, ceil(n / 8.0))) END AS size FROM c2),
chunks AS (SELECT transcript_id, CAST(floor(pos / size) AS INT) AS chunk_index, string_agg(part, ' ' ORDER BY pos) AS text FROM c3 GROUP BY ALL)"""
PARAS = """pd AS (SELECT CAST(doc_id AS STRING) AS transcript_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS parts FROM documents),
pe AS (SELECT transcript_id, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM pd),
pf AS (SELECT transcript_id, CAST(floor(pos / CASE WHEN n <= 8 THEN 1 ELSE ceil(n / 8.0) END) AS INT) AS chunk_index, string_agg(part, chr(10) || chr(10) ORDER BY pos) AS text FROM pe GROUP BY ALL)"""

JOBS = """jobs AS (SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'processing' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at,
  CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 200000) AS updated_at, CAST(o_orderkey % 9 AS INT) AS total_steps FROM orders)"""
CRAWL = """crawl AS (SELECT url, TIMESTAMP '2026-01-01 00:00:00' - to_hours(CAST(page_id % 40 AS INT)) AS fetched_at, CASE WHEN page_id % 7 = 0 THEN 'timeout' END AS error, page_id, html,
  trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages)"""


def no_label(pattern: str, text: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x: regexp_replace(x, {rx('(?i)' + pattern)}, '')), chr(10))"


def replaced(text: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        text = f"regexp_replace({text}, {rx(pattern)}, '{by}', 'g')"
    return text


_stamps = replaced("line || ' 00:01:02 - end <00:00:01>'", *[(p, "") for p in (rf"\[{S}\]", rf"\({S}\)", rf"<{S}>", rf"{S}\s*-\s*", rf"^{S}\s+")])
for _p in (rf"^(?:{N})\s*:\s*", rf"^\[(?:{N})\]\s*:\s*", rf"^>>\s*(?:{N})\s*:\s*", rf"^\*\*(?:{N})\*\*\s*:\s*"):
    _stamps = no_label(_p, _stamps)
_fill = "(?i)\\b(?:" + "|".join(sorted(L.FILLERS, key=len, reverse=True)) + ")\\b"
# word boundaries are ASCII in this dialect: word characters beyond ASCII are framed by ASCII letters while words are removed; code point 1 shows
# what is a frame, its own occurrences are followed by 2
_wide = "|".join(rf"[^\x00-\x7F\P{{{c}}}]" for c in ("L", "M", "Nd", "Nl", "Pc")) + r"|[\x{200C}\x{200D}\x{24B6}-\x{24E9}]"
_prose = replaced(
    "'WEBVTT' || chr(10) || 'NOTE x' || chr(10) || 'Um, like I said, ' || text || '  you know !! Ok'", (r"(?i)WEBVTT\s*", ""), (r"(?i)NOTE\s+[^\n]*\n", ""), (r"(?i)STYLE\s+[^\n]*\n", ""), (r"<v\s+[^>]+>", ""), (r"</v>", ""), (r"\x01", "\x01\x02"), (f"({_wide})", "Q\x01\x03\\1\x01\x03Q"), (_fill, ""), (r"Q\x01\x03|\x01\x03Q", ""), (r"\x01\x02", "\x01"),
    *[("(?i)" + p, "") for p in L.TEMPLATES], (r"([.!?,;:])([A-Za-z])", r"\1 \2"), (r"\s+([.!?,;:])", r"\1"), (r"([.!?]){2,}", r"\1"), (" +", " "),
)
_prose = f"regexp_replace({_prose}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
_prose = f"trim(array_to_string(list_transform(string_split({_prose}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), chr(10)), ' ' || chr(9) || chr(10) || chr(13))"

ORACLES: dict[str, str] = {
    "src_read_job": f"WITH {JOBS} SELECT id, user_id, status, total_steps FROM jobs ORDER BY created_at, id LIMIT 1",
    "snk_upsert": f"""WITH {JOBS}, b AS (SELECT CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'n' || id ELSE id END AS id, user_id, created_at FROM jobs WHERE status = 'processing'), w AS (SELECT id, user_id, 'completed' AS status, created_at, TIMESTAMP '2026-01-01 00:00:00' AS updated_at FROM b),
        u AS (SELECT id, user_id, status, created_at, updated_at FROM jobs WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT * FROM w) SELECT id, user_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM u""",
    "snk_insert": f"""WITH {JOBS}, n AS (SELECT CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'n' || id ELSE id END AS id, status FROM jobs), w AS (SELECT id, status, 1 AS turn FROM n UNION ALL SELECT id, 'queued', 2 FROM n)
        SELECT CASE WHEN turn = 1 AND starts_with(id, 'n') THEN 'inserted' ELSE 'rejected' END AS kind, id, status FROM w""",
    "snk_delete": f"WITH {JOBS} SELECT 'jobs' AS kind, count(*) AS n FROM jobs WHERE status <> 'failed' UNION ALL SELECT 'documents', count(*) FROM lineitem WHERE CAST(l_orderkey AS STRING) NOT IN (SELECT id FROM jobs WHERE status = 'failed')",
    "cln_stamps_speakers": f"WITH {LINES} SELECT transcript_id, line_no, {_stamps} AS text FROM lines",
    "cln_fillers": f"SELECT doc_id, {_prose} AS text FROM documents",
    "cln_exact_duplicates": f"""WITH {DOCS}, a AS (SELECT transcript_id, list_transform(string_split(text, '. '), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))) AS p FROM docs),
        b AS (SELECT transcript_id, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM a), c AS (SELECT transcript_id, arg_min(s, pos) AS s, min(pos) AS pos FROM b WHERE s <> '' GROUP BY transcript_id, lower(s)),
        d AS (SELECT transcript_id, string_agg(s, '. ' ORDER BY pos) AS t FROM c GROUP BY 1) SELECT docs.transcript_id, length(coalesce(t, '')) AS chars, md5(coalesce(t, '')) AS digest FROM docs LEFT JOIN d ON docs.transcript_id = d.transcript_id""",
    "prs_sentences": f"{BASE} SELECT *, text AS raw_text FROM sentences",
    "prs_chats": f"WITH {CHAT}, {SENTENCES} SELECT speaker, speaker_role, count(*) AS n, count_if(speaker_changed) AS changes, count_if(is_question) AS questions FROM sentences GROUP BY 1, 2",
    "prs_metadata": f"""{BASE}, n AS (SELECT transcript_id, speaker, count(*) AS n, min(sentence_index) AS f FROM sentences WHERE speaker IS NOT NULL GROUP BY ALL),
        w AS (SELECT transcript_id, string_agg(speaker, ',' ORDER BY f) AS speaker_names, first(speaker ORDER BY n DESC, f) AS primary_speaker, max(n) AS n, count(*) AS k FROM n GROUP BY 1)
        SELECT s.transcript_id, count(*) AS sentence_count, count_if(is_question) AS question_count, count_if(is_transition) AS transition_count, max(timestamp) AS duration, bool_or(timestamp IS NOT NULL) AS has_timestamps,
        bool_or(is_question AND speaker_role = 'participant') AS has_qa_sections, any_value(speaker_names) AS speaker_names, any_value(primary_speaker) AS primary_speaker, CAST(any_value(k) AS INT) AS speaker_count, round(CAST(any_value(n) AS DOUBLE) / count(*), 6) AS primary_ratio
        FROM sentences s LEFT JOIN w ON s.transcript_id = w.transcript_id GROUP BY 1""",
    "chk_sentences": f"WITH {CHUNKS} SELECT transcript_id, chunk_index, md5(text) AS digest FROM chunks",
    "chk_statistics": f"WITH {CHUNKS} SELECT transcript_id, chunk_index, length(text) AS chars, len(regexp_split_to_array(trim(text), '\\s+')) AS words, len({sentence_list('text')}) AS sentences, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM chunks",
    "chk_paragraphs": f"WITH {PARAS} SELECT transcript_id, chunk_index, length(text) AS chars FROM pf",
    # each window ends where the size is full, its first new word whatever its length; the next begins with its last fifth
    "chk_word_windows": f"""WITH RECURSIVE {DOCS}, w0 AS (SELECT transcript_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS p FROM docs),
        w1 AS (SELECT transcript_id, length(unnest(p)) + 1 AS k, generate_subscripts(p, 1) AS i FROM w0), w2 AS (SELECT transcript_id, i, CAST(sum(k) OVER (PARTITION BY transcript_id ORDER BY i) AS BIGINT) AS c FROM w1),
        w3 AS (SELECT transcript_id, list(c ORDER BY i) AS ends FROM w2 GROUP BY 1),
        win AS (SELECT transcript_id, CAST(1 AS BIGINT) AS s, CAST(greatest(1, len(list_filter(ends, lambda x: x <= 500))) AS BIGINT) AS e FROM w3
          UNION ALL SELECT transcript_id, s, CAST(greatest(first, len(list_filter(ends, lambda x: x <= before + 500))) AS BIGINT) FROM
            (SELECT v.transcript_id, s, first, ends, CASE WHEN s > 1 THEN ends[s - 1] ELSE 0 END AS before FROM (SELECT transcript_id, e - greatest(1, (e - s + 1) // 5) + 1 AS s, e + 1 AS first FROM win) v JOIN w3 ON v.transcript_id = w3.transcript_id WHERE first <= len(ends)))
        SELECT win.transcript_id, count(*) AS windows, CAST(max(ends[e] - CASE WHEN s > 1 THEN ends[s - 1] ELSE 0 END - 1) AS INT) AS longest FROM win JOIN w3 ON win.transcript_id = w3.transcript_id GROUP BY 1""",
    "chk_step_count": f"WITH {CHUNKS} SELECT transcript_id, CAST(greatest(3, least(15, max(n))) AS INT) AS steps FROM c2 GROUP BY 1",
    "str_paragraphs": f"WITH {PARAS} SELECT transcript_id, count(*) AS n, sum(length(part)) AS chars FROM pe GROUP BY 1",
    "segments": f"""{SEG} , sc AS (SELECT transcript_id, segment_id, '{{' || string_agg('"' || speaker || '":' || CAST(n AS STRING), ',' ORDER BY speaker) || '}}' AS speaker_counts FROM (SELECT transcript_id, segment_id, speaker, count(*) AS n FROM rowz WHERE speaker IS NOT NULL GROUP BY ALL) GROUP BY ALL)
        SELECT r.transcript_id, r.segment_id, any_value(speaker_counts) AS speaker_counts, min(sentence_index) AS first_index, max(sentence_index) AS last_index, count(*) AS n_sentences, min(timestamp) AS start_ts, max(timestamp) AS end_ts, max(timestamp) - min(timestamp) AS duration, any_value(primary_speaker) AS primary_speaker,
        count_if(is_question) AS question_count, arg_min(is_transition, sentence_index) AS has_transition_start, bool_or(is_question AND speaker_role = 'participant') AS has_qa_section, bool_or(fallback_split) AS fallback_split
        FROM rowz r LEFT JOIN who w ON r.transcript_id = w.transcript_id AND r.segment_id = w.segment_id LEFT JOIN sc ON r.transcript_id = sc.transcript_id AND r.segment_id = sc.segment_id GROUP BY 1, 2""",
    "seg_scores": f"{BASE}, {SCORES} SELECT transcript_id, sentence_index, round(CAST(gap_score AS DOUBLE), 6) AS gap_score, CAST(speaker_score AS DOUBLE) AS speaker_score, CAST(transition_score AS DOUBLE) AS transition_score, round(CAST(dissimilarity AS DOUBLE), 6) AS dissimilarity, round(boundary_score, 6) AS boundary_score, is_boundary FROM scored",
    "seg_coherence": f"{SEG}, {COH} SELECT transcript_id, segment_id, round(CAST(coherence AS DOUBLE), 6) AS coherence FROM coh",
    "seg_texts": f"{SEG} SELECT transcript_id, segment_id, text FROM texts",
    "qaf_sections": f"""{SEG} SELECT r.transcript_id, r.segment_id, count(*) AS n_sentences, count_if(is_question) AS question_count, round(avg(CAST(is_question AS INT)), 6) AS density, min(sentence_index) AS first_index, max(sentence_index) AS last_index,
        any_value(primary_speaker) AS primary_speaker, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM rowz r LEFT JOIN who w ON r.transcript_id = w.transcript_id AND r.segment_id = w.segment_id GROUP BY 1, 2
        HAVING avg(CAST(is_question AS INT)) >= 0.3 AND count_if(is_question) >= 2""",
    "qaf_kept": f"{SEG}, d AS (SELECT transcript_id, segment_id, count(*) AS n, count_if(is_question) AS k FROM rowz GROUP BY ALL) SELECT transcript_id, count(*) AS segments, CAST(sum(n) AS BIGINT) AS sentences FROM d WHERE NOT (k >= 0.3 * n AND k >= 2) GROUP BY 1",
    "qaf_statistics": f"""{SEG}, d AS (SELECT transcript_id, segment_id, count(*) AS n, count_if(is_question) AS k FROM rowz GROUP BY ALL) SELECT transcript_id, count(*) AS segments, count_if(k >= 0.3 * n AND k >= 2) AS qa_segments, CAST(sum(k) AS BIGINT) AS questions,
        CAST(sum(n) AS BIGINT) AS sentences, count(*) - count_if(k >= 0.3 * n AND k >= 2) AS kept, round(CAST(sum(k) AS DOUBLE) / sum(n), 6) AS density, round(CAST(count_if(k >= 0.3 * n AND k >= 2) AS DOUBLE) / count(*), 6) AS filter_rate FROM d GROUP BY 1""",
    "rnk_scores": f"""{SEG}, {RANK} SELECT transcript_id, segment_id, n_sentences, CAST(verbs AS INT) AS verbs, round(procedural, 6) AS procedural, round(action_density, 6) AS action_density, round(importance, 6) AS importance,
        round(CAST(coherence AS DOUBLE), 6) AS coherence, round(procedural * 0.4, 6) AS part_procedural, round(action_density * 0.3, 6) AS part_density, round(CAST(coherence AS DOUBLE) * 0.3, 6) AS part_coherence, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY round(importance, 9) DESC, segment_id) AS INT) AS rank FROM ranked""",
    "rnk_important": f"{SEG}, {RANK} SELECT transcript_id, segment_id, round(importance, 6) AS importance FROM ranked WHERE round(importance, 9) >= 0.3",
    "rnk_report": f"{SEG}, {RANK}, x AS (SELECT transcript_id, round(importance, 6) AS i FROM ranked) SELECT transcript_id, count(*) AS segments, count_if(i >= 0.7) AS high, count_if(i >= 0.3 AND i < 0.7) AS medium, count_if(i < 0.3) AS low, round(max(i), 3) AS max, round(min(i), 3) AS min, ((2 * sum(CAST(round(i * 1000000) AS BIGINT)) + 1000 * count(*)) // (2000 * count(*))) / 1000.0 AS avg, round(stddev_pop(i), 3) AS std FROM x GROUP BY 1",
    "str_structure": f"""{SEG}, t AS (SELECT transcript_id, string_agg(text, ' ' ORDER BY segment_id) AS text FROM texts GROUP BY 1), u AS (SELECT transcript_id, CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS INT) AS words,
        list_filter([{q(L.STRUCTURE_VERBS)}], lambda w: contains(lower(text), w)) AS a, list_filter([{q(L.ROLES)}], lambda w: contains(lower(text), w)) AS r, list_filter([{q(L.DECISIONS)}], lambda w: contains(lower(text), w)) AS d FROM t)
        SELECT transcript_id, words, array_to_string(a, ',') AS actions, array_to_string(r, ',') AS roles, array_to_string(d, ',') AS decisions,
        CAST(greatest(3, least(15, greatest(3, least(15, floor(words / 100))) + CASE WHEN len(a) > 10 THEN 2 ELSE 0 END + CASE WHEN len(d) > 3 THEN 1 ELSE 0 END)) AS INT) AS suggested_steps FROM u""",
    "str_sequence_counts": f"WITH {LINES} SELECT transcript_id, {', '.join(f'CAST(sum(len(regexp_extract_all(lower(line), {rx(p)}))) AS BIGINT) AS family_{i}' for i, p in enumerate(L.SEQUENCE_PATTERNS))} FROM lines GROUP BY 1",
    "str_ui_classes": f"{BASE} SELECT transcript_id, sentence_index, CASE WHEN {hits('lower(text)', L.BUTTONS)} > 0 THEN 'button' WHEN contains(text, '...') OR contains(text, '▶') OR contains(text, '>') THEN 'menu_item' WHEN length(text) < 30 AND NOT ends_with(text, '.') THEN 'label' WHEN length(text) > 50 THEN 'content' ELSE 'text' END AS type FROM sentences",
    "stp_from_chunks": f"WITH {CHUNKS} SELECT transcript_id, chunk_index AS step_index, 'Step ' || CAST(chunk_index + 1 AS STRING) || ': Process from transcript' AS title, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS summary FROM chunks",
    "stp_tokens": "SELECT CAST(l_orderkey AS STRING) AS transcript_id, CAST(sum(l_partkey) AS BIGINT) AS input_tokens, CAST(sum(l_suppkey) AS BIGINT) AS output_tokens, CAST(sum(l_partkey) + sum(l_suppkey) AS BIGINT) AS total_tokens, round(CAST(sum(l_partkey) AS DOUBLE) / 1000000 * 0.15 + CAST(sum(l_suppkey) AS DOUBLE) / 1000000 * 0.6, 4) AS cost FROM lineitem GROUP BY 1",
    "mat_technical": f"WITH {CHAT}, {SENTENCES} SELECT transcript_id, sentence_index, round({technical('text')}, 6) AS score FROM sentences",
    "mat_candidates": f"{SEG}, {STEPS}, {MATCH} SELECT transcript_id, step_index, sentence_index, CAST(n_step AS INT) AS n_step, CAST(n_sentence AS INT) AS n_sentence, shared, round(CAST(shared AS DOUBLE) / (n_step + n_sentence - shared), 6) AS word_overlap FROM cand",
    "mat_sources": f"{SEG}, {STEPS}, {SOURCES} SELECT transcript_id, step_index, sentence_index, round(confidence, 6) AS confidence FROM sources",
    "mat_cosine": "WITH c AS (SELECT label, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY 1) SELECT vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(c AS DOUBLE[])))), 5) AS score FROM embeddings JOIN c USING (label)",
    "mat_patterns": f"""{SEG}, {STEPS}, a AS (SELECT transcript_id, step_index, unnest(actions) AS action, CAST(generate_subscripts(actions, 1) - 1 AS INT) AS pos FROM st), b AS (SELECT *, list_filter([{q(L.PATTERN_VERBS)}], lambda v: contains(lower(action), v))[1] AS verb FROM a)
        SELECT transcript_id, step_index, pos, verb, target FROM (SELECT *, replace(replace(replace(trim(substr(lower(action), strpos(lower(action), verb) + length(verb))), 'the ', ''), 'a ', ''), 'an ', '') AS target FROM b WHERE verb IS NOT NULL) WHERE target <> ''""",
    "cnf_confidence": f"{SEG}, {STEPS}, {SOURCES} SELECT transcript_id, step_index, n AS n_sources, round(confidence, 6) AS confidence, confidence >= 0.4 AS is_grounded, CAST(CAST(confidence < 0.7 AS INT) + CAST(n = 1 AS INT) AS INT) AS n_warnings FROM confidence",
    "cnf_summary": f"{SEG}, {STEPS}, {SOURCES} SELECT transcript_id, step_index, 'transcript (' || CAST(n AS STRING) || ')' AS summary FROM confidence",
    "cnf_records": f"{SEG}, {STEPS}, {SOURCES} SELECT transcript_id, step_index, n AS n_sources, CAST(n AS INT) AS listed, true AS has_transcript_support FROM confidence",
    "cnf_bands": """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS c, CAST(o_orderkey % 7 AS DOUBLE) / 6 AS z FROM orders) SELECT o_orderkey, round(c, 6) AS confidence, CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS indicator,
        CASE WHEN c >= 0.75 THEN 'Very High' WHEN c >= 0.55 THEN 'High' WHEN c >= 0.35 THEN 'Medium' WHEN c >= 0.2 THEN 'Low' ELSE 'Very Low' END AS level, CASE WHEN c >= 0.85 THEN 'Very High' WHEN c >= 0.7 THEN 'High' WHEN c >= 0.5 THEN 'Medium' WHEN c >= 0.3 THEN 'Low' ELSE 'Very Low' END AS document_label,
        CASE WHEN c >= 0.85 THEN 'green' WHEN c >= 0.7 THEN 'blue' WHEN c >= 0.5 THEN 'yellow' ELSE 'red' END AS color,
        round(greatest(0.0, least(1.0, (c * 0.7 + z * 0.3) * CASE WHEN z >= 0.8 THEN 1.1 WHEN z >= 0.6 THEN 1.05 WHEN z < 0.3 THEN 0.95 ELSE 1.0 END)), 6) AS blended FROM o""",
    "val_checked": f"""{SEG}, {STEPS}, {CHECKED.replace("MINC", "0.2")} SELECT transcript_id, step_index, n_errors = 0 AS is_valid, CAST(n_errors AS INT) AS n_errors, has_duplicates, round(CAST(quality AS DOUBLE), 6) AS quality, array_to_string(issues, ',') AS issue_types,
        CAST(CASE WHEN n_errors = 0 THEN 0 ELSE CAST(list_contains(issues, 'insufficient_actions') AS INT) + CAST(has_duplicates AS INT) END AS INT) AS n_fixes FROM v2""",
    "val_report": f"""{SEG}, {STEPS}, {CHECKED.replace("MINC", "0.2")}, z AS (SELECT *, round(CAST(quality AS DOUBLE), 6) AS qq FROM v2) SELECT count(*) AS steps, count_if(n_errors = 0) AS valid, round(avg(CAST(n_errors = 0 AS INT)), 6) AS rate, round(avg(qq), 6) AS avg_quality, round(min(qq), 6) AS min_quality, round(max(qq), 6) AS max_quality,
        round(avg(na), 6) AS avg_actions, round(CAST(avg(conf) AS DOUBLE), 6) AS avg_confidence, count_if(qq >= 0.8) AS high, count_if(qq >= 0.5 AND qq < 0.8) AS medium, count_if(qq < 0.5) AS low FROM z""",
    "val_issues": f"""{SEG}, {STEPS}, {CHECKED.replace("MINC", "0.2")}, e AS (SELECT unnest(issues) AS type FROM v2), f AS (SELECT type, CASE WHEN type IN ('insufficient_actions', 'very_low_confidence') THEN 'error' WHEN type = 'generic_title' THEN 'info' ELSE 'warning' END AS severity FROM e)
        SELECT severity, type, count(*) AS n FROM f GROUP BY ROLLUP (severity, type)""",
    "val_actions": f"{SEG}, {STEPS}, {VERBS} SELECT transcript_id, step_index, CAST(n_actions AS INT) AS n_actions, n_weak, n_strong, CAST(content_words AS INT) AS content_words, n_warnings, passed FROM checks",
    "val_verbs": f"{SEG}, {STEPS}, {VERBS} SELECT verb, class, CASE WHEN class = 'weak' THEN 'too vague: ' || verb END AS suggestion, count(*) AS n FROM ax GROUP BY 1, 2, 3",
    "val_summary": f"{SEG}, {STEPS}, {VERBS} SELECT count(*) AS steps, count_if(passed) AS passed, count_if(NOT passed) AS failed, CAST(sum(n_warnings) AS BIGINT) AS warnings, coalesce((SELECT string_agg(DISTINCT verb, ',' ORDER BY verb) FROM ax WHERE class = 'weak'), '') AS weak_verbs FROM checks",
    "val_accepted": f"""{SEG}, {STEPS}, {CHECKED.replace("MINC", "0.25")}, {VERBS}, {SOURCES}, j AS (SELECT v2.n_errors, passed, coalesce(confidence, 0) AS c, coalesce(n, 0) AS n FROM v2 JOIN checks USING (transcript_id, step_index) LEFT JOIN confidence USING (transcript_id, step_index)),
        k AS (SELECT CASE WHEN NOT passed THEN 'actions' WHEN NOT (c >= 0.25 OR (n >= 1 AND c >= 0.2)) THEN 'sources' WHEN n_errors > 0 THEN 'validation' END AS reason FROM j) SELECT reason IS NULL AS accepted, reason, count(*) AS n FROM k GROUP BY 1, 2""",
    "val_corpus": f"""{SEG}, {STEPS}, {VERBS} SELECT count(*) AS steps, CAST(sum(n_actions) AS BIGINT) AS actions, round(avg(n_actions), 6) AS avg_actions, CAST(sum(n_strong) AS BIGINT) AS strong, CAST(sum(n_weak) AS BIGINT) AS weak, CAST(sum(content_words) AS BIGINT) AS words,
        round(avg(content_words), 6) AS avg_words, bool_and(n_actions BETWEEN 3 AND 6) AS all_counts, bool_and(n_weak = 0) AS no_weak, bool_and(content_words >= 50) AS all_long FROM checks""",
    "knw_to_fetch": f"WITH {CRAWL}, f AS (SELECT url, fetched_at AS t, coalesce(error, '') AS e FROM crawl QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, error IS NULL DESC) = 1) SELECT md5(url) AS key, url FROM f WHERE NOT (e = '' AND TIMESTAMP '2026-01-01 00:00:00' - t < INTERVAL 24 HOUR)",
    "knw_types": f"WITH {CRAWL}, p AS (SELECT error, lower(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[?#].*', '')) AS path FROM crawl) SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN path LIKE '%.pdf' THEN 'pdf' WHEN path LIKE '%.txt' OR path LIKE '%.md' THEN 'text' ELSE 'web' END AS type, count(*) AS n FROM p GROUP BY 1",
    "knw_near_excerpts": """WITH p AS (SELECT page_id, url, count(*) OVER () AS n FROM pages), w AS (SELECT url, vec_id // n AS window_index, 'label ' || CAST(label AS STRING) AS win, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN p ON page_id = vec_id % n),
        g AS (SELECT DISTINCT vec_id AS query_id, url, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN p ON page_id = (vec_id * 3 + 1) % n OR page_id = (vec_id * 5 + 2) % n),
        h AS (SELECT query_id, g.url, window_index, win, greatest(0.0, least(1.0, list_cosine_similarity(g.v, w.v))) AS score FROM g JOIN w ON g.url = w.url),
        f AS (SELECT * FROM h WHERE score > 0.1 QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY round(score, 9) DESC, window_index, coalesce(md5(win), ''), score DESC) <= 3)
        SELECT query_id, url, window_index, win AS "window", round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, url, window_index, coalesce(md5(win), ''), score DESC) AS INT) AS rank FROM f QUALIFY rank <= 5""",
    "knw_digest": f"WITH {CRAWL} SELECT url, length('Source: ' || coalesce(title, '') || chr(10) || 'URL: ' || url || chr(10) || chr(10)) + CASE WHEN length(html) > 2000 THEN 2003 ELSE length(html) END AS chars FROM crawl WHERE error IS NULL",
    "knw_usage": f"WITH {CRAWL} SELECT count_if(error IS NULL) AS fetched, count(DISTINCT left(html, 100)) AS cited, round(CAST(count(DISTINCT left(html, 100)) AS DOUBLE) / count_if(error IS NULL), 6) AS rate FROM crawl",
    "doc_contents": f"{SEG}, {STEPS} SELECT transcript_id, 100 + step_index AS position, 'Step ' || CAST(step_index + 1 AS STRING) || ': ' || title AS entry FROM st UNION ALL SELECT DISTINCT transcript_id, p, e FROM st, (VALUES (0, 'Introduction'), (1000000, 'Source References'), (1000001, 'Document Statistics')) AS v(p, e)",
    "doc_references": f"{SEG}, {STEPS}, {SOURCES} SELECT transcript_id, step_index, CAST(row_number() OVER (PARTITION BY transcript_id, step_index ORDER BY round(confidence, 6) DESC, sentence_index) AS INT) AS number, 'Transcript (Sentence ' || CAST(sentence_index + 1 AS STRING) || ')' AS label FROM sources",
    "doc_statistics": f"""{SEG}, {STEPS}, {SOURCES}, u AS (SELECT transcript_id, count(*) * 7.5 AS s, CAST(sum(length(line)) AS BIGINT) AS total_tokens FROM lines GROUP BY 1), a AS (SELECT transcript_id, count(*) AS steps FROM st GROUP BY 1), r AS (SELECT transcript_id, count(*) AS n FROM sources GROUP BY 1)
        SELECT transcript_id, steps, coalesce(n, 0) AS "references", CASE WHEN s < 60 THEN printf('%.1f seconds', CAST(s AS DOUBLE)) ELSE CAST(CAST(floor(s / 60) AS BIGINT) AS STRING) || 'm ' || CAST(CAST(floor(s % 60) AS BIGINT) AS STRING) || 's' END AS time, total_tokens,
        round(CAST(total_tokens AS DOUBLE) / 1000000 * 0.15, 4) AS cost FROM a LEFT JOIN r USING (transcript_id) LEFT JOIN u USING (transcript_id)""",
    "doc_code_spans": "SELECT CAST(doc_id AS STRING) AS transcript_id, 0 AS number, replace(text, '`', '') AS code FROM documents WHERE length(replace(text, '`', '')) > 50",
    "doc_code_spans_whole": """WITH d AS (SELECT CAST(doc_id AS STRING) AS transcript_id, replace(coalesce(text, ''), '`', '') AS t FROM documents),
      l AS (SELECT transcript_id, length(t) AS n, unnest(string_split(t, chr(10))) AS code, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
      s AS (SELECT transcript_id, 0 AS i, 0 AS b, t AS code FROM d UNION ALL
        SELECT transcript_id, i, n + 3 + coalesce(sum(CASE code WHEN '' THEN 1 ELSE length(code) + 3 END) OVER (PARTITION BY transcript_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, code FROM l)
      SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY i) - 1 AS INT) AS number, CAST(b AS INT) AS start, CAST(b + length(code) + 2 AS INT) AS "end", sha256(code) AS code_sha256 FROM s WHERE length(code) > 50""",
    "job_recent_of_all": f"WITH {JOBS} SELECT user_id, id, status, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM jobs) WHERE rank <= 3",
    "job_recent": f"WITH {JOBS}, b AS (SELECT user_id FROM jobs GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1) SELECT id, user_id, status, CAST(total_steps AS STRING) AS total_steps FROM jobs WHERE user_id IN (SELECT user_id FROM b) AND status = 'completed' ORDER BY created_at DESC, id LIMIT 50",
    "job_history": f"WITH {JOBS} SELECT user_id, status, count(*) AS n, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest FROM jobs WHERE status IN ('completed', 'failed') GROUP BY 1, 2",
    "job_active": f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs WHERE status IN ('queued', 'processing') OR (status = 'completed' AND epoch(TIMESTAMP '1998-01-01 00:00:00') - epoch(updated_at) <= 5) GROUP BY 1",
    "job_state": """WITH e AS (SELECT user_id AS id, ts, event_id, CASE WHEN event_type <> 'view' THEN event_type END AS stage, CASE WHEN event_id % 3 = 0 THEN event_id END AS step FROM events)
        SELECT id, last(stage ORDER BY ts, event_id) FILTER (stage IS NOT NULL) AS stage, last(step ORDER BY ts, event_id) FILTER (step IS NOT NULL) AS step, last(event_id ORDER BY ts, event_id) AS last_event FROM e GROUP BY 1""",
    "job_results": f"WITH {JOBS} SELECT id, total_steps, CAST(0 AS DOUBLE) AS average_confidence, 0 AS high_confidence_steps, CAST(0 AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS total_tokens FROM jobs",
}


_low = "lower(line)"
_title = "array_to_string(list_transform(string_split(replace(replace({x}, '_', ' '), '-', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
_path = "regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
_host = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"
_name = f"regexp_replace(string_split({_path}, '/')[-1], '\\.[^.]*$', '')"


def _spent(s: str) -> str:
    """Seconds as text, an hour and more in whole minutes and hours."""
    m, h, d = f"CAST(floor({s} / 60) AS BIGINT)", f"CAST(floor({s} / 3600) AS BIGINT)", f"CAST(floor({s} / 86400) AS BIGINT)"
    rest = lambda x, unit: f"CASE WHEN {x} > 0 THEN ' ' || CAST({x} AS STRING) || ' {unit}' ELSE '' END"
    return f"""CASE WHEN {s} < 1 THEN 'just now' WHEN {s} < 60 THEN CAST({s} AS STRING) || ' secs' WHEN {m} < 60 THEN CAST({m} AS STRING) || ' min' || {rest(f'({s} % 60)', 'sec')}
        WHEN {h} < 24 THEN CAST({h} AS STRING) || ' hr' || {rest(f'({m} % 60)', 'min')} ELSE CAST({d} AS STRING) || CASE WHEN {d} = 1 THEN ' day' ELSE ' days' END || {rest(f'({h} % 24)', 'hr')} END"""


def _ago(s: str) -> str:
    part = lambda n, unit: f"CAST(CAST(floor({s} / {n}) AS BIGINT) AS STRING) || CASE WHEN floor({s} / {n}) = 1 THEN ' {unit} ago' ELSE ' {unit}s ago' END"
    return f"CASE WHEN {s} < 5 THEN 'just now' WHEN {s} < 60 THEN CAST({s} AS STRING) || ' secs ago' WHEN {s} < 3600 THEN {part(60, 'min')} WHEN {s} < 86400 THEN {part(3600, 'hr')} ELSE {part(86400, 'day')} END"


_age, _took = "CAST(epoch(TIMESTAMP '2026-01-01 00:00:00') - epoch(created_at) AS BIGINT)", "CAST(epoch(updated_at) - epoch(created_at) AS BIGINT)"
_stages = "pending load_transcript clean_transcript fetch_knowledge azure_di_analysis determine_steps generate_steps build_sources validate_steps create_document upload_document complete error".split()
_seq = " UNION ALL ".join(
    f"SELECT transcript_id, {i} AS family, regexp_extract_all({_low}, {rx(p)}) AS hits, regexp_split_to_array({_low}, {rx(p)}) AS pieces FROM lines" for i, p in enumerate(L.SEQUENCE_PATTERNS)
)
_tags = f"list_filter(regexp_extract_all(z, '\\[[\\w\\s]+\\]'), lambda x: NOT regexp_matches(x, '(?i)^\\[({'|'.join(L.VISUAL)})'))"
_plain = "line || ' [inaudible] (laughs) [slide 2] [some words]'"
for _t in L.TAGS:
    _plain = f"replace({_plain}, '{_t}', '')"
_stripped = match_words("title || ' ' || summary || ' ' || details", "")
_words = f"list_filter({_stripped}, lambda w: length(w) > 3)"
_aligned = f"""a AS (SELECT transcript_id, step_index, unnest({_words}) AS word FROM @rows), b AS (SELECT transcript_id, sentence_index, list_distinct(regexp_split_to_array(trim(lower(text)), '\\s+')) AS tokens FROM sentences),
        c AS (SELECT a.transcript_id, step_index, sentence_index, count(*) AS matches FROM a JOIN b ON a.transcript_id = b.transcript_id AND len(list_filter(tokens, lambda t: contains(t, word))) > 0 GROUP BY ALL HAVING count(*) >= 2)"""
_first = "len(phrases) > 0 AND details <> '' AND length(details) < 150 AND length(phrases[1]) < 50 AND NOT contains(lower(details), phrases[1])"
# distinct words in text order, which list_distinct does not keep
_told = match_words("title || ' ' || summary || ' ' || details || ' ' || array_to_string(actions, ' ')", STOP).removeprefix("list_distinct")
_keys = "list_filter(w, lambda x: length(x) > 4)"
_pairs = "list_filter(range(1, len(w)), lambda i: length(w[i]) > 3 AND length(w[i + 1]) > 3 AND contains(lower(text), w[i] || ' ' || w[i + 1]))"
_bare = f"CASE WHEN len(list_filter([{q(L.BARE_VERBS)}], lambda v: list_contains(actions, v) AND contains(lower(text), v))) > 0 THEN 0.1 ELSE 0 END"
_three = f"""{CRAWL}, ev AS (SELECT event_id AS number, strftime(ts, '%Y-%m-%d-%H') AS transcript_id FROM events),
    kp AS (SELECT transcript_id, {match_words("html", "")} AS v FROM crawl JOIN ev ON number = page_id WHERE error IS NULL),
    kn AS (SELECT ms.transcript_id, step_index, 0.6 * CAST(len(list_intersect(w, v)) AS DOUBLE) / (len(w) + len(v) - len(list_intersect(w, v))) AS confidence FROM ms JOIN kp ON ms.transcript_id = kp.transcript_id),
    vs AS (SELECT ev.transcript_id, st.step_index FROM conversations c JOIN ev ON number = conv_id JOIN st ON st.transcript_id = ev.transcript_id AND st.step_index = c.turn // 2 WHERE role = 'assistant'),
    s2 AS (SELECT transcript_id, step_index, 'transcript' AS type, confidence FROM sources UNION ALL SELECT transcript_id, step_index, 'knowledge', confidence FROM kn WHERE confidence > 0 UNION ALL SELECT transcript_id, step_index, 'visual', 0.8 FROM vs),
    s3 AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, step_index, type = 'visual' ORDER BY confidence DESC) AS rn FROM s2),
    s4 AS (SELECT transcript_id, step_index, count(*) AS n_sources, count_if(type <> 'visual') AS n, count_if(type = 'transcript') AS nt, count_if(type = 'knowledge') AS nk, bool_or(type = 'visual') AS has_visual_support,
      coalesce(max(confidence) FILTER (type <> 'visual' AND rn = 1), 0) AS c1, coalesce(max(confidence) FILTER (type <> 'visual' AND rn = 2), 0) AS c2, coalesce(max(confidence) FILTER (type <> 'visual' AND rn = 3), 0) AS c3 FROM s3 GROUP BY ALL)"""

ORACLES |= {
    "cln_tags": f"WITH {LINES}, a AS (SELECT transcript_id, line_no, {_plain} AS z FROM lines), b AS (SELECT transcript_id, line_no, z, {_tags} AS tags FROM a) SELECT transcript_id, line_no, regexp_replace(list_reduce(list_concat([z], tags), lambda a, x: replace(a, x, '')), '\\([\\w\\s]+\\)', '', 'g') AS text FROM b",
    "chk_smart": f"""WITH {PARAS}, d2 AS (SELECT CAST(doc_id AS STRING) AS transcript_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), e1 AS (SELECT transcript_id, {sentence_list("text")} AS parts FROM d2),
        e2 AS (SELECT transcript_id, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM e1), e3 AS (SELECT transcript_id, part, pos, CASE WHEN n <= 8 THEN 1 ELSE greatest(2, least(20, ceil(n / 8.0))) END AS size FROM e2),
        e4 AS (SELECT transcript_id, CAST(floor(pos / size) AS INT) AS chunk_index, string_agg(part, ' ' ORDER BY pos) AS text FROM e3 GROUP BY ALL), p AS (SELECT transcript_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM pf GROUP BY 1 HAVING abs(count(*) - 8) <= 1)
        SELECT * FROM p UNION ALL SELECT transcript_id, count(*), CAST(sum(length(text)) AS BIGINT) FROM e4 WHERE transcript_id NOT IN (SELECT transcript_id FROM p) GROUP BY 1""",
    "qaf_instructor_led": f"""{SEG}, o AS (SELECT r.transcript_id, r.segment_id, arg_min(coalesce(speaker_role, 'none'), sentence_index) AS role FROM rowz r LEFT JOIN who w ON r.transcript_id = w.transcript_id AND r.segment_id = w.segment_id
        WHERE speaker IS NOT DISTINCT FROM primary_speaker AND (speaker_role IS NULL OR speaker_role = 'instructor') GROUP BY 1, 2), n AS (SELECT transcript_id, segment_id, avg(CAST(is_question AS INT)) AS density FROM rowz GROUP BY 1, 2)
        SELECT n.transcript_id, n.segment_id, coalesce(role = 'instructor' OR (role = 'none' AND density < 0.2), false) AS instructor_led FROM n LEFT JOIN o ON n.transcript_id = o.transcript_id AND n.segment_id = o.segment_id""",
    "str_sequence_hits": f"""WITH {LINES}, a AS ({_seq}), b AS (SELECT transcript_id, family, hits, pieces, unnest(range(1, len(hits) + 1)) AS i FROM a)
        SELECT transcript_id, family, hits[i] AS indicator, CAST(length(array_to_string(pieces[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS INT) AS position FROM b""",
    "stp_aligned": f"""{SEG}, {STEPS}, {_aligned.replace("@rows", "st")}
        SELECT transcript_id, step_index, sentence_index, matches, CAST(row_number() OVER (PARTITION BY transcript_id, step_index ORDER BY matches DESC, sentence_index) AS INT) AS rank FROM c QUALIFY rank <= 3""",
    "stp_phrases": f"""{SEG}, {STEPS}, s1 AS (SELECT transcript_id, step_index, title, summary, coalesce(actions[1], '') AS details FROM st), {_aligned.replace("@rows", "s1")},
        r AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, step_index ORDER BY matches DESC, sentence_index) AS rank FROM c QUALIFY rank <= 2),
        t AS (SELECT r.transcript_id, r.step_index, rank, regexp_split_to_array(trim(lower(text)), '\\s+') AS tk, {_words} AS w FROM r JOIN sentences USING (transcript_id, sentence_index) JOIN s1 USING (transcript_id, step_index)),
        g AS (SELECT *, array_to_string(tk[i:i + 3], ' ') AS phrase FROM (SELECT *, unnest(range(1, greatest(1, CAST(len(tk) AS BIGINT) - 1))) AS i FROM t)),
        k AS (SELECT transcript_id, step_index, list(phrase ORDER BY rank, i) AS phrases FROM g WHERE len(list_filter(w, lambda x: length(x) > 4 AND contains(phrase, x))) > 0 GROUP BY 1, 2)
        SELECT transcript_id, step_index, coalesce(array_to_string(phrases, '|'), '') AS phrases, details || CASE WHEN {_first} THEN '{L.ALIGNED}' ELSE '' END AS details FROM s1 LEFT JOIN k USING (transcript_id, step_index)""",
    "mat_keywords": f"""{SEG}, {STEPS}, {MATCH}, wl AS (SELECT transcript_id, step_index, {_told} AS a FROM st), wo AS (SELECT transcript_id, step_index, list_filter(a, lambda x, i: list_position(a, x) = i) AS w FROM wl), k AS (SELECT c.*, w FROM cand c JOIN wo USING (transcript_id, step_index)), l AS (SELECT *, CASE WHEN len({_keys}) > 0 THEN CAST(len(list_filter({_keys}, lambda x: contains(lower(text), x))) AS DOUBLE) / len({_keys}) ELSE 0 END AS kw,
        least(0.6, len({_pairs}) * 0.2) AS ph, {technical("text")} AS tech FROM k) SELECT transcript_id, step_index, sentence_index, round(CAST(kw AS DOUBLE), 6) AS keyword_score, round(CAST(ph AS DOUBLE), 6) AS phrase_score,
        round(CAST(CAST(shared AS DOUBLE) / (n_step + n_sentence - shared) * 0.4 + kw * 0.4 + ph * 0.2 + {_bare} AS DOUBLE), 6) AS base_score, round(tech, 6) AS technical FROM l""",
    "mat_hybrid": f"""{SEG}, {STEPS}, {MATCH}, v AS (SELECT c.*, greatest(0.0, least(1.0, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))) AS near FROM cand c JOIN embeddings x ON x.vec_id = (CAST(replace(c.transcript_id, '-', '') AS BIGINT) * 31 + c.step_index * 7) % (SELECT count(*) FROM embeddings) JOIN embeddings y ON y.vec_id = (CAST(replace(c.transcript_id, '-', '') AS BIGINT) * 31 + c.sentence_index * 3) % (SELECT count(*) FROM embeddings)),
        u AS (SELECT *, (CAST(shared AS DOUBLE) / (n_step + n_sentence - shared) * 0.5 + near * 0.5 + {_bare}) * 0.85 AS x, {technical("text")} AS tech FROM v), t AS (SELECT *, least(1.0, CASE WHEN x >= 0.1 THEN x + tech * 0.2 ELSE x END) AS confidence FROM u)
        SELECT transcript_id, step_index, sentence_index, CAST(round(CAST(confidence AS DECIMAL(18, 12)), 6) AS DOUBLE) AS confidence FROM t WHERE confidence >= 0.15 QUALIFY row_number() OVER (PARTITION BY transcript_id, step_index ORDER BY round(confidence, 9) DESC, sentence_index) <= 5""",
    "mat_all_sources": f"""{SEG}, {STEPS}, {SOURCES}, {_three} SELECT transcript_id, step_index, n_sources, nt > 0 AS has_transcript_support, nk > 0 AS has_knowledge_support, has_visual_support,
        CASE WHEN nt + nk = 0 THEN 'none' ELSE concat_ws(', ', CASE WHEN nt > 0 THEN 'transcript (' || CAST(nt AS STRING) || ')' END, CASE WHEN nk > 0 THEN 'knowledge (' || CAST(nk AS STRING) || ')' END) END AS summary,
        CAST(round(CAST(CASE WHEN n = 0 THEN 0 ELSE least(1.0, CASE WHEN n = 1 THEN c1 WHEN n = 2 THEN c1 * 0.6 + c2 * 0.4 ELSE c1 * 0.5 + c2 * 0.3 + c3 * 0.2 END * CASE WHEN n >= 4 THEN 1.25 WHEN n = 3 THEN 1.15 WHEN n = 2 THEN 1.08 ELSE 1.0 END * CASE WHEN nt > 0 AND nk > 0 THEN 1.12 ELSE 1.0 END * CASE WHEN c1 > 0.5 THEN 1.1 ELSE 1.0 END) END AS DECIMAL(18, 12)), 6) AS DOUBLE) AS confidence FROM s4""",
    "knw_titles": f"SELECT page_id, coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]+'), false) AS is_valid, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, CASE WHEN {_name} = '' THEN {_host} ELSE {_title.format(x=_name)} END AS url_title FROM pages",
    "doc_sections": f"""{SEG}, {STEPS}, {SOURCES}, {CRAWL}, kp AS (SELECT strftime(ts, '%Y-%m-%d-%H') AS transcript_id, url, title, html, CASE WHEN path LIKE '%.pdf' THEN 'Pdf' WHEN path LIKE '%.txt' OR path LIKE '%.md' THEN 'Text' ELSE 'Web' END AS type,
        CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d-%H') ORDER BY url, title, html) AS INT) AS number FROM (SELECT *, lower(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[?#].*', '')) AS path FROM crawl) JOIN events ON event_id = page_id WHERE error IS NULL AND trim(url) <> ''), r AS (SELECT transcript_id, step_index, sentence_index, text, row_number() OVER (PARTITION BY transcript_id, step_index ORDER BY confidence DESC, sentence_index, text) AS number FROM sources), t AS (SELECT DISTINCT transcript_id FROM lines), n AS (SELECT transcript_id, count(*) AS n FROM st GROUP BY 1), m AS (SELECT transcript_id, count(*) AS m FROM r GROUP BY 1)
        SELECT transcript_id, 0 AS part, 0 AS position, length(transcript_id) AS chars FROM t UNION ALL SELECT transcript_id, 1, 100 + step_index, length('Step ' || CAST(step_index + 1 AS STRING) || ': ' || title) FROM st
        UNION ALL SELECT transcript_id, 1, p, length(e) FROM n, (VALUES (0, 'Introduction'), (1000000, 'Source References'), (1000001, 'Document Statistics')) AS v(p, e) UNION ALL SELECT transcript_id, 2, 0, length('This document has ' || CAST(n AS STRING) || ' steps.') FROM n
        UNION ALL SELECT transcript_id, 3, step_index, length(title) + length(summary) + length(details) + 3 + coalesce(length(array_to_string(list_transform(actions, lambda a: '- ' || a), chr(10))), 0) FROM st
        UNION ALL SELECT transcript_id, 4, step_index * 1000 + number, length('Transcript (Sentence ' || CAST(sentence_index + 1 AS STRING) || ') ' || text) FROM r
        UNION ALL SELECT DISTINCT transcript_id, 5, 0, length('Knowledge Sources') FROM kp UNION ALL SELECT transcript_id, 5, number, length('Source ' || CAST(number AS STRING) || ': ' || title || 'URL: ' || url || 'Type: ' || type) + 2 + CASE WHEN length(html) > 500 THEN 504 WHEN length(html) > 0 THEN length(html) + 1 ELSE 0 END FROM kp
        UNION ALL SELECT transcript_id, 6, 0, length('Steps: ' || CAST(n AS STRING) || ', references: ' || CAST(coalesce(m, 0) AS STRING)) FROM n LEFT JOIN m USING (transcript_id)""",
    "job_stages": f"""WITH s AS (SELECT event_id, [{q(_stages)}][event_id % 13 + 1] AS stage, event_id % 13 AS i FROM events) SELECT event_id, stage, CASE stage WHEN 'complete' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, CASE WHEN i < 12 THEN round(CAST(i AS DOUBLE) / 11, 6) END AS progress FROM s""",
    "job_times": f"WITH {JOBS} SELECT id, {_spent(_took)} AS duration, {_ago(_age)} AS age FROM jobs",
}

ORACLES |= {made: ORACLES[name] for made, name in (("sto_read_job", "src_read_job"), ("sto_upsert", "snk_upsert"), ("sto_recent", "job_recent"))}
_win = ORACLES["chk_word_windows"]
ORACLES["knw_text_excerpts"] = f"""{_win[:_win.rindex("WHERE first <= len(ends)))") + len("WHERE first <= len(ends)))")]},
wx AS MATERIALIZED (SELECT win.transcript_id AS url, CAST(row_number() OVER (PARTITION BY win.transcript_id ORDER BY s) - 1 AS INT) AS window_index, array_to_string(p[s:e], ' ') AS whole, p[s:e] AS ws FROM win JOIN w0 ON win.transcript_id = w0.transcript_id),
wy AS (SELECT DISTINCT url, window_index, unnest(list_transform(ws, lambda w: lower(w))) AS word FROM wx),
q1 AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda w: w <> '')) AS w FROM benchmark),
q2 AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM q1),
h AS (SELECT query_id, url, window_index, CAST(count(*) AS DOUBLE) / n AS score FROM q2 JOIN wy ON q2.word = wy.word GROUP BY query_id, url, window_index, n HAVING CAST(count(*) AS DOUBLE) / n > 0.1),
i AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY round(score, 9) DESC, window_index) <= 3),
j AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, url, window_index) AS INT) AS rank FROM i)
SELECT query_id, j.url, j.window_index, md5(whole) AS digest, round(score, 6) AS score, rank FROM j JOIN wx ON j.url = wx.url AND j.window_index = wx.window_index WHERE rank <= 5"""
ORACLES["mat_most_similar"] = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, greatest(0.0, least(1.0, list_cosine_similarity(a.e, b.e))) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INT) AS rank, vec_id, round(score, 5) AS score FROM s QUALIFY rank <= 10"""
ORACLES["knw_upkeep"] = f"""WITH {CRAWL}, l AS (SELECT page_id, url, error, fetched_at - to_hours(CAST(n * 5 AS INT)) AS fetched_at, 'landing ' || CAST(n AS STRING) || ': ' || html AS content FROM crawl, (VALUES (0), (1), (2)) AS v(n) WHERE page_id % 3 <> n),
m AS (SELECT *, TIMESTAMP '2026-01-01 00:00:00' - fetched_at >= INTERVAL 1 DAY OR error IS NOT NULL AS gone FROM l QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, error IS NULL DESC, content DESC) = 1)
SELECT page_id, url, md5(url) AS key, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, gone, CASE WHEN NOT gone THEN md5(content) END AS digest FROM m"""
ORACLES["stm_state"] = ORACLES["job_state"]
ORACLES["stm_messages"] = """SELECT DISTINCT 'handled' AS kind, CAST(user_id AS STRING) || '-' || event_type AS message FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0
UNION ALL SELECT 'invalid JSON', 'broken ' || CAST(event_id AS STRING) FROM events WHERE event_id % 7 = 0 UNION ALL SELECT 'missing job_id', '{"user_id":"' || CAST(event_id AS STRING) || '"}' FROM events WHERE event_id % 7 <> 0 AND event_id % 11 = 0"""

# step by step: what earlier steps have chosen is a list that the next one reads
_used = "base * (1 - least(0.6, (len(list_filter(r.used, lambda u: u = x.s)) + 1) * 0.15))"
ORACLES["mat_reuse"] = f"""WITH RECURSIVE {f"{SEG}, {STEPS}, {SOURCES}".removeprefix("WITH ")}, ca AS MATERIALIZED (SELECT transcript_id, step_index, list(struct_pack(s := sentence_index, b := CAST(base AS DOUBLE), t := CAST(tech AS DOUBLE))) AS cs FROM so1 GROUP BY 1, 2),
r AS (SELECT transcript_id, CAST(-1 AS BIGINT) AS k, CAST(max(step_index) AS BIGINT) AS last, CAST([] AS INT[]) AS used, CAST([] AS STRUCT(o DOUBLE, s INT, c DOUBLE)[]) AS picks FROM ca GROUP BY 1
  UNION ALL SELECT transcript_id, k + 1, last, list_concat(used, list_transform(p, lambda x: x.s)), p FROM (
    SELECT r.transcript_id, r.k, r.last, r.used, coalesce(list_sort(list_filter(list_transform(list_transform(cs, lambda x: struct_pack(s := x.s, t := x.t, v := {_used.replace("base", "x.b")})),
      lambda y: struct_pack(o := -round(least(1.0, CASE WHEN y.v >= 0.1 THEN y.v + y.t * 0.2 ELSE y.v END), 9), s := CAST(y.s AS INT), c := least(1.0, CASE WHEN y.v >= 0.1 THEN y.v + y.t * 0.2 ELSE y.v END))), lambda z: z.c >= 0.15))[1:5], []) AS p
    FROM r LEFT JOIN ca ON ca.transcript_id = r.transcript_id AND ca.step_index = r.k + 1 WHERE r.k < r.last))
SELECT transcript_id, CAST(k AS INT) AS step_index, p.s AS sentence_index, round(p.c, 6) AS confidence FROM (SELECT transcript_id, k, unnest(picks) AS p FROM r)"""

# the same statements over lines of which every third is in one transcript
_hour = "CAST(CAST(ts AS DATE) AS STRING) || '-' || lpad(CAST(hour(ts) AS STRING), 2, '0')"
_uneven = LINES.replace(f"{_hour} AS transcript_id", f"CASE WHEN event_id % 3 = 0 THEN 'meeting' ELSE {_hour} END AS transcript_id").replace("row_number() OVER (PARTITION BY CAST(ts AS DATE), hour(ts) ORDER BY ts, event_id) - 1 AS line_no", "event_id AS line_no")
ORACLES |= {f"{made}_long": ORACLES[name].replace(LINES, _uneven) for made, name in (("segments", "segments"), ("prs", "prs_sentences"))}

# pairs of steps and texts, each text by its first sentence, and the sentences of each text
_texts = "tf AS (SELECT transcript_id, sentence_index, CAST(min(sentence_index) OVER (PARTITION BY transcript_id, text) AS INT) AS text_index FROM sentences)"
for _name, _none in (("mat_keywords", ("keyword_score", "phrase_score", "base_score", "technical")),):
    _head, _sep, _tail = ORACLES[_name].rpartition(" SELECT transcript_id, step_index, sentence_index, ")
    ORACLES[_name] = f"""{_head}, {_texts}, pairs AS (SELECT transcript_id, step_index, sentence_index, {_tail})
        SELECT 'pair' AS kind, p.transcript_id, step_index, p.sentence_index, text_index, {", ".join(_none)} FROM pairs p JOIN tf ON p.transcript_id = tf.transcript_id AND p.sentence_index = tf.sentence_index WHERE text_index = p.sentence_index
        UNION ALL SELECT 'member', transcript_id, NULL, sentence_index, text_index, {", ".join("NULL" for _ in _none)} FROM tf"""
