"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from .chat import CONTROLS
from .quality_rules import BASE, CONDEMNED, SOFT, SUSPECT, TOLERATED

_SPACED = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_PLAIN}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_PLAIN}') AS w FROM benchmark),
s AS (SELECT item, w, least(8, len(w)) AS k, unnest(generate_series(1, len(w) - least(8, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s),
t AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM p) x WHERE len(w) >= k),
h AS (SELECT t.doc_id, t.i, t.k, p.item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM t) t JOIN p ON p.k = t.k AND p.phrase = t.phrase),
c AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS place FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, coalesce(m.digest, sha256('')) AS items_sha256, coalesce(m.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS phrase FROM s),
f AS (SELECT phrase, min(doc_id) AS first FROM v GROUP BY phrase),
g AS (SELECT DISTINCT doc_id, place FROM (SELECT v.doc_id, unnest(generate_series(v.i, v.i + 49)) AS place FROM v JOIN f ON f.phrase = v.phrase WHERE f.first < v.doc_id)),
e AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS place FROM d WHERE len(w) > 0),
k AS (SELECT e.doc_id, count(g.place) AS removed, string_agg(CASE WHEN g.place IS NULL THEN e.word END, ' ' ORDER BY e.place) AS kept FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.place = e.place GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def _escapes(text: str) -> str:
    """How many escape signs a text gets: one for each backslash and control string."""
    single = f"(length({text}) - length(replace({text}, chr(92), '')))"
    return " + ".join([single, *(f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in CONTROLS)])


CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, length(role) + length(text) + 17 + {_escapes("role")} + length(role) - length(replace(role, chr(10), '')) + {_escapes("text")} AS size FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
CAST(sum(size) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id
"""

_RULES = {"base": BASE, **{r: usual for r, (usual, _) in SOFT.items()}}


def _rates() -> str:
    """The hosts' posterior rates, as quality_rules.host_rates() has them."""
    moments = ", ".join(f"sum(k_{r}) * 1.0 / sum(n) AS m_{r}, var_pop(k_{r} * 1.0 / n) AS v_{r}" for r in _RULES)
    strengths = ", ".join(f"least(greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * inv, 1e-6) - 1, 2.0), 1000.0) AS s_{r}" for r in _RULES)
    priors = ", ".join(f"greatest(m_{r} * s_{r}, 1e-3) AS a_{r}, greatest((1 - m_{r}) * s_{r}, 1e-3) AS b_{r}" for r in _RULES)
    means = ", ".join(f"(k_{r} + a_{r}) / (n + a_{r} + b_{r}) AS rate_{r}" for r in _RULES)
    high = "a_{r} / (a_{r} + b_{r}) + {s} * sqrt(a_{r} * b_{r} / ((a_{r} + b_{r}) * (a_{r} + b_{r}) * (a_{r} + b_{r} + 1)))"
    deviations = ", ".join(f"sqrt(rate_{r} * (1 - rate_{r}) / (n + a_{r} + b_{r} + 1)) AS sd_{r}, rate_{r} > {high.format(r=r, s=SUSPECT)} AS suspect_{r}" for r in _RULES)
    return (
        f"h AS (SELECT host, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {sql}) AS k_{r}' for r, sql in _RULES.items())} FROM x GROUP BY host), m AS (SELECT {moments}, avg(1.0 / n) AS inv FROM h), "
        f"q AS (SELECT *, {strengths} FROM m), p AS (SELECT *, {priors} FROM q), y AS (SELECT h.*, p.*, {means} FROM h CROSS JOIN p), z AS (SELECT *, {deviations} FROM y)"
    )


_LINE_HAS_WORD = f"regexp_matches(line, '{_SPACED}')"
QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE {_LINE_HAS_WORD} GROUP BY doc_id),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS phrase FROM s),
o AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, phrase) AS times FROM v),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 2)) AS place FROM o WHERE times > 1) GROUP BY doc_id),
x AS (SELECT d.doc_id, d.host, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id),
{_rates()},
j AS (SELECT x.*, ({BASE}) AS base_failed, ({" OR ".join(f"(({usual}) AND rate_{r} > {TOLERATED})" for r, (usual, _) in SOFT.items())}) AS soft_failed,
({" OR ".join(f"(({closer}) AND (suspect_base OR suspect_{r}))" for r, (_, closer) in SOFT.items())}) AS strict_failed, ({" OR ".join(f"suspect_{r}" for r in _RULES)}) AS host_suspect,
greatest({", ".join(f"rate_{r} - 2 * sd_{r}" for r in _RULES)}) > {CONDEMNED} AS host_condemned
FROM x JOIN z ON x.host IS NOT DISTINCT FROM z.host)
SELECT doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed, strict_failed, host_suspect, host_condemned, NOT (base_failed OR soft_failed OR strict_failed OR host_condemned) AS kept FROM j
"""
