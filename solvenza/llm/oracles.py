"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from solvenza.llm import licenses, quality

_BLANK = "\\x20\\x09-\\x0D"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WARC = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
       sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (SELECT *, CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000
                THEN nullif(max(page_id) OVER (PARTITION BY html), page_id) END AS refers_to
      FROM pages)
"""


def _divergence(names: list[str], total: str) -> str:
    """Jensen-Shannon distance of the counts ``names`` and their ``ref_`` sums."""
    parts = []
    for n in names:
        p, q = f"({n} / greatest({total}, 1))", f"(ref_{n} / greatest(ref_{total}, 1))"
        for x in (p, q):
            parts.append(f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0 END / 2")
    return f"sqrt(greatest({' + '.join(parts)}, 0))"


def _quality() -> str:
    symbols, least = quality.SYMBOLS, quality.LEAST_WORDS
    times, limit = quality.SHARE_REPEATED
    counted = ", ".join(
        f"len(regexp_extract_all(t, {_quoted(p)})) AS {n}" for n, p in quality.COUNTED.items()
    )
    lists = ", ".join(
        f"({_quoted(lang)}, [{', '.join(map(_quoted, words))}])" for lang, words in quality.COMMON_WORDS.items()
    )
    common = ", ".join(
        f"coalesce(len(list_filter(ws, lambda x: lower(x) = common[{k + 1}])), 0) AS {n}"
        for k, n in enumerate(quality.WORDS)
    )
    classes = list(quality.CLASSES)
    summed = ", ".join(f"sum({n}) AS ref_{n}" for n in (*classes, *quality.WORDS, "n_words", "chars"))
    words = [*quality.WORDS, "other"]
    in_words = " + ".join(quality.WORDS)
    ref_words = " + ".join(f"ref_{n}" for n in quality.WORDS)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
lists(lang, common) AS (VALUES {lists}),
w AS (
  SELECT d.*, common, regexp_extract_all(t, '[^{_BLANK}]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS ls
  FROM d LEFT JOIN lists USING (lang)),
runs AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM runs WHERE n > 1) GROUP BY rid),
counts AS (
  SELECT rid, doc_id, lang, common IS NOT NULL AS listed, length(t) AS chars, len(ws) AS n_words,
         length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '{symbols}')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         {counted}, strlen(t) - length(t) AS wide, length(t) - word_chars AS blank, {common}
  FROM w LEFT JOIN covered USING (rid)),
whole AS (SELECT *, chars - {' - '.join(quality.COUNTED)} - blank AS rest, 0 AS other FROM counts),
refs AS (SELECT lang AS ref_lang, {summed} FROM whole GROUP BY lang),
both_ AS (
  SELECT * REPLACE (greatest(n_words - ({in_words}), 0) AS other),
         greatest(ref_n_words - ({ref_words}), 0) AS ref_other,
         {' + '.join(classes)} AS all_, {' + '.join('ref_' + n for n in classes)} AS ref_all_,
         n_words < {least} OR {times} * n_repeat_words > {limit} * n_words AS base_failed
  FROM whole JOIN refs ON lang IS NOT DISTINCT FROM ref_lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND (chars < {quality.CHARS_GUARD} OR {_divergence(classes, 'all_')} <= {quality.CHARS_LIMIT})
       AND (NOT listed OR n_words < {quality.WORDS_GUARD}
            OR {_divergence(words, 'n_words')} <= {quality.WORDS_LIMIT}) AS kept
FROM both_
"""


def _licenses() -> str:
    templates = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.TEMPLATES.items())
    word, last = "'[\\p{L}\\p{N}_]+'", licenses.SHINGLE - 1
    return f"""
WITH templates(license, text) AS (VALUES {templates}),
tw AS (SELECT license, regexp_extract_all(lower(text), {word}) AS ws FROM templates),
ts AS (
  SELECT DISTINCT license, array_to_string(ws[i:i + {last}], ' ') AS s
  FROM (SELECT license, ws, unnest(range(1, len(ws) - {last} + 1)) AS i FROM tw)),
sizes AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), {word}) AS ws
  FROM documents),
ds AS (
  SELECT rid, doc_id, i - 1 AS place, array_to_string(ws[i:i + {last}], ' ') AS s
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - {last} + 1)) AS i FROM d)),
hits AS (
  SELECT rid, doc_id, license, s, min(place) AS a, max(place) AS b FROM ds JOIN ts USING (s) GROUP BY ALL)
SELECT doc_id, license, count(*) / any_value(n) AS containment, CAST(min(a) AS INTEGER) AS first_word,
       CAST(max(b) + {licenses.SHINGLE} AS INTEGER) AS end_word
FROM hits JOIN sizes USING (license) GROUP BY rid, doc_id, license
HAVING count(*) / any_value(n) >= {licenses.CONTAINED}
"""


DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
langs AS (
  SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS n
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + l.v) AS HUGEINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS HUGEINT) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM rows
QUALIFY part = 'pair' OR rank <= 200
"""

REPEATED_WORDS = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS s FROM w),
windows AS (
  SELECT doc_id, s, words[s] AS word,
         CASE WHEN s + 19 <= len(words) THEN array_to_string(words[s:s + 19], ' ') END AS content
  FROM p),
judged AS (
  SELECT doc_id, s, word,
         content IS NOT NULL AND row_number() OVER (PARTITION BY content ORDER BY doc_id, s) > 1 AS again
  FROM windows),
marked AS (
  SELECT doc_id, s, word,
         bool_or(again) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM judged)
SELECT w.doc_id, CAST(len(any_value(w.words)) AS BIGINT) AS n_words,
       CAST(coalesce(count(*) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY s) FILTER (WHERE NOT gone), '')) AS kept_sha256,
       coalesce(bool_or(gone), false) AS has_repeats
FROM w LEFT JOIN marked m ON m.doc_id = w.doc_id
GROUP BY w.doc_id
"""


def all_oracles() -> dict[str, str]:
    return {
        "op1_warc": WARC, "op2_quality": _quality(), "op9_licenses": _licenses(),
        "op11_divergence": DIVERGENCE, "op13_debruijn": REPEATED_WORDS,
    }
