"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from vigilog.llm.chat import _ESCAPES, TEMPLATE

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}')"


def _escaped(text: str) -> str:
    for plain, reference in _ESCAPES:
        text = f"replace({text}, '{plain}', '{reference}')"
    return text


_DOCS = f"""d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w
  FROM documents)"""

RULES = rf"""WITH {_DOCS},
  places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
  threes AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
    FROM places),
  repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM threes, (VALUES (0), (1), (2)) AS v(k)
    WHERE n > 1 GROUP BY doc_id),
  lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  measured AS (SELECT d.doc_id, t, len(w)::BIGINT AS n_words,
      length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
      len([x FOR x IN w IF regexp_full_match(x, '\p{{L}}+[.,;:!?]?')]) AS plain
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
    OR 4 * len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]{{2}}')) > n_words
    OR 10 * (length(t) - length(replace(t, '!!', ''))) > n_words OR 2 * plain < n_words
    OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * (length(t) - length(replace(t, chr(10), '')) + 1)))
    AS kept
FROM measured"""

REPEATS = f"""WITH {_DOCS},
  windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
  often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM windows)
    WHERE n > 1),
  gone AS (SELECT DISTINCT doc_id, i + k AS j FROM often, range(35) AS r(k)),
  kept AS (SELECT doc_id, string_agg(w[j], ' ' ORDER BY j) AS text
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (doc_id, j)
    GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) AS g USING (doc_id)
  LEFT JOIN kept USING (doc_id)"""

CHAT = f"""WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, text IS NULL AS missing
    FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', false),
      (-1, 1, 'assistant', '</s>[INST] ok [/INST]', false)),
  told AS (SELECT conv_id, count(*) AS n_turns,
      string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, missing, text) AS all_turns,
      coalesce(string_agg(text, '' ORDER BY turn, role, missing, text) FILTER (role = 'assistant'), '') AS learnt,
      sum(length({_escaped('role')}) + length({_escaped('text')})
        + {len(TEMPLATE.begin + TEMPLATE.middle + TEMPLATE.end)})::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
  sha256(learnt) AS loss_sha256, formatted_chars FROM told"""

LEAKS = f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS.format(_lower('text'))} AS w FROM documents),
  items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS.format(_lower('text'))} AS w
    FROM benchmark),
  windows AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS s
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
  places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM windows)),
  found AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n,
      array_to_string(w[i:i + n - 1], ' ') AS s FROM places) JOIN windows USING (n, s)),
  hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
  held AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit,
  coalesce(held.n, 0)::BIGINT AS n_items, sha256(coalesce(held.list, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_lower('text'))} AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y USING (s)
      JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
    WHERE x.doc_id <> y.doc_id GROUP BY a, b, m.n, n.n
    HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM d
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
  least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)"""

NEGATIVES = """WITH r AS (SELECT row_number() OVER () AS n, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10
      ELSE label END)::BIGINT AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
  scores AS (SELECT a.n AS an, a.vec_id AS anchor_id, a.label AS al, b.n AS bn, b.vec_id AS id, b.label AS bl,
      coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS s
    FROM r a JOIN r b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
  positives AS (SELECT an, bn AS pn, id AS positive_id, s AS positive_score FROM scores WHERE al = bl
    QUALIFY row_number() OVER (PARTITION BY an ORDER BY s DESC, id NULLS LAST) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY an, pn
    ORDER BY s DESC, id NULLS LAST))::INTEGER AS rank, id AS negative_id, positive_score, s AS negative_score
FROM positives JOIN scores USING (an) WHERE bl <> al
  AND 80 * positive_score <= 100 * s AND 100 * s <= 100 * positive_score QUALIFY rank <= 5"""

ORACLE = {
    "op3_quality_rules": RULES,
    "op6_substring_dedup": REPEATS,
    "op7_chat": CHAT,
    "op9_decontamination": LEAKS,
    "op10_minhash": NEAR,
    "op13_hard_negatives": NEGATIVES,
}
