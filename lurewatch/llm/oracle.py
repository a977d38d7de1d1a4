"""SQL for DuckDB that gives the rows of the queries which SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATE = f"""WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  item_window AS (
    SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT *, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
  doc_window AS (
    SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM item_window))),
  found AS (SELECT doc_id, i, k, item_id FROM doc_window JOIN item_window USING (k, win)),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
  listed AS (
    SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""

#: The patterns of the contract, and the one for IBANs.
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b"),
)
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum([CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INTEGER)
  ELSE (2 * CAST({_DIGITS}[i] AS INTEGER)) % 10 + (2 * CAST({_DIGITS}[i] AS INTEGER)) // 10 END
  for i in range(1, length({_DIGITS}) + 1)]) % 10 = 0"""
_TURNED = "concat(replace(m, ' ', '')[5:], replace(m, ' ', '')[1:4])"
_MOD97 = f"""list_reduce([CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ascii(c) - 55 END for c in string_split({_TURNED}, '')],
  lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) % 97 = 1"""
_VALID = {
    "email": "true",
    "ip": rf"regexp_full_match(m, '{_BYTE}(\.{_BYTE}){{3}}')",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": _MOD97,
}


def _spans(order: int, kind: str, pattern: str) -> str:
    return f"""SELECT doc_id, {order} AS k, '{kind}' AS kind, begin, begin + length(m) AS finish FROM (
      SELECT doc_id, m, sum(length(gap)) OVER before + coalesce(sum(length(m)) OVER earlier, 0) AS begin
      FROM (SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM body))
      WINDOW before AS (PARTITION BY doc_id ORDER BY i),
        earlier AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE {_VALID[kind]}"""


_PII = f"""WITH body AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  span AS ({' UNION ALL '.join(_spans(i, k, p) for i, (k, p) in enumerate(_KINDS))}),
  listed AS (
    SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _ in _KINDS[:4])},
      string_agg(concat(kind, ':', CAST(begin AS BIGINT), ':', CAST(finish AS BIGINT)), ',' ORDER BY k, begin) FILTER (kind <> 'iban') AS base,
      string_agg(concat(kind, ':', CAST(begin AS BIGINT), ':', CAST(finish AS BIGINT)), ',' ORDER BY k, begin) AS spans
    FROM span GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _ in _KINDS[:4])},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM body LEFT JOIN listed USING (doc_id)"""

_HARD_NEGATIVES = """WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  pair AS (
    SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, CAST(list_dot_product(a.e, o.e) AS BIGINT) AS s
    FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
  positive AS (
    SELECT anchor_id, other AS positive_id, s AS positive_score FROM pair WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other AS negative_id, positive_score, s AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other)
QUALIFY row_number() OVER best <= 10"""

_MINHASH = rf"""WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT *, least(4, len(w)) AS k, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)),
  size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
  pair AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
  near AS (
    SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
  link AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
  reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN link ON x = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id, n"""

SQL: dict[str, str] = {"op1_decontaminate": _DECONTAMINATE, "op6_pii": _PII, "op12_hard_negatives": _HARD_NEGATIVES, "op13_minhash": _MINHASH}
