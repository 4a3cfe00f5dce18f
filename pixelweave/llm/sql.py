"""DuckDB SQL for the registered queries that SQL can express, written on its own from what they are to return."""

from __future__ import annotations

_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _shingles(table: str, key: str) -> str:
    return f"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
    FROM (SELECT {key}, {_WORDS.format("coalesce(text, '')")} AS w FROM {table} WHERE {key} IS NOT NULL)"""


CONTAINED = f"""
WITH d AS ({_shingles("documents", "doc_id")}), b AS ({_shingles("benchmark", "item_id")}),
     n AS (SELECT item_id, CAST(count(*) AS INT) AS n_shingles FROM b GROUP BY item_id),
     f AS (SELECT doc_id, item_id, CAST(count(*) AS INT) AS n_found FROM d JOIN b USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found >= ceil(n_shingles * 0.8 - 1e-9)
"""

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
    "pan": r"[0-9](?:[\x20-]?[0-9])+",
    "ssn": r"[0-9-]*[0-9]{3}-[0-9]{2}-[0-9]{4}[0-9-]*",
}


def _luhn(d: str) -> str:
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST({d}[i] AS INT) + 1] ELSE CAST({d}[i] AS INT) END)) % 10 = 0"


_D = "regexp_replace(s.m, '[^0-9]', '', 'g')"
_C = "replace(s.m, ' ', '')"
_MOD = f"list_reduce(list_prepend(0, list_transform(string_split(substr({_C}, 5) || substr({_C}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"


def _near(words: str) -> str:
    return f"regexp_matches(lower(substr(t, greatest(s.b - 40, 0) + 1, least(s.b, 40))), '{words}')"


_TESTS = {
    "email": "true",
    "ip": "len(list_filter(string_split(s.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || substr(ltrim(p, '0'), 1, 3) AS INT) > 255)) = 0",
    "card": f"CASE WHEN length({_D}) BETWEEN 16 AND 19 THEN {_luhn(_D)} ELSE false END",
    "phone": f"length({_D}) BETWEEN 8 AND 15",
    "iban": f"CASE WHEN length({_C}) BETWEEN 15 AND 34 THEN {_MOD} ELSE false END",
    "pan": f"CASE WHEN length({_D}) BETWEEN 13 AND 15 AND {_near('card|credit|visa|amex|karte|carte|tarjeta')} THEN {_luhn(_D)} ELSE false END",
    "ssn": f"regexp_full_match(s.m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND {_near('ssn|social security|tax id')}",
}


def _spans(kind: str) -> str:
    # a match begins after all gaps and matches before it
    p = _PATTERNS[kind]
    gaps = f"list_transform(string_split_regex(t, '{p}'), lambda x: length(x))"
    return f"""list_filter(list_transform(range(1, len({kind}_m) + 1), lambda i: {{'b': CAST(list_sum({kind}_g[1:i]) + coalesce(list_sum(list_transform({kind}_m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT), 'm': {kind}_m[i]}}), lambda s: {_TESTS[kind]})""", f"regexp_extract_all(t, '{p}') AS {kind}_m, {gaps} AS {kind}_g"


def _listed(kinds: list[str]) -> str:
    return "array_to_string(list_concat(" + ", ".join(f"list_transform({k}, lambda s: '{k}:' || s.b || ':' || (s.b + length(s.m)))" for k in kinds) + "), ',')"


_KINDS = list(_PATTERNS)
PII = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     m AS (SELECT doc_id, t, {", ".join(_spans(k)[1] for k in _KINDS)} FROM d),
     s AS (SELECT doc_id, {", ".join(f"{_spans(k)[0]} AS {k}" for k in _KINDS)} FROM m)
SELECT doc_id, {", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k in _KINDS[:4])}, sha256({_listed(_KINDS[:4])}) AS base_sha256, {_listed(_KINDS)} AS spans
FROM s
"""

HARD_NEGATIVES = """
WITH v AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INT) AS rank, negative_id, positive_score, negative_score
FROM n QUALIFY rank <= 3
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
     e AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * hits >= 80 * (p.n + q.n - hits)),
     r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k) WHERE len(w) >= k),
     f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
     c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
     kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = c.lang AND o.k > c.k AND o.a >= c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
     cut AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS one, array_to_string(w[i + 1 :], ' ') AS two FROM kept, range(1, 5) t(i) WHERE i < k),
     s AS (SELECT cut.lang, cut.phrase, a, n, i, l.f AS l, r.f AS r, CAST((1000 * a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS BIGINT) AS score
           FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = one JOIN f r ON r.lang = cut.lang AND r.phrase = two JOIN n ON n.lang = cut.lang),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {"op1_decontaminate": CONTAINED, "op9_pii": PII, "op11_hard_negatives": HARD_NEGATIVES, "op12_minhash": NEAR_DUPLICATES, "op13_phrases": PHRASES}
