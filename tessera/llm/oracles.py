"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LEAKS = rf"""WITH f AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS g FROM q),
s AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM f, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
h AS (SELECT s.doc_id, s.s, s.n, p.item_id FROM (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g FROM s) s JOIN p ON p.n = s.n AND p.g = s.g),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT f.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM f LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

LINKS = rf"""WITH RECURSIVE f AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
q AS (SELECT doc_id, w, least(len(w), 3) AS n, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM f WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, list_slice(w, s, s + n - 1) AS g FROM q),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT f.doc_id, coalesce(c.n, 0) AS n_shingles, least(f.doc_id, coalesce(m.y, f.doc_id)) AS component_id
FROM f LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = f.doc_id"""


def _codes(rounds: int = 4) -> str:
    """Codes by comparing every part with every entry."""
    steps = [
        """WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS id, vec_id, label, v FROM (
SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT id, p, v[len(v) // 4 * p + 1 : len(v) // 4 * (p + 1)] AS v FROM k, range(4) r(p)),
c0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM p WHERE id <= 256)"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT id, p, min(CAST(list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) * 256 + e) AS best
FROM p JOIN c{n} c USING (p) GROUP BY id, p)"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM (
SELECT p, best % 256 AS e, i, floor(sum(v[i]) / count(*)) AS x FROM a{n} JOIN p USING (id, p), range(1, len(v) + 1) r(i) GROUP BY ALL) GROUP BY p, e) n USING (p, e))"""
            )
    steps.append(
        f"""f AS (SELECT id, string_agg(format('{{:02x}}', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(CAST(CAST(v[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{rounds}, range(1, len(v) + 1) r(i)) AS codebooks_sha256
FROM f JOIN k USING (id)"""
    )
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]


CODES = _codes()


def _plus(key: str, cost: str, letter: str) -> str:
    """A way (nine digits of cost, then its audit) with one more edit; 'z' where there is none."""
    return f"CASE WHEN {key} = 'z' THEN 'z' ELSE lpad(CAST(CAST(left({key}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}' END"


_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
_SPACES = r"\x20\x09-\x0D"
_INSERTED = f"""SELECT *, least(u2, {_plus("u0", "5", "I")}, {_plus("u1", "5", "I")}, {_plus("u3", "5", "I")}) AS n2"""

#: The cheapest ways to each role state (none, s, u, a), row by row; then the edits are applied one by one.
REPAIRS = rf"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
{_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
r AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
FROM d, (VALUES (0), (1)) t(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS c FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_SPACES}]') THEN 'b' WHEN c > 1 THEN 'd' WHEN regexp_matches(text, '[^.!?{_SPACES}][{_SPACES}]*\z') THEN 't' ELSE '-' END AS q FROM o),
w AS (SELECT conv_id, list(left(role, 1) ORDER BY i) AS a, list(q ORDER BY i) AS q, list(role ORDER BY i) AS ro, list(text ORDER BY i) AS te,
coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
x AS (SELECT conv_id, a, q, 1 AS i, '000000000' AS u0, 'z' AS u1, 'z' AS u2, 'z' AS u3 FROM w
UNION ALL SELECT conv_id, a, q, i + 1, {_plus("u0", "2", "D")},
least({_plus("u1", "2", "D")}, CASE WHEN q[i] IN ('-', 't') AND a[i] = 's' THEN {_plus("u0", "t", "K")} ELSE 'z' END),
least({_plus("n2", "2", "D")}, CASE WHEN q[i] IN ('-', 't') THEN least({_plus("m", "1 + t", "R")}, CASE WHEN a[i] = 'u' THEN {_plus("m", "t", "K")} ELSE 'z' END) ELSE 'z' END),
least({_plus("n3", "2", "D")}, CASE WHEN q[i] IN ('-', 't') THEN least({_plus("n2", "1 + t", "R")}, CASE WHEN a[i] = 'a' THEN {_plus("n2", "t", "K")} ELSE 'z' END) ELSE 'z' END)
FROM (SELECT *, least(u0, u1, n3) AS m, CASE q[i] WHEN 't' THEN 5 ELSE 0 END AS t FROM (SELECT *, least(u3, {_plus("n2", "5", "I")}) AS n3 FROM ({_INSERTED} FROM x))) WHERE i <= len(a)),
e AS (SELECT conv_id, least(u0, u3, {_plus("n2", "5", "I")}) AS best FROM ({_INSERTED} FROM x) WHERE i = len(a) + 1),
y AS (SELECT w.conv_id, substr(best, 10) AS audit, ro, te, 1 AS j, 1 AS i, '' AS st, CAST([] AS VARCHAR[]) AS lines FROM w JOIN e ON w.conv_id IS NOT DISTINCT FROM e.conv_id
UNION ALL SELECT conv_id, audit, ro, te, j + 1, i + CASE l WHEN 'I' THEN 0 ELSE 1 END, CASE l WHEN 'D' THEN st ELSE left(n, 1) END,
CASE l WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, n || ':') ELSE list_append(lines, n || ':' || te[i]) END
FROM (SELECT *, CASE WHEN l = 'K' THEN ro[i] WHEN st = 'u' THEN 'assistant' ELSE 'user' END AS n FROM (SELECT *, substr(audit, j, 1) AS l FROM y WHERE j <= length(audit)))),
z AS (SELECT conv_id, audit, array_to_string(lines, chr(10)) AS repaired FROM y WHERE j = length(audit) + 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(len(list_filter(q, lambda v: v = 'b')), 0) AS blank, coalesce(len(list_filter(q, lambda v: v = 'd')), 0) AS duplicate, coalesce(len(list_filter(q, lambda v: v = 't')), 0) AS truncated,
coalesce(len(list_filter(range(1, len(a)), lambda v: a[v] || a[v + 1] NOT IN ('su', 'ua', 'au'))), 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""
