"""SQL of those training-data operators that SQL can say."""

from __future__ import annotations

from .part_codes import ENTRIES, PARTS, ROUNDS, SCALE


def part_codes_sql() -> str:
    """The rounds of part codes, one after the other, all parts against all entries."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) r(p)
), book0 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, x AS c FROM parts
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES}
)"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min((d, e)) AS m FROM (
    SELECT vec_id, label, parts.p, x, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d
    FROM parts JOIN book{r} ON parts.p = book{r}.p) GROUP BY ALL)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(new, c) AS c FROM book{r} LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS new FROM (
      SELECT p, m[2] AS e, i, sum(x[i]) AS s, count(*) AS n FROM near{r}, range(1, 1 + (SELECT max(len(x)) FROM parts)) q(i) GROUP BY ALL)
    GROUP BY ALL) USING (p, e))"""
            )
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id, label
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


DECONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, len(p) AS n, array_to_string(p, ' ') AS p FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i:i + 9])) AS p FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n
), hits AS (
  SELECT r, places.n, i, item_id FROM (SELECT places.*, array_to_string(w[i:i + n - 1], ' ') AS p FROM places JOIN docs USING (r)) places JOIN windows USING (n, p)
), marked AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda w: w <> '') AS w FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), counts AS MATERIALIZED (
  SELECT lang, len(p) AS size, p, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - s + 2), lambda i: w[i:i + s - 1])) AS p FROM words, range(1, 5) t(s) WHERE len(w) >= s)
  GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c
  JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1:c.size]
), best AS (
  SELECT lang, p, a, arg_min((l, r, score), (score, k)) AS b FROM cuts GROUP BY lang, p, a
), inside AS (
  SELECT lang, p[i:i + m - 1] AS p, max(f) AS longer FROM (
    SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM counts WHERE size > 2)) GROUP BY ALL
), ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, b[1] AS l, b[2] AS r, CAST(b[3] AS BIGINT) AS score
  FROM best LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN sizes USING (lang) QUALIFY rank <= 2000
"""
