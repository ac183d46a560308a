"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP8 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM d, unnest(range(0, greatest(length(x) // 2 - 49, 0))) AS t(i)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE w.doc_id > m.least),
e AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
p AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY ALL),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM p),
k AS (SELECT q.doc_id, string_agg(substr(x, (2 * prior + 1)::BIGINT, (2 * (a - prior))::BIGINT), '' ORDER BY a) AS head, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last
  FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN x ELSE head || substr(x, (2 * last + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

WORDS = r"""list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP5 = f"""
WITH iw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
  FROM iw, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS shingles FROM ig GROUP BY item_id),
dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM dw, k, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN ig USING (g) GROUP BY ALL)
SELECT doc_id, item_id, shared::BIGINT AS shared, shingles::BIGINT AS shingles, shared / shingles AS containment
FROM s JOIN n USING (item_id) WHERE shared >= 0.5 * shingles
"""

OP6 = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
num AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS r FROM src),
wt AS (SELECT source, source_size, [5, 2, 1][(r % 3 + 1)::INT]::BIGINT AS w FROM num),
ord AS (SELECT *, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / w, source) AS k FROM wt),
pre AS (SELECT *,
    coalesce(sum(source_size * 3) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held,
    (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS free,
    (sum(source_size) OVER ())::BIGINT AS total FROM ord),
lev AS (SELECT arg_min((total - held)::DOUBLE, k) AS num, arg_min(free::DOUBLE, k) AS den FROM pre
    WHERE w * (total - held)::DOUBLE / free <= source_size * 3),
tgt AS (SELECT source, source_size, least(coalesce(w * num / den, source_size * 3), (source_size * 3)::DOUBLE) AS target FROM wt, lev),
sized AS (SELECT b.doc_id, b.source, b.size, t.source_size, t.target, greatest(64 - 2 * length(bin(b.size)), 1)::BIGINT AS g
    FROM base b JOIN tgt t ON b.source IS NOT DISTINCT FROM t.source),
cls AS (SELECT source, target, g, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
stp AS (SELECT *,
    coalesce(sum(words) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
    (sum(words * g) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM cls),
th0 AS (SELECT *, CASE WHEN rest > 0 THEN (target - above * 3) / rest ELSE 0.0::DOUBLE END AS theta FROM stp),
th AS (SELECT source, arg_max(theta, g) FILTER (theta * g <= 3) AS theta FROM th0 GROUP BY source),
exp AS (SELECT s.*, coalesce(th.theta * s.g, 3.0::DOUBLE) AS e FROM sized s JOIN th ON s.source IS NOT DISTINCT FROM th.source),
odds AS (SELECT *, least(floor(e), 3)::BIGINT AS whole, CASE WHEN e >= 3 THEN 0.0::DOUBLE ELSE e - floor(e) END AS p,
    (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM exp),
rk AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM odds),
lft AS (SELECT source, any_value(target) - sum(whole * size)::BIGINT AS lft FROM rk GROUP BY source),
cum AS (SELECT rk.*, lft.lft, (sum(size) OVER (PARTITION BY rk.source ORDER BY q NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS reach
    FROM rk JOIN lft ON rk.source IS NOT DISTINCT FROM lft.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN q IS NULL THEN 0 WHEN reach <= lft OR (reach - size <= lft AND reach - lft < lft - (reach - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cum
"""


OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_remove_repeats": OP2, "op5_decontaminate": OP5, "op6_mix_sources": OP6, "op8_exact_dedup": OP8, "op10_warc": OP10}
