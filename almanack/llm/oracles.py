"""What the numbered queries return, stated in SQL for DuckDB on the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op11_filter_audit"] = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS text, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents d),
 first AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
   (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
   + (CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text) THEN 4 ELSE 0 END)
   + (CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN t.doc_id > first.least THEN 16 ELSE 0 END) AS mask
  FROM t JOIN first ON first.text = t.text LEFT JOIN l ON l.doc_id = t.doc_id),
 c AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
 letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
 grown AS (SELECT x AS o, bit AS used, 1 AS step, 0 AS before, bit AS own FROM letters
  UNION ALL SELECT g.o || l.x, g.used + l.bit, g.step + 1, g.used, l.bit FROM grown g JOIN letters l ON NOT contains(g.o, l.x)),
 full_orders AS (SELECT o FROM grown WHERE step = 5),
 steps AS (SELECT f.o AS filter_order, g.step, g.before, g.own FROM full_orders f JOIN grown g ON starts_with(f.o, g.o)),
 r AS (SELECT c.part, s.filter_order, s.step, s.own,
   sum(CASE WHEN c.mask & (s.before | s.own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN c.mask & s.before = 0 AND c.mask & s.own <> 0 THEN n ELSE 0 END) AS removed,
   sum(CASE WHEN c.mask & s.before <> 0 AND c.mask & s.own <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN c.mask = s.own THEN n ELSE 0 END) AS unique_fails,
   sum(CASE WHEN c.mask & s.before = 0 AND c.mask & s.own <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN c.mask & s.before = 0 AND c.mask & s.own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN steps s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


def _codes_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Lloyd's rounds as a chain of tables: assignment by ranked distances, then floors of means."""
    out = [f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 width AS (SELECT max(len(v)) // {parts} AS w FROM kept),
 cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1 : p * w + w] AS v FROM kept, width, (SELECT unnest(range({parts})) AS p)),
 seed AS (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}),
 b0 AS MATERIALIZED (SELECT p, e, v[p * w + 1 : p * w + w] AS c FROM seed, width, (SELECT unnest(range({parts})) AS p))"""]
    near = """
 a{r} AS MATERIALIZED (SELECT vec_id, label, p, v, e, d FROM (SELECT k.*, b.e, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(k.v, b.c)]) AS d FROM cut k JOIN b{r} b ON b.p = k.p)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
    for r in range(rounds):
        out.append(near.format(r=r))
        out.append(f"""
 m{r} AS (SELECT p, e, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS c FROM (
   SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, width, (SELECT unnest(range(1, 65)) AS i) WHERE i <= w GROUP BY p, e, i) GROUP BY p, e),
 b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    out.append(near.format(r=rounds))
    return ",".join(out) + f""",
 digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{rounds}),
 coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, digest"""


ORACLES["op13_vector_codes"] = _codes_sql()

ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM p"""

ORACLES["op6_embedding_near_dedup"] = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 whole AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM whole x JOIN whole y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
 c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

ORACLES["op10_suffix_array_dedup"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
 w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS p FROM d)),
 again AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
 marked AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER o + 100 OR lag(p) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
 numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked),
 runs AS (SELECT doc_id, g, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, g),
 gaps AS (SELECT r.doc_id, r.a, r.b, coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0) AS since FROM runs r),
 cut AS (SELECT g.doc_id, count(*) AS spans, sum(g.b - g.a) AS gone, max(g.b) AS last, string_agg(substr(d.h, 2 * g.since + 1, 2 * (g.a - g.since)), '' ORDER BY g.a) AS kept FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN c.doc_id IS NULL THEN d.h ELSE c.kept || substr(d.h, 2 * c.last + 1) END)) AS kept_sha256 FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id"""
