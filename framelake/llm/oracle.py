"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_HOST = r"translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1)"

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": rf"""
        WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        r(rhost, rpath, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        f AS (SELECT u.*, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
              FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1""",
    "op11_source_divergence_audit": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
        n AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (SELECT *, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM n),
        s AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY ALL),
        q AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM s),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        e AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM e)
        SELECT * FROM o WHERE part = 'pair' OR rank <= 10""",
    "op12_exact_top_k_search": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::HUGEINT) AS w FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
        s AS (SELECT a.r, a.vec_id AS query_id, b.r AS other, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.w, b.w, true), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5""",
    "op13_filter_interaction_audit": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INTEGER
                     + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(w.doc_id > first, false)::INTEGER AS fails
              FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
        k AS (SELECT part, s AS subset, count(*) FILTER (fails & s = 0) AS kept, count(*) FILTER (fails & s = 0 AND good) AS good, count(*) FILTER (fails & s = 0 AND toxic) AS toxic FROM m, range(32) r(s) GROUP BY ALL),
        o AS (SELECT '' AS o, 0 AS b, 0 AS x, 0 AS step UNION ALL SELECT o || chr(65 + i::INTEGER), b | x, (1 << i)::INTEGER, step + 1 FROM o, range(5) r(i) WHERE (b | x) & (1 << i) = 0 AND step < 5),
        f AS (SELECT a.o AS filter_order, b.b, b.x, b.step FROM o a JOIN o b ON starts_with(a.o, b.o) WHERE a.step = 5 AND b.step > 0),
        e AS (SELECT f.*, p.part, p.kept AS was, q.kept, p.kept - q.kept AS removed, u.kept - v.kept AS fails, y.kept - z.kept AS unique_fails, p.good - q.good AS good_lost, p.toxic - q.toxic AS toxic_lost
              FROM f JOIN k p ON p.subset = b JOIN k q ON q.part = p.part AND q.subset = b | x JOIN k u ON u.part = p.part AND u.subset = 0 JOIN k v ON v.part = p.part AND v.subset = x
              JOIN k y ON y.part = p.part AND y.subset = 31 - x JOIN k z ON z.part = p.part AND z.subset = 31)
        SELECT part, filter_order, step, kept, removed, fails - removed AS redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM e""",
}
