"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from adloom.llm.quality_rules import EDGE, LOWER, STOP_WORDS, UPPER

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_BARE = f"trim(translate(x, '{UPPER}', '{LOWER}'), '{EDGE.replace(chr(39), 2 * chr(39))}')"

OP1 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS g FROM w),
r AS (SELECT *, list_transform(list_filter(map_entries(list_histogram(g)), lambda e: e.value > 1), lambda e: e.key) AS again FROM l),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS bangs,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             len(list_distinct(flatten(list_transform(list_filter(range(1, len(w) - 1), lambda i: list_contains(again, g[i])),
                                                      lambda i: [i, i + 1, i + 2]))))::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: {_BARE} IN ({_STOPS}))) AS stops FROM r),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             greatest(n_words, 1) AS one FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND word_chars / one BETWEEN 2 AND 12 AND n_symbols / one <= 0.1 AND bangs / one <= 0.3
        AND stops / one >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5) AS kept FROM b"""

OP3 = """
WITH p AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
                                THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, regexp_extract(r, '^([^/?#]*)', 1) AS raw, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
q AS (SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM h),
f AS (SELECT *, starts_with(path, '/') AND (host = 'net' OR ends_with(host, '.net')) AS net,
             starts_with(path, '/en/') AND (host = 'example.net' OR ends_with(host, '.example.net')) AS example_net,
             starts_with(path, '/de/') AND (host = 'example.com' OR ends_with(host, '.example.com')) AS example_com,
             starts_with(path, '/fr/') AND (host = 'org' OR ends_with(host, '.org')) AS org FROM q)
SELECT page_id, host, path,
       CASE WHEN example_net THEN 'example.net/en/' WHEN net THEN 'net/'
            WHEN example_com THEN 'example.com/de/' WHEN org THEN 'org/fr/' END AS rule,
       CASE WHEN example_net THEN 'allow' WHEN net OR example_com THEN 'block' ELSE 'allow' END AS verdict FROM f"""

_WHOLE = """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
#: Integers rounded down: the remainder is taken off before dividing.
_MEAN = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"


def _codes_sql(rounds: int = 2) -> str:
    """16 parts, 64 entries; cells are (vector r, part p, place k, integer x)."""
    steps = [f"WITH {_WHOLE}", "cell AS MATERIALIZED (SELECT r, (i - 1) // (len(x) // 16) AS p, (i - 1) % (len(x) // 16) AS k, x[i] AS x "
             "FROM (SELECT r, x, unnest(range(1, len(x) + 1)) AS i FROM kept))",
             "book0 AS MATERIALIZED (SELECT p, r - 1 AS e, k, x FROM cell WHERE r <= 64)"]
    near = ("near{0} AS MATERIALIZED (SELECT r, p, (m % 64)::INTEGER AS e, m // 64 AS d FROM (SELECT r, p, min(d * 64 + e) AS m FROM "
            "(SELECT r, c.p, e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cell c JOIN book{0} b ON c.p = b.p AND c.k = b.k GROUP BY r, c.p, e) GROUP BY r, p))")
    for i in range(rounds):
        steps += [near.format(i), f"mean{i} AS (SELECT c.p, e, k, {_MEAN} AS x FROM cell c JOIN near{i} n ON c.r = n.r AND c.p = n.p GROUP BY c.p, e, k)",
                  f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, b.k, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m ON b.p = m.p AND b.e = m.e AND b.k = m.k)"]
    steps += [near.format(rounds),
              "coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error "
              f"FROM near{rounds} GROUP BY r)"]
    return ",\n".join(steps) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, k)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


def _clusters_sql(rounds: int = 5) -> str:
    """40 centroids of 64 components; cells are (vector r, place k, integer x)."""
    whole = _WHOLE.replace("WHERE", "WHERE len(embedding) = 64 AND")
    steps = [f"WITH {whole}", "cell AS MATERIALIZED (SELECT r, k, x[k] AS x FROM (SELECT r, x, unnest(range(1, 65)) AS k FROM kept))",
             "first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept)",
             "mid0 AS MATERIALIZED (SELECT c, k, x FROM cell JOIN first USING (r) WHERE c < 40)"]
    near = ("near{0} AS MATERIALIZED (SELECT r, (m % 64)::INTEGER AS c, m // 64 AS d FROM (SELECT r, min(d * 64 + c) AS m FROM "
            "(SELECT r, c, sum((v.x - b.x) * (v.x - b.x)) AS d FROM cell v JOIN mid{0} b ON v.k = b.k GROUP BY r, c) GROUP BY r))")
    for i in range(rounds):
        steps += [near.format(i), f"mean{i} AS (SELECT c, k, {_MEAN} AS x FROM cell JOIN near{i} USING (r) GROUP BY c, k)",
                  f"mid{i + 1} AS MATERIALIZED (SELECT c, k, coalesce(m.x, b.x) AS x FROM mid{i} b LEFT JOIN mean{i} m USING (c, k))"]
    steps += [near.format(rounds), f"sha AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY k)) AS centroid_sha256 FROM mid{rounds} GROUP BY c)"]
    return ",\n".join(steps) + f"""
SELECT vec_id, c AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM kept JOIN near{rounds} USING (r) JOIN sha USING (c)"""


ORACLE = {"op1_quality_rules": OP1, "op3_url_filter": OP3,
          "op11_vector_codes": _codes_sql(), "op12_centroid_clusters": _clusters_sql()}
