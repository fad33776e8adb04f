"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WINDOWED = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
it AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM (SELECT *, least(10, len(ws)) AS n FROM i WHERE len(ws) > 0))),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM it))),
hit AS (SELECT DISTINCT doc_id, n, s, item_id FROM dw JOIN it USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN f USING (doc_id)
"""

LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, s, ws[s] AS a, ws[s + 1] AS b, ws[s + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS s FROM d)),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(s, s + 3)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
 coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_bangs FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (100 * n_dup_lines > 30 * n_lines)::INT
 + 16 * (word_chars > 12 * n_words)::INT + 32 * (10 * word_chars < 20 * n_words)::INT + 64 * (2 * n_bangs > n_words)::INT)::BIGINT AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, rule_bits & 3 <> 0 AS base_failed, rule_bits = 0 AS kept, rule_bits FROM b
"""

REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
x AS (SELECT d.doc_id, word, x.p, gone.p IS NOT NULL AS cut FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d) x JOIN d USING (doc_id) LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p),
k AS (SELECT doc_id, count(*) FILTER (WHERE cut) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT cut) AS kept FROM x GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

BYTES = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT rid, doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT rid, doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE doc_id IS NOT NULL)),
gone AS (SELECT rid, p FROM (SELECT rid, p, doc_id, min(doc_id) OVER (PARTITION BY g) AS earliest FROM w) WHERE earliest < doc_id),
runs AS (SELECT rid, p, p - coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), -1000) > 50 AS fresh FROM gone),
spans AS (SELECT rid, min(p) AS a, max(p) + 50 AS z FROM (SELECT rid, p, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY p) AS k FROM runs) GROUP BY rid, k),
kept AS (SELECT rid, a, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS s, z FROM spans),
s AS (SELECT rid, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * s + 1, 2 * (a - s)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS left_over FROM kept JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256 FROM d LEFT JOIN s USING (rid)
"""

_LEDGER = LEDGER.rsplit("SELECT doc_id, n_words", 1)[0]
ABLATION = f"""{_LEDGER}, rules AS (SELECT unnest(range(7)) AS bit, unnest(['few_words', 'repeated_windows', 'symbol_heavy', 'repeated_lines', 'long_words', 'short_words', 'shouting']) AS rule)
SELECT 2 AS policy, bit::INT AS bit, rule, count(*) FILTER (WHERE rule_bits & (1 << bit) <> 0) AS n_failed, count(*) FILTER (WHERE rule_bits = (1 << bit)) AS n_failed_alone,
 count(*) FILTER (WHERE rule_bits & ~(1 << bit) = 0) AS n_kept_without FROM b, rules GROUP BY bit, rule"""



def _lloyd(rounds: int = 10, k: int = 8) -> str:
    """Rounds of assignment and exact floor means, as one chain of materialized CTEs."""
    steps = [
        f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
f AS MATERIALIZED (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS c FROM e QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN v USING (rid))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT rid, c, sum((v.x - q.x) * (v.x - q.x))::BIGINT AS d FROM v JOIN c{r} q USING (i) GROUP BY rid, c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS MATERIALIZED (SELECT c, i, ((s - (s % n + n) % n) // n)::BIGINT AS x FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (rid) GROUP BY c, i))")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.x, q.x) AS x FROM c{r} q LEFT JOIN m{r} m USING (c, i))")
    return (
        ",\n".join(steps)
        + f""",
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN e USING (rid) JOIN h USING (c)"""
    )


LLOYD = _lloyd()

ORACLE_SQL = {"op3_decontamination": WINDOWED, "op7_quality_rules": LEDGER, "op9_substring_dedup": REPEATS, "ablation_of_quality_rules": ABLATION, "op11_centroid_clustering": LLOYD, "op12_suffix_dedup": BYTES}
