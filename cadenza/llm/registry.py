"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import conversations, decontaminate, fingerprints, jaccard_join, licenses, line_dedup, lm_scoring, packing, pii, quality, suffix_dedup, token_counts, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_pii": pii.op9_pii,
    "op10_best_two_fit_packing": packing.op10_best_two_fit_packing,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_suffix_array_dedup": suffix_dedup.op13_suffix_array_dedup,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op5_benchmark_decontamination": f"""WITH i AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark), d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
x AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[k : k + least(len(ws), 13) - 1], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS k FROM i WHERE len(ws) > 0)),
g AS (SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS gram FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM x) WHERE len(ws) >= n)),
m AS (SELECT doc_id, item_id, n, k FROM g JOIN x USING (n, gram)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM m) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op7_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_BLANK} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.low AS component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY 1) c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1) k USING (doc_id)""",
    "op12_conversation_repair": conversations.ORACLE,
}
