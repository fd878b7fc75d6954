"""The operators' queries and their DuckDB SQL, by name."""

from __future__ import annotations

from spanlake.llm import byte_bpe, decontaminate, exact_dedup, language_id, line_dedup, quality_gam, secret_scan, simhash, toxicity, url_filter



def llm_url_rules(spark, sf_dir):
    """Host, path and rule of every page, as op2_url_filter gives them."""
    return url_filter.op2_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def llm_secret_counts(spark, sf_dir):
    """The base finds of every document, as op8_secret_scan gives them."""
    return secret_scan.op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


URL_RULES_SQL = """
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT rule, split_part(rule, '/', 1) AS own, substr(rule, instr(rule, '/')) AS start FROM (VALUES ('com/en/'), ('example.com/en/7'), ('net/de/'), ('example.net/de/8'), ('org/es/')) v(rule))
SELECT page_id, host, path, (SELECT arg_max(rule, len(rule)) FROM r WHERE (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)) AS rule FROM p
"""

SECRET_COUNTS_SQL = """
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 18)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 16)) AS n_hex
FROM documents
"""

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_gam": quality_gam.op5_quality_gam,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_language_id": language_id.op10_language_id,
    "llm_url_rules": llm_url_rules,
    "llm_secret_counts": llm_secret_counts,
}

SQL = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "llm_url_rules": URL_RULES_SQL,
    "llm_secret_counts": SECRET_COUNTS_SQL,
}
