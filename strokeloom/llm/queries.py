"""The corpus operators as registered queries, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from strokeloom.llm import secrets
from strokeloom.llm.decontaminate import op2_benchmark_decontamination
from strokeloom.llm.mixing import op6_mixing_sources
from strokeloom.llm.neighbours import op4_nearest_neighbours
from strokeloom.llm.secrets import op8_secret_scans
from strokeloom.llm.sharding import op10_sharding
from strokeloom.llm.simhash import op1_simhash_near_dedup
from strokeloom.llm.substrings import op9_substring_dedup
from strokeloom.llm.suffixes import op3_suffix_array_dedup
from strokeloom.llm.tokens import op5_token_counts
from strokeloom.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_benchmark_decontamination,
        op3_suffix_array_dedup,
        op4_nearest_neighbours,
        op5_token_counts,
        op6_mixing_sources,
        op7_toxicity,
        op8_secret_scans,
        op9_substring_dedup,
        op10_sharding,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS seq
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS seq
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, s, n, item_id FROM starts JOIN windows USING (n, seq)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _matches(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, {order} AS k, '{kind}' AS kind, start, start + length(whole) AS stop, value FROM (
    SELECT doc_id, source, m[i] AS whole, v[i] AS value,
      coalesce(list_sum([length(x) FOR x IN p[1 : i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1 : i - 1]]), 0) AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, source, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v
      FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents))))
  WHERE length(value) >= {least}"""


_SECRETS = f"""
WITH base AS ({_matches("assign", 0, secrets.PATTERNS["assign"], 2, 6)} UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_matches("hex", 2, "[0-9a-f]+", 0, 24)}),
owned AS (
  SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT doc_id) AS repositories FROM base GROUP BY value),
spans AS (
  SELECT doc_id, k, kind, start, stop FROM base
  UNION ALL SELECT DISTINCT doc_id, 3, 'live', stop - length(value), stop FROM base JOIN owned USING (value) WHERE owners <= 1 AND repositories <= 5),
joined AS (
  SELECT doc_id, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k, stop) FILTER (WHERE k < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k, stop) AS spans,
    count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE k = 3) AS n_live
  FROM spans GROUP BY doc_id),
owning AS (
  SELECT doc_id, count(*) FILTER (WHERE owners > 1 OR repositories > 5) AS n_copied, max(owners) AS max_owners, max(repositories) AS max_repositories
  FROM base JOIN owned USING (value) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(max_owners, 0) AS max_owners,
  coalesce(max_repositories, 0) AS max_repositories
FROM documents LEFT JOIN joined USING (doc_id) LEFT JOIN owning USING (doc_id)"""

#: The others need XXH64, seeded shuffles or trained models; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op2_benchmark_decontamination": _DECONTAMINATION, "op8_secret_scans": _SECRETS}
