"""DuckDB SQL for the derived tables, as common table expressions."""

PACKAGES = r"""
part_node AS (SELECT p_partkey AS k, lower(replace(p_brand, '#', '')) AS brand, p_type,
  'parts.example.org/' || lower(replace(p_brand, '#', '')) || '/p' || p_partkey AS path FROM part),
supplier_node AS (SELECT s_suppkey, s_nationkey, 'suppliers.example.net/n' || s_nationkey || '/s' || s_suppkey AS path FROM supplier),
order_target AS (
  SELECT l_orderkey, path FROM lineitem JOIN part_node ON k = l_partkey
  UNION SELECT l_orderkey, path FROM lineitem JOIN supplier_node ON s_suppkey = l_suppkey),
part_target AS (
  SELECT a.k, b.path FROM part_node a JOIN part_node b ON b.k = a.k - a.k % 4 + (a.k % 4 + 1) % 4
  UNION SELECT a.k, b.path FROM part_node a JOIN part_node b ON b.k = a.k // 10
  UNION SELECT k, 'type/' || lower(p_type) FROM part_node),
packages AS MATERIALIZED (
  SELECT 'orders.example.com/c' || o_custkey || '/o' || o_orderkey AS import_path, 'https://orders.example.com/c' || o_custkey AS repository,
         list(path ORDER BY path) AS directs, 3 AS type, 0.0::DOUBLE AS ranking
  FROM orders JOIN order_target ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey
  UNION ALL SELECT n.path, 'https://parts.example.org/' || brand, list(t.path ORDER BY t.path), 2, 0.0 FROM part_node n JOIN part_target t USING (k) GROUP BY n.path, brand
  UNION ALL SELECT path, 'https://suppliers.example.net/n' || s_nationkey, ['geo/nation' || s_nationkey], 2, 0.0 FROM supplier_node
  UNION ALL SELECT 'geo/nation' || n_nationkey, '', ['geo.example.com/region' || n_regionkey], 1, 0.0 FROM nation),
edges AS MATERIALIZED (SELECT import_path AS source, repository, unnest(directs) AS target, generate_subscripts(directs, 1) - 1 AS pos FROM packages)"""

FILES = r"""
files AS (SELECT 'docs.example.io/' || source || '/' || lang AS import_path, 'https://docs.example.io/' || source AS repository,
  lang || '/doc' || doc_id || '.txt' AS repo_path, sha256(text) AS digest FROM documents)"""

OBSERVATIONS = r"""
obs AS (SELECT 'https://repos.example.com/u' || user_id AS repository, '' AS tag, 'refs/heads/master' AS ref,
  json_extract_string(props, '$.k') AS digest, event_type = 'error' AS failed, ts, event_id AS seq FROM events),
good AS (SELECT *, lag(digest) OVER w AS prev_digest, lag(ts) OVER w AS prev_check FROM obs WHERE NOT failed WINDOW w AS (PARTITION BY repository, tag ORDER BY ts, seq)),
changes AS (SELECT repository, tag, prev_check AS "when", prev_digest AS digest, ts AS changed_at,
  row_number() OVER (PARTITION BY repository, tag ORDER BY ts DESC, seq DESC) AS n
  FROM good WHERE prev_digest IS NOT NULL AND digest <> prev_digest),
last_ok AS (SELECT repository, tag, max(ts) AS last_check, arg_max(digest, ts) AS digest, arg_max(ref, ts) AS ref_name FROM good GROUP BY ALL),
status AS (
  SELECT o.repository, o.tag, any_value(k.ref_name) AS ref_name, any_value(k.digest) AS digest,
         (count(*) FILTER (o.failed AND (k.last_check IS NULL OR o.ts > k.last_check)))::INT AS error_count, any_value(k.last_check) AS last_check
  FROM obs o LEFT JOIN last_ok k USING (repository, tag) GROUP BY o.repository, o.tag),
spans AS (SELECT repository, tag, count(*) AS n_updates, min("when") AS first_update, max("when") AS last_update FROM changes WHERE n <= 20 GROUP BY ALL)"""

NOW, MINIMUM = "2024-01-31 00:00:00", 3600


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n"
