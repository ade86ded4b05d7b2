"""Registered queries over the derived tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import closure as C
from ..operators import maintain as M
from ..operators import match as MA
from ..operators import paging as PG
from ..operators import rank as R
from ..operators import rank_updates as RU
from ..operators import resolve as RE
from ..operators import reverse as RV
from ..operators import reverse_index as RI
from ..operators import stats as S
from ..operators import status as ST
from ..sources import buckets as B
from ..sources import derived as D
from ..sources import export as X
from ..sources import ingest as IN
from ..sources.scratch import Rounds, Snapshots, shared_dir
from ..streaming import keyed_status as KS
from ..streaming import status_stream as SS
from .oracle_base import FILES, MINIMUM, NOW, OBSERVATIONS, PACKAGES, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def _folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def over_packages(name: str, fn: Callable[[DataFrame], DataFrame], sql: str | None = None, *more: str, often: bool = False) -> None:
    """Register a query that needs the package table only, several times with ``often``; ``sql`` follows the tables' definitions."""
    query(with_(PACKAGES, *more) + sql if sql else None, name)(lambda spark, d: fn((stored if often else D.packages)(spark, d)))


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The package table, made once and written: for queries that read it several times."""
    return Rounds(spark, "packages").write(D.packages(spark, d), keep=True)


FLAT = "import_path, repository, array_to_string(directs, ' ') AS directs, type, ranking"


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, so that rows compare alike in any engine."""
    return df.withColumn("directs", F.array_join("directs", " ")).select("import_path", "repository", "directs", "type", "ranking")


# --- lookups, scans, matches ---------------------------------------------------------------------
PART, SUBTREE, BRAND = "parts.example.org/brand1/p1", "parts.example.org/brand1/...", "parts.example.org/brand1"
IN_BRAND = f"(import_path = '{BRAND}' OR starts_with(import_path, '{BRAND}/'))"

over_packages("lookup", lambda p: flat(MA.lookup(p, "geo/nation7")), f"SELECT {FLAT} FROM packages WHERE import_path = 'geo/nation7'")
over_packages("scan_from", lambda p: flat(MA.scan_from(p, "parts.")), f"SELECT {FLAT} FROM packages WHERE import_path >= 'parts.' ORDER BY 1")
over_packages("match_exact", lambda p: flat(MA.match(p, "geo/nation3")), f"SELECT {FLAT} FROM packages WHERE import_path = 'geo/nation3'")
over_packages("match_prefix", lambda p: flat(MA.match(p, "orders.example.com/c1/...")), f"SELECT {FLAT} FROM packages WHERE starts_with(import_path, 'orders.example.com/c1/') OR import_path = 'orders.example.com/c1'")
over_packages("match_repo", lambda p: flat(MA.match(p, repository="git@suppliers.example.net:n3.git")), f"SELECT {FLAT} FROM packages WHERE repository = 'https://suppliers.example.net/n3'")
over_packages("match_count", lambda p: MA.match_count(p, package="parts.example.org/..."), "SELECT count(*) AS num_rows FROM packages WHERE starts_with(import_path, 'parts.example.org/')")
over_packages("match_slim", lambda p: MA.match(p, "suppliers.example.net/...", include_directs=False), "SELECT import_path, repository, type, ranking FROM packages WHERE starts_with(import_path, 'suppliers.example.net/')")
over_packages(
    "match_page", lambda p: MA.match_page(p, 25, "parts.example.org/brand2", package="parts.example.org/...").select("import_path", "repository", "next_page"),
    """, f AS (SELECT import_path, repository, row_number() OVER (ORDER BY import_path) AS n FROM packages
    WHERE starts_with(import_path, 'parts.example.org/') AND import_path >= 'parts.example.org/brand2')
    SELECT import_path, repository, (SELECT import_path FROM f WHERE n = 26) AS next_page FROM f WHERE n <= 25""",
)
over_packages("match_limit", lambda p: MA.match_limit(p, 150, package="orders.example.com/...").select("import_path", "repository"), "SELECT import_path, repository FROM packages WHERE starts_with(import_path, 'orders.example.com/') ORDER BY 1 LIMIT 150")
over_packages("match_keys", lambda p: MA.match(p, include_directs=False).select("import_path"), "SELECT import_path FROM packages")
over_packages("domain_only", lambda p: p.select("import_path").filter(P.has_domain(F.col("import_path"))), "SELECT import_path FROM packages WHERE contains(split_part(import_path, '/', 1), '.')")
over_packages(
    "match_importers", lambda p: MA.match_importers(p, lambda t: t.startswith("suppliers.example.net/")),
    "SELECT source AS import_path, arg_min(target, pos) AS target FROM edges WHERE starts_with(target, 'suppliers.example.net/') GROUP BY source",
)

# --- reverse dependencies ------------------------------------------------------------------------
over_packages("reverse_exact", lambda p: RV.reverse(p, ["geo/nation5"]), "SELECT target, source FROM edges WHERE target = 'geo/nation5'")
over_packages("reverse_prefix", lambda p: RV.reverse(p, ["suppliers.example.net/n1/..."]), "SELECT target, source FROM edges WHERE starts_with(target, 'suppliers.example.net/n1/')")
MANY = [f"suppliers.example.net/n{i}/..." for i in range(0, 25, 2)] + [f"geo/nation{i}" for i in range(0, 25)] + [f"geo.example.com/region{i}" for i in range(5)] + [f"type/none{i}" for i in range(80)]
over_packages(
    "reverse_many", lambda p: RV.reverse(p, MANY),
    "SELECT target, source FROM edges WHERE starts_with(target, 'geo/nation') OR starts_with(target, 'geo.example.com/region') OR (starts_with(target, 'suppliers.example.net/n') AND CAST(regexp_extract(target, '/n([0-9]+)/', 1) AS INT) % 2 = 0)",
)
over_packages("reverse_matching", lambda p: RV.reverse(p, ["parts.example.org/..."], matching=r"/c1[0-9]*/o\d+$"), r"SELECT target, source FROM edges WHERE starts_with(target, 'parts.example.org/') AND regexp_matches(source, '/c1[0-9]*/o\d+$')")
over_packages("reverse_not_matching", lambda p: RV.reverse(p, ["parts.example.org/..."], matching="(?!)^orders"), "SELECT target, source FROM edges WHERE starts_with(target, 'parts.example.org/') AND NOT regexp_matches(source, '^orders')")
over_packages(
    "reverse_other_repo", lambda p: RV.reverse(p, ["parts.example.org/...", "geo.example.com/..."], other_repository=True),
    """SELECT e.target, e.source FROM edges e LEFT JOIN packages t ON t.import_path = e.target
    WHERE (starts_with(target, 'parts.example.org/') OR starts_with(target, 'geo.example.com/')) AND coalesce(t.repository <> e.repository, true)""",
)
over_packages("reverse_complete", lambda p: flat(RV.reverse(p, ["geo/..."], complete=True).withColumnRenamed("source", "import_path")), f"SELECT {FLAT} FROM packages JOIN (SELECT source FROM edges WHERE starts_with(target, 'geo/')) ON source = import_path")
over_packages("reverse_count", lambda p: RV.reverse_count(p, ["type/..."], start="parts.example.org/brand2"), "SELECT count(*) AS num_imports FROM edges WHERE starts_with(target, 'type/') AND source >= 'parts.example.org/brand2'")
over_packages(
    "reverse_page", lambda p: RV.reverse_page(p, ["suppliers.example.net/..."], 40, "orders.example.com/c2"),
    """, h AS (SELECT source, count(*) AS c FROM edges WHERE starts_with(target, 'suppliers.example.net/') AND source >= 'orders.example.com/c2' GROUP BY source),
    r AS (SELECT source, sum(c) OVER (ORDER BY source) AS run, row_number() OVER (ORDER BY source) AS n FROM h)
    SELECT target, source, (SELECT min(source) FROM r WHERE run > 40 AND n > 1) AS next_page FROM edges
    WHERE starts_with(target, 'suppliers.example.net/') AND source IN (SELECT source FROM r WHERE run <= 40 OR n = 1)""",
)
query(
    with_(PACKAGES, recursive=True)
    + """, h AS (SELECT source, count(*) AS c FROM edges WHERE starts_with(target, 'suppliers.example.net/') GROUP BY source),
    r AS MATERIALIZED (SELECT source, c, sum(c) OVER (ORDER BY source)::BIGINT AS run, row_number() OVER (ORDER BY source) AS i FROM h),
    starts(page, i) AS (SELECT 0::BIGINT, 1::BIGINT WHERE (SELECT count(*) FROM r) > 0
      UNION ALL SELECT page + 1, n FROM (SELECT p.page, min(b.i) AS n FROM starts p JOIN r a ON a.i = p.i JOIN r b ON b.i > p.i AND b.run - a.run + a.c > 300 GROUP BY p.page)),
    placed AS (SELECT r.source, max(s.page) AS page FROM r JOIN starts s ON s.i <= r.i GROUP BY r.source)
    SELECT page, target, source FROM edges JOIN placed USING (source) WHERE starts_with(target, 'suppliers.example.net/')""",
    "reverse_pages",
)(lambda spark, d: PG.reverse_pages(D.packages(spark, d), ["suppliers.example.net/..."], 300))
over_packages("reverse_json", lambda p: X.edges_json(RV.reverse(p, ["geo/..."])), """SELECT '{"target":"' || target || '","source":"' || source || '"}' AS value FROM edges WHERE starts_with(target, 'geo/')""")
over_packages(
    "affected", lambda p: RV.affected(p, ["suppliers.example.net/n1/..."]).withColumn("packages", F.array_join("packages", " ")),
    "SELECT repository, string_agg(DISTINCT source, ' ' ORDER BY source) AS packages FROM edges WHERE starts_with(target, 'suppliers.example.net/n1/') AND repository <> 'https://suppliers.example.net/n1' GROUP BY repository",
)
over_packages("affected_targets", lambda p: RV.affected_targets(p, ["suppliers.example.net/n1/..."]), "SELECT DISTINCT target FROM edges WHERE starts_with(target, 'suppliers.example.net/n1/') AND repository <> 'https://suppliers.example.net/n1'")
over_packages(
    "affected_repo", lambda p: RV.affected_by_repository(p, "https://parts.example.org/brand13").withColumn("packages", F.array_join("packages", " ")),
    """SELECT repository, string_agg(DISTINCT source, ' ' ORDER BY source) AS packages FROM edges
    WHERE repository <> 'https://parts.example.org/brand13' AND target IN (SELECT import_path FROM packages WHERE repository = 'https://parts.example.org/brand13') GROUP BY repository""",
)
over_packages(
    "affected_repo_edges", lambda p: RV.affected_by_repository_edges(p, "https://parts.example.org/brand13"),
    """SELECT DISTINCT repository, source AS package FROM edges
    WHERE repository <> 'https://parts.example.org/brand13' AND target IN (SELECT import_path FROM packages WHERE repository = 'https://parts.example.org/brand13')""",
)

# the same on paths that have importers in the smallest tables too
over_packages("reverse_region", lambda p: RV.reverse(p, ["geo.example.com/region1"]), "SELECT target, source FROM edges WHERE target = 'geo.example.com/region1'")
over_packages("reverse_subtree", lambda p: RV.reverse(p, ["parts.example.org/brand13/..."]), "SELECT target, source FROM edges WHERE starts_with(target, 'parts.example.org/brand13/')")
BRAND13 = "FROM edges WHERE starts_with(target, 'parts.example.org/brand13/') AND repository <> 'https://parts.example.org/brand13'"
over_packages(
    "affected_parts", lambda p: RV.affected(p, ["parts.example.org/brand13/..."]).withColumn("packages", F.array_join("packages", " ")),
    f"SELECT repository, string_agg(DISTINCT source, ' ' ORDER BY source) AS packages {BRAND13} GROUP BY repository",
)
over_packages("affected_edges", lambda p: RV.affected_edges(p, ["parts.example.org/brand13/..."]), f"SELECT DISTINCT repository, source AS package {BRAND13}")
over_packages("affected_part_targets", lambda p: RV.affected_targets(p, ["parts.example.org/brand13/..."]), f"SELECT DISTINCT target {BRAND13}")
over_packages(
    "reverse_rows_json", lambda p: X.edges_json(RV.reverse(p, ["geo/..."], complete=True), rows=True),
    """SELECT '{"target":"' || target || '","row":{"importPath":"' || import_path || '","repository":"' || p.repository || '","directs":["' || array_to_string(directs, '","') || '"],"type":"LIBRARY"}}' AS value
    FROM edges JOIN packages p ON import_path = source WHERE starts_with(target, 'geo/')""",
)
# the same operators under SQL that unnests in place, without joining edges back to whole rows
UNNESTED = "SELECT import_path, repository, directs, type, ranking, unnest(directs) AS target FROM packages"
over_packages("reverse_complete_rows", lambda p: flat(RV.reverse(p, ["geo/...", "geo.example.com/..."], complete=True).withColumnRenamed("source", "import_path")),
              f"SELECT {FLAT} FROM ({UNNESTED}) WHERE starts_with(target, 'geo/') OR starts_with(target, 'geo.example.com/')")
over_packages(
    "reverse_across_repositories", lambda p: RV.reverse(p, ["parts.example.org/...", "suppliers.example.net/...", "geo.example.com/..."], other_repository=True),
    f""", owner AS MATERIALIZED (SELECT import_path AS node, repository AS owner FROM packages)
    SELECT target, import_path AS source FROM ({UNNESTED}) LEFT JOIN owner ON node = target
    WHERE (starts_with(target, 'parts.example.org/') OR starts_with(target, 'suppliers.example.net/') OR starts_with(target, 'geo.example.com/')) AND coalesce(owner <> repository, true)""",
)
over_packages(
    "reverse_rows_json_parts", lambda p: X.edges_json(RV.reverse(p, ["type/..."], complete=True), rows=True),
    f"""SELECT '{{"target":"' || target || '","row":{{"importPath":"' || import_path || '","repository":"' || repository || '","directs":["' || array_to_string(directs, '","') || '"],"type":"LIBRARY"}}}}' AS value
    FROM ({UNNESTED}) WHERE starts_with(target, 'type/')""",
)

# --- sets and statistics -------------------------------------------------------------------------
NOT_THERE = "target NOT IN (SELECT import_path FROM packages)"
over_packages("missing", S.missing, f"SELECT DISTINCT target AS import_path FROM edges WHERE {NOT_THERE}")
over_packages("missing_domain", lambda p: S.missing(p, domain_only=True), f"SELECT DISTINCT target AS import_path FROM edges WHERE {NOT_THERE} AND contains(split_part(target, '/', 1), '.')")
over_packages("all_nodes", S.all_nodes, "SELECT import_path FROM packages UNION SELECT target FROM edges")
over_packages("graph_stats", S.graph_stats, f"SELECT (SELECT count(*) FROM packages) AS packages, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT import_path FROM packages UNION SELECT target FROM edges)) AS nodes, (SELECT count(DISTINCT target) FROM edges WHERE {NOT_THERE}) AS missing")
HIST = """, h AS (SELECT split_part(target, '/', 1) AS domain, count(*) AS deps, count(DISTINCT source) AS pkgs FROM edges WHERE contains(split_part(target, '/', 1), '.') GROUP BY 1),
out AS (SELECT domain, deps, round(100.0 * deps / (SELECT count(*) FROM edges), 6) AS pct_deps, pkgs, round(100.0 * pkgs / (SELECT count(*) FROM packages), 6) AS pct_pkgs, round(deps / pkgs, 6) AS deps_per_pkg FROM h)
SELECT domain, deps, pct_deps::DOUBLE AS pct_deps, pkgs, pct_pkgs::DOUBLE AS pct_pkgs, deps_per_pkg FROM out"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("pct_deps", "pct_pkgs", "deps_per_pkg")})


over_packages("domain_hist", lambda p: rounded(S.domain_histogram(p)), HIST)
over_packages("domain_top", lambda p: rounded(S.domain_top(p, 3, 100)), HIST + " WHERE domain IN (SELECT domain FROM out ORDER BY deps DESC, domain LIMIT 3) AND pkgs >= 100")
over_packages("domain_totals", S.domain_totals, "SELECT (SELECT count(*) FROM packages) AS packages, count(*) AS edges, count(*) FILTER (NOT contains(split_part(target, '/', 1), '.')) AS non_domain FROM edges")


@query(with_(FILES) + "SELECT digest, regexp_extract(repo_path, '[^/]*$') AS file, repository, import_path FROM files WHERE digest IN (SELECT digest FROM files GROUP BY digest HAVING count(*) > 1)")
def dup_files(spark, d):
    return S.duplicate_files(D.source_files(spark, d))


@query(with_(FILES) + "SELECT digest, count(*) AS locations, count(DISTINCT repository) AS repositories FROM files GROUP BY digest HAVING count(*) > 1")
def dup_groups(spark, d):
    return S.duplicate_groups(D.source_files(spark, d))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def file_digest(spark, d):
    return D.table(spark, d, "documents").select("doc_id", P.hex_digest(P.content_digest(F.col("text"))).alias("digest"))


# --- ranking and closure -------------------------------------------------------------------------
def _rank_sql(rounds: int) -> str:
    out = ["nodes AS MATERIALIZED (SELECT import_path AS node FROM packages UNION SELECT target FROM edges)", "links AS MATERIALIZED (SELECT source, target, count(*) OVER (PARTITION BY source) AS n FROM edges)",
           "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS w FROM nodes)"]
    for k in range(1, rounds + 1):
        out.append(f"p{k} AS MATERIALIZED (SELECT target, sum(w / n) AS got FROM links JOIN r{k - 1} ON node = source GROUP BY target)")
        out.append(f"r{k} AS MATERIALIZED (SELECT n.node, 0.15 + 0.85 * coalesce(got, 0) AS w FROM nodes n LEFT JOIN p{k} ON target = node)")
    return ",".join(out)


RANKED = with_(PACKAGES, _rank_sql(10))
QUERIES["pagerank"] = lambda spark, d: R.pagerank(D.packages(spark, d)).select("import_path", F.round("weight", 6).alias("weight"))
ORACLES["pagerank"] = RANKED + "SELECT node AS import_path, round(w, 6) AS weight FROM r10"
@query(RANKED + "SELECT node AS import_path, round(w, 6) AS weight FROM r10")
def pagerank_updated(spark, d):
    """Ranks of a graph that lacks a repository and some links, brought up to the whole graph by the difference."""
    p = stored(spark, d)
    touched = F.col("repository").isin("https://suppliers.example.net/n1", "https://parts.example.org/brand13")
    old = p.filter(touched & ~F.col("import_path").startswith("suppliers.")).withColumn("directs", F.slice("directs", 1, 1))
    state = RU.RankState(spark, _folder(spark, "ranks"))
    state.build(p.filter(~touched).unionByName(old))
    state.update(0, old, p.filter(touched), p)
    return state.weights().select("import_path", F.round("weight", 6).alias("weight"))


over_packages("pagerank_scaled", lambda p: R.scaled(R.pagerank(p)).select("import_path", "ranking"))
over_packages("rank_diff_rows", lambda p: R.rank_diff(p, R.scaled(R.pagerank(p))), often=True)  # at the default rounds and scale; a test holds it to within 1 of SQL
over_packages("rank_diff", lambda p: R.rank_diff(p, R.scaled(R.pagerank(p), 2)).agg(F.count("*").alias("updated"), F.count_if(F.col("old") != 0).alias("ranked_before")), often=True)
ORACLES["rank_diff"] = RANKED + "SELECT count(*) FILTER (floor(100 * w / (1 + (SELECT max(w) FROM r10))) <> 0) AS updated, 0::BIGINT AS ranked_before FROM r10 JOIN packages ON import_path = node"
over_packages("rank_apply", lambda p: M.apply_ranks(p, R.scaled(R.pagerank(p, 2), 2)).agg(F.count("*").alias("packages"), F.count_if(F.col("ranking") > 0).alias("ranked")), often=True)
ORACLES["rank_apply"] = with_(PACKAGES, _rank_sql(2)) + "SELECT count(*) AS packages, count(*) FILTER (floor(100 * w / (1 + (SELECT max(w) FROM r2))) > 0) AS ranked FROM packages JOIN r2 ON import_path = node"

CLOSURE = ", reach AS (SELECT import_path AS node FROM packages WHERE starts_with(import_path, 'orders.example.com/c1/') UNION SELECT target FROM reach JOIN edges ON source = node JOIN packages ON import_path = target)\n"
ROOTS = ["orders.example.com/c1/..."]
QUERIES["closure"] = lambda spark, d: C.closure(D.packages(spark, d), ROOTS)
ORACLES["closure"] = with_(PACKAGES, recursive=True) + CLOSURE + "SELECT node AS import_path FROM reach"
query(
    with_(PACKAGES, recursive=True)
    + """, reach(root, node) AS (SELECT repository, import_path FROM packages WHERE starts_with(repository, 'https://parts.') OR starts_with(repository, 'https://suppliers.')
    UNION SELECT r.root, e.target FROM reach r JOIN edges e ON e.source = r.node)
    SELECT root, node AS import_path FROM reach WHERE node IN (SELECT import_path FROM packages)""",
    "closure_of_repositories",
)(lambda spark, d: C.closures(p := stored(spark, d), p.filter("repository LIKE 'https://parts.%' OR repository LIKE 'https://suppliers.%'").select(F.col("repository").alias("root"), "import_path")))
QUERIES["closure_no_stdlib"] = lambda spark, d: C.closure(D.packages(spark, d), ROOTS, skip_stdlib=True)
ORACLES["closure_no_stdlib"] = with_(PACKAGES, recursive=True) + CLOSURE + "SELECT node AS import_path FROM reach JOIN packages ON import_path = node WHERE type <> 1"

# --- exports -------------------------------------------------------------------------------------
over_packages("csv_adjacency", lambda p: X.csv_adjacency(p, domain_only=True, skip_no_deps=True), "SELECT source AS import_path, source || ';' || string_agg(target, ';' ORDER BY pos) AS value FROM edges WHERE contains(split_part(source, '/', 1), '.') AND contains(split_part(target, '/', 1), '.') GROUP BY source")
over_packages(
    "csv_vocab", X.csv_vocabulary,
    ", f AS (SELECT path, min((r, n)) AS spot FROM (SELECT import_path AS r, 0 AS n, import_path AS path FROM packages UNION ALL SELECT source, pos + 1, target FROM edges) GROUP BY path) SELECT path, row_number() OVER (ORDER BY spot) AS id FROM f",
    often=True,
)
over_packages("csv_ids", X.csv_by_id, often=True)
ORACLES["csv_ids"] = with_(PACKAGES) + """, all_ AS (SELECT import_path AS r, 0 AS n, import_path AS path FROM packages UNION ALL SELECT source, pos + 1, target FROM edges),
f AS (SELECT path, min((r, n)) AS spot FROM all_ GROUP BY path), v AS (SELECT path, row_number() OVER (ORDER BY spot) AS id FROM f)
SELECT string_agg(id, ';' ORDER BY n) AS value FROM all_ JOIN v USING (path) GROUP BY r"""
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
over_packages(
    "rdf_quads", X.rdf_quads,
    f""", n AS (SELECT *, '_:p' || md5(import_path) AS s FROM packages)
    SELECT s AS subject, '<{RDF}>' AS predicate, '<dep:Package>' AS object FROM n
    UNION ALL SELECT s, '<dep:ranking>', '"0.0"^^<http://www.w3.org/2001/XMLSchema#double>' FROM n
    UNION ALL SELECT s, '<dep:import-path>', '"' || import_path || '"' FROM n
    UNION ALL SELECT '<' || repository || '>', '<{RDF}>', '<dep:Repo>' FROM n
    UNION ALL SELECT s, '<dep:defined-in>', '<' || repository || '>' FROM n
    UNION ALL SELECT '_:p' || md5(source), '<dep:imports>', '_:p' || md5(target) FROM edges""",
)
over_packages(
    "rdf_missing", X.rdf_missing,
    f""", m AS (SELECT DISTINCT '_:p' || md5(target) AS s FROM edges WHERE {NOT_THERE})
    SELECT s AS subject, '<{RDF}>' AS predicate, '<dep:Package>' AS object FROM m
    UNION ALL SELECT s, '<dep:is-missing>', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>' FROM m""",
)


#: Rows that are gathered into one written object, about, at most.
PART_ROWS = 10_000


def salted(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Adds part, a number by the key's hash: as many as the row's own group needs, so that no part has more than about PART_ROWS rows."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts"))
    return rows.join(sizes, group).withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts"))).drop("_parts")


def with_files(files: DataFrame) -> DataFrame:
    """Packages of the files; a package of many files is several rows, each with a part of them."""
    files = salted(files, ["import_path", "repository"], "repo_path").groupBy("import_path", "repository", "part").agg(F.array_sort(F.collect_list(F.struct("repo_path", F.unhex("digest").alias("digest")))).alias("source_files"))
    return files.select("import_path", F.lit("").alias("name"), "repository", F.array(F.regexp_extract("import_path", r"\A(.*)/", 1)).alias("directs"), "source_files", F.lit(2).alias("type"), F.lit(0.0).alias("ranking"))


@query(with_(FILES) + """, s AS (SELECT * FROM files) SELECT '_:f' || digest AS subject, p AS predicate, o AS object FROM (
  SELECT digest, unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<dep:digest>', '<dep:repo-path>']) AS p, unnest(['<dep:File>', '"' || digest || '"', '"' || repo_path || '"']) AS o FROM s)
  UNION ALL SELECT '_:p' || md5(import_path), '<dep:has-file>', '_:f' || digest FROM s""")
def rdf_files(spark, d):
    files = D.source_files(spark, d)  # each file as a row of its package; nothing is gathered
    rows = files.select("import_path", "repository", F.array().cast("array<string>").alias("directs"), F.lit(0.0).alias("ranking"), F.array(F.struct("repo_path", F.unhex("digest").alias("digest"))).alias("source_files"))
    return X.rdf_quads(rows).filter(F.col("subject").startswith("_:f") | (F.col("predicate") == X.HAS_FILE))


@query(with_(FILES) + "SELECT import_path, repository, regexp_extract(import_path, '^(.*)/', 1) AS directs, count(*)::INT AS files, 2 AS type FROM files GROUP BY import_path, repository")
def rows_json(spark, d):
    """Rows as JSON lines, several for a package of many files, written, read back and parsed; files are counted per package."""
    path = _folder(spark, "rows-json")
    X.rows_json(with_files(D.source_files(spark, d))).write.text(path)
    back = X.parse_rows_json(spark.read.text(path))
    back = back.groupBy("import_path", "repository", F.array_join("directs", " ").alias("directs"), "type").agg(F.sum(F.size("source_files")).cast("int").alias("files"))
    return back.select("import_path", "repository", "directs", "files", "type")


def _manifests(spark, d) -> str:
    """A folder with manifests of every repository, several for one of many packages, as JSON arrays over many lines with types by name."""
    path = _folder(spark, "manifests")
    package = F.struct(F.col("import_path").alias("importPath"), P.type_name(F.col("type")).alias("type"), F.col("directs").alias("imports"))
    p = D.packages(spark, d)
    repos = salted(p, ["repository"], "import_path").groupBy("repository", "part").agg(F.collect_list(package).alias("packages"))
    remotes = F.when(F.col("repository") != "", F.array(F.struct(F.lit("origin").alias("name"), F.col("repository").alias("url")))).otherwise(F.array())
    text = F.to_json(F.array(F.struct(remotes.alias("remotes"), "packages")), {"pretty": "true"})
    repos.select(text.alias("value")).write.text(path)
    return path


@query(with_(PACKAGES) + f"SELECT {FLAT} FROM packages")
def ingest_manifest(spark, d):
    """Manifests written and ingested, a file at a time."""
    return flat(IN.read_manifests(spark, _manifests(spark, d)))


@query(with_(PACKAGES) + f"SELECT {FLAT} FROM packages")
def ingest_manifest_split(spark, d):
    """Manifests written and ingested, each file cut into its values by many tasks."""
    return flat(IN.read_manifests(spark, _manifests(spark, d), split=True))


@query(with_(PACKAGES) + """SELECT import_path, CASE WHEN length(import_path) % 5 = 0 THEN 'main' ELSE 'lib' END AS name, repository, array_to_string(directs, ' ') AS directs,
  CASE WHEN length(import_path) % 5 = 0 THEN 3 ELSE 2 END AS type FROM packages WHERE starts_with(import_path, 'parts.')""")
def ingest_sources(spark, d):
    """Source files written for every part, with imports of what it depends on, and ingested."""
    return _ingested(D.packages(spark, d).filter(F.col("import_path").startswith("parts.")))


def _ingested(p: DataFrame) -> DataFrame:
    """Packages written as a source file each, and ingested."""
    text = F.concat(F.lit("package "), F.when(F.length("import_path") % 5 == 0, "main").otherwise("lib"), F.lit('\n\nimport (\n\t"'), F.array_join("directs", '"\n\t"'), F.lit('"\n)\n'))
    files = p.select(F.col("repository"), F.col("repository").alias("remote"), F.concat(P.base_name(F.col("import_path")), F.lit("/a.go")).alias("repo_path"), text.alias("content"))
    return IN.ingest_sources(files).select("import_path", "name", "repository", F.array_join("directs", " ").alias("directs"), "type")


@query(with_(PACKAGES) + """SELECT import_path, CASE WHEN length(import_path) % 5 = 0 THEN 'main' ELSE 'lib' END AS name, repository, array_to_string(directs, ' ') AS directs,
  CASE WHEN length(import_path) % 5 = 0 THEN 3 ELSE 2 END AS type FROM packages WHERE repository <> ''""")
def ingest_sources_all(spark, d):
    """Source files written for every package with a repository, and ingested."""
    return _ingested(D.packages(spark, d).filter("repository <> ''"))


LEXED = """SELECT CASE WHEN length(import_path) % 7 = 0 THEN 'labels.example.io/' || replace(import_path, '/', '-') WHEN starts_with(import_path, 'suppliers.') THEN 'alias.example.io/' || regexp_extract(import_path, '[^/]*$') ELSE import_path END AS import_path,
  CASE WHEN length(import_path) % 5 = 0 THEN 'main' ELSE 'lib' END AS name, repository, array_to_string(list_sort(list_distinct(list_append(directs, 'C'))), ' ') AS directs, CASE WHEN length(import_path) % 5 = 0 THEN 3 ELSE 2 END AS type
  FROM packages WHERE repository <> ''"""


@query(with_(PACKAGES) + LEXED)
def ingest_lexed(spark, d):
    """Two source files written for every package, with comments, strings, labels and declarations that look like imports, and ingested; suppliers have a prefix of their own."""
    p = D.packages(spark, d).filter("repository <> ''")
    name = F.when(F.length("import_path") % 5 == 0, "main").otherwise("lib")
    label = F.when(F.length("import_path") % 7 == 0, F.concat(F.lit(' // import "labels.example.io/'), F.replace("import_path", F.lit("/"), F.lit("-")), F.lit('"'))).otherwise(F.lit(" // a plain remark"))
    first = F.concat(
        F.lit('// Package notes: import "dead/line"\n/* import "dead/block"\n func */\npackage '), name, label,
        F.lit('\n\nimport "C"; import (\n\t// "old/name" (gone)\n\tx "'), F.array_join(F.slice("directs", 1, 2), '" /* ) */\n\t. "'), F.lit('"\n)\n\nvar s = `\nimport "in/string"\n`\n'),
    )
    second = F.concat(
        F.lit("package "), name, F.lit(";import (_`"), F.array_join("directs", "`;`"), F.lit('`)\nfunc f() string { return "import (\\"in/quotes\\")" }\nimport "after/all"\n'),
    )
    base = P.base_name(F.col("import_path"))
    files = p.select("repository", F.col("repository").alias("remote"), F.explode(F.array(F.struct(F.lit("/a.go").alias("file"), first.alias("content")), F.struct(F.lit("/b.go").alias("file"), second.alias("content")))).alias("f"), base.alias("dir"))
    files = files.select("repository", "remote", F.concat("dir", "f.file").alias("repo_path"), "f.content")
    prefixes = D.supplier_packages(spark, d).select("repository", F.lit("alias.example.io").alias("prefix")).distinct()
    return IN.ingest_sources(files, prefixes=prefixes).select("import_path", "name", "repository", F.array_join("directs", " ").alias("directs"), "type")


@query("SELECT c_name AS name FROM customer UNION ALL SELECT 'geo/nation1'")
def input_list(spark, d):
    path = _folder(spark, "lines")
    D.table(spark, d, "customer").select("c_name").write.text(path)
    return IN.read_lines(spark, path, ["geo/nation1"])


# --- table maintenance ---------------------------------------------------------------------------
CHANGED = "('https://suppliers.example.net/n1', 'https://parts.example.org/brand13')"


def _changed(p: DataFrame) -> DataFrame:
    """A batch that replaces half of two repositories' rows: without dependencies, ranked 7."""
    rows = p.filter(F.col("repository").isin("https://suppliers.example.net/n1", "https://parts.example.org/brand13") & (F.length("import_path") % 2 == 0))
    return rows.withColumn("directs", F.slice("directs", 1, 1)).withColumn("ranking", F.lit(7.0))


BATCH = f", batch AS (SELECT import_path, repository, directs[1:1] AS directs, type, 7.0::DOUBLE AS ranking FROM packages WHERE repository IN {CHANGED} AND length(import_path) % 2 = 0)\n"
over_packages("upsert", lambda p: flat(M.upsert(p, _changed(p))), BATCH + f"SELECT {FLAT} FROM (SELECT * FROM packages WHERE import_path NOT IN (SELECT import_path FROM batch) UNION ALL SELECT * FROM batch)")
over_packages("upsert_reset", lambda p: flat(M.upsert_reset(p, _changed(p))), BATCH + f"SELECT {FLAT} FROM (SELECT * FROM packages WHERE repository NOT IN (SELECT repository FROM batch) UNION ALL SELECT * FROM batch)")
over_packages("remove_packages", lambda p: M.remove_packages(p, S.all_nodes(p).filter(F.col("import_path").contains("1")))[0].select("import_path"), "SELECT import_path FROM packages WHERE NOT contains(import_path, '1')")


@query(with_(PACKAGES) + "SELECT import_path FROM packages WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 = 0 AND repository = 'https://orders.example.com/c' || c_custkey)")
def remove_repos(spark, d):
    p = D.packages(spark, d)
    key = F.col("c_custkey").cast("string")
    customers = D.table(spark, d, "customer")
    status = customers.select(F.concat(F.lit("https://orders.example.com/c"), key).alias("repository"), F.lit("").alias("tag"))
    urls = customers.filter("c_custkey % 3 = 0").select(F.concat(F.lit("git@orders.example.com:c"), key, F.lit(".git")).alias("url"))
    return M.remove_repositories(status, p, urls)[1].select("import_path")


# --- repository status ---------------------------------------------------------------------------
def over_observations(name: str, fn, sql: str | None = None) -> None:
    query(with_(OBSERVATIONS) + sql if sql else None, name)(lambda spark, d: plain_times(fn(D.observations(spark, d))))


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as in the tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def now():
    return F.lit(NOW).cast("timestamp")


def status_columns(s: DataFrame) -> DataFrame:
    n = F.size("updates")
    return s.select("repository", "tag", "ref_name", "digest", "error_count", "last_check", n.cast("long").alias("n_updates"), F.get("updates", F.lit(0))["when"].alias("first_update"), F.get("updates", n - 1)["when"].alias("last_update"))


STATUS_SQL = "SELECT s.*, coalesce(n_updates, 0) AS n_updates, first_update, last_update FROM status s LEFT JOIN spans USING (repository, tag)"
over_observations("status_history", ST.history, "SELECT * FROM changes WHERE n <= 20")
over_observations("status_errors", ST.consecutive_errors, "SELECT repository, tag, error_count FROM status")
over_observations("needs_update", ST.needs_update, "SELECT repository, tag, ts, seq, digest IS DISTINCT FROM prev_digest AS needs_update FROM good")
over_observations("status_fold", lambda o: status_columns(ST.fold(o)), STATUS_SQL)
over_observations("repo_status", lambda o: status_columns(ST.repository_status(ST.fold(o), "git@repos.example.com:u7.git")), STATUS_SQL + " WHERE repository = 'https://repos.example.com/u7'")
over_observations("prune_errors", lambda o: ST.prune(ST.fold(o), 2)[0].select("repository", "error_count"), "SELECT repository, error_count FROM status WHERE error_count < 2")
DUE = f"""SELECT repository, tag, CASE WHEN last_check IS NULL THEN true WHEN last_check + INTERVAL {MINIMUM} SECOND > TIMESTAMP '{NOW}' THEN false WHEN n_updates IS NULL THEN true
  ELSE epoch_us(last_check) + (epoch_us(last_update) - epoch_us(first_update)) // n_updates < epoch_us(TIMESTAMP '{NOW}') END AS due FROM status LEFT JOIN spans USING (repository, tag)"""
over_observations("due", lambda o: ST.due(ST.fold(o), now(), MINIMUM), DUE)
SHARE = "('0x' || substr(md5('{seed}:' || repository), 1, 13))::BIGINT / 4503599627370496.0"
PLAN = f", d AS ({DUE}), p AS (SELECT s.repository, s.tag, s.ref_name, due, {SHARE.format(seed=3)} < 0.5 AS chosen FROM status s JOIN d USING (repository, tag))"
over_observations("scan_plan", lambda o: ST.scan_plan(ST.fold(o), now(), MINIMUM, 0.5, 3), PLAN + " SELECT repository, tag, ref_name FROM p WHERE due AND chosen")
over_observations("sample_due", lambda o: ST.sample(ST.due(ST.fold(o), now(), MINIMUM), "repository", 0.3, 1), f", d AS ({DUE}) SELECT * FROM d WHERE {SHARE.format(seed=1)} < 0.3")


@query(
    with_(PACKAGES, OBSERVATIONS)
    + PLAN
    + """, fresh AS (SELECT repository, max(ts) AS changed_ts FROM good WHERE digest IS DISTINCT FROM prev_digest GROUP BY repository),
    u AS (SELECT repository FROM p JOIN fresh USING (repository) JOIN last_ok USING (repository, tag) WHERE due AND chosen AND changed_ts = last_check)
    SELECT (SELECT count(*) FROM p) AS scanned, (SELECT count(*) - count(DISTINCT repository) FROM p) AS duplicates, (SELECT count(*) FROM p WHERE due) AS due,
    (SELECT count(*) FROM p WHERE due AND chosen) AS samples, (SELECT count(*) FROM u) AS updates,
    (SELECT count(*) FROM packages WHERE replace(repository, 'orders.example.com/c', 'repos.example.com/u') IN (SELECT repository FROM u)) AS packages"""
)
def scan_summary(spark, d):
    """A scan's report: its checks are the last ones observed, its packages the customers' orders."""
    o = D.observations(spark, d)
    last = ST.needs_update(o).groupBy("repository").agg(F.max_by("needs_update", F.struct("ts", "seq")).alias("needs_update"))
    owned = D.packages(spark, d).select(F.replace("repository", F.lit("orders.example.com/c"), F.lit("repos.example.com/u")).alias("repository"))
    return ST.scan_summary(ST.fold(o), now(), MINIMUM, 0.5, 3, last, owned)


@query(
    """WITH refs AS (SELECT 'https://repos.example.com/u' || user_id || '/' || strftime(ts, '%Y-%m-%d') AS repository, event_id, json_extract_string(props, '$.k') AS digest,
    CASE event_type WHEN 'view' THEN 'refs/heads/master' WHEN 'click' THEN 'refs/heads/dev' WHEN 'signup' THEN 'HEAD' WHEN 'purchase' THEN 'refs/tags/v1' ELSE NULL END AS ref FROM events),
    placed AS (SELECT *, CASE ref WHEN 'refs/heads/master' THEN 0 WHEN 'HEAD' THEN 2 ELSE 1 END AS rank, CASE ref WHEN 'HEAD' THEN -event_id ELSE event_id END AS spot FROM refs WHERE ref IS NOT NULL)
    SELECT r.repository, b.ref, b.digest FROM (SELECT DISTINCT repository FROM refs) r LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY rank, spot) AS n FROM placed) b ON b.repository = r.repository AND n = 1"""
)
def best_head(spark, d):
    return ST.best_heads(D.remote_refs(spark, d))


@query(with_(OBSERVATIONS) + STATUS_SQL)
def status_stream(spark, d):
    """The fold over five deliveries of the observations, each written by many tasks and streamed when it is there."""
    root = _folder(spark, "status")
    rows = D.observations(spark, d).select("repository", "tag", "ref", "digest", "failed", "ts", "seq")
    cuts = rows.select(F.percentile_approx(F.unix_micros("ts"), [0.2, 0.4, 0.6, 0.8]).alias("q")).first()["q"]
    bounds = [None, *cuts, None]
    for k in range(5):
        part = rows
        if bounds[k] is not None:
            part = part.filter(F.unix_micros("ts") > bounds[k])
        if bounds[k + 1] is not None:
            part = part.filter(F.unix_micros("ts") <= bounds[k + 1])
        part.write.mode("append").parquet(f"{root}/in")
        status = SS.run_status_stream(spark, f"{root}/in", Snapshots(spark, f"{root}/table"), f"{root}/checkpoint", 1_000_000)
    return plain_times(status_columns(status))


def _deliveries(rows: DataFrame, parts: int) -> list[DataFrame]:
    """The rows in so many parts of about the same size, in order of time."""
    cuts = rows.select(F.percentile_approx(F.unix_micros("ts"), [k / parts for k in range(1, parts)]).alias("q")).first()["q"] or []
    at, bounds = F.unix_micros("ts"), [None, *cuts, None]
    both = lambda lo, hi: (F.lit(True) if lo is None else at > lo) & (F.lit(True) if hi is None else at <= hi)
    return [rows.filter(both(lo, hi)) for lo, hi in zip(bounds, bounds[1:], strict=False)]


@query(with_(OBSERVATIONS) + STATUS_SQL)
def status_keyed(spark, d):
    """The fold as keyed streaming state over three deliveries; the table is read from the state."""
    root = _folder(spark, "keyed")
    rows = D.observations(spark, d).select("repository", "tag", "ref", "digest", "failed", "ts", "seq")
    for part in _deliveries(rows, 3):
        part.write.mode("append").parquet(f"{root}/in")
        KS.run_keyed_status(spark, f"{root}/in", root, files_per_batch=1_000_000)
    return plain_times(status_columns(KS.keyed_status(spark, root)))


@query(with_(OBSERVATIONS) + PLAN + " SELECT repository, tag, ref_name FROM p WHERE due AND chosen")
def due_stream(spark, d):
    """The work list as timers emit it: two deliveries of the observations, then the clock moves to the time of the scan."""
    root = _folder(spark, "timers")
    rule = KS.ScanRule(MINIMUM, 0.5, 3)
    for part in _deliveries(D.observations(spark, d).select("repository", "tag", "ref", "digest", "failed", "ts", "seq"), 2):
        part.write.mode("append").parquet(f"{root}/in")
        KS.run_keyed_status(spark, f"{root}/in", root, rule, files_per_batch=1_000_000)
    KS.tick(spark, f"{root}/in", datetime.fromisoformat(NOW))
    KS.run_keyed_status(spark, f"{root}/in", root, rule, files_per_batch=1_000_000)
    return KS.due_changes(spark, root).filter(F.col("at") == now()).select("repository", "tag", "ref_name")


@query()
def crawl_batch(spark, d):
    """A crawl round: customers' repositories checked by the events, reloaded without their suppliers."""
    p = stored(spark, d)
    checks = D.observations(spark, d).withColumn("repository", F.replace("repository", F.lit("https://repos.example.com/u"), F.lit("https://orders.example.com/c")))
    fresh = p.withColumn("directs", F.filter("directs", lambda t: ~t.startswith("suppliers.")))
    return SS.crawl_batch(p, checks, fresh, 3).select("import_path", "repository", F.size("directs").alias("links"), "ranking")


def _customer_checks(spark, d) -> DataFrame:
    """Observations of the customers' repositories."""
    o = D.observations(spark, d).select("repository", "tag", "ref", "digest", "failed", "ts", "seq")
    return o.withColumn("repository", F.replace("repository", F.lit("https://repos.example.com/u"), F.lit("https://orders.example.com/c")))


@query(
    with_(PACKAGES, OBSERVATIONS)
    + """SELECT import_path, repository, len(CASE WHEN replace(repository, 'orders.example.com/c', 'repos.example.com/u') IN (SELECT repository FROM good)
    THEN list_filter(directs, lambda t: NOT starts_with(t, 'suppliers.')) ELSE directs END)::INT AS links FROM packages"""
)
def crawl_stream(spark, d):
    """A crawl as a stream over two deliveries of checks: customers with a successful check are reloaded without their suppliers."""
    root, p = _folder(spark, "crawl"), stored(spark, d)
    checks, fresh = _customer_checks(spark, d), p.withColumn("directs", F.filter("directs", lambda t: ~t.startswith("suppliers.")))
    packages, status = Snapshots(spark, f"{root}/packages"), Snapshots(spark, f"{root}/status")
    packages.publish(p, "import_path")
    middle = checks.select(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0] or 0
    for part in (F.unix_micros("ts") <= middle, F.unix_micros("ts") > middle):
        checks.filter(part).write.mode("append").parquet(f"{root}/in")
        out = SS.run_crawl_stream(spark, f"{root}/in", status, packages, fresh, f"{root}/checkpoint", files_per_batch=1_000_000)
    return out.select("import_path", "repository", F.size("directs").alias("links"))


def _keyed_crawl(spark, d, indexed: bool) -> tuple[B.Buckets, RI.ReverseIndex | None]:
    """The crawl as keyed state over two deliveries; its package table, and its index where one is asked for."""
    root, p = _folder(spark, "keyed-crawl"), stored(spark, d)
    fresh = p.withColumn("directs", F.filter("directs", lambda t: ~t.startswith("suppliers.")))
    packages, index = B.Buckets(spark, f"{root}/packages", 16), RI.ReverseIndex(spark, f"{root}/index") if indexed else None
    packages.create(p)
    if index is not None:
        index.build(packages.read())
    for part in _deliveries(_customer_checks(spark, d), 2):
        part.write.mode("append").parquet(f"{root}/in")
        KS.run_keyed_crawl(spark, f"{root}/in", root, packages, fresh, index, files_per_batch=1_000_000)
    return packages, index


RELOADED = """SELECT import_path, repository, CASE WHEN replace(repository, 'orders.example.com/c', 'repos.example.com/u') IN (SELECT repository FROM good)
    THEN list_filter(directs, lambda t: NOT starts_with(t, 'suppliers.')) ELSE directs END AS directs FROM packages"""


@query(with_(PACKAGES, OBSERVATIONS) + f"SELECT import_path, repository, array_to_string(directs, ' ') AS directs FROM ({RELOADED})")
def crawl_keyed(spark, d):
    """Keyed state, one fold for each batch, and a package table of which a batch rewrites the buckets it touches."""
    packages, _ = _keyed_crawl(spark, d, indexed=False)
    return packages.read().select("import_path", "repository", F.array_join("directs", " ").alias("directs"))


@query(with_(PACKAGES, OBSERVATIONS) + f"SELECT target, source FROM (SELECT import_path AS source, unnest(directs) AS target FROM ({RELOADED})) WHERE starts_with(target, 'suppliers.example.net/') OR target = 'parts.example.org/brand1/p1' OR starts_with(target, 'parts.example.org/brand1/')")
def reverse_indexed(spark, d):
    """Reverse dependencies from the index that the crawl has kept up."""
    _, index = _keyed_crawl(spark, d, indexed=True)
    return index.reverse(["suppliers.example.net/...", "parts.example.org/brand1/..."])


@query(with_(PACKAGES) + f"SELECT {FLAT} FROM packages WHERE starts_with(import_path, 'orders.example.com/c1/') OR import_path = 'orders.example.com/c1'")
def match_snapshot(spark, d):
    """The prefix match on a published table that is sorted by key: the pattern reaches the files."""
    store = Snapshots(spark, _folder(spark, "snapshot"))
    store.publish(D.packages(spark, d), "import_path")
    return flat(MA.match(store.current(), "orders.example.com/c1/..."))


# --- scalar functions and resolution -------------------------------------------------------------
URLS = """urls AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'git@' || host || ':' || path || '.git' WHEN 2 THEN 'ssh://git@' || host || '/' || path ELSE host || '/' || path || '.git.git' END AS raw
  FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages)),
b AS (SELECT page_id, raw, regexp_replace(raw, '^.*?://', '') AS bare FROM urls),
c AS (SELECT page_id, raw, regexp_replace(CASE WHEN starts_with(bare, 'git@') THEN regexp_replace(bare[5:], '^([^:]*):', '\\1/') ELSE bare END, '\\.git$', '') AS clean FROM b)
"""


def repository_urls(spark, d) -> DataFrame:
    pages = D.table(spark, d, "pages")
    host, path = F.regexp_extract("url", r"://([^/?#]*)", 1), F.regexp_extract("url", r"://[^/?#]*/([^?#]*)", 1)
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("git@"), host, F.lit(":"), path, F.lit(".git")))
    raw = raw.when(k == 2, F.concat(F.lit("ssh://git@"), host, F.lit("/"), path)).otherwise(F.concat(host, F.lit("/"), path, F.lit(".git.git")))
    return pages.select("page_id", raw.alias("raw"))


@query(with_(URLS) + "SELECT page_id, raw, clean FROM c")
def clean_url(spark, d):
    return repository_urls(spark, d).withColumn("clean", P.clean_repo_url(F.col("raw")))


@query(with_(URLS) + "SELECT page_id, 'https://' || clean AS fixed FROM c")
def fix_url(spark, d):
    return repository_urls(spark, d).select("page_id", P.fix_repo_url(F.col("raw")).alias("fixed"))


over_packages("domain_of", lambda p: S.all_nodes(p).select("import_path", P.domain(F.col("import_path")).alias("domain"), P.has_domain(F.col("import_path")).alias("has_domain")),
              "SELECT node AS import_path, split_part(node, '/', 1) AS domain, contains(split_part(node, '/', 1), '.') AS has_domain FROM (SELECT import_path AS node FROM packages UNION SELECT target FROM edges)")
over_packages("is_local", lambda p: S.all_nodes(p).select("import_path", P.is_local_package(F.col("import_path")).alias("local")),
              "SELECT node AS import_path, NOT contains(split_part(node, '/', 1), '.') AS local FROM (SELECT import_path AS node FROM packages UNION SELECT target FROM edges)")

HOSTED = """hosted AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'github.com/u' || p_size || '/r' || p_partkey || '/sub' WHEN 1 THEN 'bitbucket.org/u' || p_size || '/r' || p_partkey WHEN 2 THEN 'gopkg.in/r' || p_partkey || '.v2'
  WHEN 3 THEN 'gopkg.in/u' || p_size || '/r' || p_partkey || '.v3/sub' WHEN 4 THEN 'github.com/u' || p_size ELSE 'parts.example.org/x' || p_partkey END AS import_path FROM part),
res AS (SELECT DISTINCT import_path,
  CASE WHEN split_part(import_path, '/', 1) IN ('github.com', 'bitbucket.org') AND len(string_split(import_path, '/')) >= 3 THEN 'https://' || array_to_string(string_split(import_path, '/')[1:3], '/')
       WHEN starts_with(import_path, 'gopkg.in/r') THEN 'https://github.com/go-' || regexp_extract(import_path, '/(r[0-9]+)', 1) || '/' || regexp_extract(import_path, '/(r[0-9]+)', 1)
       WHEN starts_with(import_path, 'gopkg.in/u') THEN 'https://github.com/' || split_part(import_path, '/', 2) || '/' || regexp_extract(import_path, '/(r[0-9]+)', 1) END AS repository,
  CASE WHEN split_part(import_path, '/', 1) IN ('github.com', 'bitbucket.org') AND len(string_split(import_path, '/')) >= 3 THEN array_to_string(string_split(import_path, '/')[1:3], '/')
       WHEN starts_with(import_path, 'gopkg.in/r') THEN import_path WHEN starts_with(import_path, 'gopkg.in/u') THEN array_to_string(string_split(import_path, '/')[1:3], '/') END AS prefix
  FROM hosted)
"""


def hosted_paths(spark, d) -> DataFrame:
    """Import paths on known hosts, one per part."""
    part = D.table(spark, d, "part")
    k, size, m = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 6
    user, name = F.concat(F.lit("/u"), size), F.concat(F.lit("/r"), k)
    path = (
        F.when(m == 0, F.concat(F.lit("github.com"), user, name, F.lit("/sub"))).when(m == 1, F.concat(F.lit("bitbucket.org"), user, name))
        .when(m == 2, F.concat(F.lit("gopkg.in"), name, F.lit(".v2"))).when(m == 3, F.concat(F.lit("gopkg.in"), user, name, F.lit(".v3/sub")))
        .when(m == 4, F.concat(F.lit("github.com"), user)).otherwise(F.concat(F.lit("parts.example.org/x"), k))
    )
    return part.select(path.alias("import_path")).distinct()


@query(with_(HOSTED) + "SELECT import_path, repository, prefix, NULL::VARCHAR AS error FROM res")
def resolve(spark, d):
    return RE.resolve(hosted_paths(spark, d))


@query(with_(HOSTED) + "SELECT repository, min(prefix) AS prefix FROM res WHERE repository IS NOT NULL GROUP BY repository")
def resolve_dedupe(spark, d):
    return RE.resolve_distinct(hosted_paths(spark, d))


@query(with_(HOSTED) + "SELECT repository, min(prefix) AS prefix FROM res WHERE repository IS NOT NULL AND NOT contains(repository, 'github.com/go-') GROUP BY repository")
def resolve_unknown(spark, d):
    found = RE.resolve_distinct(hosted_paths(spark, d))
    return RE.resolve_unknown(found, found.filter(F.col("repository").contains("github.com/go-")))


@query(with_(HOSTED) + "SELECT repository, min(prefix) AS prefix FROM res WHERE repository IS NOT NULL AND starts_with(repository, 'https://github.com/') GROUP BY repository")
def crawl_frontier(spark, d):
    """Packages that import the hosted paths, none of which has a row; bitbucket's repositories are known."""
    hosted = hosted_paths(spark, d)
    p = hosted.select(F.concat(F.lit("parts.example.org/y"), F.crc32(F.col("import_path").cast("binary")).cast("string")).alias("import_path"), F.array("import_path").alias("directs"))
    known = RE.resolve_distinct(hosted).filter(F.col("repository").startswith("https://bitbucket.org/"))
    return RE.crawl_frontier(p, known)


@query(
    """SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS import_path, CASE WHEN page_id % 7 <> 3 THEN 'https://' || regexp_extract(url, '://([^/?#]*)', 1) END AS repository,
    CASE WHEN page_id % 7 <> 3 THEN regexp_extract(url, '://([^/?#]*)', 1) END AS prefix, CASE WHEN page_id % 7 = 3 THEN 'status' END AS error FROM pages"""
)
def resolve_pages(spark, d):
    return RE.resolve_pages(D.fetched_pages(spark, d))


LABELLED = [f"orders.example.com/c{i}" for i in range(1, 60, 2)] + ["parts.example.org", "parts.example.org/brand1", "geo"]


@query(with_(PACKAGES) + f""", l AS (SELECT unnest({LABELLED!r}) AS anchor), p AS (SELECT DISTINCT import_path AS path FROM packages),
    hits AS (SELECT path, arg_max(anchor, length(anchor)) AS anchor FROM p JOIN l ON path = anchor OR starts_with(path, anchor || '/') GROUP BY path)
    SELECT path, 'label:' || anchor AS label, anchor FROM p LEFT JOIN hits USING (path)""")
def nearest_label_sorted(spark, d):
    """Labels on several levels, found by one sort of paths and labels."""
    labels = spark.createDataFrame([(x, f"label:{x}") for x in LABELLED], "path string, label string")
    return RE.nearest_label_sorted(D.packages(spark, d).select(F.col("import_path").alias("path")), labels)


over_packages(
    "nearest_label",
    lambda p: RE.nearest_label(p.select(F.col("import_path").alias("path")), p.select(F.regexp_extract("import_path", r"\A(.*)/", 1).alias("path")).distinct().filter("path rlike '[02468]$'").withColumn("label", F.concat(F.lit("label:"), "path"))),
    """SELECT import_path AS path, CASE WHEN regexp_matches(up, '[02468]$') THEN 'label:' || up END AS label, CASE WHEN regexp_matches(up, '[02468]$') THEN up END AS anchor
    FROM (SELECT import_path, regexp_extract(import_path, '^(.*)/', 1) AS up FROM packages)""",
)
