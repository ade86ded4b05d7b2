"""JSON rows, adjacency lists, vocabularies and RDF quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import has_domain, type_name, type_number
from ..operators.stats import missing
from .order import numbered
from .scratch import Rounds
from .schema import FILE

#: RDF vocabulary (fixed values).
TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
PACKAGE, REPO, FILE_TYPE = "<dep:Package>", "<dep:Repo>", "<dep:File>"
DEFINED_IN, DIGEST, HAS_FILE, IMPORTS = "<dep:defined-in>", "<dep:digest>", "<dep:has-file>", "<dep:imports>"
RANKING, REPO_PATH, IMPORT_PATH, MISSING = "<dep:ranking>", "<dep:repo-path>", "<dep:import-path>", "<dep:is-missing>"
XSD = "http://www.w3.org/2001/XMLSchema#"


def row_struct(packages: DataFrame, path: str = "import_path") -> Column:
    """A row as it is written in JSON: zero values left out, bytes in base64, the type by name.  Absent columns are left out."""
    have = set(packages.columns)
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    out = [text("name").alias("name")] if "name" in have else []
    out += [text(path).alias("importPath"), text("repository").alias("repository"), F.when(F.size("directs") > 0, F.col("directs")).alias("directs")]
    if "source_files" in have:
        files = F.transform("source_files", lambda f: F.struct(F.nullif(f["repo_path"], F.lit("")).alias("repoPath"), F.base64(f["digest"]).alias("digest")))
        out.append(F.when(F.size("source_files") > 0, files).alias("sourceFiles"))
    return F.struct(*out, type_name(F.col("type")).alias("type"), F.nullif(F.col("ranking"), F.lit(0.0)).alias("ranking"))


def rows_json(packages: DataFrame) -> DataFrame:
    """(value): a JSON object per row."""
    return packages.select(F.to_json(row_struct(packages)).alias("value"))


JSON_ROW = (
    "name string, importPath string, repository string, directs array<string>, "
    "sourceFiles array<struct<repoPath: string, digest: string>>, type string, ranking double"
)


def parse_rows_json(lines: DataFrame) -> DataFrame:
    """Package rows from ``rows_json`` text."""
    r = F.from_json("value", JSON_ROW)
    files = F.transform(F.coalesce(F.col("r.sourceFiles"), F.array()), lambda f: F.struct(F.coalesce(f["repoPath"], F.lit("")).alias("repo_path"), F.unbase64(f["digest"]).alias("digest")))
    return lines.select(r.alias("r")).select(
        F.coalesce("r.importPath", F.lit("")).alias("import_path"), F.coalesce("r.name", F.lit("")).alias("name"), F.coalesce("r.repository", F.lit("")).alias("repository"),
        F.coalesce("r.directs", F.array().cast("array<string>")).alias("directs"), files.cast(f"array<{FILE}>").alias("source_files"), type_number(F.col("r.type")).alias("type"), F.coalesce("r.ranking", F.lit(0.0)).alias("ranking"),
    )


def _quoted(field: Column) -> Column:
    special = field.rlike(r'[;"\r\n]') | field.rlike(r"\A\s") | (field == r"\.")
    return F.when(special, F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def csv_adjacency(packages: DataFrame, domain_only: bool = False, skip_no_deps: bool = False) -> DataFrame:
    """(import_path, value): a line per package, itself and then its directs."""
    directs, rows = F.col("directs"), packages
    if domain_only:
        rows, directs = rows.filter(has_domain(F.col("import_path"))), F.filter("directs", has_domain)
    record = F.concat(F.array("import_path"), directs)
    if skip_no_deps:
        rows = rows.filter(F.size(record) > 1)
    return rows.select("import_path", F.array_join(F.transform(record, _quoted), ";").alias("value"))


def _places(packages: DataFrame, rounds: Rounds) -> DataFrame:
    """(row, place, path): the paths of all records; rows are numbered in key order, places in the order of rows and then in the record."""
    width = packages.agg(F.coalesce(F.max(F.size("directs")), F.lit(0)).cast("long") + 1).first()[0]
    rows = numbered(packages.select("import_path", "directs"), "import_path", rounds, ties=True)
    places = rows.select(F.col("n").alias("row"), F.posexplode(F.concat(F.array("import_path"), "directs")).alias("pos", "path"))
    return places.select("row", (F.col("row") * F.lit(width).cast("long") + F.col("pos")).alias("place"), "path")


def _vocabulary(places: DataFrame, rounds: Rounds) -> DataFrame:
    first = numbered(places.groupBy("path").agg(F.min("place").alias("place")), "place", rounds)
    return first.select("path", (F.col("n") + 1).alias("id"))


def _by_id(places: DataFrame, vocabulary: DataFrame) -> DataFrame:
    # a digest beside the path: most paths begin alike, and rows are sorted by what begins their keys
    digest = F.xxhash64("path")
    ids = places.withColumn("digest", digest).join(vocabulary.withColumn("digest", digest), ["digest", "path"]).select("row", "place", "id")
    ids = ids.repartition("row").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("ids"))
    return ids.select(F.array_join(F.transform("ids", lambda x: x["id"].cast("string")), ";").alias("value"))


def csv_vocabulary(packages: DataFrame) -> DataFrame:
    """(path, id): ids from 1 by first appearance in key order, then in the record.  The table is read several times."""
    rounds = Rounds(packages.sparkSession, "vocabulary")
    return _vocabulary(_places(packages, rounds), rounds)


def csv_by_id(packages: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(value): the adjacency lists in ids, by default those of the packages' own vocabulary.

    Rows are sorted by key once and go by their numbers from there; paths meet the vocabulary in one join.
    """
    rounds = Rounds(packages.sparkSession, "ids")
    places = _places(packages, rounds)
    return _by_id(places, _vocabulary(places, rounds) if vocabulary is None else vocabulary)


def _node(path: Column) -> Column:
    """A blank node named by a digest of the path, so that every task names it alike."""
    return F.concat(F.lit("_:p"), F.md5(path.cast("binary")))


def _text(value: Column) -> Column:
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))


def _iri(url: Column) -> Column:
    return F.concat(F.lit("<"), url, F.lit(">"))


def rdf_quads(packages: DataFrame) -> DataFrame:
    """(subject, predicate, object) of every row: its type, ranking, path, repository, imports and files."""
    p = _node(F.col("import_path"))
    triple = lambda s, name, o: F.struct(s.alias("subject"), F.lit(name).alias("predicate"), o.alias("object"))
    ranking = F.concat(F.lit('"'), F.col("ranking").cast("string"), F.lit(f'"^^<{XSD}double>'))
    own = F.array(
        triple(p, TYPE, F.lit(PACKAGE)), triple(p, RANKING, ranking), triple(p, IMPORT_PATH, _text(F.col("import_path"))),
        triple(_iri(F.col("repository")), TYPE, F.lit(REPO)), triple(p, DEFINED_IN, _iri(F.col("repository"))),
    )
    imports = F.transform("directs", lambda t: triple(p, IMPORTS, _node(t)))
    quads = F.concat(own, imports)
    if "source_files" in packages.columns:
        def about(f):
            name, digest = F.concat(F.lit("_:f"), F.lower(F.hex(f["digest"]))), F.lower(F.hex(f["digest"]))
            return F.array(triple(name, TYPE, F.lit(FILE_TYPE)), triple(name, DIGEST, _text(digest)), triple(name, REPO_PATH, _text(f["repo_path"])), triple(p, HAS_FILE, name))

        quads = F.concat(quads, F.flatten(F.transform(F.coalesce("source_files", F.array().cast(f"array<{FILE}>")), about)))
    return packages.select(F.inline(quads))


def rdf_missing(packages: DataFrame) -> DataFrame:
    """(subject, predicate, object) that mark the targets without a row."""
    p = _node(F.col("import_path"))
    gone = F.array(
        F.struct(p.alias("subject"), F.lit(TYPE).alias("predicate"), F.lit(PACKAGE).alias("object")),
        F.struct(p.alias("subject"), F.lit(MISSING).alias("predicate"), F.lit(f'"true"^^<{XSD}boolean>').alias("object")),
    )
    return missing(packages).select(F.inline(gone))


def nquads(quads: DataFrame) -> DataFrame:
    """(value): N-Quads lines, to be written as text."""
    return quads.select(F.concat_ws(" ", "subject", "predicate", "object", F.lit(".")).alias("value"))


def edges_json(edges: DataFrame, rows: bool = False) -> DataFrame:
    """(value): an edge per line, with the importing row in place of its path if ``rows`` (edges of ``reverse(complete=True)``)."""
    if rows:
        return edges.select(F.to_json(F.struct("target", row_struct(edges, "source").alias("row"))).alias("value"))
    return edges.select(F.to_json(F.struct("target", "source")).alias("value"))
