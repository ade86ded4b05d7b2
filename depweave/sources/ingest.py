"""Package rows from manifests, source files and line lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, clean_repo_url, content_digest, has_domain, host_path, package_type, trim_prefix, type_number
from .joins import BROADCAST_ROWS, to_join
from .schema import MANIFEST
from .scratch import Rounds

#: Directories that never hold packages, and files that are not part of one.
IGNORED_DIRECTORY = r"(^|/)(testdata|vendor|\.[^/]*|_[^/]*)(/|$)"
IGNORED_FILE = r"(^|/)([._][^/]*|[^/]*_test\.go)$"


#: Where one JSON value ends and the next begins: never inside a value, since elements are parted by commas.
BETWEEN_VALUES = r"(?<=[\]}])\s*\n(?=\s*[\[{])"


#: An escaped character of JSON; a string, or what begins one; what may stand before a value of a file.
_ESCAPE, _STRING, _BEFORE = r"\\.", r'"[^"]*("|\z)', r"^(?:[\s\[\]]*|\s*,\s*)$"


def split_values(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the objects of JSON files, elements of arrays or values one after the other, each as its text.

    Files are read in pieces that end with a closing brace, by as many tasks as their size asks for.  Prefix sums over a
    file's pieces (within each block of the file, and over one row per block) tell whether a piece begins inside a
    string, by the number of quotes before it, and how many braces are open there; where none is open after a piece, a
    value ends.  These sums need numbers of a piece only; they give for each block its first end of a value.  What stands
    before that goes with the block in which the value began, so that texts move once: values lie together, and
    nothing is open where such a run of pieces begins.  No task holds more than a block of a file, or one value.
    What stands between values must be white space, brackets or one comma, all brackets and quotes must be
    closed at the end of a file; else reading is an error.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value",
        F.col("_metadata.file_size").alias("size"),
    )
    bare = F.regexp_replace("value", _ESCAPE, "")
    number = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    pieces = pieces.withColumn("bare", bare).select(
        "file", "block", "at", "value", "size", F.octet_length("value").alias("bytes"), number("bare", '"').alias("quotes"), number("bare", "{").alias("inside"),
        number(F.regexp_replace("bare", _STRING, ""), "{").alias("outside"),  # of the braces, where the piece begins outside of strings; the others count where not
        F.regexp_extract("value", r"^[^{]*", 0).alias("lead"),
    )
    pieces = pieces.withColumns({"inside": F.col("inside") - F.col("outside"), "brackets": number("lead", "[") - number("lead", "]")}).drop("lead")
    # a table, since numbers of pieces must be the same in all that follows
    rounds = Rounds(spark, "json-pieces")
    pieces = rounds.write(pieces, keep=True)
    slim = pieces.drop("value")

    def before(rows: DataFrame, column: Column, *within: str) -> Column:
        return F.coalesce(F.sum(column).over(Window.partitionBy("file", *within).orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def traced(rows: DataFrame, within: str, odd: Column, depth: Column) -> DataFrame:
        """Adds opened, depth and ended of each piece, from the quotes and braces before the first one of each ``within``."""
        rows = rows.withColumn("opened", (before(rows, F.col("quotes"), within) + odd) % 2 == 1)
        closed = F.col("opened") == (F.col("quotes") % 2 == 1)
        # the brace that ended the piece counts unless it was in a string
        rows = rows.withColumns({"braces": F.when(F.col("opened"), F.col("inside")).otherwise(F.col("outside")) - (closed & ~F.col("final")).cast("int"), "closed": closed})
        rows = rows.withColumn("depth", before(rows, F.col("braces"), within) + depth)
        return rows.withColumn("ended", F.col("closed") & ~F.col("final") & (F.col("depth") + F.col("braces") == 0))

    # braces of a block for either beginning; the last piece's count nowhere, so that it may lack its brace here
    own = slim.withColumn("odd", before(slim, F.col("quotes"), "block") % 2 == 1)
    ends_closed = F.col("odd") == (F.col("quotes") % 2 == 1)
    blocks = own.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.max("at").alias("last"), F.max("size").alias("size"), F.sum(F.col("bytes").cast("long") + 1).alias("braced"),
        F.sum(F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside")) - ends_closed.cast("int")).alias("even_braces"),
        F.sum(F.when(F.col("odd"), F.col("outside")).otherwise(F.col("inside")) - (~ends_closed).cast("int")).alias("odd_braces"),
    )
    order = Window.partitionBy("file").orderBy("block")  # a row per block
    ahead, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    blocks = blocks.withColumn("odd", F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2)
    blocks = blocks.withColumn("start", F.coalesce(F.sum(F.when(F.col("odd") == 1, F.col("odd_braces")).otherwise(F.col("even_braces"))).over(ahead), F.lit(0)))
    # a file's last piece has no brace unless the bytes of all pieces and a brace for each are the whole file
    last = F.when((F.sum("braced").over(whole) > F.col("size")) & (F.col("block") == F.max("block").over(whole)), F.col("last"))
    blocks = rounds.write(blocks.select("file", "block", "odd", "start", last.alias("last")), keep=True)

    final = F.coalesce(F.col("at") == F.col("last"), F.lit(False))
    ends = traced(slim.join(blocks, ["file", "block"]).withColumn("final", final), "block", F.col("odd"), F.col("start"))
    ends = ends.groupBy("file", "block").agg(F.min(F.when(F.col("ended"), F.col("at"))).alias("first"), F.sum(F.when(F.col("depth") == 0, F.col("brackets")).otherwise(0)).alias("open"), F.max("last").alias("last"))
    # where a block's first value began: the last block before that has an end, else the file's first
    began = F.coalesce(F.max(F.when(F.col("first").isNotNull(), F.col("block"))).over(ahead), F.min("block").over(whole))
    ends = rounds.write(ends.select("file", "block", "first", "last", began.alias("began"), F.sum("open").over(whole).alias("open")), keep=True)

    texts = pieces.select("file", "block", "at", "value", "quotes", "inside", "outside").join(F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends, ["file", "block"])
    texts = texts.withColumns({"home": F.when(F.col("at") > F.col("first"), F.col("block")).otherwise(F.col("began")), "final": final})
    texts = texts.select("file", "home", "block", "at", "value", "quotes", "inside", "outside", "final", "open").repartition("file", "home")
    texts = traced(texts, "home", F.lit(0), F.lit(0)).select("file", "home", "block", "at", "value", "final", "open", "ended")
    texts = texts.withColumn("number", before(texts, F.col("ended").cast("int"), "home"))
    text = F.concat("value", F.when(F.col("final"), F.lit("")).otherwise(F.lit("}")))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", text.alias("text"))))
    values = texts.groupBy("file", "home", "number").agg(parts.alias("parts"), F.max("ended").alias("whole"), F.max("open").alias("open"))
    values = values.select("file", "whole", "open", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))
    rest = F.regexp_extract("text", r"(?s)\{.*", 0)
    wrong = ~F.regexp_extract("text", r"^[^{]*", 0).rlike(_BEFORE) | (F.col("open") != 0) | ~F.col("whole") & (rest != "")
    value = F.when(wrong, F.raise_error(F.concat(F.lit("malformed JSON in "), "file", F.lit(" near "), F.substring("text", 1, 60)))).otherwise(rest)
    return values.select("file", value.alias("value")).filter("value <> ''")


def read_manifests(spark: SparkSession, path: str, lines: bool = False, split: bool = False) -> DataFrame:
    """Package rows of manifest files: JSON arrays of repositories, or single ones, one after the other, on any number of lines.

    Types are given by name or number.  Corrupt values and unknown type names are errors.  A file is one row until
    it is cut into its values; ``lines`` promises one value per line, so that large files can be split, and ``split``
    cuts files of any form into their values by many tasks.
    """
    manifest = f"struct<{MANIFEST}>"
    if split:
        repos = split_values(spark, path).select(F.from_json("value", manifest, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    else:
        text = spark.read.text(path, wholetext=not lines)
        values = text if lines else text.select(F.explode(F.split("value", BETWEEN_VALUES)).alias("value"))
        parsed = values.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select(F.explode(F.from_json("value", f"array<{manifest}>", {"mode": "FAILFAST"})).alias("r"))
        repos = parsed.select("r.*")
    remote = F.coalesce(F.get("remotes", F.lit(0))["url"], F.lit(""))
    rows = repos.select(remote.alias("repository"), F.explode("packages").alias("p"))
    files = F.array_sort(F.transform(F.coalesce("p.sources", F.array()), lambda s: F.struct(s["repoPath"].alias("repo_path"), F.unbase64(s["digest"]).alias("digest"))))
    return rows.select(
        F.col("p.importPath").alias("import_path"), F.coalesce("p.name", F.lit("")).alias("name"), "repository",
        F.coalesce("p.imports", F.array().cast("array<string>")).alias("directs"), files.alias("source_files"),
        type_number(F.col("p.type")).alias("type"), F.lit(0.0).alias("ranking"),
    )


def read_lines(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """(name): given names, then one per input line, blank ones left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")
    return lines.union(spark.createDataFrame([(x,) for x in extra], "name string")) if extra else lines


#: What a source file is cut into, comments and strings first, so that nothing is looked for inside them.  No alternative
#: repeats a group, so the matcher's depth does not grow with the file.
TOKEN = r'''//[^\n]*|/\*(?s:.*?)\*/|`[^`]*`|"[^"\n]*"|[\p{L}_][\p{L}\p{Nd}_]*|\n|[^\s]'''
DECLARATIONS = ("const", "func", "type", "var")


def _header(tokens: Column) -> Column:
    """Tokens of a file before its first declaration: comments, the package clause, imports and line ends."""
    ends = F.array_min(F.filter(F.array(*[F.array_position(tokens, F.lit(d)) for d in DECLARATIONS]), lambda p: p > 0))
    return F.slice(tokens, 1, F.coalesce(ends - 1, F.size(tokens)).cast("int"))


def parse_sources(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds name, comment (the import comment's path) and imports (distinct, in order) of each source file; name is null without a package clause.

    The package clause comes first, imports follow before any declaration, so every string among the header's tokens is
    an import path; comments and whatever strings hold are tokens of their own.  An import comment stands behind the
    package clause on its line.
    """
    is_comment = lambda t: t.startswith("//") | t.startswith("/*")

    def parsed(x: Column) -> Column:
        header, plain = x["header"], x["plain"]
        named = (F.get(plain, F.lit(0)) == "package") & F.get(plain, F.lit(1)).rlike(r"^[\p{L}_][\p{L}\p{Nd}_]*$")
        beside = F.get(header, (F.array_position(header, F.lit("package")) + 1).cast("int"))
        label = F.nullif(F.regexp_extract(beside, r'^(?://|/\*)[\t ]*import[\t ]+["`]([^"`\s]+)["`]', 1), F.lit(""))
        strings = F.filter(plain, lambda t: t.startswith('"') | t.startswith("`"))
        imports = F.array_distinct(F.transform(strings, lambda t: F.substring(t, F.lit(2), F.length(t) - 2)))
        return F.struct(F.when(named, F.get(plain, F.lit(1))).alias("name"), F.when(named, label).alias("comment"), imports.alias("imports"))

    # variables of lambdas hold the tokens, and a generator stands before filters on what is made of them: a file is cut once
    header = F.transform(F.array(F.regexp_extract_all(F.col(content), F.lit(TOKEN), F.lit(0))), _header)
    rest = [c for c in files.columns if c not in ("name", "comment", "imports")]
    both = F.transform(header, lambda h: F.struct(h.alias("header"), F.filter(h, lambda t: ~is_comment(t) & (t != "\n")).alias("plain")))
    return files.select(*rest, F.inline(F.transform(both, parsed)))


def read_source_tree(spark: SparkSession, root: str, remotes: DataFrame) -> DataFrame:
    """(repository, remote, repo_path, content) of the source and module files in a tree that holds a folder for each repository.

    ``remotes`` has (repository, remote), the folders' names and their first remotes; folders without one are left out, as
    are files of other kinds.  Files are read as whole rows.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.go,go.mod}").load(root)
    inside = F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))
    rows = files.select(F.regexp_extract(inside, "^([^/]+)/", 1).alias("repository"), F.regexp_extract(inside, "^[^/]+/(.*)$", 1).alias("repo_path"), F.decode("content", "UTF-8").alias("content"))
    return rows.join(remotes.select("repository", "remote"), "repository").select("repository", "remote", "repo_path", "content")


def _labelled(rows: DataFrame, modules: DataFrame) -> DataFrame:
    """Adds label and anchor: the label of the closest labelled directory of the same repository, the row's own included.

    Labels (those with a domain) are the rows' own comments and what ``modules`` (repository, dir, label) gives, the greatest of a directory.
    A row that has its own looks no further. For the others, the distinct directories above them meet the labels first, so that
    a root of very many directories is one row there; only labels with unlabelled rows below are joined with these.
    """
    rounds = Rounds(rows.sparkSession, "labels")
    place = ["repository", "dir"]
    modules = rounds.write(modules.filter(has_domain(F.col("label")) & F.col("repository").isNotNull()).groupBy(*place).agg(F.max("label").alias("_module")), keep=True)
    comment = F.when(has_domain(F.col("comment")) & F.col("repository").isNotNull(), F.col("comment"))
    if modules.isEmpty():
        rows, label = rows.withColumn("_module", F.lit(None).cast("string")), comment
    else:
        rows, label = rows.join(to_join(modules), place, "left"), F.greatest(comment, F.col("_module"))
    rows = rows.withColumn("_own", label).drop("_module")
    labels = rows.filter("_own is not null").select(*place, F.col("_own").alias("label")).unionByName(modules.withColumnRenamed("_module", "label"))
    labels = rounds.write(labels.groupBy(*place).agg(F.max("label").alias("label")).withColumnRenamed("dir", "anchor"), keep=True)
    up = F.when(F.col("dir") != "", F.concat(F.array(F.lit("")), F.slice(ancestors(F.col("dir")), 1, F.size(F.split("dir", "/")) - 1))).otherwise(F.array().cast("array<string>"))
    bare = rows.filter("_own is null").select(*place, F.explode(up).alias("anchor"))
    met = rounds.write(bare.select("repository", "anchor").distinct().join(to_join(labels), ["repository", "anchor"]), keep=True)
    own = F.when(F.col("_own").isNotNull(), F.col("dir"))
    if met.isEmpty():
        return rows.withColumns({"label": F.col("_own"), "anchor": own}).drop("_own")
    above = bare.distinct().join(to_join(met), ["repository", "anchor"])
    best = above.groupBy(*place).agg(F.max_by(F.struct("label", "anchor"), F.length("anchor")).alias("_best"))
    rows = rows.join(best, place, "left")
    return rows.withColumns({"label": F.coalesce("_own", "_best.label"), "anchor": F.coalesce(own, F.col("_best.anchor"))}).drop("_own", "_best")


def ingest_sources(
    files: DataFrame, stdlib: bool = False, trim_repository_prefix: bool = False, prefixes: DataFrame | None = None, import_comments: bool = True
) -> DataFrame:
    """Package rows from a table of files (repository, remote, repo_path, content).

    A directory with importable source files of one package is a package: its name, distinct imports, type and file
    digests; one with files of several packages is none, nor is anything of a repository without a remote.  The path is
    the repository's prefix plus the directory: the one that ``prefixes`` (repository, prefix) gives, as the status
    table records it, else the cleaned remote.  With ``import_comments``, an import comment with a domain, or a module
    file's path, labels its directory; below a label, paths are the label plus the rest of the way.
    """
    own = files.filter(F.coalesce("remote", F.lit("")) != "")
    own = own.filter(~F.col("repo_path").rlike(IGNORED_DIRECTORY)).withColumn("dir", F.regexp_replace(F.col("repo_path"), r"/?[^/]*$", ""))
    source = F.col("repo_path").endswith(".go") & ~F.col("repo_path").rlike(IGNORED_FILE)
    module = F.col("repo_path").rlike(r"(^|/)go\.mod$") if import_comments else F.lit(False)
    # source and module files in one pass, as files may be costly to make or read; a module file has no content to be cut
    label = F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1)
    own = own.filter(source | module).withColumns({"module": F.when(module & has_domain(label), label), "content": F.when(source, F.col("content"))})
    parsed = parse_sources(own).filter("name is not null or module is not null")
    file = F.when(F.col("name").isNotNull(), F.struct("repo_path", content_digest(F.col("content")).alias("digest")))
    rows = parsed.select("repository", "remote", "dir", "name", "comment", "imports", "module", file.alias("file")).groupBy("repository", "remote", "dir").agg(
        F.min("name").alias("name"), F.max("name").alias("_other"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("imports")))).alias("directs"),
        F.max("comment").alias("comment"), F.array_sort(F.collect_list("file")).alias("source_files"), F.max("module").alias("module"),
    )
    rows = rows.withColumn("name", F.when(F.col("name") == F.col("_other"), F.col("name"))).drop("_other").filter("name is not null or module is not null")
    if import_comments:
        rows = Rounds(files.sparkSession, "sources").write(rows, keep=True)  # read for its labels and for its rows
    modules = rows.filter("module is not null").select("repository", "dir", F.col("module").alias("label"))
    rows = rows.filter("name is not null").drop("module")
    prefix = clean_repo_url(F.col("remote"))
    if prefixes is not None:
        known = Rounds(files.sparkSession, "prefixes").write(prefixes.select("repository", F.nullif("prefix", F.lit("")).alias("_prefix")), keep=True)
        rows = rows.join(to_join(known), "repository", "left")
        prefix = F.coalesce(F.col("_prefix"), prefix)
    plain = host_path(prefix, F.col("dir"))
    if import_comments:
        rows = _labelled(rows, modules)
        below = F.replace(F.when(F.col("anchor") == "", F.col("dir")).otherwise(F.substring(F.col("dir"), F.length("anchor") + 2, F.length("dir"))), F.lit("|"), F.lit("%7C"))
        plain = F.when(F.col("label").isNotNull(), host_path(F.col("label"), below)).otherwise(plain)
    path = trim_prefix(plain, prefix) if trim_repository_prefix else plain
    return rows.select(
        path.alias("import_path"), "name", F.col("remote").alias("repository"), "directs", "source_files", package_type(F.col("name"), stdlib).alias("type"), F.lit(0.0).alias("ranking")
    )
