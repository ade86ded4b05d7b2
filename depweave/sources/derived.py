"""Package graph, source files, observations and pages derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import joins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part_path(key, brand) -> F.Column:
    return F.concat(F.lit("parts.example.org/"), F.lower(F.replace(brand, F.lit("#"), F.lit(""))), F.lit("/p"), key.cast("string"))


def _supplier_path(key, nation) -> F.Column:
    return F.concat(F.lit("suppliers.example.net/n"), nation.cast("string"), F.lit("/s"), key.cast("string"))


def _rows(df: DataFrame, path, repository, kind: int) -> DataFrame:
    return df.select(path.alias("import_path"), repository.alias("repository"), "directs", F.lit(kind).alias("type"))


def supplier_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' rows of ``packages``, from their own table."""
    nation = F.col("s_nationkey").cast("string")
    rows = table(spark, sf_dir, "supplier").withColumn("directs", F.array(F.concat(F.lit("geo/nation"), nation)))
    return _rows(rows, _supplier_path(F.col("s_suppkey"), F.col("s_nationkey")), F.concat(F.lit("https://suppliers.example.net/n"), nation), 2)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, part, supplier and nation, with what it depends on in path order.

    What is broadcast goes by numbers of rows, as the tables' files are far smaller than their rows.
    """
    read = lambda name: table(spark, sf_dir, name)
    part = read("part").select("p_partkey", "p_brand", "p_type", _part_path(F.col("p_partkey"), F.col("p_brand")).alias("path"))
    keyed = joins.to_join(part.select("p_partkey", "p_brand", "path"))
    supplier = joins.to_join(read("supplier").select("s_suppkey", "s_nationkey"), 10 * joins.BROADCAST_ROWS)
    # one pass over the lines: numbers and brands move, paths are made where an order's lines have met
    line = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(keyed.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    line = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").filter("p_partkey is not null or s_suppkey is not null")
    bought = F.when(F.col("p_partkey").isNotNull(), F.struct("p_partkey", "p_brand"))
    sold = F.when(F.col("s_suppkey").isNotNull(), F.struct("s_suppkey", "s_nationkey"))
    met = line.select("l_orderkey", bought.alias("part"), sold.alias("supplier")).repartition("l_orderkey")
    per_order = met.groupBy("l_orderkey").agg(F.collect_set("part").alias("parts"), F.collect_set("supplier").alias("suppliers"))
    paths = F.concat(F.transform("parts", lambda x: _part_path(x["p_partkey"], x["p_brand"])), F.transform("suppliers", lambda x: _supplier_path(x["s_suppkey"], x["s_nationkey"])))
    per_order = per_order.select("l_orderkey", F.array_sort(F.array_distinct(F.array_compact(paths))).alias("directs"))
    orders = read("orders").select("o_orderkey", "o_custkey").hint("merge").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    customer = F.concat(F.lit("orders.example.com/c"), F.col("o_custkey").cast("string"))
    order_rows = _rows(orders, F.concat(customer, F.lit("/o"), F.col("o_orderkey").cast("string")), F.concat(F.lit("https://"), customer), 3)

    k = F.col("p_partkey")
    other = keyed.select(F.col("p_partkey").alias("k"), F.col("path").alias("other"))
    near = part.withColumn("ring", k - k % 4 + (k % 4 + 1) % 4).withColumn("above", F.floor(k / 10))
    near = near.join(other.withColumnsRenamed({"k": "ring", "other": "ring_path"}), "ring", "left")
    near = near.join(other.withColumnsRenamed({"k": "above", "other": "above_path"}), "above", "left")
    kind = F.concat(F.lit("type/"), F.lower("p_type"))
    near = near.withColumn("directs", F.array_sort(F.array_distinct(F.array_compact(F.array("ring_path", "above_path", kind)))))
    part_rows = _rows(near, F.col("path"), F.concat(F.lit("https://parts.example.org/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))), 2)

    nations = read("nation").withColumn("directs", F.array(F.concat(F.lit("geo.example.com/region"), F.col("n_regionkey").cast("string"))))
    nation_rows = _rows(nations, F.concat(F.lit("geo/nation"), F.col("n_nationkey").cast("string")), F.lit(""), 1)
    return order_rows.unionByName(part_rows).unionByName(supplier_packages(spark, sf_dir)).unionByName(nation_rows).withColumn("ranking", F.lit(0.0))


def edges(packages: DataFrame) -> DataFrame:
    """(source, pos, target) of every direct dependency."""
    return packages.select(F.col("import_path").alias("source"), F.posexplode("directs").alias("pos", "target"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(import_path, repository, repo_path, digest): one row per document as a file of a package."""
    docs = table(spark, sf_dir, "documents")
    repo = F.concat(F.lit("docs.example.io/"), F.col("source"))
    return docs.select(
        F.concat(repo, F.lit("/"), F.col("lang")).alias("import_path"), F.concat(F.lit("https://"), repo).alias("repository"),
        F.concat(F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("repo_path"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repository, tag, ref, digest, failed, ts, seq): one row per event as a check of a repository."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("https://repos.example.com/u"), F.col("user_id").cast("string")).alias("repository"), F.lit("").alias("tag"),
        F.lit("refs/heads/master").alias("ref"), F.get_json_object("props", "$.k").alias("digest"),
        (F.col("event_type") == "error").alias("failed"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
    )


def remote_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repository, line_no, line): ref listings, one per user and day."""
    events = table(spark, sf_dir, "events")
    name = F.create_map(*[F.lit(x) for x in (
        "view", "refs/heads/master", "click", "refs/heads/dev", "signup", "HEAD", "purchase", "refs/tags/v1", "error", "refs/pull/1/head"
    )])
    day = F.date_format("ts", "yyyy-MM-dd")
    return events.select(
        F.concat(F.lit("https://repos.example.com/u"), F.col("user_id").cast("string"), F.lit("/"), day).alias("repository"),
        F.col("event_id").alias("line_no"), F.concat(F.get_json_object("props", "$.k"), F.lit("\t"), name[F.col("event_type")]).alias("line"),
    )


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, import_path, status, html): pages with an import tag made from their URL."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    tag = F.concat(F.lit('<meta name="go-import" content="'), host, F.lit(" git https://"), host, F.lit('">'))
    status = F.when(F.col("page_id") % 7 == 3, 500).when(F.col("page_id") % 5 == 2, 404).otherwise(200)
    return pages.select("page_id", host.alias("import_path"), status.alias("status"), F.concat(tag, "html").alias("html"))
