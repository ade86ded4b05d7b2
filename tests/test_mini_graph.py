"""The hand-worked graph: one assertion per operator and per choice."""

import pytest
from pyspark.sql import functions as F

from depweave.functions import paths as P
from depweave.operators import closure, maintain, match, rank, resolve, reverse, stats
from depweave.sources import export
from depweave.sources.scratch import Snapshots, shared_dir

ROWS = [
    ("a.io/x", "https://a.io/x", ["a.io/x/sub", "b.io/y", "fmt"], 2),
    ("a.io/x-tool", "https://a.io/x-tool", ["a.io/x"], 3),
    ("a.io/x/sub", "https://a.io/x", ["fmt"], 2),
    ("b.io/y", "https://b.io/y", ["a.io/x", "c.io/z"], 2),
    ("fmt", "", [], 1),
]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame([(*r, 0.0) for r in ROWS], "import_path string, repository string, directs array<string>, type int, ranking double").cache()


def paths(df, column="import_path"):
    return sorted(r[column] for r in df.collect())


def pairs(df):
    return sorted((r["target"], r["source"]) for r in df.collect())


def test_match(graph):
    assert paths(match.match(graph, "a.io/x/...")) == ["a.io/x", "a.io/x/sub"]
    assert paths(match.match(graph, "a.io/x")) == ["a.io/x"]
    assert len(paths(match.match(graph))) == 5
    assert paths(match.match(graph, "/...")) == []
    page = match.match_page(graph, 1, package="a.io/x/...").collect()
    assert [(r["import_path"], r["next_page"]) for r in page] == [("a.io/x", "a.io/x/sub")]
    last = match.match_page(graph, 1, page_key="a.io/x/sub", package="a.io/x/...").collect()
    assert [(r["import_path"], r["next_page"]) for r in last] == [("a.io/x/sub", None)]
    assert match.match_count(graph, package="a.io/x/...").first()[0] == 2
    with pytest.raises(KeyError):
        match.lookup_one(graph, "nope")
    assert match.lookup_one(graph, "fmt")["type"] == 1


def test_pages_together_are_the_whole(graph):
    found, key = [], ""
    while key is not None:
        page = match.match_page(graph, 2, page_key=key).collect()
        found += [r["import_path"] for r in page]
        key = page[0]["next_page"] if page else None
    assert found == sorted(r[0] for r in ROWS)


def test_reverse(graph):
    assert pairs(reverse.reverse(graph, ["a.io/x"])) == [("a.io/x", "a.io/x-tool"), ("a.io/x", "b.io/y")]
    every = [("a.io/x", "a.io/x-tool"), ("a.io/x", "b.io/y"), ("a.io/x/sub", "a.io/x")]
    assert pairs(reverse.reverse(graph, ["a.io/x/..."])) == every
    assert pairs(reverse.reverse(graph, ["a.io/x/..."] + [f"n{i}" for i in range(200)])) == every
    assert pairs(reverse.reverse(graph, ["a.io/x/..."], other_repository=True)) == every[:2]
    assert pairs(reverse.reverse(graph, ["c.io/z"], other_repository=True)) == [("c.io/z", "b.io/y")]
    assert pairs(reverse.reverse(graph, ["a.io/x"], matching="(?!)tool")) == [("a.io/x", "b.io/y")]
    assert pairs(reverse.reverse(graph, [])) == []
    assert reverse.reverse_count(graph, ["a.io/x/..."]).first()[0] == 3


def test_reverse_page(graph):
    one = reverse.reverse_page(graph, ["fmt", "a.io/x/sub"], 1)
    assert pairs(one) == [("a.io/x/sub", "a.io/x"), ("fmt", "a.io/x")]
    assert {r["next_page"] for r in one.collect()} == {"a.io/x-tool"}
    two = reverse.reverse_page(graph, ["fmt", "a.io/x/sub"], 1, "a.io/x-tool")
    assert [tuple(r) for r in two.collect()] == [("fmt", "a.io/x/sub", None)]


def test_sets(graph):
    assert paths(stats.missing(graph)) == ["c.io/z"] == paths(stats.missing(graph, True))
    assert tuple(stats.domain_totals(graph).first()) == (5, 7, 2)
    hist = {r["domain"]: r for r in stats.domain_histogram(graph).collect()}
    assert (hist["a.io"]["deps"], hist["a.io"]["pkgs"], round(hist["a.io"]["pct_deps"], 3), hist["a.io"]["pct_pkgs"]) == (3, 3, 42.857, 60.0)
    assert (hist["b.io"]["deps"], hist["c.io"]["pkgs"]) == (1, 1)
    assert tuple(stats.graph_stats(graph).first()) == (5, 7, 6, 1)
    assert sum(r["deps"] for r in hist.values()) + 2 == 7


def test_affected(graph):
    got = {r["repository"]: r["packages"] for r in reverse.affected(graph, ["a.io/x/..."], other_repository=False).collect()}
    assert got == {"https://a.io/x": ["a.io/x"], "https://a.io/x-tool": ["a.io/x-tool"], "https://b.io/y": ["b.io/y"]}


def test_closure(graph):
    everything = sorted(r[0] for r in ROWS)
    assert paths(closure.closure(graph, ["a.io/x-tool"])) == everything
    assert paths(closure.closure(graph, ["a.io/x-tool"], skip_stdlib=True)) == everything[:-1]
    assert paths(closure.closure(graph, paths(closure.closure(graph, ["a.io/x"])))) == paths(closure.closure(graph, ["a.io/x"]))


@pytest.mark.parametrize(
    "rounds, want",
    [
        (1, {"a.io/x": (0.3625, 2660), "c.io/z": (0.220833333, 1620), "fmt": (0.338888889, 2487)}),
        (10, {"a.io/x": (0.387962185, 2619), "a.io/x-tool": (0.15, 1012), "b.io/y": (0.259922689, 1755), "c.io/z": (0.260462185, 1758), "fmt": (0.480847059, 3247)}),
    ],
)
def test_pagerank(graph, rounds, want):
    got = {r["import_path"]: (round(r["weight"], 9), r["ranking"]) for r in rank.scaled(rank.pagerank(graph, rounds)).collect()}
    assert {k: got[k] for k in want} == want


def test_rank_write_back(graph):
    ranks = rank.scaled(rank.pagerank(graph))
    assert rank.rank_diff(graph, ranks).count() == 5
    written = maintain.apply_ranks(graph, ranks)
    assert rank.rank_diff(written, ranks).count() == 0
    with pytest.raises(ValueError):
        rank.pagerank(graph, damping=1.5)


def test_exports(graph):
    lines = [r["value"] for r in export.csv_adjacency(graph).orderBy("import_path").collect()]
    assert lines == ["a.io/x;a.io/x/sub;b.io/y;fmt", "a.io/x-tool;a.io/x", "a.io/x/sub;fmt", "b.io/y;a.io/x;c.io/z", "fmt"]
    some = [r["value"] for r in export.csv_adjacency(graph, True, True).orderBy("import_path").collect()]
    assert some == ["a.io/x;a.io/x/sub;b.io/y", "a.io/x-tool;a.io/x", "b.io/y;a.io/x;c.io/z"]
    ids = {r["path"]: r["id"] for r in export.csv_vocabulary(graph).collect()}
    assert ids == {"a.io/x": 1, "a.io/x/sub": 2, "b.io/y": 3, "fmt": 4, "a.io/x-tool": 5, "c.io/z": 6}
    assert export.rdf_missing(graph).count() == 2
    assert export.nquads(export.rdf_quads(graph)).count() == 5 * 5 + 7


def test_row_json_round_trip(spark, graph):
    full = graph.withColumn("name", F.lit("")).withColumn("source_files", F.array(F.struct(F.lit("a.go").alias("repo_path"), F.unhex(F.lit("00ff")).alias("digest"))))
    back = export.parse_rows_json(export.rows_json(full))
    keys = ["import_path", "name", "repository", "directs", "source_files", "type", "ranking"]
    assert back.select(*keys).orderBy("import_path").collect() == full.select(*keys).orderBy("import_path").collect()


def test_maintenance(spark, graph):
    new = spark.createDataFrame([("a.io/x", "https://a.io/x", ["fmt"], 2, 0.0), ("d.io/n", "https://d.io/n", [], 2, 0.0)], graph.schema)
    once = maintain.upsert(graph, new)
    assert once.count() == 6
    assert sorted(map(str, maintain.upsert(once, new).collect())) == sorted(map(str, once.collect()))
    assert paths(maintain.upsert_reset(graph, new)) == ["a.io/x", "a.io/x-tool", "b.io/y", "d.io/n", "fmt"]
    left, gone = maintain.remove_packages(graph, spark.createDataFrame([("fmt",), ("nope",)], "import_path string"))
    assert (left.count(), paths(gone)) == (4, ["fmt"])
    status = spark.createDataFrame([("https://a.io/x", ""), ("https://a.io/x", "v1"), ("https://b.io/y", "")], "repository string, tag string")
    urls = spark.createDataFrame([("git@a.io:x.git",), ("https://fmt",)], "url string")
    s, p = maintain.remove_repositories(status, graph, urls)
    assert (s.count(), paths(p)) == (1, ["a.io/x-tool", "b.io/y", "fmt"])
    assert maintain.remove_repositories(status, graph, urls, keep_packages=True)[1].count() == 5
    batch = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, n int, v string")
    assert [tuple(r) for r in maintain.last_per_key(batch, "key", "n").collect()] == [("k", "b")]


def test_snapshots(spark, graph):
    store = Snapshots(spark, f"{shared_dir(spark)}/snapshots-test")
    store.publish(graph, "import_path")
    store.publish(store.current().filter("type = 2"))
    assert paths(store.current()) == ["a.io/x", "a.io/x/sub", "b.io/y"]


def test_urls(spark):
    cases = {
        "https://github.com/a/b.git": "github.com/a/b", "git@github.com:a/b.git": "github.com/a/b", "ssh://git@github.com:a/b.git": "github.com/a/b",
        "ssh://git@host.io/a/b": "host.io/a/b", "git@host.io:22:x": "host.io/22:x", "github.com/a/b.git.git": "github.com/a/b.git",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r["u"]: r["c"] for r in df.withColumn("c", P.clean_repo_url(F.col("u"))).collect()} == cases


def test_known_hosts(spark):
    cases = {
        "github.com/a/b/c/d": ("https://github.com/a/b", "github.com/a/b", None), "github.com/a": (None, None, None),
        "gopkg.in/yaml.v2": ("https://github.com/go-yaml/yaml", "gopkg.in/yaml.v2", None),
        "gopkg.in/user/pkg.v3/sub": ("https://github.com/user/pkg", "gopkg.in/user/pkg.v3", None),
        "gopkg.in/yaml.v2/sub": ("https://github.com/yaml.v2/sub", "gopkg.in/yaml.v2/sub", None),
        "gopkg.in": (None, None, "short"), "fmt": (None, None, "local"), "./x": (None, None, "local"), "example.org/x": (None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "import_path string")
    assert {r["import_path"]: (r["repository"], r["prefix"], r["error"]) for r in resolve.resolve(df).collect()} == cases


def test_pages(spark):
    meta = '<HEAD><META Name="go-import" Content="x.io/p git https://h.io/p"></HEAD>'
    rows = [
        (0, "p", 200, meta), (1, "p", 404, meta), (2, "p", 500, meta), (3, "p", 200, meta.replace(" git ", " hg ")),
        (4, "p", 200, "<body>" + meta), (5, "p", 404, "<head></head>"),
    ]
    got = resolve.resolve_pages(spark.createDataFrame(rows, "page_id long, import_path string, status int, html string"))
    hit = ("https://h.io/p", "x.io/p", None)
    want = [hit, hit, (None, None, "status"), (None, None, "no targets"), (None, None, "no targets"), (None, None, "status")]
    assert [(r["repository"], r["prefix"], r["error"]) for r in got.orderBy("page_id").collect()] == want


def test_cover_ends_at_a_slash(spark):
    df = spark.createDataFrame([("github.com/a/b/c",), ("github.com/a/bc/d",)], "import_path string")
    known = spark.createDataFrame([("github.com/a/b",)], "prefix string")
    assert paths(resolve.resolve_distinct(df, known), "repository") == ["https://github.com/a/bc"]


def test_nearest_label(spark):
    p = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",)], "path string")
    labels = spark.createDataFrame([("a", "A"), ("a/b", "B")], "path string, label string")
    assert {r["path"]: r["label"] for r in resolve.nearest_label(p, labels).collect()} == {"a/b/c": "B", "a/x": "A", "z": None}


def test_empty_graph(spark, graph):
    none = graph.filter("false")
    assert stats.missing(none).count() == 0
    assert closure.closure(none, ["a"]).count() == 0
    assert rank.pagerank(none).count() == 0
    assert export.csv_vocabulary(none).count() == 0
    assert reverse.reverse_page(none, ["a/..."], 3).count() == 0


@pytest.mark.parametrize("inline, in_set", [(0, 1000), (0, 0)])
def test_reverse_by_sets_and_by_joins(graph, monkeypatch, inline, in_set):
    patterns = ["a.io/x/...", "fmt"]
    want = sorted(map(tuple, reverse.reverse(graph, patterns).collect()))
    page = sorted(map(tuple, reverse.reverse_page(graph, patterns, 2).collect()))
    monkeypatch.setattr(reverse, "INLINE_PATTERNS", inline)
    monkeypatch.setattr(reverse, "SET_PATTERNS", in_set)
    assert sorted(map(tuple, reverse.reverse(graph, patterns).collect())) == want
    assert sorted(map(tuple, reverse.reverse_page(graph, patterns, 2).collect())) == page


@pytest.mark.parametrize("bad", ["a(?=b)", "(?<!x)y", r"(a)\1", "(?!)(?!b)", "(?>a)"])
def test_look_around_and_back_references_are_refused(graph, bad):
    with pytest.raises(ValueError):
        reverse.reverse(graph, ["fmt"], matching=bad)
    reverse.reverse(graph, ["fmt"], matching=r"(?!)a\(\?=b|\\d|(?:x)").count()


def test_the_prefix_reaches_the_files(spark, graph):
    from depweave.sources.scratch import Snapshots, shared_dir

    store = Snapshots(spark, f"{shared_dir(spark)}/prefix")
    store.publish(graph, "import_path")
    plan = match.match(store.current(), "a.io/x/...", include_directs=False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(import_path,a.io/x/)" in text and "directs" not in text.split("ReadSchema")[1]
    assert sorted(r["import_path"] for r in plan.collect()) == ["a.io/x", "a.io/x/sub"]


def test_row_json_writes_types_by_name(spark, graph):
    lines = [r["value"] for r in export.rows_json(graph.withColumn("name", F.lit(""))).collect()]
    assert any('"type":"LIBRARY"' in x for x in lines) and not any('"type":2' in x for x in lines)
    back = export.parse_rows_json(spark.createDataFrame([('{"importPath":"a","type":2}',), ('{"importPath":"b","type":"PROGRAM"}',), ('{"importPath":"c"}',)], "value string"))
    assert [r["type"] for r in back.orderBy("import_path").collect()] == [2, 3, 0]


def test_the_last_write_of_a_batch_wins(spark, graph):
    row = lambda path, repo, directs, n: (path, repo, directs, 2, 0.0, n)
    batch = spark.createDataFrame([row("a.io/x", "r1", ["old"], 1), row("a.io/x", "r2", ["new"], 3), row("a.io/x", "r1", ["mid"], 2), row("z.io/z", "r2", [], 1)],
                                  "import_path string, repository string, directs array<string>, type int, ranking double, n long")
    plain = graph.select("import_path", "repository", "directs", "type", "ranking")
    got = {r["import_path"]: (r["repository"], r["directs"]) for r in maintain.upsert(plain, batch, order="n").collect()}
    assert got["a.io/x"] == ("r2", ["new"]) and got["z.io/z"] == ("r2", [])
    assert maintain.upsert(plain, batch, order="n").columns == plain.columns
    assert maintain.upsert_reset(plain, batch, order="n").filter("import_path = 'a.io/x'").count() == 1
    with pytest.raises(Exception, match="is repeated in a batch"):
        maintain.upsert(plain, batch.drop("n")).collect()


def test_closure_of_a_deep_graph(spark, monkeypatch):
    monkeypatch.setattr(closure, "MERGE_ROUNDS", 3)
    chain = [(f"n{k:02d}", "r", [f"n{k + 1:02d}", f"n{k // 2:02d}"], 2, 0.0) for k in range(14)]
    packages = spark.createDataFrame(chain, "import_path string, repository string, directs array<string>, type int, ranking double")
    assert paths(closure.closure(packages, ["n05"])) == [f"n{k:02d}" for k in range(14)]
    assert paths(closure.closure(packages.filter("import_path <> 'n09'"), ["n06"])) == [f"n{k:02d}" for k in range(9)]


def test_closures_of_many_root_sets_equal_single_ones(spark, monkeypatch):
    """Also of more sets than one number holds, with cycles, empty sets and paths without a row; jobs do not grow with the sets."""
    import random

    from depweave.sources.scratch import Rounds

    rnd = random.Random(2)
    rows = [(f"n{k}", "r", [f"n{rnd.randrange(70)}" for _ in range(rnd.choice([0, 1, 1, 2]))], 1 if k % 9 == 0 else 2, 0.0) for k in range(60)]
    packages = spark.createDataFrame(rows, "import_path string, repository string, directs array<string>, type int, ranking double")
    sets = {f"set{k}": [f"n{rnd.randrange(65)}" for _ in range(rnd.randrange(1, 3))] for k in range(150)}
    roots = spark.createDataFrame([(s, p) for s, ps in sets.items() for p in ps] + [("lost", None), ("lost", "nowhere")], "root string, import_path string")
    links, there = {r[0]: r[2] for r in rows}, {r[0] for r in rows}

    def reach(start):
        seen, todo = set(), [p for p in start if p in there]
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += [t for t in links[p] if t in there]
        return seen

    written, write = [], Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, *a, **k: written.append(1) or write(self, *a, **k))
    got = sorted(map(tuple, closure.closures(packages, roots).collect()))
    assert got == sorted((s, p) for s, ps in sets.items() for p in reach(ps))
    many = len(written)
    one = closure.closures(packages, roots.filter("root = 'set0'"), skip_stdlib=True)
    assert {r["import_path"] for r in one.collect()} == {p for p in reach(sets["set0"]) if int(p[1:]) % 9}
    assert many <= 70


@pytest.mark.parametrize("parts", [1, 7])
def test_labels_by_one_sort(spark, parts):
    """Equal to the join of ancestors, with labels on many levels and of whole partitions, names that sort around '/', and repeated rows."""
    import random

    rnd = random.Random(parts)
    names = ["a", "a-b", "a.b", "ab", "b", "a b", "\u00e9", "~"]
    path = lambda: "/".join(rnd.choice(names) for _ in range(rnd.randrange(1, 6)))
    paths = spark.createDataFrame([(path(),) for _ in range(400)] + [(None,), ("a",), ("a",)], "path string")
    marks = list({path() for _ in range(25)} | {"a", "b/a"})
    labels = spark.createDataFrame([(p, f"l{k}") for k, p in enumerate(marks)], "path string, label string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(str, resolve.nearest_label_sorted(paths, labels).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(map(str, resolve.nearest_label(paths, labels).collect()))
    assert resolve.nearest_label_sorted(paths, labels.filter("false")).filter("label is not null").count() == 0
