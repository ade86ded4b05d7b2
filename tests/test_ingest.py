"""Packages from source files and manifests."""

import json
import re

import pytest
from pyspark.sql import functions as F

from depweave.functions.paths import content_digest
from depweave.sources import ingest


def test_sources(spark):
    files = [
        ("r", "git@h.io:u/r.git", "a.go", 'package r\nimport "fmt"\n'),
        ("r", "git@h.io:u/r.git", "b.go", 'package r\nimport (\n  x "h.io/u/q"\n  "fmt"\n)\n'),
        ("r", "git@h.io:u/r.git", "cmd/main.go", 'package main\nimport "os"\n'),
        ("r", "git@h.io:u/r.git", "a_test.go", 'package r\nimport "testing"\n'),
        ("r", "git@h.io:u/r.git", "vendor/v/v.go", "package v\n"),
        ("m", "https://h.io/m", "go.mod", "module m.io/mod\n"),
        ("m", "https://h.io/m", "sub/s.go", "package s\n"),
        ("m", "https://h.io/m", "own/o.go", 'package o // import "o.io/own"\n'),
        ("m", "https://h.io/m", "docs/readme.txt", "nothing"),
    ]
    df = spark.createDataFrame(files, "repository string, remote string, repo_path string, content string")
    got = {r["import_path"]: r for r in ingest.ingest_sources(df).collect()}
    assert sorted(got) == ["h.io/u/r", "h.io/u/r/cmd", "m.io/mod/sub", "o.io/own"]
    assert got["h.io/u/r"]["directs"] == ["fmt", "h.io/u/q"]
    assert (got["h.io/u/r/cmd"]["type"], got["h.io/u/r"]["type"]) == (3, 2)
    assert [f["repo_path"] for f in got["h.io/u/r"]["source_files"]] == ["a.go", "b.go"]
    want = spark.createDataFrame([(files[0][3],)], "c string").select(content_digest(F.col("c"))).first()[0]
    assert got["h.io/u/r"]["source_files"][0]["digest"] == want


def test_manifests(spark, tmp_path):
    repo = {"remotes": [{"name": "o", "url": "https://h/r"}], "packages": [
        {"name": "p", "importPath": "h/r/p", "type": 2, "imports": ["b", "a", "b"], "sources": [{"repoPath": "z.go", "digest": "AP8="}, {"repoPath": "a.go", "digest": "AA=="}]}, {"importPath": "h/r/q"}]}
    (tmp_path / "m.json").write_text(json.dumps(repo) + "\n" + json.dumps({"packages": [{"importPath": "solo"}]}))
    got = {r["import_path"]: r for r in ingest.read_manifests(spark, str(tmp_path)).collect()}
    assert got["h/r/p"]["directs"] == ["b", "a", "b"] and got["h/r/p"]["repository"] == "https://h/r"
    assert [f["repo_path"] for f in got["h/r/p"]["source_files"]] == ["a.go", "z.go"]
    assert (got["h/r/q"]["directs"], got["h/r/q"]["type"], got["solo"]["repository"]) == ([], 0, "")


def test_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\n\n b \n")
    assert sorted(r["name"] for r in ingest.read_lines(spark, str(tmp_path), ["c"]).collect()) == ["a", "b", "c"]


ARRAY = """[{
  "from": "git",
  "remotes": [
    {
      "name": "origin",
      "url": "https://h/r"
    }
  ],
  "packages": [
    {
      "name": "p",
      "importPath": "h/r/p",
      "type": "LIBRARY",
      "imports": [
        "fmt"
      ]
    },
    {
      "name": "main",
      "importPath": "h/r/cmd",
      "type": "PROGRAM"
    }
  ]
},{
  "packages": [
    {
      "importPath": "fmt",
      "type": "STDLIB"
    }
  ]
}]
"""


def test_manifests_over_many_lines_with_types_by_name(spark, tmp_path):
    (tmp_path / "a.json").write_text(ARRAY + ARRAY.replace("h/r", "h/s"))  # one array after the other, as a loader writes them
    (tmp_path / "empty.json").write_text("[]\n")
    got = sorted((r["import_path"], r["type"], r["repository"], r["directs"]) for r in ingest.read_manifests(spark, str(tmp_path)).collect())
    assert got == [
        ("fmt", 1, "", []), ("fmt", 1, "", []), ("h/r/cmd", 3, "https://h/r", []), ("h/r/p", 2, "https://h/r", ["fmt"]),
        ("h/s/cmd", 3, "https://h/s", []), ("h/s/p", 2, "https://h/s", ["fmt"]),
    ]


@pytest.mark.parametrize("text", [ARRAY[:200], "{not json}", ARRAY.replace("LIBRARY", "NO_SUCH_TYPE")])
def test_corrupt_manifests_are_errors(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|no such package type"):
        ingest.read_manifests(spark, str(tmp_path)).collect()


def test_trimmed_repository_prefix(spark):
    files = [("r", "https://h.io/u/r", "sub/a.go", "package a\n"), ("q", "https://h.io/q", "go.mod", "module m.io/q\n"), ("q", "https://h.io/q", "b/b.go", "package b\n"), ("r", "https://h.io/u/r", "top.go", "package r\n")]
    df = spark.createDataFrame(files, "repository string, remote string, repo_path string, content string")
    assert sorted(r["import_path"] for r in ingest.ingest_sources(df, trim_repository_prefix=True).collect()) == ["h.io/u/r", "m.io/q/b", "sub"]


TRICKY = """/* import "dead/block" */
// import "dead/line"
package d // import "l.io/d"
import (
	"fmt" // "old/pkg"
	x "real/x" // see (docs)
	. "after/paren"
	_ `raw/path`
)
import "one"; import two "two/b"
var s = `
import "in/string"
`
import "late"
"""


def test_imports_are_lexed(spark):
    cases = {
        TRICKY: ("d", "l.io/d", ["fmt", "real/x", "after/paren", "raw/path", "one", "two/b"]),
        'package a; import "x";func f() {}': ("a", None, ["x"]),
        'package a /* import "l.io/a" */\nimport ( /* "no" */ "x"\n/* "multi\nline" ) */ y "z" )': ("a", "l.io/a", ["x", "z"]),
        'package a\n// import "not/a/label"\nimport "x"': ("a", None, ["x"]),
        'import "x"\npackage a': (None, None, ["x"]),
        "// package no": (None, None, []),
        "": (None, None, []),
        'package été\nimport ü "x"\nconst c = "//"': ("été", None, ["x"]),
        "/*" + "*" * 20000 + "*/package a\n" + "// remark\n" * 20000 + 'import "x"\nvar v = "' + "\\x00" * 50000 + '"': ("a", None, ["x"]),
    }
    df = spark.createDataFrame([(k,) for k in cases], "content string")
    got = {r["content"]: (r["name"], r["comment"], r["imports"]) for r in ingest.parse_sources(df).collect()}
    assert got == cases
    none = ingest.parse_sources(spark.createDataFrame([(None,)], "content string")).first()
    assert none["name"] is None and none["imports"] is None


def test_prefixes_remotes_and_mixed_packages(spark):
    files = [
        ("r", "https://h.io/r", "p/a.go", "package p\n"), ("r", "https://h.io/r", "mixed/a.go", "package a"), ("r", "https://h.io/r", "mixed/b.go", "package b"),
        ("none", None, "p/a.go", "package p"), ("empty", "", "p/a.go", "package p"), ("own", "https://h.io/own", "a.go", 'package o // import "l.io/o"'), ("own", "https://h.io/own", "q/a.go", "package q"),
    ]
    df = spark.createDataFrame(files, "repository string, remote string, repo_path string, content string")
    prefixes = spark.createDataFrame([("own", "mine.io/x"), ("r", "")], "repository string, prefix string")
    paths = lambda **a: sorted(r["import_path"] for r in ingest.ingest_sources(df, **a).collect())
    assert paths() == ["h.io/r/p", "l.io/o", "l.io/o/q"]
    assert paths(import_comments=False) == ["h.io/own", "h.io/own/q", "h.io/r/p"]
    assert paths(prefixes=prefixes, import_comments=False) == ["h.io/r/p", "mine.io/x", "mine.io/x/q"]
    assert paths(prefixes=prefixes, import_comments=False, trim_repository_prefix=True) == ["mine.io/x", "p", "q"]


def test_a_tree_of_repositories(spark, tmp_path):
    for name, text in {"one/a.go": "package one\nimport \"x\"\n", "one/sub dir/b.go": "package b", "one/readme.txt": "package no", "two/go.mod": "module m.io/two", "two/c.go": "package c", "three/d.go": "package d", "loose.go": "package l"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    remotes = spark.createDataFrame([("one", "git@h.io:u/one.git"), ("two", "https://h.io/two"), ("other", "https://h.io/o")], "repository string, remote string")
    files = ingest.read_source_tree(spark, str(tmp_path), remotes)
    assert sorted((r["repository"], r["repo_path"]) for r in files.collect()) == [("one", "a.go"), ("one", "sub dir/b.go"), ("two", "c.go"), ("two", "go.mod")]
    assert sorted(r["import_path"] for r in ingest.ingest_sources(files).collect()) == ["h.io/u/one", "h.io/u/one/sub dir", "m.io/two"]


def manifest(k):
    odd = ['plain', 'br{ace', 'br}ace }', 'quo\\"te }{', 'back\\\\', 'a],[b', 'line'][k % 7]
    files = [{"repoPath": f"{odd}{i}.go", "digest": "AP8="} for i in range(k % 4)]
    return {"from": odd, "remotes": [{"name": "o", "url": f"https://h/{k}"}] if k % 5 else [], "packages": [{"importPath": f"h/{k}/{odd}", "name": odd, "type": k % 4, "imports": [odd, "x"], "sources": files}] * (k % 3)}


@pytest.mark.parametrize("form", ["pretty", "one line", "values", "arrays"])
def test_a_large_manifest_is_read_by_many_tasks(spark, tmp_path, form):
    repos = [manifest(k) for k in range(300)]
    text = {
        "pretty": lambda: json.dumps(repos, indent=2), "one line": lambda: json.dumps(repos), "values": lambda: "\n".join(json.dumps(r, indent=1) for r in repos),
        "arrays": lambda: "\n".join(json.dumps(repos[k : k + 70]) for k in range(0, 300, 70)) + "\n[]\n",
    }[form]()
    (tmp_path / "m.json").write_text(text)
    (tmp_path / "other.json").write_text("[\n]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        values = ingest.split_values(spark, str(tmp_path))
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert sorted(r["value"].strip() and json.dumps(json.loads(r["value"])) for r in values.collect()) == sorted(json.dumps(r) for r in repos)
        got = sorted(map(str, ingest.read_manifests(spark, str(tmp_path), split=True).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == sum(len(r["packages"]) for r in repos)
    if form != "values":
        assert got == sorted(map(str, ingest.read_manifests(spark, str(tmp_path)).collect()))


@pytest.mark.parametrize("text", ['[{"packages": []}', '[{"packages": []},, {"packages": []}]', '[{"packages": [}]', 'x [{"packages": []}]', '[{"from": "a}]', '{"packages": []} y {"packages": []}', '[{"packages": []}]]'])
def test_a_malformed_manifest_is_an_error(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(Exception, match="malformed|MALFORMED|Malformed"):
        ingest.read_manifests(spark, str(tmp_path), split=True).collect()


def test_a_file_is_cut_once(spark):
    """Neither the filter on what is made of a file's tokens nor its several uses cut the file again."""
    rows = ingest.parse_sources(spark.createDataFrame([("package a", "a.go")], "content string, repo_path string")).filter("name is not null")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_labels_above_and_beside(spark):
    files = [
        ("r", "https://h.io/r", "a/x.go", 'package a // import "l.io/a"'), ("r", "https://h.io/r", "a/b/x.go", "package b"), ("r", "https://h.io/r", "a/b/c|d/x.go", "package c"),
        ("r", "https://h.io/r", "m/go.mod", "module z.io/m\n"), ("r", "https://h.io/r", "m/x.go", 'package m // import "l.io/m"'), ("r", "https://h.io/r", "m/n/o/x.go", "package o"),
        ("r", "https://h.io/r", "x.go", "package r"), ("s", "https://h.io/s", "go.mod", "module t.io/s\n"), ("s", "https://h.io/s", "p/q/x.go", "package q"), ("s", "https://h.io/s", "x.go", "package s"),
    ]
    got = ingest.ingest_sources(spark.createDataFrame(files, "repository string, remote string, repo_path string, content string"))
    assert sorted(r["import_path"] for r in got.collect()) == ["h.io/r", "l.io/a", "l.io/a/b", "l.io/a/b/c%7Cd", "t.io/s", "t.io/s/p/q", "z.io/m", "z.io/m/n/o"]


def test_texts_of_a_large_manifest_move_once(spark, tmp_path):
    """Prefix sums go over numbers of the pieces; only what puts values together moves their text."""
    (tmp_path / "m.json").write_text(json.dumps([manifest(k) for k in range(300)], indent=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        plan = ingest.split_values(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange (?:hash|range)partitioning", plan)) == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_value_longer_than_many_blocks(spark, tmp_path):
    """Blocks in which no value ends go with the block where theirs began, whatever braces and quotes its strings hold."""
    long = {"from": "q\\\"}{" * 3000, "remotes": [], "packages": [{"importPath": f"h/long{i}", "type": 1, "imports": ["}", "\"{"] * 20} for i in range(100)]}
    repos = [manifest(1), long, manifest(2), long, long, manifest(4)]
    (tmp_path / "m.json").write_text(json.dumps(repos, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = [json.loads(r["value"]) for r in ingest.split_values(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, repos))


def test_a_string_between_values_is_an_error(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"packages": []}, "a}b", {"packages": []}]')
    with pytest.raises(Exception, match="malformed"):
        ingest.read_manifests(spark, str(tmp_path), split=True).collect()
