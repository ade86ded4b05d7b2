"""Table schemas as DDL strings."""

FILE = "struct<repo_path: string, digest: binary>"
PACKAGES = f"import_path string, name string, repository string, directs array<string>, source_files array<{FILE}>, type int, ranking double"
STATUS = (
    "repository string, tag string, ref_name string, digest string, error_count int, prefix string, last_check timestamp, last_seq long, "
    "updates array<struct<when: timestamp, digest: string>>"
)
MANIFEST = (
    "`from`: string, remotes: array<struct<name: string, url: string>>, packages: array<struct<name: string, importPath: string, type: string, "
    "imports: array<string>, sources: array<struct<repoPath: string, digest: string>>>>"
)
