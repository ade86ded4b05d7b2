"""Scalar functions over import paths and repository URLs, all as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STDLIB, LIBRARY, PROGRAM = 1, 2, 3
TYPE_NAMES = {0: "UNKNOWN", STDLIB: "STDLIB", LIBRARY: "LIBRARY", PROGRAM: "PROGRAM"}


def clean_repo_url(url: Column) -> Column:
    """Without the scheme, a ``git@`` user (whose first ``:`` becomes ``/``) and one trailing ``.git``."""
    bare = F.regexp_replace(url, r"(?s)\A.*?://", "")
    at = F.regexp_replace(F.regexp_replace(bare, r"\Agit@", ""), r"(?s)\A([^:]*):", "$1/")
    return F.regexp_replace(F.when(bare.startswith("git@"), at).otherwise(bare), r"\.git\z", "")


def fix_repo_url(url: Column) -> Column:
    """The normalized URL that keys a repository."""
    return F.concat(F.lit("https://"), clean_repo_url(url))


def domain(path: Column) -> Column:
    """First segment of a path."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def has_domain(path: Column) -> Column:
    """Whether the first segment looks like a host name."""
    return domain(path).contains(".") & ~is_relative(path)


def is_relative(path: Column) -> Column:
    return path.startswith("./") | path.startswith("../") | path.startswith("/") | path.isin(".", "..")


def is_local_package(path: Column) -> Column:
    """Local or intrinsic: relative, or without a domain."""
    return is_relative(path) | ~has_domain(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def trim_ext(path: Column) -> Column:
    """Without the suffix from the last dot of the last segment."""
    return F.regexp_replace(path, r"\.[^./]*\z", "")


def hex_digest(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def content_digest(content: Column) -> Column:
    """SHA-256 of a file's content, as bytes."""
    return F.unhex(F.sha2(content.cast("binary"), 256))


def trim_prefix(path: Column, prefix: Column) -> Column:
    """Without ``prefix`` and the slash after it, where the path begins with both."""
    lead = F.concat(prefix, F.lit("/"))
    return F.when(F.startswith(path, lead), F.substring(path, F.length(lead) + 1, F.length(path))).otherwise(path)


def host_path(prefix: Column, relative_dir: Column) -> Column:
    """The import path of a directory in a repository; an empty directory adds nothing."""
    return F.concat_ws("/", prefix, F.when(relative_dir != "", relative_dir))


def package_type(name: Column, stdlib: bool = False) -> Column:
    if stdlib:
        return F.lit(STDLIB)
    return F.when(name == "main", PROGRAM).otherwise(LIBRARY)


def type_name(kind: Column) -> Column:
    """The name of a package type's number; null for unknown, which messages leave out."""
    out = F.when(kind == STDLIB, TYPE_NAMES[STDLIB])
    for number in (LIBRARY, PROGRAM):
        out = out.when(kind == number, TYPE_NAMES[number])
    return out


def type_number(text: Column) -> Column:
    """The number of a package type given by name or as a number; absent: unknown. Any other name is an error."""
    out = F.when(text.isNull(), 0)
    for number, name in TYPE_NAMES.items():
        out = out.when(text == name, number)
    number = text.try_cast("int")
    return out.when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("no such package type: "), text)).cast("int"))


def ancestors(path: Column) -> Column:
    """The path and every path above it, longest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def matches(path: Column, pattern: str) -> Column:
    """``t/...`` is t and all below; empty matches all; anything else exactly itself.

    The prefix test is pushed down to Parquet as a starts-with filter.
    """
    if not pattern:
        return F.lit(True)
    base = pattern.removesuffix("/...")
    if base == pattern or not base:
        return path == pattern
    return (path == base) | path.startswith(base + "/")


def source_filter(path: Column, expression: str) -> Column:
    """Unanchored regular expression; a leading ``(?!)`` negates the rest. A final ``$`` means the end of the text.

    Look-around and back-references are refused: filters are to run in time linear in the text.
    """
    negate = expression.startswith("(?!)")
    exp = expression[4:] if negate else expression
    plain = re.sub(r"\\\\", "", exp)
    if re.search(r"(?<!\\)\(\?(?:[=!>]|<[=!])", plain) or re.search(r"\\(?:[1-9]|k<)", plain):
        raise ValueError(f"look-around and back-references are not supported: {expression!r}")
    if exp.endswith("$") and not exp.endswith(r"\$"):
        exp = exp[:-1] + r"\z"
    hit = path.rlike(exp)
    return ~hit if negate else hit


#: Hosts whose repositories are named by the first two segments below them.
TWO_LEVEL_HOSTS = ("github.com", "bitbucket.org")
VERSIONED_HOST = "gopkg.in"


def resolve_known_host(path: Column) -> Column:
    """struct(repository, prefix, error) of a path on a well-known host; all null where it is unknown.

    error: 'local' for a local path, 'short' for the versioned host alone.
    """
    parts = F.split(path, "/")
    n, first = F.size(parts), F.element_at(parts, 1)
    lead = lambda k: F.array_join(F.slice(parts, 1, k), "/")
    two, three = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    direct = first.isin(*TWO_LEVEL_HOSTS) & (n >= 3)
    versioned = first == VERSIONED_HOST
    name = trim_ext(two)
    repository = (
        F.when(direct, F.concat(F.lit("https://"), lead(3)))
        .when(versioned & (n == 2), F.concat(F.lit("https://github.com/go-"), name, F.lit("/"), name))
        .when(versioned & (n >= 3), F.concat(F.lit("https://github.com/"), two, F.lit("/"), trim_ext(three)))
    )
    prefix = F.when(direct | versioned & (n >= 3), lead(3)).when(versioned & (n == 2), lead(2))
    local = is_local_package(path)
    error = F.when(local, F.lit("local")).when(versioned & (n == 1), F.lit("short"))
    return F.struct(
        F.when(~local, repository).alias("repository"), F.when(~local, prefix).alias("prefix"), error.alias("error")
    )


def resolve_from_page(status: Column, html: Column) -> Column:
    """struct(repository, prefix, error) from a fetched page.

    The first ``<meta name=go-import content="prefix git url">`` of the page's head decides; status 200 and
    404 are read. error: 'status' for other codes and for a 404 without a target, 'no targets' else.
    """
    head = F.regexp_extract(html, r"(?is)\A(.*?)(?:<body|</head|\z)", 1)
    tags = F.regexp_extract_all(head, F.lit(r"(?is)(<meta\s[^>]*>)"), F.lit(1))
    content = F.transform(
        F.filter(tags, lambda t: F.regexp_extract(t, r"""(?is)\sname\s*=\s*["']?([^"'\s>]*)""", 1) == "go-import"),
        lambda t: F.split(F.trim(F.regexp_extract(t, r"""(?is)\scontent\s*=\s*["']([^"']*)["']""", 1)), r"\s+"),
    )
    found = F.get(F.filter(content, lambda c: (F.size(c) == 3) & (F.get(c, F.lit(1)) == "git")), F.lit(0))
    read = status.isin(200, 404)
    error = F.when(~read, F.lit("status")).when(found.isNull(), F.when(status == 404, F.lit("status")).otherwise(F.lit("no targets")))
    return F.struct(
        F.when(error.isNull(), F.get(found, F.lit(2))).alias("repository"), F.when(error.isNull(), F.get(found, F.lit(0))).alias("prefix"), error.alias("error")
    )
