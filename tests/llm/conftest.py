import zlib

import pytest

#: doc_id, text: nulls, empties, blanks, ties, repeats, near copies, long and odd texts.
BASE = " ".join(f"word{i % 37}x{i}" for i in range(120))
MESSY = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One  TWO"), (6, "one two three four five six"), (7, BASE), (8, BASE.upper()), (9, BASE + " tail of it"),
    (10, BASE.replace("word3x3", "other")), (11, "é È naïve — “quoted” 漢字 😀 don't 12 34\nline two of the text\nline two of the text\n\nend"), (12, "Line two of the text \nfresh line here\n"),
    (13, "one two"), (13, "one two"), (None, "null id text of some words"), (None, None), (14, "x" * 30000 + " " + "lorem ipsum dolor " * 4000), (15, "\x1c\x00 control\x0bchars\r\n tab\tbed"),
    (16, " ".join(f"word{i % 37}x{i}" for i in range(60, 180))), (17, "line two of the text"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, node string, size int, kept string, digest string, d int, t int"


@pytest.fixture(scope="session")
def messy(spark):
    """The odd rows with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, None if i == 6 else "en", None, None, "a", "b", 1, "c", "d", 1, 2) for i, t in MESSY], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


def crc_mod(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
