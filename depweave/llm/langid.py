"""Language identification by compression.

For each language a zstandard raw-content dictionary is taken from training texts.  A text, lower-cased
and without ASCII digits and punctuation, is compressed with each dictionary, forwards and with its words
in reverse order, in blocks that each begin from the fresh dictionary; the language whose dictionary leaves
the fewest bytes wins.  Where the best and the second-best size are too close, the document is marked as
rejected.  All texts are treated alike, whatever their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, remember

DICTIONARY_BYTES = 250_000  # raw content per language
PIECE = 1000  # characters of a text that are drawn for a dictionary at a time
MIN_MARGIN = 0.0005  # (second - best) / best below which a document is rejected
UNDETERMINED = "und"

LEVEL = 6
BLOCK = 2000  # bytes compressed at a time

_NOISE = bytes([*range(0, 10), *range(11, 32), *range(33, 65), *range(91, 97), *range(123, 128)])
_COMPRESSORS: dict[bytes, list] = {}
_SPACE = 1 << 40  # draws are hashes below this


def plain_bytes(text: str) -> bytes:
    """The lower-cased text in UTF-8 without ASCII control characters, digits and punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _NOISE)


def sample_dictionaries(training: DataFrame, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """{language: raw content} from rows (text, lang): pieces of all its texts, drawn by hash, up to ``size`` bytes.

    A language's share of pieces is what gives twice ``size`` of its distinct characters (estimated from distinct
    texts by powers of two of their length), all of them where there are fewer.  Draws hash the text and the
    piece's place, so the sample is the same however the rows are partitioned, however long the texts are and
    however often one occurs; about 2 * ``size`` characters per language reach the driver.
    """
    rows = training.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    length = F.length("text")
    known = rows.groupBy("lang", F.floor(F.log2(length)).alias("power")).agg(
        F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts"), F.avg(length).alias("chars")
    )
    total: dict[str, float] = {}
    for r in known.collect():  # at most 31 rows per language
        total[r["lang"]] = total.get(r["lang"], 0) + r["texts"] * r["chars"]
    if not total:
        return {}
    limit = F.lit(0)
    for lang, chars in total.items():
        limit = F.when(F.col("lang") == lang, int(_SPACE * min(1.0, 2 * size / chars))).otherwise(limit)
    draw = lambda k: F.pmod(F.xxhash64(F.lit(17), F.col("h"), k), F.lit(_SPACE))
    places = F.sequence(F.lit(0), F.floor((length - 1) / PIECE).cast("int"))
    drawn = rows.withColumns({"h": F.xxhash64("text"), "limit": limit})
    drawn = drawn.withColumn("k", F.explode(F.filter(places, lambda k: draw(k) < F.col("limit"))))
    pieces = drawn.select("lang", F.substr("text", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"), draw(F.col("k")).alias("draw")).distinct()
    parts: dict[str, list[bytes]] = {}
    left = dict.fromkeys(total, size)
    for r in sorted(pieces.collect(), key=lambda r: (r["draw"], r["piece"])):
        raw = plain_bytes(r["piece"]) + b"\n"
        if 1 < len(raw) <= left[r["lang"]]:
            parts.setdefault(r["lang"], []).append(raw)
            left[r["lang"]] -= len(raw)
    return {lang: b"".join(reversed(parts[lang])) for lang in sorted(parts)}


def _compressors(dictionaries: dict[str, bytes]) -> list:
    """Each language's compressor, by name; built once per worker."""
    import zstandard as z

    key = b"\0".join(dictionaries[k] for k in sorted(dictionaries))
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        made = []
        for lang in sorted(dictionaries):
            content = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            made.append(z.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))
        _COMPRESSORS[key] = made
        remember("langid", _COMPRESSORS.clear)
    return _COMPRESSORS[key]


def compressed_sizes(text: str, compressors: list) -> list[int]:
    """Bytes that the text takes with each language's dictionary, over both word orders."""
    raw = plain_bytes(text)
    blocks = [x[i : i + BLOCK] for x in (raw, b" ".join(raw.split()[::-1])) for i in range(0, len(x), BLOCK)]
    return [sum([len(c.compress(x)) for x in blocks]) for c in compressors]


def predict(text: str | None, names: list[str], compressors: list) -> tuple[str, float, float]:
    """(language, score, margin) of one text."""
    if not names or text is None or not any(map(str.isalpha, text)):  # letters of Unicode: not digits, fractions or numerals
        return UNDETERMINED, 0.0, 0.0
    sizes = np.array(compressed_sizes(text, compressors), float)
    order = np.argsort(sizes, kind="stable")
    best = sizes[order[0]]
    margin = (sizes[order[1]] - best) / best if len(sizes) > 1 else 1.0
    weights = np.exp2(-(sizes - best) / max(1.0, 0.02 * best))
    return names[order[0]], float(1 / weights.sum()), float(margin)


def _learn(docs: DataFrame, held_out: Column) -> dict[str, bytes]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return sample_dictionaries(rows.filter(~F.coalesce(held_out, F.lit(True))).select("text", "lang"))


def keep_identified(docs: DataFrame, held_out: Column, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs, with all their columns, that ``identify_languages`` would not reject.

    Null, empty and letterless texts go, as do all rows where no language could be learnt; repeated rows and
    rows with a null doc_id are judged by their text like any other; an empty table stays empty.
    """
    import pyarrow as pa

    dictionaries = _learn(docs, held_out)
    names = sorted(dictionaries)

    def run(batches):
        compressors = _compressors(dictionaries) if names else []
        for batch in batches:
            keep = []
            for lo in range(0, len(batch), 256):
                for text in batch.column("text").slice(lo, 256).to_pylist():
                    lang, _, margin = predict(text, names, compressors)
                    keep.append(lang != UNDETERMINED and margin >= min_margin)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema, memo="langid")


def identify_languages(docs: DataFrame, held_out: Column, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Predict every document's language: doc_id, held_out, lang_pred, score, margin, rejected.

    docs: doc_id, text, lang; other columns are ignored.  ``held_out`` is an expression over doc_id; such
    rows, and those with a null doc_id, text or lang, are not learnt from.  Predictions use the text alone.
    A null text, or one without any letter, is ``und`` with score 0 and rejected, as is every text where
    nothing could be learnt.  ``score`` is the winner's share under weights 2**(-bytes) tempered by length,
    0 to 1; ties go to the first language by name, with margin 0.  Rows that repeat are predicted each.
    """
    import pyarrow as pa

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    dictionaries = _learn(docs, held_out)
    names = sorted(dictionaries)

    def run(batches):
        compressors = _compressors(dictionaries) if names else []
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                found = [predict(text, names, compressors) for text in part.column("text").to_pylist()]
                pred, score, margin = ([f[k] for f in found] for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score", "margin"],
                )

    out = map_arrow(rows.select("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, margin double", memo="langid")
    return out.withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("margin") < min_margin))
