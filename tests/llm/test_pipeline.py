"""The pipeline stage by stage against what each stage's operator says of its own input."""

import collections
import os

import corpus_pipeline
from compare import plain
from depweave.llm import exact_dedup, langid, minhash_dedup, quality
from depweave.llm.common import Scratch, crc32_mod
from depweave.sources.scratch import owned_folders, shared_dir
from pyspark.sql import functions as F
from test_near_dup import brute
from test_packing import check


def test_stages(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scratch, docs, seen = Scratch(spark, "stages"), documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == documents.columns
            assert docs.exceptAll(before).count() == 0
        if name == "quality":
            good = quality.classify_quality(before, labels, crc32_mod(F.col("doc_id"), 3) == 1).filter("predicted = 1")
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r["doc_id"] for r in good.collect())
            bad = {r["doc_id"] for r in labels.collect() if r["quality"] == 0}
            assert len(bad & {r["doc_id"] for r in docs.collect()}) <= 0.1 * len(bad)
        if name == "language":
            gone = langid.identify_languages(before, crc32_mod(F.col("doc_id"), 5) == 0).filter("rejected")
            assert docs.count() == before.count() - gone.count() and docs.count() > 0.98 * before.count()
        if name == "exact_dedup":
            assert docs.count() == exact_dedup.deduplicate(before).select("text_sha256").distinct().count()
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = {eval(x)[2] for x in brute(rows)}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "packing":
            check([(r["doc_id"], r["text"]) for r in before.collect()], docs.collect())
    count = lambda df: collections.Counter(str([plain(r[c]) for c in ("doc_id", "start", "length", "ids_crc32")]) for r in df.collect())
    assert count(corpus_pipeline.run(spark, sf_dir)) == count(seen["packing"])


def test_stages_on_odd_rows(spark, sf_dir, messy, nothing):
    """Null and empty texts and ids, ties and repeated rows go through every stage; each keeps what its operator says."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scratch = Scratch(spark, "odd")
    for rows in (messy, nothing):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
            if name != "packing":
                assert docs.columns == rows.columns and docs.exceptAll(before).count() == 0
            if name == "quality":
                assert docs.count() == quality.classify_quality(before, labels, crc32_mod(F.col("doc_id"), 3) == 1).filter("predicted = 1").count()
            if name == "language":
                assert docs.count() == langid.identify_languages(before, crc32_mod(F.col("doc_id"), 5) == 0).filter("not rejected").count()
                assert docs.filter("text is null or text = ''").count() == 0
            if name == "exact_dedup":
                assert docs.count() == exact_dedup.deduplicate(before).select("text_sha256").distinct().count()
            if name == "near_dedup":
                named = minhash_dedup.near_duplicates(before)
                assert docs.count() == named.filter("kept or component_id is null").count()
            if name == "packing":
                check([(r["doc_id"], r["text"]) for r in before.collect()], docs.collect())


def folders(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_run_leaves_only_its_result(spark, sf_dir):
    """Its own result stays, and so does what another caller in the process has made meanwhile."""
    before = folders(spark)
    other = Scratch(spark, "other-caller")
    table = other.write(spark.range(3), "kept")
    with owned_folders(spark) as mine:
        inner = Scratch(spark, "inner-caller")
        inner.write(spark.range(2), "gone")
        with owned_folders(spark):
            assert corpus_pipeline.run(spark, sf_dir).count() > 0
        assert mine == [inner.root]
    assert table.count() == 3
    assert {x.rsplit("-", 1)[0] for x in folders(spark) - before} == {"other-caller"}
