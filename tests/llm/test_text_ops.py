"""Exact dedup, line dedup, SentencePiece, URLs and media: brute force and round trips."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from depweave.llm import exact_dedup, line_dedup, media, sentencepiece_bpe as SP, url_filter as U
from depweave.llm.common import Scratch, shared_dir

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- exact dedup
def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (i, _), x in zip(rows, norm, strict=True):
        groups[x].append(i)
    low = {x: min((i for i in g if i is not None), default=None) for x, g in groups.items()}
    return sorted(str((i, low[x], len(groups[x]), i == low[x], sha(x))) for (i, _), x in zip(rows, norm, strict=True))


def exact_rows(df):
    return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in df.collect())


def test_exact(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert exact_rows(exact_dedup.deduplicate(messy)) == brute_exact(rows)
    assert exact_dedup.deduplicate(nothing).count() == 0
    kept = exact_dedup.keep_first(messy)
    assert kept.columns == messy.columns and sum(r["doc_id"] == 13 for r in kept.collect()) == 0  # 4 has the same text
    assert kept.filter("text = 'one two'").count() == 1


def test_bytes_are_compared_when_digests_collide(messy):
    weak = lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2).cast("string"))
    one = lambda c: F.lit(b"same") if c is not None else None
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for digest in (weak, one):
        assert exact_rows(exact_dedup.deduplicate(messy, digest=digest)) == brute_exact(rows)


def test_state_goes_on(spark):
    scratch = Scratch(spark, "state-test")
    schema = "doc_id long, locator string, digest binary, text_sha256 string"
    source, state = f"{scratch.root}/in", f"{scratch.root}/checkpoint"
    for part in ([(5, "f", b"a"), (6, "f", b"b")], [(3, "g", b"a"), (9, "g", b"c")]):
        spark.createDataFrame([(i, f, d, "") for i, f, d in part], schema).write.mode("append").parquet(source)
        out = {bytes(r["digest"]): (r["keep_id"], r["locator"], r["group_size"]) for r in exact_dedup.update_state(source, schema, scratch, state).collect()}
    assert out == {b"a": (3, "g", 2), b"c": (9, "g", 1)}  # what the second run touched, on top of the first's state


@pytest.mark.parametrize("weak", [False, True])
def test_two_deliveries_give_the_result_of_one(spark, messy, weak):
    digest = (lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2).cast("string"))) if weak else exact_dedup.sha256_digest
    state = Scratch(spark, "deliveries").root
    first, second = messy.filter("coalesce(doc_id, 0) % 2 = 0"), messy.filter("coalesce(doc_id, 0) % 2 = 1")
    assert exact_rows(exact_dedup.deduplicate(first, state, digest)) == brute_exact([(r["doc_id"], r["text"]) for r in first.collect()])
    whole = brute_exact([(r["doc_id"], r["text"]) for r in messy.collect()])
    later = exact_rows(exact_dedup.deduplicate(second, state, digest))
    assert len(later) == second.count() and set(later) <= set(whole)
    assert exact_rows(exact_dedup.deduplicate(messy.filter("false"), state, digest, every_delivery=True)) == whole


# --- line dedup
def brute_lines(rows):
    docs = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    first = {k: min(v, key=order) for k, v in docs.items() if len(k) >= 10}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if first.get(key(x), i) == i]
        out.append(str((i, len(lines), len(lines) - len(keep), sha("\n".join(keep)))))
    return sorted(out)


def test_lines(spark, messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = sorted(str((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"])) for r in line_dedup.deduplicate_lines(messy).collect())
    assert got == brute_lines(rows)
    assert line_dedup.deduplicate_lines(nothing).count() == 0
    texts = line_dedup.deduplicate_lines(messy, with_text=True).collect()
    assert all(sha(r["kept_text"]) == r["kept_sha256"] for r in texts)


def test_a_line_that_everyone_shares(spark):
    rnd = random.Random(4)
    rows = [(k, "\n".join(rnd.choice(["the very common line", " The very COMMON line\t", f"own line number {k}", "short", "another shared line"]) for _ in range(rnd.randint(0, 9)))) for k in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted(str((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"])) for r in line_dedup.deduplicate_lines(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_lines(rows)


def test_bitmaps():
    packed = zlib.compress(np.packbits(np.array([1, 0, 1, 1, 1, 1, 1, 1], np.uint8), bitorder="little").tobytes())
    assert line_dedup.read_bitmap(packed, 11).tolist() == [True, False] + [True] * 9


# --- sentencepiece
def test_encode_decode(messy, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = SP.encode_decode(messy, MODEL, with_ids=True).collect()
    want = collections.Counter((r["doc_id"], ",".join(map(str, sp.encode(r["text"] or "")))) for r in messy.collect())
    assert collections.Counter((r["doc_id"], ",".join(map(str, r["ids"]))) for r in rows) == want
    for r in rows:
        assert r["decoded"] == sp.decode(r["ids"]) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == sha(",".join(map(str, r["ids"]))) and r["decoded_sha256"] == sha(r["decoded"])
    assert SP.encode_decode(nothing, MODEL).count() == 0


def test_encode_random_texts():
    sp, table, rnd = sentencepiece.SentencePieceProcessor(model_file=MODEL), SP.PieceTable(MODEL), random.Random(9)
    parts = [" ", "  ", "a", "the", "▁", "é", "\n", "\t", "́", "漢", "😀", "<s>", "<unk>", "<0x0A>", "22", "....", "—", "\x00", "ing", "er", "ß", "'s", "ﬁ", "   ", "====", "aaaa"]
    for _ in range(4000):
        x = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        ids = sp.encode(x)
        assert table.encode(x) == ids and table.ids_and_text(x) == (",".join(map(str, ids)), sp.decode(ids)) and table.decode(ids) == sp.decode(ids)


#: Bytes that, put after a model, override one of its settings: white space, dummy prefix, the model's type.
@pytest.mark.parametrize("setting", [b"\x1a\x02\x20\x01", b"\x1a\x02\x18\x00", b"\x12\x02\x18\x01"])
def test_models_with_other_settings_are_refused(tmp_path, setting):
    with open(MODEL, "rb") as f:
        (tmp_path / "m.model").write_bytes(f.read() + setting)
    with pytest.raises(ValueError):
        SP.PieceTable(str(tmp_path / "m.model"))


def test_memo_starts_anew_between_texts(monkeypatch):
    monkeypatch.setattr(SP, "MEMO_CHUNKS", 3)
    sp, table, rnd = sentencepiece.SentencePieceProcessor(model_file=MODEL), SP.PieceTable(MODEL), random.Random(5)
    parts = ["\x00", "▁▁", "<unk>", "é", "word", " ", "\n", "x" * 40, "漢"]  # some chunks do not come back as they were
    for _ in range(400):
        x = " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        ids = sp.encode(x)
        assert table.ids_and_text(x) == (",".join(map(str, ids)), sp.decode(ids))


def test_pairs_are_compatible_exactly_when_merging_keeps_them_apart():
    table, rnd = SP.PieceTable(MODEL), random.Random(3)
    pieces = [p for p in table.id if p in table.made or len(p) == 1]
    assert table.ordered
    for _ in range(4000):
        a, b = rnd.choice(pieces), rnd.choice(pieces)
        assert table._stay_apart(a, b) == (table._merged(a + b) == [a, b])


# --- urls
RULES = [("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False)]


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fit = [(len(h + p), h + p, ok) for h, p, ok in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], "allow" if max(fit)[2] else "block") if fit else (host, path, None, "allow")


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://ORG/", "https://a.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/en/2", "https://notexample.org/es/", "https://x.com/fr/1",
        "https://com/de/", "https://b.com/DE/", "http://example.org", "http://example.org?x=/es/", "a://b://org/", "http://org./", "http://.org/", "http://é.org/ü", "http://x.com/fr/\nline", "https://example.org:80/es/",
    ]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    out = U.judge_urls(df, [U.Rule(*r) for r in RULES])
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out.orderBy("page_id").collect()] == [judge(u) for u in urls for _ in range(2)]
    assert U.judge_urls(df.filter("false"), [U.Rule(*r) for r in RULES]).count() == 0
    assert {r["verdict"] for r in U.judge_urls(df, [], default_allow=False).collect()} == {"block"}
    with pytest.raises(ValueError):
        U.judge_urls(df, [U.Rule("a", "/", True), U.Rule("a", "/", False)])


def test_urls_by_a_table_of_rules_and_beyond_the_cascades(spark, monkeypatch):
    rnd = random.Random(1)
    hosts = [f"{a}.{b}" for a in ("www", "x", "news") for b in ("com", "org", "example.org")]
    urls = [f"https://{rnd.choice(hosts)}/{rnd.choice(['fr', 'de', 'es', 'en'])}/{rnd.randint(0, 20)}" for _ in range(300)] + [None]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    table = spark.createDataFrame(RULES + RULES[:2], "host string, path string, allow boolean")
    rows = lambda rules: [tuple(r)[1:] for r in U.judge_urls(df, rules).orderBy("page_id").collect()]
    want = [judge(u) for u in urls]
    assert rows(table) == want
    monkeypatch.setattr(U, "MAX_WORDS", 0)
    assert rows(table) == rows([U.Rule(*r) for r in RULES]) == want


def test_a_long_list(spark):
    rules = [U.Rule(f"host{k}.example.com", "/", k % 2 == 0) for k in range(20_000)]
    df = spark.range(0, 40_000, 7).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.host"), "id", F.lit(".example.com/x")).alias("url"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge_urls(df, rules).collect()}
    assert all(v == ((f"host{k}.example.com/", "allow" if k % 2 == 0 else "block") if k < 20_000 else (None, "allow")) for k, v in got.items())


def test_a_list_of_many_shards_keeps_its_cascades(spark, monkeypatch):
    """Beyond the bound of one plan the keys are dealt into shards; verdicts are those of one cascade."""
    rules = [U.Rule(f"h{k % 60}.example.com", f"/p{k // 60}", k % 3 == 0) for k in range(600)] + [U.Rule("com", "/", False)]
    rows = [(k, f"http://{'www.' if k % 2 else ''}H{k % 70}.example.{'com' if k % 5 else 'net'}/p{k % 12}/x?q") for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    judged = lambda: sorted(map(str, U.judge_urls(df, rules).collect()))
    want, made = judged(), []
    build = U._sharded_cascades
    monkeypatch.setattr(U, "MAX_WORDS", 12)
    monkeypatch.setattr(U, "_sharded_cascades", lambda *a: made.append(build(*a)) or made[-1])
    assert judged() == want
    assert len(made[0]) >= 3 and all(c.words <= 12 or c.words <= 3 * U.FEW for pair in made[0] for c in pair)
    assert U.expected_words(10**8, 10**10) / 500_000 < 60  # a hundred million keys take so many passes


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.filter("crc32(key) % 9 = 0")
    cascade = U.build_cascade(listed, universe, Scratch(spark, "cascade"), 20000)
    assert len(cascade.levels) > 2
    got = {r["key"] for r in universe.filter(cascade.holds(F.col("key"))).collect()}
    assert got == {r["key"] for r in listed.collect()}
    assert cascade.words * 64 < 20 * len(got)


# --- media
def test_media(messy, nothing):
    import pyarrow as pa

    rows = media.audio_features(messy, with_media=True).collect()
    by_text = collections.defaultdict(set)
    for r, (i, text) in zip(sorted(rows, key=lambda r: str(r["doc_id"])), sorted(((m["doc_id"], m["text"]) for m in messy.collect()), key=lambda m: str(m[0])), strict=True):
        if i in (None, 13):
            continue
        raw = (text or "").encode()
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert media.read_wave(bytes(r["media"])) == want
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
        by_text[text or ""].add(r["feature"])
        with pa.ipc.open_stream(io.BytesIO(bytes(r["tensors"]))) as stream:
            table = stream.read_all()
        assert table.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), [media.TENSOR_FRAMES, media.MELS])
        assert all(a.as_py() < b.as_py() for a, b in zip(table["start"], table["end"], strict=True))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.audio_features(nothing).count() == 0


def test_resampling_is_polyphase_filtering():
    x = np.random.default_rng(0).normal(size=576)
    taps = media._phases()[:, ::-1].T.ravel()
    wide = np.zeros(len(x) * media.UP)
    wide[:: media.UP] = x
    want = np.convolve(wide, taps)[:: media.DOWN][: len(x) * media.UP // media.DOWN]
    assert np.allclose(media.resample(x), want)


def test_a_tone_is_in_its_band_and_bursts_are_segments():
    t = np.arange(16000) / media.RATE
    tone = np.where((t > 0.5) & (t < 1.0), np.sin(2 * np.pi * 1000 * t), 0)
    mel, energy = media.log_mel((128 + 100 * tone).astype(np.uint8))
    loud = media.seconds(media.segments(energy))
    assert len(loud) == 1 and abs(loud[0, 0] - 0.5) < 0.05 and abs(loud[0, 1] - 1.0) < 0.05
    k = media._filters().argmax(axis=0) * media.RATE * 0.75 / media.FRAME
    assert abs(k[mel[len(mel) * 3 // 8].argmax()] - 1000) < 250


def test_hysteresis_holds_between_thresholds():
    e = np.array([0, 0, 10, 3, 3, 0, 0, 0, 3, 0], float)
    assert media.segments(e).tolist() == [[2, 5]]


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_the_end_of_a_text_lies_in_a_frame():
    for k in (1, 2, 5):
        quiet = np.full(k * media.UNIT, 128, np.uint8)
        loud = quiet.copy()
        loud[-40:-8] += np.tile(np.array([90, 0], np.uint8), 16)
        assert not np.array_equal(media.log_mel(quiet)[0], media.log_mel(loud)[0])


def test_features_in_blocks_equal_features_of_the_whole(monkeypatch):
    samples = np.random.default_rng(8).integers(0, 256, 40 * media.UNIT, dtype=np.uint8)
    whole = media.log_mel(samples)
    monkeypatch.setattr(media, "BLOCK", 12)
    for a, b in zip(whole, media.log_mel(samples), strict=True):
        assert np.allclose(a, b)
    x = media.resample((samples.astype(float) - 128) / 128)
    frames = [np.pad(x[k : k + media.FRAME], (0, max(0, media.FRAME - len(x[k:])))) for k in range(0, len(x) - media.FRAME + media.HOP, media.HOP)]
    power = np.abs(np.fft.rfft(np.array(frames) * np.hanning(media.FRAME), axis=1)) ** 2
    assert np.allclose(whole[1], np.log(power.sum(axis=1) + 1e-6)) and len(whole[0]) == len(frames)


def test_the_query_returns_tensors_and_spans(spark, sf_dir):
    import pyarrow as pa

    from depweave.llm.queries import op10_media

    row = op10_media(spark, sf_dir).filter("n_bytes > 3000").first()
    with pa.ipc.open_stream(io.BytesIO(bytes(row["tensors"]))) as stream:
        table = stream.read_all()
    assert table.schema.field("tensor").type.shape == [media.TENSOR_FRAMES, media.MELS]
    assert f"tensors={table.num_rows} segments={len(row['spans'])} " in row["feature"]
    assert all(s["start"] < s["end"] for s in row["spans"])
