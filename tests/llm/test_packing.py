"""Packing: exact cover by tokens, little padding, a sound pattern program."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from depweave.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference_ids(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [np.array(e.ids + [2], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, pieces, capacity=4096):
    """Pieces cover each row's ids once; sequences are gapless and within capacity."""
    want = sorted((str(i), zlib.crc32(ids[s : s + capacity].tobytes()), s, len(ids[s : s + capacity]), len(ids))
                  for (i, _), ids in zip(rows, reference_ids([t or "" for _, t in rows]), strict=True) for s in range(0, len(ids), capacity))
    assert sorted((str(p["doc_id"]), p["ids_crc32"], p["start"], p["length"], p["doc_tokens"]) for p in pieces) == want
    at = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= capacity for n in at.values())
    return 1 - sum(at.values()) / (capacity * max(1, len(at)))


def test_messy_rows(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    check(rows, P.pack_documents(messy, PATH).collect())
    assert P.pack_documents(nothing, PATH).count() == 0


def test_documents(documents, texts):
    pieces = P.pack_documents(documents, PATH, with_ids=True).collect()
    assert check(list(texts.items()), pieces) < 0.03
    assert all(zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] for p in pieces)


def test_ranks_over_salts(documents, texts, monkeypatch):
    monkeypatch.setattr(P, "SALT_ROWS", 20)
    check(list(texts.items()), P.pack_documents(documents, PATH).collect())


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_and_beat_greedy_packing(seed):
    rng = np.random.default_rng(seed)
    demand = {int(s): int(n) for s, n in zip(rng.choice(64, 20, replace=False) + 1, rng.integers(1, 3000, 20), strict=True)}
    patterns = P.solve_patterns(demand, 64)
    have = {}
    for times, pattern in patterns:
        assert times > 0 and sum(s * k for s, k in pattern.items()) <= 64
        for s, k in pattern.items():
            have[s] = have.get(s, 0) + times * k
    assert all(have.get(s, 0) >= n for s, n in demand.items())
    greedy, left = 0, dict(sorted(demand.items(), reverse=True))  # the largest that fits, again and again
    while any(left.values()):
        room = 64
        for s in left:
            k = min(left[s], room // s)
            left[s] -= k
            room -= k * s
        greedy += 1
    assert sum(s * n for s, n in demand.items()) / 64 <= sum(t for t, _ in patterns) <= greedy


def test_small_programs():
    assert P.solve_patterns({}, 8) == []
    assert sum(t for t, _ in P.solve_patterns({8: 3}, 8)) == 3
    assert sum(t for t, _ in P.solve_patterns({5: 10, 3: 10}, 8)) == 10
    assert sum(t for t, _ in P.solve_patterns({1: 17}, 8)) == 3


PARTS = ["a", "The", "É", "é", "ß", "x", "'s", "'", "’", "don't", ",", "!!", "#$", "—", "12", "²", "×", "÷", "J̌", "́", "漢字", "😀", "\x01", "\x1c", "\xa0", " ", "\n", "\x0b", "<|endoftext|>", "İ", "Σ", "_", "@x", "z" * 70, "7" * 65]


def columns(texts):
    import pyarrow as pa

    from depweave.llm.common import byte_groups

    return byte_groups(pa.array(texts), 1 << 12)


def test_units_are_cut_where_the_tokenizer_cuts():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(PARTS, rng.integers(0, 10))) for _ in range(6000)]
    memo = P._encoder(PATH)
    assert memo.cut
    for at, data, off in columns(texts):
        flat, bounds = memo.ids(data, off, 2)
        for i, want in enumerate(reference_ids(texts[at : at + len(off) - 1])):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == want.tolist(), texts[at + i]


def test_memo_starts_anew_and_slots_collide(monkeypatch):
    from depweave.llm import unit_memo

    monkeypatch.setattr(unit_memo, "SLOT_BITS", 8)
    monkeypatch.setattr(unit_memo, "MAX_UNITS", 200)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(60)) for _ in range(300)]
    memo = unit_memo.UnitMemo(P._encoder(PATH).encode)
    for at, data, off in columns(texts):
        flat, bounds = memo.ids(data, off, 2)
        for i, want in enumerate(reference_ids(texts[at : at + len(off) - 1])):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == want.tolist()
        assert memo.count <= 200


def test_a_tokenizer_that_looks_across_words_gets_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(PATH).read())
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    (tmp_path / "whole.json").write_text(json.dumps(spec))
    other = P._encoder(str(tmp_path / "whole.json"))
    assert isinstance(other, P.WholeTexts)
    texts = ["one two, three", "", "é è"]
    (_, data, off), = columns(texts)
    flat, bounds = other.ids(data, off, 2)
    t = Tokenizer.from_file(str(tmp_path / "whole.json"))
    for i, x in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids + [2]


def test_clashing_columns_are_carried(spark):
    rows = [(k, 0, 100 + k, 7, 100 + k, "a", "b", 3, 4) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size string, salt string, rank int, slot int")
    out = P.pack(df)
    assert out.columns == [*df.columns, "sequence_id", "offset"] and out.select(*df.columns).exceptAll(df).count() == 0 and out.count() == 50


def test_units_under_one_hash_keep_their_ids(documents, texts, monkeypatch):
    """Where the hash that units are found by fails, the check tells them apart."""
    from depweave.llm import unit_memo

    real = unit_memo.span_hashes
    monkeypatch.setattr(unit_memo, "span_hashes", lambda data, s, e: real(data, s, e) % np.uint64(50) << np.uint64(58))
    memo = unit_memo.UnitMemo(P._encoder(PATH).encode)
    some = [t for t in texts.values() if t][:40]
    for group in (some[:20], some[20:], some[:20]):
        raw = [t.encode() for t in group]
        data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        flat, bounds = memo.ids(data, off, 2)
        for k, want in enumerate(reference_ids(group)):
            assert (flat[bounds[k] : bounds[k + 1]] == want).all()
