"""SentencePiece BPE encoding and decoding by a table of last tokens.

For a BPE vocabulary, every prefix of a text has exactly one encoding, and it ends in one token: the last
token of prefix i is the vocabulary piece that ends at i and is *compatible* with the last token of the
prefix it leaves, which means that the two stay apart when their texts are encoded together.  The table
of last tokens is filled from left to right, with an automaton naming the pieces that end at a place; the
ids are then read backwards, from the last token to the first.

When no piece has a space after a non-space, or a line end (checked when the model is loaded), merges
never cross the start of a run of spaces or a line end; texts are cut there, and each distinct chunk is
encoded once per worker.  Within a chunk, words and punctuation are encoded apart and joined where the
tokens that meet are compatible.  Characters outside the vocabulary become byte pieces.

A model is refused (ValueError) when it is loaded if it normalizes texts, drops or moves spaces, has no dummy
prefix, lacks byte pieces, has unused pieces, or encodes a set of probes in another way than the table does.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, remember

SPACE = "▁"
MEMO_CHUNKS, MEMO_CHARS = 500_000, 30_000_000  # the memo starts anew, between texts, beyond these; about 200 bytes a chunk besides

_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
_UNIT = re.compile(rf"{SPACE}*\w+|{SPACE}*[^\w{SPACE}]+|{SPACE}+")
_MODELS: dict[str, PieceTable] = {}

#: Texts that a model must leave as they are, but for the space mark: outer and repeated spaces, controls, case, compatibility
#: and combining characters, invisible ones, the space mark itself.
PROBES = (
    "a", " a", "a ", "  a  b  ", " ", "   ", "a\tb", "a\nb", "\r\n", "a\x0bb\x0c", "Ab", "ÀÉ", "e\u0301", "\ufb01", "\uff21", "½²", "a\u00a0b", "a\u3000b",
    "a\u200bb", "\ufeffa", "\u2581a", "\ud7a3\u4e2d\U0001f600", "the quick, brown fox; jumps 12,345 times!", "aaaaaaaaaaaaaaaaa", "internationalisation",
)


class PieceTable:
    """The vocabulary as an automaton, with the pairs of tokens that never stay apart found by their merges."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        changed = [t for t in PROBES if model.normalize(t) != SPACE + t.replace(" ", SPACE)]
        if changed:
            raise ValueError(f"the model at {path} normalizes texts or has no dummy prefix: {changed}")
        self.unknown = model.unk_id()
        self.piece = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        normal = [i for i in range(len(self.piece)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {self.piece[i]: i for i in normal}
        order = sorted(normal, key=lambda i: (-model.get_score(i), i))
        #: Merges go by score; single characters are there from the start.
        self.rank = {self.piece[i]: k for k, i in enumerate(order)}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(len(self.piece)) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.text = [None if model.is_control(i) else p for i, p in enumerate(self.piece)]
        self.cut = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id)
        self.made: dict[str, tuple[int, str, str]] = {}  # rank and the two parts of the last merge
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self._reachable(p):
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.ordered = all(len(x) == 1 or x in self.made and self.made[x][0] < r for r, *parts in self.made.values() for x in parts)
        self.apart: dict[tuple[int, int], bool] = {}
        self._forget()
        if len(self.byte) < 256 or any(model.is_unused(i) for i in range(len(self.piece))):
            raise ValueError(f"the model at {path} lacks byte pieces or has unused ones")
        #: Symbols that a user defines are never split; they have no score.
        symbols = [f"a{self.piece[i]}b" for i in normal if model.get_score(i) >= 0]
        other = [t for t in (*PROBES, *symbols) if model.encode(t) != self.encode(t)]
        if other:
            raise ValueError(f"the model at {path} does not encode by merges of best score alone: {other[:5]}")

    def _merged(self, text: str) -> list[str]:
        """Plain merging of adjacent symbols, best score first and then leftmost; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 40:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _reachable(self, piece: str) -> bool:
        """Whether the piece's own text encodes to it alone; others can never be a token. Notes its last merge."""
        if len(piece) == 1:
            return True
        parts, before = list(piece), list(piece)
        while len(parts) > 1:
            due, k = min((self.rank.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if due == 1 << 40:
                return False
            before = parts
            parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
        self.made[piece] = (self.rank[piece], before[0], before[1])
        return True

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when their texts meet."""
        known = self.apart.get((a, b))
        if known is None:
            known = self._stay_apart(self.piece[a], self.piece[b])
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            self.apart[a, b] = known
        return known

    def _stay_apart(self, a: str, b: str) -> bool:
        """Undo the merges that made a and b, latest first, looking for one across their border that was due earlier.

        Needs pieces whose parts were merged before them, which holds for trained vocabularies and is
        checked when the model is loaded; else the two texts are merged together.
        """
        if not self.ordered:
            return self._merged(a + b) == [a, b]
        limit = 1 << 40
        while True:
            if self.rank.get(a + b, limit) < limit:
                return False
            x, y = self.made.get(a), self.made.get(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and x[0] > y[0]:
                limit, a = x[0], x[2]
            else:
                limit, b = y[0] + 1, y[1]

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of a text, recovered backwards through the table of last tokens."""
        whole = self.id.get(text)
        if whole is not None and self.automaton.exists(text):
            return [whole]
        n = len(text)
        last = [-1] * (n + 1)  # token that ends each prefix; -1: a character without a piece, or the start
        apart, compatible, done = self.apart.get, self._compatible, -1
        for at, (length, token) in self.automaton.iter(text):
            if at == done:
                continue
            before = last[at + 1 - length]
            if before == -1 or (apart((before, token)) or compatible(before, token)):
                last[at + 1] = token
                done = at
        ids: list[int] = []
        i = n
        while i:
            token = last[i]
            if token == -1:
                raw = text[i - 1].encode("utf-8", "surrogatepass")
                ids += [self.byte[b] for b in reversed(raw)]
                i -= 1
            else:
                ids.append(token)
                i -= len(self.piece[token])
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: byte pieces joined to characters, space marks turned back, the dummy space dropped."""
        out, raw = [], bytearray()
        back = self.byte_of
        for token in ids:
            if token in back:
                raw.append(back[token])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(" ⁇ " if token == self.unknown else self.text[token] or "")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).removeprefix(SPACE).replace(SPACE, " ")

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return _CHUNK.findall(marked) if self.cut else [marked]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.encode_chunk(c)]

    def learn(self, chunk: str) -> str:
        """The ids of a chunk, kept for the next time; decoding them is tried at once."""
        units = _UNIT.findall(chunk)
        ids: list[int] = []
        if len(units) > 1:
            for unit in units:
                known = self.memo.get(unit) or self.learn(unit)
                more = [int(i) for i in known.split(",")]
                if ids and not (ids[-1] in self.byte_of or more[0] in self.byte_of or self.unknown in (ids[-1], more[0]) or self._compatible(ids[-1], more[0])):
                    ids = self.encode_chunk(chunk)
                    break
                ids += more
        else:
            ids = self.encode_chunk(chunk)
        back = self.decode([self.id.get(SPACE, 0), *ids])
        if back != chunk.replace(SPACE, " "):
            self.odd[chunk] = back
        out = self.memo[chunk] = ",".join(map(str, ids))
        self.held += len(chunk) + len(out)
        return out

    def _forget(self) -> None:
        self.memo: dict[str, str] = {}  # ids of a chunk as text
        self.odd: dict[str, str] = {}  # decoded texts of chunks that do not come back as they were
        self.held = 0  # characters in the memo

    def ids_and_text(self, text: str) -> tuple[str, str]:
        """The text's ids, joined by commas, and what they decode to."""
        if len(self.memo) >= MEMO_CHUNKS or self.held >= MEMO_CHARS:
            self._forget()
        chunks = self.chunks(text)
        memo, learn = self.memo.get, self.learn
        ids = ",".join([memo(c) or learn(c) for c in chunks])
        odd = self.odd
        decoded = "".join([odd.get(c, c) for c in chunks] if odd else chunks)
        return ids, decoded[1:].replace(SPACE, " ")


def _model(path: str) -> PieceTable:
    if path not in _MODELS:
        _MODELS[path] = PieceTable(path)
        remember("sentencepiece", _MODELS.clear)
    return _MODELS[path]


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded).

    The digests are lower-case hex, of the decimal ids joined by commas and of the decoded text in UTF-8.
    Null text counts as empty: no ids, an empty decoded text.  One row per input row, repeated ones and
    those with a null doc_id too; an empty table gives an empty table.
    """
    import pyarrow as pa

    def run(batches):
        table = _model(model_path)
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(batch), 256):
                n, ids_hex, text_hex, all_ids, all_text = [], [], [], [], []
                for text in texts.slice(lo, 256).to_pylist():
                    ids, decoded = table.ids_and_text(text or "")
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_hex.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hex.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32))
                        all_text.append(decoded)
                arrays = [batch.column("doc_id").slice(lo, 256), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, schema, memo="sentencepiece")
