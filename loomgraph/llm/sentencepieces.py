"""SentencePiece encoding and decoding of a BPE model, without backtracking.

Merge-type prefix table: the encoding of every prefix of a text ends in one token only. That
token is the vocabulary match ending there (found by an Aho-Corasick automaton) that is
compatible with the last token of the prefix before it: two tokens are compatible when merging
their joint string from scratch gives the two of them again. The ids are then recovered
backwards through the table. Pieces with a space only at their front let a text be cut
before its words; the same word is encoded once in a worker.

Defined results: null is the empty text; the empty text has only the begin and end ids and decodes
to "". Characters without a piece become their UTF-8 bytes' pieces. Repeated rows give
repeated rows; no row is dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text, record

SPACE = "▁"
#: Distinct words, and compatible pairs, whose results a worker keeps; beyond it starts anew.
KEPT = 250_000


class _Known(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, word):
        ids = self.make(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class PieceCodec:
    """Encodes and decodes with the model file of a sentencepiece BPE model (byte fallback, identity normaliser)."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.vocab_size()
        if not model.encode(" a  ", out_type=str)[-1].endswith(SPACE):
            raise ValueError("only models that keep all white space are supported")
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: list[bytes] = [np.array([self.unk], "<u4").tobytes()] * 256
        self.raw: list[bytes] = []
        self.is_byte = np.zeros(n, dtype=bool)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.is_byte[i] = True
                self.byte[int(piece[3:5], 16)] = np.array([i], "<u4").tobytes()
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.raw.append(b"")
            elif model.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.id[piece], self.score[piece] = i, model.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.chars = {p for p in self.id if len(p) == 1}
        self.inside = {two for p in self.id for two in zip(p, p[1:])}
        self.id_bytes = {p: np.array([i], "<u4").tobytes() for p, i in self.id.items()}
        apart = all(SPACE not in p.lstrip(SPACE) for p in self.id)
        cuts = "\n" if not any("\n" in p for p in self.id) else ""
        self.words = re.compile(f"{SPACE}*[^{SPACE}{cuts}]+|{SPACE}+" + "|\n" * bool(cuts)) if apart else re.compile("(?s:.+)")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known = _Known(self._ids_of_word)

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging the best-scored neighbours, the leftmost first, over and over."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            found = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def tokens(self, text: str) -> list[str]:
        """The pieces (or characters without one) of a text whose spaces are marks."""
        last: list[str | None] = [None] * (len(text) + 1)
        last[0] = ""
        pairs = self.pairs
        for end, (piece, size) in self._matches(text):
            end += 1
            if last[end] is None and (before := last[end - size]) is not None:
                fits = pairs.get((before, piece))
                if self.compatible(before, piece) if fits is None else fits:
                    last[end] = piece
        out, i = [], len(text)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def _matches(self, text: str) -> Iterator[tuple[int, tuple[str, int]]]:
        if self.chars.issuperset(text):
            return self.automaton.iter(text)
        found = list(self.automaton.iter(text))
        found += [(i, (ch, 1)) for i, ch in enumerate(text) if ch not in self.id]
        return iter(sorted(found, key=lambda m: m[0]))

    def _ids_of_word(self, word: str) -> bytes:
        """Ids of a word, from those of its parts: no piece reaches over two characters that stand together in none."""
        if len(word) > 1:
            cuts = [i for i, two in enumerate(zip(word, word[1:]), 1) if two not in self.inside]
            if cuts:
                return b"".join(self.known[word[i:j]] for i, j in zip([0, *cuts], [*cuts, len(word)]))
        ids = self.id_bytes
        return b"".join([ids[t] if t in ids else b"".join(self.byte[b] for b in t.encode("utf-8", "replace")) for t in self.tokens(word)])

    def encode(self, text: str, ends: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT:
            self.known.clear()
        body = b"".join(map(self.known.__getitem__, self.words.findall(SPACE + text.replace(" ", SPACE)))) if text else b""
        return np.array([self.bos], "<u4").tobytes() + body + np.array([self.eos], "<u4").tobytes() if ends else body

    def decode(self, ids: bytes | Iterable[int]) -> bytes:
        """The text of the ids, in UTF-8. One space at the front is that which encoding put there."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.array(list(ids), dtype=np.uint32)
        out = b"".join(map(self.raw.__getitem__, ids.tolist()))
        inner = ids[1:-1]
        try:
            if ((inner == self.bos) | (inner == self.eos)).any():
                raise ValueError("bytes on either side of a control id aren't one character")
            out.decode()
        except ValueError:  # byte pieces that are no character: each byte by itself becomes U+FFFD
            parts: list[bytes] = []
            for i in ids.tolist():
                if self.is_byte[i] and parts and isinstance(parts[-1], bytearray):
                    parts[-1] += self.raw[i]
                else:
                    parts.append(bytearray(self.raw[i]) if self.is_byte[i] else self.raw[i])
            out = b"".join(_repaired(bytes(p)) if isinstance(p, bytearray) else p for p in parts)
        words = ids[(ids != self.bos) & (ids != self.eos)]
        front = len(words) and not self.is_byte[words[0]] and self.raw[words[0]].startswith(b" ") and words[0] != self.unk
        return out[1:] if front else out


def _repaired(raw: bytes) -> bytes:
    out, i = b"", 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                raw[i : i + k].decode()
            except UnicodeDecodeError:
                continue
            if len(raw[i : i + k]) == k:
                out, i = out + raw[i : i + k], i + k
                break
        else:
            out, i = out + "�".encode(), i + 1
    return out


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """The worker's codec of a model; it and its words live as long as the worker."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, ids array<int> with begin and end ids, decoded string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield record(schema, batch.column(0).cast(pa.int64()), [np.frombuffer(x, "<i4") for x in ids], [c.decode(x).decode() for x in ids])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens (all ids), SHA-256 of the ids and of the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield record(_DIGESTS, batch.column(0).cast(pa.int64()), n, ids_sha, text_sha)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), model_path())
