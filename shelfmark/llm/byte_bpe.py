"""Byte-level BPE by a sentencepiece model that is written from the vocabulary.

A rank file lists byte strings; a token's rank is its id and the order of its
merge. `model` serialises a sentencepiece BPE model from it: every byte becomes
one character (byte b is the character U+0100 + b, so that no piece holds white
space or a control character), a piece's score is its negative rank, and the
normaliser is the identity. sentencepiece merges the adjacent pair of the best
score, leftmost first, which is the pair of the least rank. Pre-tokens (matches
of the pattern) are encoded separately; a pre-token that is itself a piece is
that piece. Ids decode through the inverse byte mapping of their pieces.

One narrow pass over the documents, no shuffle: a copy or a hot source costs no
more than any other row. A task keeps the pre-tokens it has met (about
`CACHE_WORDS`, then it starts anew) and cuts long texts where white space begins, a
place that no match crosses; a text without white space is one piece.

Defined cases: null and empty texts have no ids and decode to no bytes;
repeated rows are encoded each; ids of documents may be null or of any type; an
empty table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from shelfmark.session import bound_arrow_batches

CACHE_WORDS = 500_000
PIECE_CHARS = 200_000
OUT_IDS = 1_000_000        # ids in a frame that goes back to Spark

# Fixed values of sentencepiece's model format: field numbers, wire types, the model type BPE, the piece type UNKNOWN.
_VARINT, _BYTES, _FLOAT = 0, 2, 5
_MODEL_PIECES, _MODEL_TRAINER, _MODEL_NORMALIZER = 1, 2, 3
_PIECE_TEXT, _PIECE_SCORE, _PIECE_TYPE, _UNKNOWN = 1, 2, 3, 2
_TRAINER_TYPE, _BPE, _TRAINER_VOCABULARY = 3, 2, 4
_TRAINER_UNK, _TRAINER_BOS, _TRAINER_EOS, _TRAINER_PAD = 40, 41, 42, 43
_NORM_NAME, _NORM_PREFIX, _NORM_EXTRA, _NORM_ESCAPE = 1, 3, 4, 5

UNKNOWN_PIECE = "<unk>"
_CUT = regex.compile(r"(?<=\S)(?=\s)")


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; ranks must count from 0 without gaps and hold all single bytes."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes | None] = [None] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if any(t is None for t in tokens) or len({t for t in tokens if len(t) == 1}) != 256:
        raise ValueError("the ranks have gaps or lack single bytes")
    return tokens


def mapped(raw: bytes) -> str:
    """Bytes as characters from U+0100 on."""
    return raw.decode("latin-1").translate(_TO_PIECE)


def unmapped(piece: str) -> bytes:
    return piece.translate(_FROM_PIECE).encode("latin-1")


_TO_PIECE = {b: 0x100 + b for b in range(256)}
_FROM_PIECE = {c: b for b, c in _TO_PIECE.items()}


def _varint(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out + bytes([value]))


def _field(number: int, kind: int, value) -> bytes:
    head = _varint(number << 3 | kind)
    if kind == _VARINT:
        return head + _varint(value)
    if kind == _FLOAT:
        return head + np.array([value], dtype="<f4").tobytes()
    return head + _varint(len(value)) + value


def model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model in which a token's id is its rank; the unknown piece follows the last rank."""
    parts = []
    for rank, token in enumerate(tokens):
        piece = _field(_PIECE_TEXT, _BYTES, mapped(token).encode()) + _field(_PIECE_SCORE, _FLOAT, -rank)
        parts.append(_field(_MODEL_PIECES, _BYTES, piece))
    unknown = _field(_PIECE_TEXT, _BYTES, UNKNOWN_PIECE.encode()) + _field(_PIECE_SCORE, _FLOAT, 0.0) + _field(_PIECE_TYPE, _VARINT, _UNKNOWN)
    parts.append(_field(_MODEL_PIECES, _BYTES, unknown))
    trainer = _field(_TRAINER_TYPE, _VARINT, _BPE) + _field(_TRAINER_VOCABULARY, _VARINT, len(tokens) + 1)
    trainer += _field(_TRAINER_UNK, _VARINT, len(tokens))
    for absent in (_TRAINER_BOS, _TRAINER_EOS, _TRAINER_PAD):
        trainer += _field(absent, _VARINT, -1)
    normaliser = _field(_NORM_NAME, _BYTES, b"identity")
    for off in (_NORM_PREFIX, _NORM_EXTRA, _NORM_ESCAPE):
        normaliser += _field(off, _VARINT, 0)
    return b"".join(parts) + _field(_MODEL_TRAINER, _BYTES, trainer) + _field(_MODEL_NORMALIZER, _BYTES, normaliser)


class _Known:
    """Ids of the strings a task has met, one after the other in one array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.start, self.size = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.ids, self.end = np.zeros(4096, dtype=np.int32), 0

    def add(self, strings: list[str], lists: list[list[int]]) -> None:
        n, more = len(self.number), sum(map(len, lists))
        while n + len(strings) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.end + more > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self.size[n:n + len(lists)] = size
        self.start[n:n + len(lists)] = self.end + np.cumsum(size) - size
        self.ids[self.end:self.end + more] = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=more)
        self.end += more
        self.number.update(zip(strings, range(n, n + len(strings))))

    def of(self, strings: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.number.__getitem__, strings), dtype=np.int64, count=len(strings))
        return _gathered(self.ids, self.start[at], self.size[at])


def _gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return values[:0]
    return values[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]


class PieceBytes:
    """The bytes that ids stand for, by the inverse mapping of their pieces; they need not be whole characters."""

    def __init__(self, pieces: list[str]):
        raw = [unmapped(piece) for piece in pieces]
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return _gathered(self.bytes, self.start[ids], self.size[ids]).tobytes()


class Encoder:
    """Ids of texts and bytes of ids, for one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        tokens = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model(tokens))
        self.pattern = regex.compile(pattern)
        names = [self.processor.id_to_piece(i) for i in range(len(tokens))]
        self.whole = {piece: i for i, piece in enumerate(names)}
        self.pieces = PieceBytes(names)
        self.known = _Known()

    def _learn(self, words: set[str]) -> None:
        if len(self.known.number) > CACHE_WORDS:
            self.known = _Known()
        new = [w for w in words if w not in self.known.number]
        if new:
            pieces = [mapped(w.encode()) for w in new]
            found = self.processor.encode(pieces, num_threads=1)
            self.known.add(new, [f if self.whole.get(p) is None else [self.whole[p]] for p, f in zip(pieces, found)])

    def ids(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, in arrays of bounded size."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PIECE_CHARS) if at + PIECE_CHARS < len(text) else None
            end = cut.start() if cut else len(text)
            words = self.pattern.findall(text[at:end])
            self._learn(set(words))
            yield self.known.of(words)
            at = end

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of several short texts."""
        words = [self.pattern.findall(text) for text in texts]
        self._learn(set(chain.from_iterable(words)))
        return [self.known.of(own) for own in words]


def _groups(pairs: Iterator[tuple]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in groups of about PIECE_CHARS characters; a longer text is a group of its own."""
    ids, texts, chars = [], [], 0
    for doc_id, text in pairs:
        if chars + len(text) > PIECE_CHARS and texts:
            yield ids, texts
            ids, texts, chars = [], [], 0
        ids.append(doc_id)
        texts.append(text)
        chars += len(text)
    if texts:
        yield ids, texts


def encoded(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens long, ids array<int>, decoded binary) of every document."""
    vocabulary, pattern = vocabulary or vocabulary_path(), pattern or split_pattern()
    kind = documents.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary, pattern)
        ready, held = [], 0
        for ids_of, texts in _groups((i, t or "") for pdf in batches for i, t in zip(pdf["doc_id"], pdf["text"])):
            lists = encoder.ids_of(texts) if len(texts) > 1 else [np.concatenate([np.zeros(0, dtype=np.int32), *encoder.ids(texts[0])])]
            for doc_id, ids in zip(ids_of, lists):
                decoded = b"".join(encoder.pieces(ids[at:at + OUT_IDS]) for at in range(0, len(ids), OUT_IDS))
                ready.append((doc_id, len(ids), ids, decoded))
                held += len(ids) + 16
                if held >= OUT_IDS:
                    yield pd.DataFrame(ready, columns=["doc_id", "n_tokens", "ids", "decoded"])
                    ready, held = [], 0
        if ready:
            yield pd.DataFrame(ready, columns=["doc_id", "n_tokens", "ids", "decoded"])

    bound_arrow_batches(documents.sparkSession)
    # Ids travel as text so that nulls and any id type survive.
    light = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = light.mapInPandas(rows, "doc_id string, n_tokens long, ids array<int>, decoded binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def decoded(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) of rows (doc_id, ids); null ids decode to no bytes, an id outside the vocabulary is an error."""
    vocabulary = vocabulary or vocabulary_path()

    @F.pandas_udf("binary")
    def shown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = PieceBytes([mapped(token) for token in read_ranks(vocabulary)])
        for column in batches:
            yield pd.Series([b"" if ids is None else pieces(np.asarray(ids, dtype=np.int64)) for ids in column], dtype=object)

    return rows.select("doc_id", shown("ids").alias("decoded"))
