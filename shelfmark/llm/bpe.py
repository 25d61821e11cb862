"""BPE encoding and decoding over a distinct-word table.

Texts are split into words in Spark, block by block (a block holds about
`BLOCK_CHARS` characters of whole documents): the block keeps its distinct words
once and its documents as word numbers. The distinct words of all blocks meet by
hash bucket; each bucket encodes every distinct word once and returns ids to
the blocks, where they are joined back by position. Decoding looks every id up
in the id-to-piece table of the vocabulary and joins pieces by position.

Buckets grow in number with the words (about `BUCKET_WORDS` block words each),
blocks with the text, so neither grows in size. Words and ids travel packed.

The split repeats the tokenizer's own steps: special tokens are cut out of the
raw text, the rest is composed (NFC), lower-cased letter by letter, and matched
against the word pattern; so the ids equal the tokenizer's on the whole text.

Defined cases: null and empty texts have no ids and decode to the empty text;
repeated rows are encoded each; null ids of documents stay null; an empty table
gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.session import bound_arrow_batches, materialize

BLOCK_CHARS = 10_000_000
BUCKET_WORDS = 65_536
PIECE_CHARS = 200_000      # texts are split piece by piece at white space

# Fixed values of the vocabulary's word pattern and special tokens.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL_PATTERN = r"<\|startoftext\|>|<\|endoftext\|>"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _words_of(text: str, word, special) -> Iterator[list[str]]:
    """The words of a text in order, in lists of bounded size."""
    def plain(part: str) -> Iterator[list[str]]:
        at = 0
        while at < len(part):
            end = at + PIECE_CHARS
            if end < len(part):
                gap = regex.compile(r"\s").search(part, end)
                end = gap.start() if gap else len(part)
            piece = unicodedata.normalize("NFC", part[at:end])
            # Letter by letter: the final sigma has no form of its own.
            yield word.findall(piece.replace("Σ", "σ").lower())
            at = end

    at = 0
    for found in special.finditer(text):
        yield from plain(text[at:found.start()])
        yield [found.group()]
        at = found.end()
    yield from plain(text[at:])


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = value = len(self)
        return value


def split(documents: DataFrame) -> DataFrame:
    """Blocks of whole documents: (block, doc_ids, lengths, numbers, words, n_words).

    `numbers` are the packed word numbers of the documents one after the other,
    `words` the packed distinct words by number.
    """
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, special = regex.compile(WORD_PATTERN), regex.compile(SPECIAL_PATTERN)
        packer = zstandard.ZstdCompressor(level=9)
        task = TaskContext.get().partitionId()
        made = 0

        def packed(ids, lengths, parts, table):
            numbers = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
            # Frequent words get small numbers, equally frequent ones follow the alphabet: both pack better.
            uses = np.bincount(numbers, minlength=len(table)).tolist()
            ordered = sorted((-n, w, i) for (w, i), n in zip(table.items(), uses))
            renumbered = np.empty(len(table), dtype=np.uint32)
            renumbered[[i for _, _, i in ordered]] = np.arange(len(table), dtype=np.uint32)
            return pd.DataFrame({
                "block": [f"{task}-{made}"], "doc_ids": [ids], "lengths": [lengths],
                "numbers": [packer.compress(_varints(renumbered[numbers]))],
                "words": [packer.compress(" ".join(w for _, w, _ in ordered).encode("utf-8", "surrogatepass"))], "n_words": [len(table)],
            })

        ids, lengths, parts, table, chars = [], [], [], _Numbers(), 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                text = text or ""
                n = 0
                for words in _words_of(text, word, special):
                    parts.append(np.fromiter(map(table.__getitem__, words), dtype=np.uint32, count=len(words)))
                    n += len(words)
                ids.append(doc_id)
                lengths.append(n)
                chars += len(text) + 64
                if chars >= BLOCK_CHARS:
                    yield packed(ids, lengths, parts, table)
                    made += 1
                    ids, lengths, parts, table, chars = [], [], [], _Numbers(), 0
        if ids:
            yield packed(ids, lengths, parts, table)

    bound_arrow_batches(documents.sparkSession)
    # Ids travel as text so that nulls and any id type survive.
    light = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return light.mapInPandas(
        blocks, "block string, doc_ids array<string>, lengths array<long>, numbers binary, words binary, n_words long"
    )


def _unpack_words(blob: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass")
    return text.split(" ") if text else []


def _bucket_of(words: list[str], buckets: int) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint32, count=len(words)) % buckets


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values by byte position: equal high bytes lie together."""
    return values.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _varints(values: np.ndarray) -> bytes:
    """Seven bits to a byte, lowest first, the high bit on all but the last byte of a value."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= (1 << bits)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for i in range(5):
        has = size > i
        byte = (values[has] >> np.uint64(7 * i)) & np.uint64(127)
        out[start[has] + i] = byte + (size[has] > i + 1) * np.uint64(128)
    return out.tobytes()


def _from_varints(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint32)
    ends = np.flatnonzero(data < 128).astype(np.uint32)
    start = np.concatenate((np.zeros(1, dtype=np.uint32), ends[:-1] + np.uint32(1)))
    size = ends - start
    out = (data[start] & 127).astype(np.uint32)
    for i in range(1, 5):
        has = np.flatnonzero(size >= i)
        if not len(has):
            break
        out[has] |= (data[start[has] + i] & 127).astype(np.uint32) << np.uint32(7 * i)
    return out


def _pack_ids(lists: list[list[int]]) -> bytes:
    n = np.fromiter(map(len, lists), dtype=np.uint32, count=len(lists))
    ids = np.fromiter((i for ids in lists for i in ids), dtype=np.uint32, count=int(n.sum()))
    head = np.array([len(lists)], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=9).compress(head + _planes(n) + _planes(ids))


def _unpack_ids(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
    return _from_planes(raw[4:4 + 4 * k]).astype(np.int64), _from_planes(raw[4 + 4 * k:])


def word_ids(blocks: DataFrame, vocabulary: str) -> DataFrame:
    """(block, bucket, ids): ids of the block's words of each bucket, by word number; every distinct word is encoded once."""
    total = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    buckets = 1 << max(4, int(total // BUCKET_WORDS).bit_length())

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=9)
        for pdf in batches:
            for block, blob in zip(pdf["block"], pdf["words"]):
                words = np.array(_unpack_words(blob), dtype=object)
                if not len(words):
                    continue
                bucket = _bucket_of(words.tolist(), buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                parts = np.split(order, cuts)
                yield pd.DataFrame({
                    "block": [block] * len(parts), "bucket": [int(bucket[p[0]]) for p in parts],
                    "words": [packer.compress(" ".join(words[p]).encode("utf-8", "surrogatepass")) for p in parts],
                })

    loaded: list = []   # one tokenizer for all buckets of a task

    def encoded(pdf: pd.DataFrame) -> pd.DataFrame:
        if not loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(vocabulary))
            loaded[0].no_truncation()
            loaded[0].no_padding()
        tokenizer = loaded[0]
        lists = [_unpack_words(blob) for blob in pdf["words"]]
        distinct = list(dict.fromkeys(w for words in lists for w in words))
        table: dict[str, list[int]] = {}
        for at in range(0, len(distinct), 1024):
            part = distinct[at:at + 1024]
            table.update(zip(part, (e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False))))
        return pd.DataFrame({
            "block": pdf["block"], "bucket": pdf["bucket"], "ids": [_pack_ids([table[w] for w in words]) for words in lists],
        })

    posts = blocks.select("block", "words").mapInPandas(dealt, "block string, bucket long, words binary")
    return posts.groupBy("bucket").applyInPandas(encoded, "block string, bucket long, ids binary").withColumn("buckets", F.lit(buckets))


def encoded(documents: DataFrame, vocabulary: str | None = None, digests: bool = True) -> DataFrame:
    """Per document doc_id and n_tokens with, as asked, digests of ids and decoded text, or the ids themselves.

    digests: (doc_id, n_tokens, ids_sha256, decoded_sha256); otherwise
    (doc_id, n_tokens, ids array<int>, decoded string).
    """
    vocabulary = vocabulary or vocabulary_path()
    kind = documents.schema["doc_id"].dataType.simpleString()
    blocks = materialize(split(documents), "word-blocks")
    found = word_ids(blocks, vocabulary)
    # A block meets at most one packed row per bucket.
    per_block = found.groupBy(F.col("block").alias("_b")).agg(
        F.collect_list(F.struct("bucket", "ids")).alias("found"), F.max("buckets").alias("buckets")
    )
    rows = blocks.join(per_block, F.col("block") == F.col("_b"), "left").select(
        "doc_ids", "lengths", "numbers", "words", F.col("found.bucket").alias("bucket"), F.col("found.ids").alias("ids"), "buckets"
    )

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        # The id-to-piece table: as long as the vocabulary.
        pieces = np.array([tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))], dtype=object)
        del tokenizer
        for pdf in batches:
            for doc_ids, lengths, numbers, words, bucket, ids, buckets in pdf.itertuples(index=False):
                yield from _block_rows(doc_ids, lengths, numbers, words, bucket, ids, buckets, pieces, digests)

    columns = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    out = rows.mapInPandas(joined, f"doc_id string, n_tokens long, {columns}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def _block_rows(doc_ids, lengths, numbers, words, bucket, ids, buckets, pieces, digests) -> Iterator[pd.DataFrame]:
    """Joins ids back to the words of one block by position, a few documents at a time."""
    numbers = _from_varints(zstandard.ZstdDecompressor().decompress(numbers))
    table = _unpack_words(words)
    size = np.zeros(len(table), dtype=np.int64)
    flat, start = np.zeros(0, dtype=np.uint32), np.zeros(len(table), dtype=np.int64)
    if len(table):
        where, parts, at = _bucket_of(table, int(buckets)), [], 0
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(int(buckets) + 1))
        for b, blob in zip(bucket, ids):
            mine = order[bounds[int(b)]:bounds[int(b) + 1]]
            n, found = _unpack_ids(blob)
            size[mine], start[mine] = n, at + np.cumsum(n) - n
            parts.append(found)
            at += len(found)
        flat = np.concatenate(parts)
    shown = [" ".join(pieces[flat[a:a + n]]) for a, n in zip(start.tolist(), size.tolist())] if len(table) else []
    del table
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    rows: list[tuple] = []
    for doc_id, n, end in zip(doc_ids, lengths, ends.tolist()):
        own = numbers[end - n:end]
        each = size[own]
        total = int(each.sum())
        before = np.cumsum(each) - each
        got = flat[np.repeat(start[own] - before, each) + np.arange(total)]
        decoded = " ".join([shown[i] for i in own.tolist()])
        if digests:
            ids_of = hashlib.sha256(got.astype("<u4").tobytes()).hexdigest()
            rows.append((doc_id, total, ids_of, hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
        else:
            rows.append((doc_id, total, got.astype(np.int32), decoded))
        if len(rows) >= 1000:
            yield _frame(rows, digests)
            rows = []
    if rows:
        yield _frame(rows, digests)


def _frame(rows: list[tuple], digests: bool) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])


def pieces(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """(id, piece): the id-to-piece table of a vocabulary file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary or vocabulary_path())
    n = tokenizer.get_vocab_size(with_added_tokens=True)
    return spark.createDataFrame([(i, tokenizer.id_to_token(i)) for i in range(n)], "id int, piece string")


def decoded(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids): an id-to-piece join, pieces joined by position."""
    shown = rows.select("doc_id", F.posexplode_outer("ids").alias("_at", "_id")).join(table, F.col("_id") == F.col("id"), "left")
    return shown.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("_at", "piece")))), lambda e: e["piece"]), " ").alias("decoded")
    )
