"""Byte-level BPE against the tiktoken library, on whole texts and awkward rows."""

import hashlib
from functools import cache

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from shelfmark.llm import byte_bpe, queries
from tests.llm.test_llm import FOLDER, LONG, ODD, table


@cache
def _both():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(byte_bpe.vocabulary_path()))}
    pattern = byte_bpe.split_pattern()
    return byte_bpe.Encoder(byte_bpe.vocabulary_path(), pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return _both()[0]


@pytest.fixture(scope="module")
def encoding():
    return _both()[1]


AWKWARD = ODD + [
    "a\x1cb \x1c. \x1c\x1c \x1f.", "a\u0085b \u0085 c", "᠎a ​b ﻿", "İ̧ ΑΣ", "  leading and trailing  ", "\n\n \n x", "▁▁ ▁a", "\x00\x01 \x7f",
    "don't DON'T 'll's", "日本語のテキスト 123,456", "👩‍👩‍👧 🇩🇪", "x" * 5000, " " * 5000, " a" * 3, "<unk> <|endoftext|>", "é́́", "Ⅷ ² ½ ٣",
]


def test_ids_equal_the_library(encoding, encoder):
    for text in AWKWARD:
        got = [i for ids in encoder.ids(text or "") for i in ids]
        assert got == encoding.encode_ordinary(text or ""), repr((text or "")[:50])
        assert encoder.pieces(np.array(got, dtype=np.int64)) == (text or "").encode()


@settings(max_examples=1500, deadline=None)
@given(st.text(" ab\n\t\r.,1's\x1c\u3000\xa0é", max_size=24))
def test_units_and_white_space(text):
    encoder, encoding = _both()
    assert [i for ids in encoder.ids(text) for i in ids] == encoding.encode_ordinary(text)


def test_every_token_and_every_character(encoding, encoder):
    texts = [t.decode() for t in byte_bpe.read_ranks(byte_bpe.vocabulary_path()) if _whole(t)]
    assert len(texts) > 40_000
    for text in texts:
        assert [i for ids in encoder.ids(text) for i in ids] == encoding.encode_ordinary(text), repr(text)
    for start in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert [i for ids in encoder.ids(text) for i in ids] == encoding.encode_ordinary(text), hex(start)


def _whole(token):
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_space_class_is_the_library_s(encoding):
    """Characters on which the two pattern libraries could differ: matches joined by hand give the library's ids."""
    core = encoding._core_bpe
    for c in [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF]:
        for text in (f" {chr(c)}x", f"{chr(c)}{chr(c)}.", f".{chr(c)} \n{chr(c)}a"):
            parts = regex.findall(byte_bpe.split_pattern(), text)
            assert [i for p in parts for i in core.encode_single_piece(p.encode())] == encoding.encode_ordinary(text)


def test_long_texts_are_cut_where_no_match_crosses(encoding, encoder, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE_CHARS", 7)
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 50)
    for text in [*AWKWARD[:-8], LONG[:20_000], "a  b   c    d " * 30, "\t \n\r\n x" * 40]:
        got = [i for ids in encoder.ids(text or "") for i in ids]
        assert got == encoding.encode_ordinary(text or "")


def test_query_and_round_trip(spark, encoding):
    rows = {r.doc_id: r for r in queries.op11_byte_bpe(spark, FOLDER).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = encoding.encode_ordinary(text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, encoding):
    odd = table(spark, [*ODD, "a b", "a b", None], [*range(len(ODD)), None, None, 3])
    out = byte_bpe.encoded(odd)
    assert out.schema["doc_id"].dataType.simpleString() == "bigint"
    rows = out.collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        if r.doc_id is not None and r.doc_id != 3:
            assert list(r.ids) == encoding.encode_ordinary(ODD[r.doc_id] or "") and r.n_tokens == len(r.ids)
    assert sum(r.doc_id is None and bytes(r.decoded) == b"a b" for r in rows) == 2
    back = byte_bpe.decoded(out.where("doc_id = 8"), None).collect()
    assert bytes(back[0].decoded) == ODD[8].encode()
    assert byte_bpe.encoded(odd.limit(0)).count() == 0 and byte_bpe.decoded(out.limit(0)).count() == 0
