from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from common_llm import documents
from shopledger.llm import token_files
from shopledger.llm.queries import TOKENIZERS

PATH = str(TOKENIZERS / "byte_bpe_50k.json")
TOKENS = token_files.Tokens(Path(PATH).read_text("utf-8"), most=300)
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535) | st.sampled_from([0, 7, 65535]), max_size=300), st.integers(1, 80))
def test_round_trip(ids, block):
    doc_ids, lengths, back = token_files.unpack(token_files.pack([None, -5], [0, len(ids)], np.array(ids, np.int64), block))
    assert (doc_ids, lengths.tolist(), back.tolist()) == ([None, -5], [0, len(ids)], ids)


def test_round_trip_of_many_blocks_and_kinds():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 65536, 20_000), np.zeros(20_000, int), np.repeat(rng.integers(65000, 65536, 2000), 9), np.arange(20_000) % 60):
        segment = token_files.pack([1], [len(ids)], ids, 128)
        assert (token_files.unpack(segment)[2] == ids).all()
    assert len(token_files.pack([1], [20_000], np.arange(20_000) % 60, 1024)) < 20_000 * 2 / 3


def test_blocks_are_coded_by_themselves():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 300, (5, 200))
    together = token_files.encode_blocks(rows)
    assert together == [token_files.encode_blocks(rows[i : i + 1])[0] for i in range(5)]
    assert (token_files.decode_blocks([together[3]], 200)[0] == rows[3]).all()


def test_damage_is_found():
    segment = bytearray(token_files.pack([1], [100], np.arange(100)))
    for at in (20, len(segment) - 1):
        damaged = bytearray(segment)
        damaged[at] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            token_files.unpack(bytes(damaged))
    with pytest.raises(ValueError):
        token_files.pack([1], [1], np.array([1 << 16]))


PIECES = [
    "a", "\0", "the", " ", "  ", "\n", "\t", "'s", "é", "<|endoftext|>", "<|endo", "1", "!!", "日本", "𝒳", "\x1c", "\x85", "　", "\xa0",
    " x", "x ", "\r\n", "I'm", ".",
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=30), max_size=8))
def test_ids_of_pieces_are_those_of_whole_texts(texts):
    found = TOKENS.of(texts)
    assert found == TOKENS.encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_pieces_in_use_stay_known():
    """Pieces that keep coming are encoded once, though others pass the bound many times over."""
    known, encoded = token_files.Tokens(Path(PATH).read_text("utf-8"), most=200), []
    library = known.library

    class Counted:
        def encode_batch_fast(self, texts, **options):
            encoded.extend(texts)
            return library.encode_batch_fast(texts, **options)

    known.library, pieces = Counted(), set()
    for j in range(40):
        text = "x of the day " + " ".join(f"é{i}!" for i in range(j * 20, j * 20 + 20))
        pieces.update(text.replace(" ", "\0 ").split("\0"))
        assert np.frombuffer(known.of([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert sum(map(len, encoded)) == sum(map(len, pieces))
    assert len(known) + len(known.before) <= 240


def test_a_word_is_encoded_once_whatever_follows_it():
    """Punctuation and line feeds behind a word make no new piece for the library, and ids stay those of whole texts."""
    known, encoded = token_files.Tokens(Path(PATH).read_text("utf-8")), []
    library = known.library

    class Counted:
        def encode_batch_fast(self, texts, **options):
            encoded.extend(texts)
            return library.encode_batch_fast(texts, **options)

    known.library = Counted()
    texts = [f"a zyxwé{mark} zyxwé{mark}\nzyxwé a" for mark in ("", ".", ",", "!", "?", ";", ":)", "'s", "'s.")] * 2
    found = known.of(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert "".join(encoded).count("zyxwé") == 2  # with and without a blank before it


EDGES = [
    "a", "zy", "é", "Ø", "ß", "д", "×", "÷", "²", "5", ".", ",", "!", "'", "'s", "’", "<", "|", "<|endoftext|>", " ", "\n", "\t", "\x1f",
    "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u200b", "\u3000", "日", "𝒳", "", "Â", "\u0345", "\u0483",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(EDGES), max_size=12).map("".join), max_size=12))
def test_cuts_beside_white_space_letters_and_punctuation_of_any_width(texts):
    assert TOKENS.of(texts) == TOKENS.encode(texts)


def test_carries_and_highest_id():
    """Blocks whose coder carries into earlier digits, and the id that stands for no prediction."""
    rng = np.random.default_rng(5)
    rows = np.where(rng.random((300, 700)) < 0.5, 65535, rng.integers(65000, 65536, (300, 700)))
    rows[:20] = 65535
    assert (token_files.decode_blocks(token_files.encode_blocks(rows), 700) == rows).all()


def expected(rows):
    """Documents in id order, null first, then by text, with the place of their ids."""
    library, found, at = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        found.append((doc_id, at, ids))
        at += len(ids)
    return found


def test_files(spark, tmp_path):
    rows = [(i * 37 % 101, f"text {i} é \n" * (i % 9)) for i in range(101)]
    rows += [(None, "no id"), (5, "again"), (5, None), (200, "word " * 30_000), (-3, "<|endoftext|>!")]
    path = f"{tmp_path}/tokens"
    token_files.write(documents(spark, rows, extra=True), PATH, path, segment_ids=50)
    got = token_files.read(spark, path).collect()
    found = sorted(((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=lambda r: r[1])
    assert found == expected(rows)
    # Parts and segments follow the documents' order.
    order = [token_files.unpack(r.content)[0] for r in spark.read.parquet(path).orderBy("part", "segment").collect()]
    assert len(order) > 20 and sum(order, []) == [r[0] for r in expected(rows)]


def test_empty_table(spark):
    assert token_files.filed(documents(spark, []), PATH).count() == 0


def test_query_checksums(spark):
    from shopledger.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op5_token_files"](spark, folder).collect()}
    assert got == {(d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, i in expected(rows)}
