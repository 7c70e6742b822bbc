from __future__ import annotations

import random
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from common_llm import by_id, documents
from shopledger.llm import bpe
from shopledger.llm.queries import TOKENIZERS

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PIECES = [
    "a", "aa", "the", " ", "  ", "\n", "'s", "'S", "é", "é", "Σ", "ΑΣ", "İ", "ß", "<|endoftext|>", "<|startoftext|>", "<|", "1",
    "12", "!!", "日本", "한", "𝒳", "՘", "\x1c", "\x85", "　", "zz", "hello", "ing", " world", "aaaa", "-", "_", "\x00", "ا", "ﬁ",
]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = str(TOKENIZERS / request.param)
    return bpe.BPE(Path(path).read_text("utf-8")), Tokenizer.from_file(path)


def agree(both, texts):
    mine, library = both
    expected = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert mine.encode(texts) == expected
    assert [mine.decode(ids) for ids in expected] == [library.decode(ids, skip_special_tokens=False) for ids in expected]


def test_random_texts(both):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", "ab" * 3000, "a" * 5001, "".join(rng.choice("abcdefghij") for _ in range(20_000))]
    agree(both, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=10))
def test_any_texts(both, texts):
    agree(both, texts)


def test_more_words_than_are_kept(both):
    mine, library = both
    small = bpe.BPE(mine.json, most_words=50)
    texts = [" ".join(f"w{i * j}" for i in range(40)) for j in range(20)]
    assert small.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    small = bpe.BPE(mine.json, most_bytes=20_000)
    for text in texts:
        assert small.encode([text]) == [library.encode(text, add_special_tokens=False).ids]
        assert small.held < 40_000


def test_words_in_use_stay_known(both, monkeypatch):
    """Words that keep coming are merged once, though others pass the bound many times over."""
    mine, library = both
    small = bpe.BPE(mine.json, most_words=200)
    merged, merge = [], small.merge
    monkeypatch.setattr(small, "merge", lambda words: merged.extend(words) or merge(words))
    for j in range(40):
        text = "of the day " + " ".join(f"w{i}" for i in range(j * 20, j * 20 + 20))
        assert small.encode([text]) == [library.encode(text, add_special_tokens=False).ids]
    assert len(merged) == len(set(merged))
    assert len(small.known) + len(small.before) <= 200


def test_kept_words_take_bounded_memory(both):
    mine, _ = both
    rng = random.Random(4)
    words = list({"".join(rng.choices(("th", "on", "er", "an", "ti", "ou"), k=7)) for _ in range(200_000)})
    assert len(words) > 100_000
    mine.encode(["warm"])
    mine.known.clear()
    tracemalloc.start()
    for start in range(0, len(words), 2000):
        mine.encode([" ".join(words[start : start + 2000])])
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 260 * len(words)


def test_long_words(both):
    """Equal to the library, and in about linear time."""
    rng = random.Random(9)
    words = ["".join(rng.choices(letters, k=n)) for letters in ("ab", "aab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "eéß日", "0123", "-=_") for n in (500, 3000, 9001)]
    words += ["the" * 4000, "ab" * 5000 + "a", "a" * 7000, "ing" * 999 + "b" + "ing" * 999, "xy" * 300 + "z" * 300]
    agree(both, words + [" ".join(words)])
    mine, _ = both
    cost = []
    for n in (20_000, 160_000):
        word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        start = time.process_time()
        mine.merge([word])
        cost.append(time.process_time() - start)
    assert cost[1] < 16 * cost[0] + 1


def test_least_before():
    rng = random.Random(2)
    for n, width in ((1, 1), (5, 1), (40, 7), (40, 8), (9, 50)):
        ranks = [rng.randrange(50) for _ in range(n)]
        expected = [min(ranks[max(0, i - width) : i], default=bpe.NONE) for i in range(n)]
        assert bpe.least_before(np.array(ranks), width).tolist() == expected


def test_ranks_that_can_fall():
    """Where a merge opens a pair of a lower rank, one pair at a time is merged, as the library does."""
    import json

    letters = bpe.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)}
    merges = []
    for a, b in [("b", "c"), ("a", "b"), ("ab", "c"), ("abc", "a"), ("a", "bc")]:
        vocab.setdefault(a + b, len(vocab))
        merges.append([a, b])
    file = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                  "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges},
    }
    mine = bpe.BPE(json.dumps(file))
    assert not mine.safe.all()
    rng = random.Random(1)
    agree((mine, Tokenizer.from_str(json.dumps(file))), ["".join(rng.choice("abc") for _ in range(40)) for _ in range(500)])
    agree((mine, Tokenizer.from_str(json.dumps(file))), ["".join(rng.choice(abc) for _ in range(400)) for abc in ("abc", "aabc", "abbcd") for _ in range(50)])


def test_table(spark):
    rows = [(1, "Hello World's"), (2, None), (3, ""), (None, "x"), (1, "x"), (4, "word " * 50_000)]
    path = str(TOKENIZERS / FILES[0])
    library = Tokenizer.from_file(path)
    got = sorted((tuple(r) for r in bpe.encode(documents(spark, rows, extra=True), path).collect()), key=str)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    assert got == sorted(((i, ids(t), library.decode(ids(t), skip_special_tokens=False)) for i, t in rows), key=str)
    assert by_id(bpe.encode(documents(spark, rows[1:3]), path, decoded=False), "ids") == {2: ([],), 3: ([],)}
    assert bpe.encode(documents(spark, []), path).count() == 0


def test_other_vocabularies_are_refused():
    import json

    config = json.loads((TOKENIZERS / FILES[0]).read_text("utf-8"))
    config["normalizer"] = {"type": "NFKC"}
    with pytest.raises(ValueError):
        bpe.BPE(json.dumps(config))
