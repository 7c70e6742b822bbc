from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from common_llm import WORDS, by_id, documents
from shopledger.llm import minhash
from shopledger.llm.common import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = WORDS.findall((text or "").translate(LOWER))
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(texts, size, percent=80):
    """Set size and smallest reachable id per document, from all pairs."""
    sets = {i: shingle_set(t, size) for i, t in texts}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(words, share, rng):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def corpus(seed, bases=6, copies=14):
    """Near copies with all rates of change, so that similarities lie on both sides of the threshold."""
    rng, texts = random.Random(seed), []
    for b in range(bases):
        words = [f"b{b}w{rng.randrange(200)}" for _ in range(rng.choice([5, 12, 40, 150, 400]))]
        texts += [edited(words, rng.choice([0, 0.005, 0.02, 0.03, 0.05, 0.1]), rng) for _ in range(copies)]
    texts += ["", None, " \n ", "one", "One", "two words", "a b c", "A  b\tC", "a b c d", "x" * 50]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.mark.parametrize("cell", [400_000, 300])
def test_groups_are_those_of_all_pairs(spark, cell):
    """Also where clusters are cut into many small cells."""
    texts = corpus(1)
    docs = documents(spark, texts, extra=True)
    for size in (4, 5):
        got = by_id(minhash.near_duplicates(docs, size=size, cell=cell), "n_shingles", "component_id", "kept")
        assert got == brute(texts, size)


def test_chain_of_links_is_one_group(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(10)]
    got = by_id(minhash.near_duplicates(documents(spark, texts)), "n_shingles", "component_id", "kept")
    assert got == brute(texts, 5) and {v[1] for v in got.values()} == {0}


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [(i, edited(words, rng.choice([0, 0.01, 0.02, 0.04, 0.06]), rng)) for i in range(500)]
    got = by_id(minhash.near_duplicates(documents(spark, texts), cell=5000), "n_shingles", "component_id", "kept")
    assert got == brute(texts, 5)


def test_null_and_equal_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k"), (2, "g h i j k l m n"), (3, long), (4, long + " end"), (None, None)]
    docs = documents(spark, rows, extra=True)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([
        (None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (2, 4, 2, True), (3, 39_996, 3, True),
        (4, 39_997, 3, False), (None, 0, None, True),
    ], key=str)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == [
        (0, 0), (0, 11), (1, 9), (1, 11), (2, 15), (3, len(long)),
    ]


def test_equal_ids_in_different_groups(spark):
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(5, "quite another text that resembles nothing at all"), (5, near + " x"), (3, near), (5, near + " x"), (9, near + " y")]
    docs = documents(spark, rows, extra=True)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 4, 5, True), (5, 57, 3, False), (3, 56, 3, True), (5, 57, 3, False), (9, 57, 3, False)], key=str)
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(docs).collect()) == [(3, near), (5, rows[0][1])]


def test_recall_of_pairs_at_the_threshold(spark):
    """Every pair whose similarity is 0.8 or little more is found."""
    texts, total = [], 100
    for i in range(300):
        words = [f"p{i}w{j}" for j in range(total)]
        cut = 86 + i % 6
        changed = words[: cut + 4] + [f"q{i}w{j}" for j in range(total - cut - 4)]
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    got = by_id(minhash.near_duplicates(documents(spark, texts)), "n_shingles", "component_id", "kept")
    expected = brute(texts, 5)
    assert got == expected and sum(not v[2] for v in expected.values()) >= 100


def test_empty_table(spark):
    docs = documents(spark, [])
    assert minhash.near_duplicates(docs).count() == 0 and minhash.keep_one(docs).count() == 0


def test_densified_bins_agree_as_often_as_sets(spark):
    """Empty bins are filled so that single bins still match with the similarity of the sets."""
    rng = np.random.default_rng(0)
    for n in (6, 40, 2000):
        rates = []
        for _ in range(60):
            every = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            cut = n // 4
            one, two = np.unique(every[: n - cut]), np.unique(every[cut:])
            keys = [minhash.band_keys(s, 300, 1) for s in (one, two)]
            rates.append((keys[0] == keys[1]).mean())
        similarity = (n - 2 * (n // 4)) / n
        assert abs(np.mean(rates) - similarity) < 0.06


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.id: r.component for r in got.collect()} == {x: find(x) for x in root} and got.count() == len(root)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_kept_word_hashes_take_bounded_memory():
    tracemalloc.start()
    for start in range(0, 450_000, 5000):
        minhash.shingles(" ".join(f"word{i}" for i in range(start, start + 5000)), 5)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 30 << 20
