from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from common_llm import WORDS, documents
from shopledger.llm import mixing


def targets(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest, shared = total - sum(capped.values()), sum(w for n, w in weight.items() if n not in capped)
        level = {n: rest * w / shared for n, w in weight.items() if n not in capped}
        above = {n: 3 * sizes[n] for n, t in level.items() if t > 3 * sizes[n]}
        if not above:
            return capped | level
        capped |= above


def size(text):
    return len(WORDS.findall(text or ""))


def check(spark, rows, **options):
    docs = documents(spark, rows, extra=True)
    got = [tuple(r) for r in mixing.mix(docs, **options).collect()]
    again = [tuple(r) for r in mixing.mix(docs.repartition(5), **options).collect()]
    key = lambda r: str((r[0], r[1], r[2], r[5]))
    assert sorted(got, key=key) == sorted(again, key=key)
    assert Counter((r[0], r[2], r[1]) for r in got) == Counter((i, size(t), s) for i, t, s in rows)
    sizes, taken, smallest = defaultdict(int), defaultdict(int), {}
    for _, source, n, *_, shards in got:
        sizes[source] += n
        taken[source] += n * len(shards)
        smallest[source] = min(smallest.get(source, n), n)
        assert len(shards) <= 3 and all(0 <= s < 16 for s in shards)
    expected = targets(sizes)
    for _, source, _, source_size, target, _ in got:
        assert source_size == sizes[source] and target == pytest.approx(expected[source])
    return got, expected, taken


def test_targets_are_met(spark):
    rng = np.random.default_rng(0)
    sources = ["b", "a", "é", None, "", "Z", "tiny"]
    rows = [(i, "w " * int(rng.integers(1, 60)), sources[int(rng.integers(6))]) for i in range(1500)] + [(2000, "one two", "tiny")]
    got, expected, taken = check(spark, rows, block_words=700)
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 30
    assert expected["tiny"] == 6 and taken["tiny"] == 6


def test_odd_documents(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (3, "x " * 5000, "b"), (3, "x " * 5000, "b"), (4, "y", None), (1, "z z z", "c")]
    check(spark, rows)
    check(spark, [(1, None, "a"), (2, "", None)])
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mixed_corpus(documents(spark, [])).count() == 0


def test_corpus_has_the_copies(spark):
    rows = [(i, f"w{i} " * (1 + i % 7), "abcd"[i * i % 4]) for i in range(400)]
    docs = documents(spark, rows, extra=True)
    copies = {r.doc_id: len(r.shards) for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_corpus(docs)
    assert mixed.columns == docs.columns
    found = Counter(r.doc_id for r in mixed.collect())
    assert found == Counter({i: n for i, n in copies.items() if n})
    places = mixing.exploded(mixing.mix(docs)).collect()
    assert len({(r.shard, r.order_key) for r in places}) == len(places) == found.total()


def test_quotas_are_split_exactly_and_evenly(spark):
    units = {0: 700, 1: 3, 2: 40, 3: 0, 4: 257}
    table = spark.createDataFrame(list(units.items()), "source_no int, units bigint")
    draws = []
    for seed in range(12):
        found = mixing.split_quotas(table, 8, f"s{seed}").collect()
        assert {n: sum(r.units for r in found if r.source_no == n) for n in units} == units
        by_shard = Counter()
        for r in found:
            by_shard[r.shard] += r.units
        assert set(by_shard.values()) == {125} and all(r.units >= 0 for r in found)
        draws += [r.units for r in found if r.source_no == 4]
    # 257 of 1,000 units: the mean is exact, the spread that of drawing 125 without return.
    assert np.mean(draws) == pytest.approx(257 / 8)
    expected = 125 * 0.257 * 0.743 * (875 / 999)
    assert expected * 0.6 < np.var(draws) < expected * 1.5


def test_hypergeometric_draws(spark):
    """The share of each outcome over a fine grid of uniform numbers."""
    from math import comb

    grid = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    lit = lambda n: F.lit(n).cast("bigint")
    for population, marked, draws in ((30, 12, 10), (20, 20, 7), (20, 0, 7), (9, 5, 8), (1, 1, 0), (0, 0, 0)):
        x = mixing.hypergeometric(lit(population), lit(marked), lit(draws), F.col("u"))
        found = Counter(r[0] for r in grid.select(x).collect())
        every = comb(population, draws)
        for k in range(marked + 1):
            share = comb(marked, k) * comb(population - marked, draws - k) / every if draws >= k else 0
            assert abs(found[k] / 4000 - share) < 0.002


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(documents(spark, [(1, "a b", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_rows_with_null_and_repeated_ids_get_their_own_copies(spark):
    rows = [(None, f"n{i} " * (1 + i % 9), "abcd"[i % 4]) for i in range(120)]
    rows += [(i % 10, f"w{i} " * (1 + i % 7), "abcd"[i * i % 4]) for i in range(120)] + [(None, "same text", "b")] * 5
    docs = documents(spark, rows)
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").collect()}
    taken = Counter()
    for r in mixing.mixed_corpus(docs).select("source", "text").collect():
        taken[r.source] += size(r.text)
    assert {s: abs(taken[s] - t) <= 10 for s, t in target.items()} == dict.fromkeys("abcd", True)
