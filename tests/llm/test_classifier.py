from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import xxhash

from common_llm import documents
from shopledger.llm import classifier

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = classifier.score(docs, classifier.fit(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    score, quality = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    assert (score[quality == 1][:, None] > score[quality == 0][None, :]).mean() > 0.99
    assert scored.count() == docs.count() and ((score >= 0) & (score <= 1)).all()


def plain_features(text):
    """Feature numbers of a text, in plain Python."""
    whole = (1 << 64) - 1
    words = (text or "").encode().split()
    ends = [(b"^" if w[:1].isupper() else b"") + w[-2:] for w in words]
    code = lambda w: xxhash.xxh64_intdigest(w, seed=1)
    found = {code(w) for w in words} | {code(e) for e in ends}
    run = longest = 1
    for i in range(len(words) - 1):
        same = words[i] == words[i + 1]
        found.add(7 if same else (code(words[i]) * 0x9E3779B97F4A7C15 + code(words[i + 1])) & whole)
        found.add((code(ends[i]) * 0x9E3779B97F4A7C15 + code(ends[i + 1])) & whole)
        run = run + 1 if same else 1
        longest = max(longest, run)
    found |= {100 + k for k in range(1, 64) if 2**k <= longest}
    return {(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & whole) >> 46 for h in found}


def test_scores_of_the_table_equal_plain_python(spark):
    """Weights by plain sums over dictionaries, from the same rows in the same order, and a score per document."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    quality = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    learning = [i for i in quality if i in texts and zlib.crc32(str(i).encode()) % 4 != 1]
    counts = {0: Counter(), 1: Counter()}
    for i in learning:
        counts[quality[i]].update(plain_features(texts[i]))
    total = {q: sum(c.values()) + classifier.DIMENSIONS for q, c in counts.items()}
    ratio = lambda f: math.log((counts[1][f] + 1) / total[1]) - math.log((counts[0][f] + 1) / total[0])
    for row in classifier.score(docs, model).collect():
        found = plain_features(texts[row.doc_id])
        length = math.sqrt(sum(ratio(f) ** 2 for f in found))
        margin = sum(ratio(f) * model.weights[f] for f in found) / length + model.bias if length else model.bias
        expected = 1 / (1 + math.exp(-(model.slope * margin + model.offset)))
        assert math.isclose(row.score, expected, rel_tol=1e-6, abs_tol=1e-9)
        assert row.predicted == (row.score >= 0.7)


def test_descent_solves_the_dual():
    """The optimum's conditions: outside the margin no weight, inside it the full one, between them on it."""
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 60)
    rows = [np.unique(rng.integers(0, 12, 5) + (0 if rng.random() < 0.2 else 8 * y)) for y in labels]
    ratios = rng.normal(size=classifier.DIMENSIONS)
    model = classifier.dual_descent(rows, labels, ratios, rounds=3000)
    values = [ratios[r] / max(math.sqrt((ratios[r] ** 2).sum()), 1e-12) for r in rows]
    share = {y: len(labels) / (2 * (labels == y).sum()) for y in (0, 1)}

    def loss(weights, bias):
        slack = [1 - (1 if y else -1) * (weights[r] @ v + bias) for r, v, y in zip(rows, values, labels)]
        return (weights @ weights + bias * bias) / 2 + sum(share[y] * max(0.0, s) for s, y in zip(slack, labels))

    least = loss(model.weights, model.bias)
    for _ in range(300):
        step = np.zeros(classifier.DIMENSIONS)
        step[:24] = rng.normal(size=24) * 10 ** rng.uniform(-3, 0)
        assert loss(model.weights + step, model.bias + step[23]) >= least - 1e-3


def test_rows_of_one_id(spark):
    """Which texts of repeated ids are learned does not follow the order of rows."""
    many = [(i % 20, text) for i, text in corpus()]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(20)], "doc_id bigint, quality int")
    one, two = (classifier.fit(documents(spark, rows).repartition(n), labels, sample=25) for rows, n in ((many, 2), (many[::-1], 9)))
    assert (one.both == two.both).all() and one.slope == two.slope


def corpus():
    good = [(i, f"the cat of {i} sat on the mat and it was fine {i * 7}") for i in range(60)]
    return good + [(i, f"buy$$$ now!! {i} WIN cash$$$ {i * 3} now!!") for i in range(60, 120)]


def test_same_scores_again_and_no_other_inputs(spark):
    docs = documents(spark, corpus(), extra=True)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    one = classifier.fit(docs, labels)
    again = classifier.fit(docs.drop("lang", "source").repartition(7), labels.repartition(3))
    got = [sorted((tuple(r) for r in classifier.score(docs, m).collect()), key=str) for m in (one, again)]
    assert got[0] == got[1]
    for doc_id, held, score, predicted in got[0]:
        assert held == (zlib.crc32(str(doc_id).encode()) % 4 == 2) and predicted == int(score >= 0.7) == int(doc_id < 60)


def test_held_out_labels_are_not_learned(spark):
    docs = documents(spark, corpus())
    rows = [(i, int(i < 60)) for i in range(120)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in rows]
    models = [classifier.fit(docs, spark.createDataFrame(r, "doc_id bigint, quality int")) for r in (rows, turned)]
    assert (models[0].both == models[1].both).all() and models[0].slope == models[1].slope


def test_odd_texts_and_tables(spark):
    docs = documents(spark, [(1, None), (2, ""), (None, "cat"), (4, "cat " * 100_000), (4, "dog")], extra=True)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    neither = classifier.fit(docs, labels)
    assert {r.score for r in classifier.score(docs, neither).collect()} == {0.5}
    model = classifier.fit(documents(spark, corpus()), spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id bigint, quality int"))
    got = classifier.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert classifier.score(documents(spark, []), model).count() == 0
    single = classifier.fit(documents(spark, corpus()), spark.createDataFrame([(1, 1), (3, 1)], "doc_id bigint, quality int"))
    assert {r.predicted for r in classifier.score(docs, single).collect()} == {1}


def test_descent_finds_the_margin():
    rows, labels = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 2])], np.array([1, 1, 0, 0])
    model = classifier.dual_descent(rows, labels, np.ones(classifier.DIMENSIONS), cost=100, rounds=200)
    margins = [model.margin(r) for r in rows]
    assert np.allclose(margins, [1, 1, -1, -1], atol=0.02)
