"""Benchmark passages in documents against a plain search for every window."""

from __future__ import annotations

import random
import re

import pytest

from common_llm import documents
from shopledger.llm.decontamination import contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def plain(texts, items, window=10):
    out = []
    for doc_id, text in texts:
        own, hit, ids = words(text), set(), set()
        for item, passage in items:
            wanted = words(passage)
            n = min(len(wanted), window)
            for i in range(len(wanted) - n + 1 if n else 0):
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == wanted[i : i + n]:
                        hit.update(range(at, at + n))
                        ids.add("null" if item is None else str(item))
        out.append((doc_id, len(own), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


def found(spark, texts, items, extra=False, **parameters):
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, h1 int")
    rows = contaminated(documents(spark, texts, extra), benchmark, **parameters).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows), key=str)


@pytest.mark.parametrize("parameters", [{}, {"filter_bits": 6}, {"window": 4, "gram": 2}, {"window": 3, "gram": 9}])
def test_equals_plain_search(spark, parameters):
    draw = random.Random(5)
    some = lambda n: " ".join(draw.choice(["a", "B", "c", "é", "zz"]) for _ in range(n))
    items = [(i, some(draw.choice([1, 2, 5, 9, 10, 11, 14]))) for i in range(12)]
    texts = [(i, some(draw.randrange(0, 60))) for i in range(30)]
    texts += [(100 + i, some(5) + "; " + items[i][1].upper() + "," + some(5)) for i in range(12)]
    items = items[4:]
    assert found(spark, texts, items, **parameters) == plain(texts, items, parameters.get("window", 10))


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    items = [(1, passage), (1, passage), (None, "Über  x"), (3, None), (4, ""), (5, "  .,-"), (6, passage + " more")]
    texts = [
        (1, None), (1, ""), (2, "..."), (2, passage), (None, passage), (3, "no " * 30000 + passage + "\n" + passage),
        (4, "über_X über-X"), (5, " ".join(passage.split()[:9])), (6, passage.replace(" ", "\0")), (6, passage.replace(" ", "é")),
    ]
    assert found(spark, texts, items, extra=True) == plain(texts, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, [], False), (2, 0, 0, [], False)]


def test_many_copies_and_one_passage_everywhere(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    items = [(i, passage) for i in range(30)]
    texts = [(i, "x y z " + passage) for i in range(200)] + [(i, f"{i} {passage}") for i in range(200, 300)]
    rows = found(spark, texts, items)
    assert len(rows) == 300 and {r[2:4] == (12, sorted(map(str, range(30)))) for r in rows} == {True}
