from __future__ import annotations

import random
from collections import Counter

import xxhash
from hypothesis import HealthCheck, given, settings, strategies as st

from common_llm import WORDS, by_id, documents
from shopledger.llm import quality_rules


def base(text):
    """The base counts, straight from their definitions."""
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def buckets(text, n):
    words = [w.encode() for w in WORDS.findall(text or "")]
    one = [xxhash.xxh64_intdigest(w, 42) for w in words]
    two = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(words, words[1:])]
    return [signed(h) & (n - 1) for h in one + two]


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
ODD = [
    (1, None), (2, ""), (3, " \n\t\r "), (4, "a b c a b c"), (5, "x x x x x"), (6, "é\x1c#*\n\n#*\né"), (7, "a\nb\na\n a\n\na"),
    (8, "w " * 60), (9, " ".join(f"w{i}" for i in range(30_000)) + " w1 w2 w3"), (10, " ".join(f"w{i % 700}" for i in range(9000))),
    (None, "no id"), (4, "a b c a b c"), (11, " ".join(f"w{i}" for i in range(60))),
]


def test_base_counts_of_odd_texts(spark):
    docs = documents(spark, ODD, extra=True)
    got = quality_rules.judge(docs, docs.limit(0)).select("doc_id", *COLUMNS).collect()
    expected = Counter((i, *base(t)) for i, t in ODD)
    assert Counter(map(tuple, got)) == expected


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t#é𝒳", max_size=80), max_size=40))
def test_base_counts_of_any_text(spark, texts):
    docs = documents(spark, list(enumerate(texts)))
    assert by_id(quality_rules.judge(docs, docs.limit(0)), *COLUMNS) == {i: base(t) for i, t in enumerate(texts)}


def test_ratios_and_verdicts(spark):
    import math

    good = " ".join(f"good{i % 7}" for i in range(60))
    texts = [(i, " ".join(f"good{(i * j) % 50}" for j in range(70))) for i in range(12)]
    texts += [(i, " ".join(f"junk{(i * j) % 90}%" for j in range(70))) for i in range(12, 20)] + [(20, good)]
    docs, n = documents(spark, texts), 1 << 10
    trusted = spark.createDataFrame([(i,) for i in (1, 2, 3, 3, 5, 99, None)], "doc_id bigint")
    raw, target = Counter(), Counter()
    for i, text in texts:
        raw.update(buckets(text, n))
        if i in (1, 2, 3, 5):
            target.update(buckets(text, n))
    ratios = [
        round(quality_rules.UNIT * (math.log((target[b] + 1) / (target.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n))))
        for b in range(n)
    ]
    assert quality_rules.log_ratios(docs, trusted, n) == ratios
    got = by_id(quality_rules.judge(docs, trusted, buckets=n), "llr_units", "n_grams", "base_failed", "kept")
    for i, text in texts:
        found = buckets(text, n)
        units, failed = sum(ratios[b] for b in found), base(text)[-1]
        assert got[i] == (units, len(found), failed, not failed and units >= round(-0.05 * quality_rules.UNIT) * len(found))
    assert not any(got[i][3] for i in range(12, 20))
    kept = quality_rules.accepted(documents(spark, texts, extra=True), trusted, buckets=n)
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i][3]} and len(kept.columns) == 13


def test_empty_table(spark):
    docs = documents(spark, [])
    assert quality_rules.judge(docs, docs).count() == 0


def test_held_labels(spark):
    """Of the given documents, good ones stay and bad ones of a normal length go."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.judge(docs, labels.where("quality = 1")).where("not base_failed").join(labels, "doc_id")
    shares = {r.quality: r.share for r in judged.groupBy("quality").agg({"*": "count"}).join(
        judged.where("kept").groupBy("quality").count(), "quality", "left").selectExpr("quality", "coalesce(`count`, 0) / `count(1)` as share").collect()}
    assert shares[1] > 0.98 and shares[0] < 0.05


def test_no_python_in_the_plan(spark):
    docs = documents(spark, ODD)
    plan = quality_rules.judge(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_without_trusted_documents_only_the_base_rules_decide(spark):
    docs = documents(spark, [(1, " ".join(f"w{i}" for i in range(60))), (2, "short")])
    got = by_id(quality_rules.judge(docs, docs.limit(0)), "kept")
    assert got == {1: (True,), 2: (False,)}


def test_clean_documents_without_a_label_stay(spark):
    """Good documents that are kept out of the trusted ones are judged as those are, at several shares of labels."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("quality = 1").selectExpr("doc_id", "pmod(xxhash64(doc_id, 'held'), 10) as part")
    for tenths in (8, 5, 2):
        judged = quality_rules.judge(docs, held.where(f"part < {tenths}")).where("not base_failed")
        out = [r.kept for r in judged.join(held.where(f"part >= {tenths}"), "doc_id").collect()]
        bad = [r.kept for r in judged.join(labels.where("quality = 0"), "doc_id").collect()]
        assert sum(out) > 0.95 * len(out) and sum(bad) < 0.1 * len(bad)


def test_equal_texts_get_equal_verdicts(spark):
    words = [f"w{i}" for i in range(90)]
    texts = [(i, " ".join(words[(i * 7 + j * j) % 90] for j in range(80 + i // 2))) for i in range(40)]
    docs = documents(spark, texts + [(100 + i, t) for i, t in texts])
    got = by_id(quality_rules.judge(docs, docs.where("doc_id < 5").select("doc_id")), "kept", "held_out_units", "error_units")
    assert all(got[i] == got[100 + i] for i, _ in texts)


def test_verdict_by_the_other_folds(spark):
    """The sums and errors that decide, straight from their definitions."""
    import math

    n, unit = 1 << 8, quality_rules.UNIT
    chance = random.Random(4)
    draw = lambda i, w: " ".join(f"{w}{chance.randrange(60)}" for _ in range(55 + 20 * (i % 4)))
    texts = [(i, draw(i, "good")) for i in range(40)] + [(i, draw(i, "bad")) for i in range(40, 60)]
    texts += [(60 + i, draw(i, "good").replace("good1", "bad1")) for i in range(10)] + [(70, texts[0][1])]
    good = {i for i in range(0, 40, 3)}
    trusted = spark.createDataFrame([(i,) for i in good], "doc_id bigint")
    cells, folds = Counter(), {}
    for i, text in texts:
        grams = buckets(text, n)
        weight = int(unit * 100 / max(len(grams), 100))
        folds[i] = signed(xxhash.xxh64_intdigest(text.encode(), 42)) % 16
        for b in grams:
            cells[folds[i], b, "raw"] += weight
            cells[folds[i], b, "target"] += weight * (i in good)

    def table(but):
        kept = Counter()
        for (f, b, kind), value in cells.items():
            if f != but:
                kept[b, kind] += value
                kept[kind] += value
        share = kept["target"] / max(kept["raw"], 1)
        return [round(unit * math.log((kept[b, "target"] + unit) / (kept[b, "raw"] * share + unit))) for b in range(n)]

    tables = {f: table(f) for f in [None, *range(16)]}
    got = by_id(quality_rules.judge(documents(spark, texts), trusted, buckets=n), "held_out_units", "error_units", "base_failed", "kept")
    verdicts = set()
    for i, text in texts:
        grams = buckets(text, n)
        sums = {f: sum(t[b] for b in grams) for f, t in tables.items()}
        held, failed, limit = sums[folds[i]], base(text)[-1], round(-0.05 * unit) * len(grams)
        error = None
        if not failed and held < limit:
            error = math.ceil(math.sqrt(sum(float(sums[f] - sums[None]) ** 2 for f in range(16) if f != folds[i])))
        kept = not failed and held + (error or 0) >= limit
        assert abs(got[i][0] - held) <= len(grams) and got[i][2:] == (failed, kept)
        assert got[i][1] == error or abs(got[i][1] - error) <= 64
        verdicts.add((error is None, failed, kept))
    assert (False, False, False) in verdicts and (True, False, True) in verdicts
