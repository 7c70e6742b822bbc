"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, let, small, words, written

SYMBOLS = "#*$%&|<>"
#: Log ratios are kept as whole numbers of this fraction, so sums do not depend on the order of rows.
UNIT = 1 << 20
#: Parts of the corpus, by the hash of the text. A document is judged by the counts of the parts that it is not in.
FOLDS = 16
#: N-grams of a document that count as evidence for the verdict; those of a longer one weigh less, as they are no
#: independent finds. What a document's own n-grams add up to is never weighed.
DOCUMENT_GRAMS = 100


def repeated_words(found: Column) -> Column:
    """Words that lie in a three-word window found twice or more; windows are compared by 64-bit hashes."""
    windows = F.transform(
        F.slice(found, 1, F.greatest(F.size(found) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(found, i + 1), F.get(found, i + 2)),
    )

    def places(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i - 1) == x)))
        few = lambda d: F.filter(
            F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i).otherwise(-1)), lambda i: i >= 0
        )
        # Many different windows repeat: sort them with their places, as a look-up for each would be quadratic.
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        many = lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])),
            lambda x: x["p"],
        ))
        nothing = F.array().cast("array<int>")
        return let(twice, lambda d: F.when(F.size(d) == 0, nothing).when(F.size(d) <= 16, few(d)).otherwise(let(pairs, many)))

    # A window covers three words, fewer where the window before it overlaps.
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        let(windows, places),
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def bucket(buckets: int, *parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(buckets - 1))


def following_hashes(found: Column, buckets: int) -> Column:
    """Buckets of the pairs of neighbouring words."""
    first = F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))
    return F.transform(first, lambda x, i: bucket(buckets, x, F.get(found, i + 1)))


def fold(text: Column) -> Column:
    """The part of the corpus that a text belongs to; equal texts share one."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS))


def gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int, broadcast_rows: int = 2_000_000) -> DataFrame:
    """``fold, bucket, raw, target, raw_weight, target_weight``: how often each fold's documents have n-grams of a bucket.

    The target is the documents whose id is in ``trusted`` (ids that are null or not in ``docs`` count for nothing).
    The weights count each document as ``DOCUMENT_GRAMS`` n-grams at most, in units of ``1 / UNIT``.
    """
    ids = trusted.select(F.col("doc_id").alias("_trusted")).where("_trusted is not null").distinct()
    marked = docs.select("doc_id", "text").join(small(ids, broadcast_rows), F.col("doc_id") == F.col("_trusted"), "left")
    following = F.concat(F.slice("w", 2, F.size("w")), F.array(F.lit(None).cast("string")))
    pairs = marked.select(
        F.col("_trusted").isNotNull().cast("bigint").alias("target"), fold(F.col("text")).alias("fold"), words(F.col("text")).alias("w"),
    )
    weight = (F.lit(UNIT * DOCUMENT_GRAMS) / F.greatest(2 * F.size("w") - 1, F.lit(DOCUMENT_GRAMS))).cast("bigint")
    pairs = pairs.select("target", "fold", weight.alias("weight"), F.inline(F.arrays_zip("w", following.alias("next"))))
    of_pair = F.when(F.col("next").isNotNull(), bucket(buckets, F.col("w"), F.col("next")))
    grams = pairs.select("target", "fold", "weight", F.explode(F.array(bucket(buckets, F.col("w")), of_pair)).alias("bucket"))
    return grams.where("bucket is not null").groupBy("fold", "bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"), F.sum("weight").alias("raw_weight"),
        F.sum(F.col("weight") * F.col("target")).alias("target_weight"),
    )


def ratio_tables(counts: DataFrame, buckets: int, smoothing: float = 1.0) -> DataFrame:
    """One row: per bucket the log of target probability over corpus probability, in units of ``1 / UNIT``.

    ``plain`` is from all counts, each plus ``smoothing``. In ``of_all`` and ``of_others`` (all folds but one, in turn),
    from the weights, both multinomials give the same probability to what they have not seen: the target's counts are
    raised by ``smoothing``, the corpus' by as much more as it is larger, so a bucket that the corpus hardly has says
    nothing. All zero without a target. The row has ``buckets`` entries per array whatever the size of the corpus.
    """
    names = ["raw", "target", "raw_weight", "target_weight"]
    none = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in names])
    cell = F.struct("fold", F.struct(*names))
    counts = written(counts, "gram-counts")
    by_bucket = counts.groupBy("bucket").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    by_fold = counts.groupBy("fold").agg(*[F.sum(n).alias(n) for n in names])
    totals = by_fold.agg(F.map_from_entries(F.collect_list(cell)).alias("totals"))

    def over_all(cells: Column) -> Column:
        add = lambda x, y: F.struct(*[(x[n] + y[n]).alias(n) for n in names])
        return F.aggregate(F.coalesce(F.map_values(cells), F.array().cast(f"array<struct<{','.join(n + ':bigint' for n in names)}>>")), none, add)

    dense = counts.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(by_bucket, "bucket", "left")
    dense = dense.withColumn("totals", totals.scalar()).select(
        "bucket", "cells", "totals", over_all(F.col("cells")).alias("here"), over_all(F.col("totals")).alias("all")
    )
    units = lambda value: F.rint(value * UNIT).cast("bigint")
    share = lambda n: (F.col(f"here.{n}") + smoothing) / (F.col(f"all.{n}") + smoothing * buckets)
    plain = F.when(F.col("all.target") > 0, units(F.log(share("target")) - F.log(share("raw")))).otherwise(0).cast("bigint")

    def held_out(but: Column | None) -> Column:
        left = lambda whole, parts, n: (
            F.col(f"{whole}.{n}") - (F.coalesce(F.get(F.map_values(F.map_filter(parts, lambda k, _: k == but)), F.lit(0))[n], F.lit(0)) if but is not None else 0)
        ).cast("double")
        part = left("all", "totals", "target_weight") / F.greatest(left("all", "totals", "raw_weight"), F.lit(1.0))
        raw, target = left("here", "cells", "raw_weight"), left("here", "cells", "target_weight")
        return units(F.log((target + smoothing * UNIT) / (raw * part + smoothing * UNIT)))

    folds = F.transform(F.sequence(F.lit(0), F.lit(FOLDS - 1)), held_out)
    rows = dense.select(F.struct("bucket", plain.alias("plain"), held_out(None).alias("all"), folds.alias("others")).alias("e"))
    arrays = rows.agg(F.sort_array(F.collect_list("e")).alias("e"))
    others = F.transform(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda f: F.transform("e", lambda x: F.get(x["others"], f)))
    return arrays.select(F.col("e.plain").alias("plain"), F.col("e.all").alias("of_all"), others.alias("of_others"))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 14, smoothing: float = 1.0, broadcast_rows: int = 2_000_000) -> list[int]:
    """``plain`` of ``ratio_tables`` over every document. ``buckets`` is a power of two."""
    return ratio_tables(gram_counts(docs, trusted, buckets, broadcast_rows), buckets, smoothing).first()["plain"]


def verdicts(docs: DataFrame, trusted: DataFrame, threshold: float, buckets: int, min_words: int, max_repeat_percent: int) -> DataFrame:
    """``docs`` with one more column, the last: a struct of the base counts and the verdict of the row."""
    tables = written(ratio_tables(gram_counts(docs, trusted, buckets), buckets), "ratios")
    names = [fresh(f"_{name}", docs) for name in tables.columns]
    given, docs = docs, docs.withColumns({n: tables.select(c).scalar() for n, c in zip(names, tables.columns)})
    ratios, of_all, of_others = map(F.col, names)
    own = fold(F.col("text")).cast("int")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    zero = F.lit(0).cast("bigint")
    grams = lambda w: F.concat(F.transform(w, lambda x: bucket(buckets, x)), following_hashes(w, buckets))
    total = lambda g, table: F.aggregate(g, zero, lambda a, b: a + F.get(table, b))
    # What leaving out one of the other folds changes, squared and summed: the jackknife's error of the sum.
    squared = lambda x: x.cast("double") * x.cast("double")
    changes = lambda g, every, tables: F.transform(
        tables, lambda t, i: F.when(i == own, 0.0).otherwise(let(total(g, t) - every, squared))
    )
    error = lambda g, tables: F.ceil(F.sqrt(
        let(total(g, of_all), lambda every: F.aggregate(changes(g, every, tables), F.lit(0.0), lambda a, x: a + x))
    )).cast("bigint")

    def evidence(g: Column, passed: Column) -> Column:
        below = lambda x: x < F.lit(round(threshold * UNIT)) * F.size(g).cast("bigint")
        return let(
            let(F.get(of_others, own), lambda t: total(g, t)),
            lambda x: F.struct(
                total(g, ratios).alias("llr_units"), x.alias("held_out_units"),
                F.when(passed & below(x), error(g, of_others)).alias("error_units"),
            ),
        )

    failed = lambda n, repeated: (n < min_words) | (100 * repeated > max_repeat_percent * n)
    measured = let(
        words(F.col("text")),
        lambda w: let(
            repeated_words(w),
            lambda repeated: F.struct(
                F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                repeated.alias("n_repeat_words"), failed(F.size(w).cast("bigint"), repeated).alias("base_failed"),
                F.greatest(2 * F.size(w).cast("bigint") - 1, zero).alias("n_grams"),
                let(grams(w), lambda g: evidence(g, ~failed(F.size(w).cast("bigint"), repeated))).alias("sums"),
            ),
        ),
    )
    reached = lambda m: (
        m["sums"]["held_out_units"] + F.coalesce(m["sums"]["error_units"], zero) >= F.lit(round(threshold * UNIT)) * m["n_grams"]
    )
    quality = let(
        measured,
        lambda m: F.struct(
            m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"), m["base_failed"].alias("base_failed"),
            (~m["base_failed"] & reached(m)).alias("kept"), m["sums"]["llr_units"].alias("llr_units"),
            m["n_grams"].alias("n_grams"), m["sums"]["held_out_units"].alias("held_out_units"),
            m["sums"]["error_units"].alias("error_units"),
        ),
    )
    return docs.withColumn(fresh("_quality", given), quality).drop(*names)


def judge(
    docs: DataFrame, trusted: DataFrame, threshold: float = -0.05, buckets: int = 1 << 14, min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Base counts and the verdict for every row of ``docs`` (``doc_id``, ``text``; other columns are not used).

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr_units,
    n_grams, held_out_units, error_units``. ``kept`` is false for documents that fail the base rules. For the others
    it is false only if the sum of log ratios, from documents of the other folds (``held_out_units``, so a text's own
    counts and those of its copies have no part in it), lies below ``threshold`` per n-gram by more than its standard
    error (``error_units``, a jackknife over the folds; null where it can't matter): thin counts reject nothing. Sums are whole numbers and folds
    follow from the text, so equal texts get equal verdicts on every run. ``llr_units`` is the sum over all counts.

    A null or empty text has no words and is rejected. Rows with equal ids are judged one by one, and so are null
    ids. Without trusted documents every ratio is zero and only the base rules decide. An empty table gives no rows.
    """
    judged = verdicts(docs.select("doc_id", "text"), trusted, threshold, buckets, min_words, max_repeat_percent)
    return judged.select("doc_id", "_quality.*")


def accepted(
    docs: DataFrame, trusted: DataFrame, threshold: float = -0.05, buckets: int = 1 << 14, min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, without moving a text."""
    judged = verdicts(docs, trusted, threshold, buckets, min_words, max_repeat_percent)
    name = judged.columns[-1]
    return judged.where(F.col(name)["kept"]).drop(name)
