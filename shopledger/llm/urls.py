"""URL filters: rules on host and path, and gradient-boosted trees on lexical features for all other URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import let, small, written

#: Verdict, host and path of each rule. A host stands for its subdomains too.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Parts of the hosts, for statistics of labels that leave a URL's own part out.
PARTS = 8
FEATURES = (
    "length", "host_length", "host_labels", "host_hyphens", "depth", "digit_ratio", "letter_entropy", "parameters",
    "parameter_length", "fragment", "suffix_share", "suffix_blocked",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for text without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    capital, plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), capital, plain)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character of a text; 0 if empty."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda all_of, c: F.size(F.filter(all_of, lambda x: x == c)) / F.size(all_of)
    return let(
        characters,
        lambda a: F.aggregate(F.array_distinct(a), F.lit(0.0), lambda s, c: s - let(share(a, c), lambda p: p * F.log2(p))),
    )


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that the URL alone gives, and ``suffix``, the host's last two labels."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    length = F.length(url)
    return pages.select(
        "*",
        length.alias("length"), F.length("host").alias("host_length"),
        F.regexp_count("host", F.lit("[.]")).alias("host_labels"), F.regexp_count("host", F.lit("-")).alias("host_hyphens"),
        F.regexp_count("path", F.lit("/[^/]")).alias("depth"),
        (F.regexp_count(url, F.lit("[0-9]")) / F.greatest(length, F.lit(1))).alias("digit_ratio"),
        entropy(url).alias("letter_entropy"),
        F.regexp_count(query, F.lit("[^&]+")).alias("parameters"), F.length(query).alias("parameter_length"),
        F.contains(url, F.lit("#")).cast("int").alias("fragment"),
        F.regexp_extract("host", r"[^.]+\.[^.]+$|[^.]*$", 0).alias("suffix"),
    )


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, sample: int = 20_000, trees: int = 20,
    learned: Column | None = None,
) -> DataFrame:
    """Verdict on every row of ``pages`` (``page_id``, ``url``): ``page_id, host, path, rule, verdict, block_score``.

    URLs that a rule decides are the labelled ones: a bounded ``sample`` of them, those with the smallest hashes,
    trains the trees; statistics of host suffixes are counted over all pages and all labelled URLs, but those of a labelled
    URL leave out the labels of its part of the hosts (one of ``PARTS``, by a hash), its own among them. ``learned`` (on ``page_id``, ``url``, ``host``, ``path``) names the labelled
    URLs that may be learned from, all unless given; where it is not true, the label is as if unknown. The trees decide
    the URLs without a rule; ``block_score`` is their probability of a block for every URL. If the labelled URLs
    are of one kind the others get that verdict, ``allow`` if there are none.

    Null URLs and such without ``://`` have empty host and path, fit no rule and are judged by the trees. Equal rows
    are judged one by one and alike; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    located = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, decided = rule_of(rules)
    ruled = written(lexical(located.select("*", rule.alias("rule"), decided.alias("decided"))), "urls")
    taught = F.col("decided").isNotNull() & (F.lit(True) if learned is None else F.coalesce(learned, F.lit(False)))
    block = F.when(taught, (F.col("decided") == "block").cast("double"))
    # Shares of all pages, and of blocks among labelled URLs, drawn towards one half where there are few.
    of_part = lambda value: F.array(*[F.count(F.when(F.col("part") == k, value)) for k in range(PARTS)])
    ruled = ruled.withColumn("own", block).withColumn("part", F.pmod(F.xxhash64("host"), F.lit(PARTS)).cast("int"))
    suffixes = ruled.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("rows"), of_part(F.col("own")).alias("labelled"),
        of_part(F.when(F.col("own") == 1, 1)).alias("blocked"),
    )
    rows = max(1, ruled.count())
    suffixes = written(suffixes, "suffixes").select(
        F.col("suffix").alias("_suffix"), F.log(F.col("rows") / rows).alias("suffix_share"), "labelled", "blocked",
    )
    known = ruled.join(small(suffixes, 100_000), F.col("suffix") == F.col("_suffix"), "left")
    every = lambda name: F.aggregate(name, F.lit(0).cast("bigint"), lambda a, x: a + x)
    others = lambda name: every(name) - F.when(F.col("own").isNotNull(), F.get(name, F.col("part"))).otherwise(0)
    known = known.withColumn("suffix_blocked", (others("blocked") + 1) / (others("labelled") + 2))
    known = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known)
    labelled = known.where("own is not null").withColumnRenamed("own", "label")
    # At most ``sample`` rows, in one order, so that the trees are the same on every run.
    train = written(labelled.orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(sample).select("features", "label"), "train")
    kinds = [r.label for r in train.select("label").distinct().collect()]
    if len(kinds) < 2:
        judged = known.withColumn("block_score", F.lit(float(kinds[0]) if kinds else 0.0))
    else:
        model = GBTClassifier(maxIter=trees, maxDepth=4, seed=1).fit(train.coalesce(1).sortWithinPartitions(F.xxhash64("features", "label")))
        judged = model.transform(known).withColumn("block_score", F.get(vector_to_array("probability"), F.lit(1)))
    by_trees = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("decided", by_trees).alias("verdict"), "block_score")

