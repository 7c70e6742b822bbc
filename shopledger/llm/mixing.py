"""Mixing sources to target weights: exact block quotas, split among output shards by multivariate hypergeometric draws.

Every source is cut into blocks of documents by a hash. A source's target is met by whole passes over its blocks and
one partial pass in permuted block order. The units, one per block and pass, go to the output shards through a
binary tree: at every node the number of units of each source that go left is drawn from the multivariate
hypergeometric distribution, so quotas stay exact. Each shard then takes the next units of the source's permuted
order, disjoint from those of all other shards, and shuffles its documents by a hash. All draws come from hashes of
the seed, so reruns agree. Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, fresh, let, small, written


def hashed(seed: str, *parts: Column) -> Column:
    """A permutation key: the MD5 of seed and parts, as text; nulls count as the text ``null``."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def number(key: Column) -> Column:
    """The first 32 bits of a key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Per source: ``source, source_no, source_size, target``, the targets adding up to the size of all sources.

    Sources in code point order, null last, take the weights in turn. A target is the source's share by weight, at
    most ``cap`` times its size; what is cut off is shared again by weight among the others until none is above.
    The windows see one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("source_no", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("weight", F.get(cycle, F.col("source_no") % len(weights)))
    # Sources reach their cap in the order of cap over weight; the level is what a unit of weight gets.
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    sources = sources.withColumn("limit", cap * F.col("source_size")).select(
        "*",
        (F.sum("source_size").over(everything) - F.sum("limit").over(rising) + F.col("limit")).alias("left"),
        (F.sum("weight").over(everything) - F.sum("weight").over(rising) + F.col("weight")).alias("sharing"),
        F.row_number().over(rising).alias("place"),
    )
    sources = sources.withColumn("level", F.col("left").cast("double") / F.col("sharing"))
    sources = sources.withColumn("capped", F.col("weight") * F.col("level") > F.col("limit"))
    first_open = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(everything)
    sources = sources.withColumn("open", first_open)
    below = F.col("place") < F.col("open.place")
    return sources.select(
        "source", "source_no", "source_size",
        F.when(below, F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("open.level")).alias("target"),
    )


def hypergeometric(population: Column, marked: Column, draws: Column, uniform: Column) -> Column:
    """Marked items among ``draws`` without return, by inversion of the distribution outwards from its mode."""
    rest = population - marked
    low = F.greatest(F.lit(0).cast("bigint"), draws - rest)
    high = F.least(marked, draws)
    likely = F.floor((draws + 1) * (marked + 1) / (population + 2)).cast("bigint")

    def choose(mode: Column) -> Column:
        none = F.array().cast("array<bigint>")
        up = F.when(high > mode, F.sequence(mode + 1, F.greatest(high, mode + 1))).otherwise(none)
        down = F.when(low < mode, F.sequence(mode - 1, F.least(low, mode - 1), F.lit(-1).cast("bigint"))).otherwise(none)
        grow = lambda w, j: w * (marked - j + 1) * (draws - j + 1) / (j * (rest - draws + j))
        fall = lambda w, j: w * (j + 1) * (rest - draws + j + 1) / ((marked - j) * (draws - j))

        def mass(steps: Column, ratio) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

            def step(a: Column, j: Column) -> Column:
                return let(ratio(a["w"], j), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum")))

            return F.aggregate(steps, start, step, lambda a: a["sum"])

        def walk(steps: Column, ratio, start: Column) -> Column:
            def step(a: Column, j: Column) -> Column:
                return let(
                    ratio(a["w"], j),
                    lambda w: F.struct(
                        w.alias("w"), (a["to_go"] - w).alias("to_go"),
                        F.when((a["to_go"] > 0) & (a["to_go"] - w <= 0), j).otherwise(a["pick"]).alias("pick"),
                    ),
                )

            return F.aggregate(steps, start, step)

        def pick(total: Column) -> Column:
            begin = F.struct(F.lit(1.0).alias("w"), (uniform * total - 1.0).alias("to_go"), mode.alias("pick"))
            again = lambda a: F.struct(F.lit(1.0).alias("w"), a["to_go"].alias("to_go"), a["pick"].alias("pick"))
            return let(walk(up, grow, begin), lambda a: walk(down, fall, again(a))["pick"])

        return let(F.lit(1.0) + mass(up, grow) + mass(down, fall), pick)

    return let(F.least(F.greatest(likely, low), high), choose)


def split_quotas(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """``(source_no, units)`` split among ``shards`` (a power of two): ``source_no, shard, units``, sums unchanged.

    A node of the tree is one row with one entry per source.
    """
    entry = F.struct(F.col("source_no"), F.col("units").cast("bigint").alias("units"))
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(entry)).alias("entries")).withColumn("node", F.lit(1))
    width = shards
    while width > 1:
        total = F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + e["units"])
        start = F.struct(
            total.alias("population"),
            F.floor((total + F.col("node") % 2) / 2).cast("bigint").alias("draws"),
            F.array().cast("array<bigint>").alias("left"),
        )

        def draw(a: Column, e: Column) -> Column:
            uniform = (number(hashed(seed, F.lit("split"), F.col("node"), e["source_no"])) + 0.5) / float(1 << 32)
            taken = hypergeometric(a["population"], e["units"], a["draws"], uniform)
            return let(
                taken,
                lambda x: F.struct(
                    (a["population"] - e["units"]).alias("population"), (a["draws"] - x).alias("draws"),
                    F.concat(a["left"], F.array(x)).alias("left"),
                ),
            )

        nodes = nodes.withColumn("left", F.aggregate("entries", start, draw, lambda a: a["left"]))
        half = lambda side: F.transform(
            "entries",
            lambda e, i: F.struct(
                e["source_no"].alias("source_no"),
                (F.get("left", i) if side == 0 else e["units"] - F.get("left", i)).alias("units"),
            ),
        )
        children = F.array(*[F.struct((2 * F.col("node") + s).alias("node"), half(s).alias("entries")) for s in (0, 1)])
        nodes = nodes.select(F.inline(children))
        width //= 2
    return nodes.select((F.col("node") - shards).alias("shard"), F.inline("entries"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, shards: int = 16, block_words: int = 100_000,
    blocks_per_source: int = 4096, seed: str = "mix", carried: Sequence[str] = (),
) -> DataFrame:
    """Copies of every document in the mixed corpus.

    Reads ``doc_id, source, text``; returns one row per row of ``docs``: ``doc_id, source, size`` (words),
    ``source_size, target``, the columns named in ``carried``, and ``shards`` (the output shard of each copy, empty if
    the mix leaves the document out).
    ``exploded`` turns this into the mixed corpus. Each source's copies add up to its target but for the rest
    that no single document of the last block fills; no document has more than ``cap`` copies.

    Null and empty texts have size 0 and are copied with their block. Null sources form one source, the last. Rows
    with equal or null ids are mixed one by one. An empty table gives no rows. Windows see at most
    ``blocks_per_source`` blocks, or the documents of one block.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    sized = written(docs.select("doc_id", "source", size.alias("size"), *carried), "sizes")
    sources = source_targets(sized, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    blocks = F.least(F.lit(blocks_per_source), F.ceil(F.col("source_size") / block_words))
    sources = sources.withColumn("passes", F.least(F.lit(cap), whole).cast("int")).select(
        "source", "source_no", "source_size", "target", "passes",
        (F.col("target") - F.col("passes") * F.col("source_size")).alias("extra"),
        F.greatest(F.lit(1), blocks).cast("bigint").alias("blocks"),
    )
    sources = written(sources, "sources")
    named = small(sources.withColumnRenamed("source", "_source"), 10_000)
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("key", hashed(seed, F.lit("doc"), F.col("doc_id")))
    placed = placed.withColumn("block", number(F.col("key")) % F.col("blocks"))

    per_block = placed.groupBy("source_no", "block").agg(
        F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("extra").alias("extra")
    )
    permuted = Window.partitionBy("source_no").orderBy(hashed(seed, F.lit("block"), F.col("source_no"), F.col("block")))
    ends = F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per_block = per_block.withColumn("room", F.col("extra") - (ends - F.col("block_size")))
    # The extra pass takes whole blocks while there is room, and part of the block at which the room ends.
    per_block = per_block.withColumn("more", (F.col("room") > 0).cast("int"))
    per_block = written(per_block.withColumn("part", (F.col("room") > 0) & (F.col("room") < F.col("block_size"))), "blocks")

    none = F.array().cast("array<int>")
    passes = F.col("passes") + F.col("more")
    units = per_block.select(
        "source_no", "block", F.explode(F.when(passes > 0, F.sequence(F.lit(1), F.greatest(passes, F.lit(1)))).otherwise(none)).alias("pass")
    )
    unit_order = Window.partitionBy("source_no").orderBy(
        hashed(seed, F.lit("unit"), F.col("source_no"), F.col("block"), F.col("pass")), "block", "pass"
    )
    units = units.withColumn("place", F.row_number().over(unit_order).cast("bigint"))
    quotas = written(split_quotas(units.groupBy("source_no").agg(F.count(F.lit(1)).alias("units")), shards, seed), "quotas")
    until = F.sum("units").over(Window.partitionBy("source_no").orderBy("shard"))
    ranges = quotas.withColumn("until", until).where("units > 0").select(
        "source_no", F.col("shard").cast("int").alias("shard"),
        F.explode(F.sequence(F.col("until") - F.col("units") + 1, F.col("until"))).alias("place"),
    )
    entry = F.struct("pass", "shard")
    dealt = units.join(ranges, ["source_no", "place"]).groupBy("source_no", "block").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["shard"]).alias("unit_shards")
    )
    plan = per_block.select("source_no", "block", "room", "part").join(dealt, ["source_no", "block"], "left")
    joined = placed.join(plan, ["source_no", "block"])

    all_of = F.coalesce(F.col("unit_shards"), none)
    kept = ["doc_id", "source", "size", "source_size", "target", *carried]
    full = joined.where("not part").select(*kept, all_of.alias("shards"))
    # In that block: documents in hash order while they fit, then the one other that fills the rest best.
    in_block = Window.partitionBy("source_no", "block")
    ordered = in_block.orderBy("key", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = joined.where("part").withColumn("end", F.sum("size").over(ordered))
    cut = cut.withColumn("fits", F.col("end") <= F.col("room"))
    filled = F.coalesce(F.max(F.when(F.col("fits"), F.col("end"))).over(in_block), F.lit(0))
    cut = cut.withColumn("gap", F.col("room") - filled)
    off = F.abs(F.col("gap") - F.col("size"))
    best = F.row_number().over(in_block.orderBy("fits", off, "key", "doc_id", "size", *carried))
    cut = cut.withColumn("filler", ~F.col("fits") & (best == 1) & (off < F.col("gap")))
    cut = cut.select(
        *kept,
        F.when(F.col("fits") | F.col("filler"), all_of).otherwise(
            F.slice(all_of, 1, F.least(F.col("passes"), F.size(all_of)))
        ).alias("shards"),
    )
    return full.unionAll(cut)


def exploded(mixed: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per copy: ``doc_id, copy, shard`` and ``order_key``, the document's place in its shard."""
    copies = mixed.select("doc_id", F.posexplode("shards").alias("copy", "shard"))
    return copies.withColumn("order_key", hashed(seed, F.lit("order"), F.col("shard"), F.col("copy"), F.col("doc_id")))


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix has it: each row once per copy, rows grouped by shard and shuffled within it by a hash.

    Rows are matched to their copies by hashes of id, source and text, so rows with equal or null ids get each its own.
    Rows that agree in all three are interchangeable and share out the copies that the mix has for them.
    """
    one, two, number, lists, copy, shard, order = (
        fresh(name, docs) for name in ("_one", "_two", "_number", "_lists", "_copy", "_shard", "_order")
    )
    parts = [F.col(c) for c in ("doc_id", "source", "text")]
    parts += [p.isNull() for p in parts]
    marked = docs.withColumn(one, F.xxhash64(*parts)).withColumn(two, F.xxhash64(F.lit(two), *parts))
    plan = mix(marked, **options, carried=(one, two)).where(F.size("shards") > 0)
    per_row = plan.groupBy(one, two).agg(F.sort_array(F.collect_list("shards"), asc=False).alias(lists))
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "source", "text") and "map<" not in kind and "variant" not in kind]
    same = Window.partitionBy(one, two).orderBy(one, *[f"`{c}`" for c in others])
    out = marked.join(per_row, [one, two]).withColumn(number, F.row_number().over(same))
    out = out.select("*", F.posexplode(F.get(lists, F.col(number) - 1)).alias(copy, shard))
    out = out.withColumn(order, hashed(options.get("seed", "mix"), F.lit("order"), F.col(shard), F.col(copy), F.col("doc_id")))
    placed = out.repartition(shard, F.substring(order, 1, 1)).sortWithinPartitions(shard, order)
    return placed.select(*[f"`{c}`" for c in docs.columns])
