"""Mixing sources to target weights with exact quotas, dealt to output shards by a splitting tree.

All of it is DataFrame functions. Documents of a source fall into blocks by a hash, so any order of blocks is a random
permutation. A source's target fixes how many times all of its blocks are drawn, how many blocks are drawn once more,
and how much of one last block. A source's number of draws is its quota. The tree halves quotas again and again: in a
node every draw has a random key, and the half with the smaller keys goes left, so the numbers by source that go left
follow the multivariate hypergeometric distribution exactly. Keys are counted in ``BINS`` bins, and only the bin with the
middle is ranked, so no window holds a node's draws. At the leaves each shard has a quota from each source; a source's
draws, in a random order, go to the shards by these quotas, so shards get disjoint draws. Inside a shard rows are
ordered by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.blocks import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BLOCKS = 1024
LEVELS = 4
BINS = 4096


def in_order(df: DataFrame, order: list[Column], *sums: str) -> DataFrame:
    """Add ``at``, each row's number by this order from 1, and for each of ``sums`` before_..., its sum over earlier rows.

    Rows are dealt out by ranges, so a window holds one range only; what comes before a range is summed over ranges.
    """
    rows = saved(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    totals = {c: F.sum(c).alias(f"all_{c}") for c in sums}
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    ranges = rows.groupBy("range").agg(F.count(F.lit(1)).alias("all_at"), *totals.values())
    ranges = ranges.select("range", *[F.coalesce(F.sum(f"all_{c}").over(ahead), F.lit(0)).alias(f"ahead_{c}") for c in ("at", *sums)])
    within = Window.partitionBy("range").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    found = {"at": F.col("ahead_at") + F.row_number().over(within)} | {f"before_{c}": F.col(f"ahead_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums}
    return rows.join(ranges, "range").withColumns(found).select(*df.columns, *found)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) rows, one a source, with each source's weight and target.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a target stops at
    ``most`` times its source's size, and the excess is shared again by weight. With sources ordered by limit per
    weight, those before the first one whose share stays below its limit are the ones that stop.
    """
    rows = in_order(sizes, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("at") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most).withColumn("level", F.col("limit") / F.col("weight")).drop("at")
    ranked = in_order(rows, [F.col("level"), F.col("source").asc_nulls_last()], "limit", "weight")
    total, heft = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    ranked = ranked.withColumn("share", (F.lit(total or 0) - F.col("before_limit")) / (F.lit(heft or 0) - F.col("before_weight")))
    share = ranked.where(F.col("level") >= F.col("share")).agg(F.min_by("share", "at")).first()[0]
    return ranked.select("source", "source_size", "weight", F.least(F.col("limit").cast("double"), F.lit(share).cast("double") * F.col("weight")).alias("target"))


def key_of(seed: str, *parts: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") for p in parts]))


def quotas(draws: DataFrame, levels: int, seed: int, bins: int = BINS) -> DataFrame:
    """Split the draws of all sources (columns source_key, number) over 2**levels shards: (source_key, shard, quota)."""
    out = draws.withColumn("shard", F.lit(0))
    for level in range(levels):
        key = key_of(f"{seed}-{level}", "source_key", "number")
        out = saved(out.withColumn("key", key).withColumn("bin", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % bins), "mix-keys")
        ahead = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a bin
        counts = out.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        half = F.ceil(F.sum("n").over(Window.partitionBy("shard")) / 2)
        middle = counts.withColumn("room", half - F.col("ahead")).where("room >= 1 AND room <= n").select("shard", F.col("bin").alias("middle"), "room")
        told = out.join(F.broadcast(middle), "shard")  # a row a node: at most 2**levels
        place = F.row_number().over(Window.partitionBy("shard").orderBy("key", "source_key", "number"))
        split = told.where("bin = middle").withColumn("right", place > F.col("room"))
        rest = told.where("bin <> middle").withColumn("right", F.col("bin") > F.col("middle"))
        out = split.unionByName(rest).select("source_key", "number", (F.col("shard") * 2 + F.col("right").cast("int")).alias("shard"))
    return out.groupBy("source_key", "shard").agg(F.count(F.lit(1)).alias("quota"))


def deal(draws: DataFrame, levels: int, seed: int) -> DataFrame:
    """Deal draws (columns source_key, block, draw) to 2**levels shards, by the quotas of the splitting tree.

    A source's draws, in a random order, fill the shards one after the other.
    """
    order = Window.partitionBy("source_key").orderBy(key_of(str(seed), "source_key", "block", "draw"), "block", "draw")
    placed = saved(draws.withColumn("number", F.row_number().over(order)), "mix-draws")
    told = quotas(placed.select("source_key", "number"), levels, seed)
    upto = told.withColumn("upto", F.sum("quota").over(Window.partitionBy("source_key").orderBy("shard")))
    ends = upto.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ends"))  # one a shard
    shard = F.filter("ends", lambda e: e["upto"] >= F.col("number"))[0]["shard"]
    return placed.join(ends, "source_key").select("source_key", "block", "draw", shard.alias("shard"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *,
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, blocks: int = BLOCKS, levels: int = LEVELS, seed: int = 7, whole_rows: bool = False,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and shards; with whole_rows also ``row``.

    size is the number of words of the text (null: 0), taken the words that the mix takes, repeats counted. A source's
    taken words sum to its target, rounded; at most one document a source is taken in part, and none more than
    ``most`` times. shards lists, joined by commas, the output shard of each time the document is drawn. Null sources
    are a source of their own, a source without words takes none, and no documents give no rows. The order of draws
    depends on seed, doc_id, source and text alone, so reruns agree and repeated rows may stand for each other.
    ``row`` is the whole input row as a struct, so no column can clash.

    Windows hold a range of sources, the draws of one source (at most 4 * ``blocks``), the bins of a node, or the
    documents of a source's one cut block, 1/``blocks`` of it. Other rows meet their block's draws in a join, which
    Spark broadcasts only while the table of blocks is small.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.md5(F.col(text)), F.lit(""))))
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("key"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("source_key"),
        (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % blocks).cast("int").alias("block"),
        *([F.struct(*docs.columns).alias("row")] if whole_rows else []),
    )
    slim = saved(slim, "mix-sizes")
    by_block = saved(slim.groupBy("source_key", "source", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    sources = targets(by_block.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, most)
    want, whole = F.round("target").cast("long"), F.col("source_size")
    plan = sources.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), "source_size", "target",
        F.when(whole > 0, F.floor(want / whole)).otherwise(0).cast("int").alias("times"),
        F.when(whole > 0, want % whole).otherwise(0).alias("rest"),
    )
    so_far = F.coalesce(F.sum("block_size").over(Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = by_block.join(plan, "source_key").select("source_key", "block", "block_size", "source_size", "target", "times", F.greatest(F.lit(0), F.col("rest") - so_far).alias("rest"))
    drawn = saved(drawn.withColumn("cut", (F.col("rest") > 0) & (F.col("rest") < F.col("block_size"))).drop("block_size"), "mix-drawn")
    count = F.col("times") + (F.col("rest") > 0).cast("int")
    draws = drawn.select("source_key", "block", F.explode(F.when(count > 0, F.sequence(F.lit(1), count))).alias("draw"))
    dealt = (
        deal(draws, levels, seed).groupBy("source_key", "block")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "shard"))), lambda x: x["shard"].cast("string")).alias("dealt"))
    )
    told = saved(drawn.join(dealt, ["source_key", "block"], "left"), "mix-told")
    # Only rows of a source's cut block are put in order; the others need no more than what is told of their block.
    whole_blocks = slim.join(told.where("NOT cut"), ["source_key", "block"]).withColumn("part", F.when(F.col("rest") > 0, F.col("size")).otherwise(0))
    earlier = F.sum("size").over(Window.partitionBy("source_key", "block").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.coalesce(earlier, F.lit(0))))
    cut_blocks = slim.join(told.where("cut"), ["source_key", "block"]).withColumn("part", part)
    return (
        whole_blocks.unionByName(cut_blocks)
        .select(
            "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times") + F.col("part")).alias("taken"),
            F.when(F.col("size") > 0, F.array_join(F.slice(F.coalesce("dealt", F.array().cast("array<string>")), F.lit(1), F.col("times") + (F.col("part") > 0).cast("int")), ",")).otherwise("").alias("shards"),
            *(["row"] if whole_rows else []),
        )
    )


def shard_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, seed: int = 7, **options) -> DataFrame:
    """The rows of ``docs`` once for each time that mix() draws them, by output shard and shuffled inside it.

    Columns: mix_shard, mix_place (a random order inside the shard), mix_text (what is taken: the whole text, but for one
    draw a source its first words joined by one space), mix_words (how many these are) and ``row``, the whole input row
    as a struct. Rows without words are never drawn; rows with a null or repeated doc_id are drawn like any other.
    """
    mixed = mix(docs, doc_id, text, source, seed=seed, whole_rows=True, **options).where("shards <> ''")
    picks = mixed.select("row", "size", "taken", F.posexplode(F.split("shards", ",")).alias("draw", "shard"))
    words = F.least(F.col("size"), F.col("taken") - F.col("draw") * F.col("size"))
    whole = F.col("row")[text]
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), "shard", F.coalesce(F.col("row")[doc_id].cast("string"), F.lit("")), F.md5(whole), F.col("draw").cast("string")))
    rows = picks.select(
        F.col("shard").cast("int").alias("mix_shard"), place.alias("mix_place"),
        F.when(words < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")).otherwise(whole).alias("mix_text"),
        words.alias("mix_words"), "row",
    )
    return rows.repartitionByRange("mix_shard", "mix_place").sortWithinPartitions("mix_shard", "mix_place")
