"""One-to-one matching and suppression.

A sequential greedy choice over a strict total order takes, at each step, the best pair that is left. Pairs of one page come
together in a row, and the choice is one walk over them; pages are the unit of parallelism.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import Box, nearly_same


def shared_folder(spark: SparkSession) -> str:
    """Where rounds are written: spark.checkpoint.dir, or a temporary folder in local mode."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not folder:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def by_page(df: DataFrame) -> DataFrame:
    """The same rows, to be joined by page without a broadcast.

    Spark guesses sizes from compressed files and takes no account of explode, so it would send tables through the driver that
    grow with the pages.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Write a round and read it back, so plans don't grow and lost executors cost one round. Joins never broadcast it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return by_page(spark.read.schema(df.schema).parquet(path))


def greedy_match(pairs: DataFrame, page: Sequence[str], left: str, right: str, score: str, floor: float | None = None, within: Sequence[str] = ()) -> DataFrame:
    """The pairs that a greedy choice by (-score, left, right) takes, each end once.

    A page's pairs are settled in one walk in that order, so no round is written or joined. within: columns of which an end has one value only
    in its page, so that the pairs of each value are settled apart; a walk's work grows with its pairs times those that it takes.
    """
    rest = pairs if floor is None else pairs.where(F.col(score) >= floor)
    key = [*page, *within]
    value = F.col(score)
    first = [value.isNull().alias("k0"), (~F.isnan(value.cast("double"))).alias("k1"), (-value).alias("k2"), F.col(left).alias("l"), F.col(right).alias("r")]
    packed = rest.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*first, F.struct(*[c for c in pairs.columns if c not in key]).alias("row")))).alias("_all"))
    none = lambda name: F.array().cast(f"array<{rest.schema[name].dataType.simpleString()}>")
    start = F.struct(none(left).alias("l"), none(right).alias("r"), F.array().cast("array<int>").alias("won"))
    # One of one, so that the walk is made once; places are kept instead of rows.
    walk = F.aggregate(
        F.sequence(F.lit(1), F.size("_all")), start, lambda g, i: F.transform(F.array(F.element_at("_all", i)), lambda x: F.when(F.array_contains(g["l"], x["l"]) | F.array_contains(g["r"], x["r"]), g).otherwise(
            F.struct(F.array_append(g["l"], x["l"]).alias("l"), F.array_append(g["r"], x["r"]).alias("r"), F.array_append(g["won"], i).alias("won"))))[0], lambda g: g["won"],
    )
    won = packed.select(*key, F.explode(F.transform(walk, lambda i: F.element_at("_all", i)["row"])).alias("w"))
    return won.select(*[F.col(c) if c in key else F.col(f"w.{c}").alias(c) for c in pairs.columns])


def suppress(boxes: DataFrame, page: Sequence[str], order: Sequence[Column], same: Column | None = None) -> DataFrame:
    """Keep a box unless a kept box that comes before it in the order is nearly the same.

    boxes: page columns, ref, x, y, w, h. Pairs that are nearly the same are found by page; what they leave is settled in one walk over a page's
    pairs by rank, as the fate of all boxes before a box is known when its turn comes. Pages without a key have no rows.
    """
    p = list(page)
    ranked = boxes.dropna(subset=[*p, "ref"]).withColumn("_rank", F.row_number().over(Window.partitionBy(*p).orderBy(*order, "ref")))
    twin = ranked.select(*p, *[F.col(c).alias(f"t_{c}") for c in ("ref", "x", "y", "w", "h", "_rank")])
    over = ranked.join(by_page(twin), p).where((F.col("t__rank") < F.col("_rank")) & (same if same is not None else nearly_same(Box.of("t_"), Box.of())))
    links = over.groupBy(*p).agg(F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("i"), F.col("t__rank").alias("j")))).alias("_links"))
    goes = lambda gone, s: ~F.array_contains(gone, s["j"]) & ~F.array_contains(gone, s["i"])
    none = F.array().cast("array<int>")
    gone = links.select(*p, F.aggregate("_links", none, lambda g, s: F.when(goes(g, s), F.array_append(g, s["i"])).otherwise(g)).alias("_gone"))
    kept = ranked.join(by_page(gone), p, "left").where(~F.array_contains(F.coalesce("_gone", none), F.col("_rank")))
    return kept.select(*boxes.columns)
