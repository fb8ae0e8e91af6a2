"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

A stage gets (spark, docs, sf_dir), works on every row of docs, and returns the columns of documents; the last one
returns the mix. Columns that documents has beyond the usual ones are carried along, whatever their names.

Stages run one after the other: docs must be the written result of the stage before (or any other table), as a stage
begins by deleting the scratch tables of the one that was called before it. Null and empty texts, repeated rows, ties and
empty tables are handled as the operators' docstrings say; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontam, langid, mixing, neardup, substrings
from pagewright.llm.blocks import discard, noted, read, saved
from pagewright.llm.queries import remainder

LEAST_SCORE = 0.3
SCRATCH: list[str] = []  # of the stage called last

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """A stage that first deletes what the one before it left in the scratch folder."""

    @wraps(work)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, SCRATCH)
        with noted(SCRATCH):
            return work(spark, docs, sf_dir)

    return staged


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside the whole row as one struct, so that no other column can clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), *names)


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose best language has a probability under 0.3."""
    rows = langid.identify(carried(docs, "doc_id", "text", "lang"), F.coalesce(remainder(4) != 2, F.lit(True)))
    return rows.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates only the document with the smallest doc_id stays."""
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    own = docs.withColumnsRenamed({c: f"d_{c}" for c in docs.columns})
    rows = own.join(kept, F.col("d_doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return rows.withColumnsRenamed({f"d_{c}": c for c in docs.columns})


@stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out of texts; a text without any stays as it is. n_chars follows the text."""
    others = [c for c in docs.columns if c != "text"]
    rows = substrings.remove_repeats(docs.select(F.struct(*others).alias("row"), "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    values = {c: F.col(f"row.`{c}`") for c in others} | {"text": text}
    if "n_chars" in values:
        values["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(values["n_chars"])
    return rows.select(*[values[c].alias(c) for c in docs.columns])


@stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or a paraphrase of one."""
    rows = decontam.find_leaks(carried(docs, "text"), read(spark, sf_dir, "benchmark"))
    return rows.where(F.size("leaks") == 0).select("row.*")


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: drawn texts by output shard, shuffled inside it: shard, place, doc_id, source, words and text."""
    rows = mixing.shard_rows(docs.select("doc_id", "text", "source"))
    return rows.select(F.col("mix_shard").alias("shard"), F.col("mix_place").alias("place"), "row.doc_id", "row.source", F.col("mix_words").alias("words"), F.col("mix_text").alias("text"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontamination", without_leaks),
    ("mixing", mixed),
]

#: Not expressible: the language network and the latent space have no SQL form. tests/llm checks it otherwise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = saved(work(spark, docs, sf_dir), f"pipeline-{name}")
    discard(spark, SCRATCH)
    return docs
