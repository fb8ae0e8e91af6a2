"""Queries over document records built from the ruled pages and word boxes: JSON out and in, provenance, assets, fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions import text as t
from pagewright.functions.geometry import Box
from pagewright.operators import compare, order
from pagewright.sources import layout
from pagewright.sources import records as r

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + sql.strip()
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each order's ruled page as a JSON document; some miss a field, have one too many, or are cut."""
    e = layout.grid_rects(spark, sf_dir)
    box = F.struct(F.col("x"), F.col("y"), F.col("w").alias("width"), F.col("h").alias("height"))
    prov = F.array(F.struct(F.lit("structure").alias("stage"), F.lit("rules").alias("provider"), F.array("element_id", "kind").alias("source_refs")))
    item = F.struct(F.col("element_id").alias("id"), F.lit("rectangle").alias("type"), box.alias("bbox"), F.col("r").alias("z_index"), F.struct(F.col("conf").alias("overall")).alias("confidence"), prov.alias("provenance"))
    pages = r.assembled(e, ["doc_id"], item, "element_id")
    name = F.format_string("doc-%d", "doc_id")
    doc = F.struct(
        F.lit("0.1.0").alias("ir_version"), name.alias("document_id"), F.struct(F.lit("rules").alias("name"), F.lit("1").alias("version")).alias("generator"),
        F.array(F.struct(F.lit("p001").alias("id"), F.lit(1).alias("number"), F.struct(F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.lit("pt").alias("unit")).alias("size"), F.col("elements"))).alias("pages"),
        F.array(F.struct(F.lit("a").alias("id"), F.concat(F.lit("assets/sha256-"), F.sha2(name, 256), F.lit(".png")).alias("path"), F.lit("image/png").alias("media_type"), F.sha2(name, 256).alias("sha256"))).alias("assets"),
    )
    json = F.to_json(doc)
    broken = F.when(F.col("doc_id") % 31 == 0, F.regexp_replace(json, '"ir_version":"0.1.0",', "")).when(F.col("doc_id") % 37 == 0, F.regexp_replace(json, r"^\{", '{"extra":1,')).when(F.col("doc_id") % 41 == 0, F.substring(json, 2, 1 << 30)).otherwise(json)
    return pages.select(name.alias("path"), broken.alias("content"))


@query(layout.GRID_SQL + """
SELECT 'doc-' || doc_id AS doc_id, count(*) AS elements, round(sum(x * 3 + y * 5 + w * 7 + h * 11), 3) AS boxes, min(element_id) AS first
FROM rects WHERE doc_id % 41 <> 0 OR doc_id % 31 = 0 OR doc_id % 37 = 0 GROUP BY doc_id""")
def parsed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents parsed and flattened to elements."""
    e = r.elements(r.parsed(documents(spark, sf_dir)).where("NOT bad"))
    b = Box.of()
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("elements"), F.round(F.sum(b.x * 3 + b.y * 5 + b.w * 7 + b.h * 11), 3).alias("boxes"), F.min("ref").alias("first"))


@query(layout.GRID_SQL + """
SELECT 'doc-' || doc_id AS doc_id, CASE WHEN doc_id % 31 = 0 THEN '$.ir_version' WHEN doc_id % 37 = 0 THEN '$.extra' ELSE '$.' END AS path,
  CASE WHEN doc_id % 31 = 0 THEN 'missing_field' WHEN doc_id % 37 = 0 THEN 'unknown_field' ELSE 'not_an_object' END AS code
FROM ord WHERE doc_id % 31 = 0 OR doc_id % 37 = 0 OR doc_id % 41 = 0""")
def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and unknown fields, and content that is no object."""
    return r.field_issues(documents(spark, sf_dir))


@query(layout.GRID_SQL + """
SELECT 'doc-' || doc_id AS doc_id, 'structure' AS stage, count(*) AS refs, count(DISTINCT source) AS names FROM (SELECT doc_id, unnest([element_id, kind]) AS source FROM rects) WHERE doc_id % 41 <> 0 OR doc_id % 31 = 0 OR doc_id % 37 = 0 GROUP BY doc_id""")
def provenance_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source references of provenance records."""
    p = r.provenance(r.elements(r.parsed(documents(spark, sf_dir)).where("NOT bad")))
    return p.groupBy("doc_id", "stage").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("source_ref").alias("names"))


@query(layout.GRID_SQL + """,
reg AS (SELECT doc_id, 'a' AS asset_id FROM ord)
SELECT 'doc-' || doc_id AS doc_id, 'a' AS asset_id, CASE WHEN doc_id % 6 = 0 THEN 'payload_missing' WHEN doc_id % 6 = 1 THEN 'payload_repeated' ELSE 'payload_differs' END AS code FROM reg WHERE doc_id % 6 < 3
UNION ALL SELECT 'doc-' || doc_id, 'b', 'payload_unknown' FROM reg WHERE doc_id % 6 = 3""")
def payload_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads against the registry, as sets."""
    ids = layout.table(spark, sf_dir, "orders").select(F.format_string("doc-%d", "o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 6).alias("k"))
    registry = ids.select("doc_id", F.lit("a").alias("asset_id"), F.sha2("doc_id", 256).alias("sha256"))
    own = ids.where("k <> 0").select("doc_id", F.lit("a").alias("asset_id"), F.when(F.col("k") == 2, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("doc_id", 256)).alias("sha256"), F.explode(F.when(F.col("k") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_n")).drop("_n")
    strange = ids.where("k = 3").select("doc_id", F.lit("b").alias("asset_id"), F.sha2(F.lit("b"), 256).alias("sha256"))
    return r.payload_issues(registry, own.unionByName(strange))


@query(layout.TOKENS_SQL + "," + layout.candidate_sql() + """
SELECT doc_id, line_no, count(*) AS words, sum(x)::BIGINT AS xs, count(conf) AS known FROM cand WHERE conf IS NULL OR conf >= 0.2 GROUP BY ALL""")
def engine_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as parallel arrays back to words; confidences scaled and filtered."""
    c = layout.candidate(layout.tokens(spark, sf_dir))
    raw = F.coalesce((F.col("conf") * 100).cast("string"), F.lit("-1"))
    rows = F.array_sort(F.collect_list(F.struct("word_no", F.col("word").alias("text"), raw.alias("conf"), F.col("x").alias("left"), F.col("y").alias("top"), F.col("w").alias("width"), F.col("h").alias("height"))))
    packed = c.groupBy("doc_id", "line_no").agg(rows.alias("rows"))
    arrays = {n: F.col(f"rows.{n}") for n in ("text", "conf", "left", "top", "width", "height")}
    words = r.engine_rows(packed.select("doc_id", "line_no", *[v.alias(k) for k, v in arrays.items()])).where("text <> ''").withColumn("conf", t.confidence(F.col("conf")))
    kept = words.where(F.col("conf").isNull() | (F.round("conf", 9) >= 0.2))
    return kept.groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("words"), F.sum("left").alias("xs"), F.count("conf").alias("known"))


@query(layout.TOKENS_SQL + """,
d AS (SELECT doc_id, word, count(*) AS n, min(line_no * 100000 + word_no) AS first FROM tokens GROUP BY ALL)
SELECT doc_id, count(*) AS assets, sum(n - 1)::BIGINT AS repeated, sum(first)::BIGINT AS firsts FROM d GROUP BY doc_id""")
def content_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry entry for each digest in a document; the first use wins."""
    words = layout.words(spark, sf_dir).withColumn("sha256", F.sha2("word", 256))
    rows = order.first_uses(words, ["doc_id", "sha256"], "line_no", "word_no")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("assets"), F.sum(F.col("n") - 1).alias("repeated"), F.sum(F.col("line_no").cast("long") * 100000 + F.col("word_no")).alias("firsts"))


@query("""
a AS (SELECT o_orderkey AS doc_id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders),
b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'X' ELSE status END AS status, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE priority END AS priority, price + (doc_id % 3 = 0)::INT AS price FROM a)
SELECT doc_id, concat_ws(',', CASE WHEN a.priority IS DISTINCT FROM b.priority THEN 'priority' END, CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END) AS changed FROM a JOIN b USING (doc_id)""")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ between two runs, but for those that may."""
    a = layout.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    b = a.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(F.col("doc_id") % 10 != 0, F.col("priority")).alias("priority"), (F.col("price") + (F.col("doc_id") % 3 == 0).cast("int")).alias("price"))
    return compare.field_changes(a, b, ["doc_id"], ["price"]).select("doc_id", F.array_join("changed", ",").alias("changed"))


@query(layout.TOKENS_SQL + """
SELECT doc_id, count(*) AS n, floor(sum(CASE WHEN w >= 24 AND w >= 4 * h / 2 THEN round(least(1.0, greatest(0.0, 0.55 + 0.25 * (word_no % 5) / 4 + 0.20 * least(1.0, 4 * w / 595.0))), 6) ELSE 0 END))::BIGINT AS scores, count(*) FILTER (WHERE w >= 24 AND w >= 4 * h / 2) AS kept FROM tokens GROUP BY doc_id""")
def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and score of measured line candidates."""
    c = layout.tokens(spark, sf_dir)
    keep = g.is_raw_line(F.col("w"), F.col("h") / 2, 24, 100)
    s = g.line_score((F.col("word_no") % 5) / 4, F.col("w") / 595.0)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(F.when(keep, s).otherwise(0.0))).cast("long").alias("scores"), F.count(F.when(keep, 1)).alias("kept"))
