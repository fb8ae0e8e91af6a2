"""Queries over parts of the record and evaluation rules: unit boxes, neighbours, page images, counts, digests, mapped edges, scores, page texts.

Boxes are made from columns of ``lineitem`` so that every rule meets rows on both sides of it; a document is an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.operators import compare, score
from pagewright.sources import layout

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = "WITH " + sql.strip()
        return f

    return add


BOXES = """
boxes AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, (l_partkey % 640 - 20)::DOUBLE AS x, (l_suppkey % 900 - 30)::DOUBLE AS y,
  (l_quantity::INT * 13 - 26)::DOUBLE AS w, (l_linenumber * 40 + l_partkey % 7 - 43)::DOUBLE AS h, l_returnflag AS kind FROM lineitem)"""


def page_size() -> tuple[Column, Column]:
    return F.lit(layout.PAGE_W), F.lit(layout.PAGE_H)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 640 - 20).cast("double").alias("x"), (F.col("l_suppkey") % 900 - 30).cast("double").alias("y"),
        (F.col("l_quantity").cast("int") * 13 - 26).cast("double").alias("w"), (F.col("l_linenumber") * 40 + F.col("l_partkey") % 7 - 43).cast("double").alias("h"), F.col("l_returnflag").alias("kind"),
    )


@query(BOXES + """,
u AS (SELECT *, least(1.0, greatest(w / 595, 1 / 595.0::DOUBLE)) AS uw, least(1.0, greatest(h / 842, 1 / 842.0::DOUBLE)) AS uh FROM boxes)
SELECT doc_id, n, least(greatest(x / 595, 0.0::DOUBLE), 1 - uw) AS ux, least(greatest(y / 842, 0.0::DOUBLE), 1 - uh) AS uy, uw, uh, w > 0 AND h > 0 AS has_extent,
  CASE WHEN w > 0 AND h > 0 THEN x / 595 END AS plain_x, x >= -0.01 AND y >= -0.01 AND x + w <= 595.01 AND y + h <= 842.01 AS inside,
  x + (w - 1) / 2 >= 100 AND x + (w - 1) / 2 < 400 AND y + (h - 1) / 2 >= 200 AND y + (h - 1) / 2 < 600 AS pixel_center,
  x + w / 2 >= 99.5 AND x + w / 2 <= 400.5 AND y + h / 2 >= 199.5 AND y + h / 2 <= 600.5 AS near_center FROM u""")
def unit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as shares of the page, and points and boxes inside others, by pixels and with a tolerance."""
    b, frame = g.Box.of(), g.Box(F.lit(100), F.lit(200), F.lit(300), F.lit(400))
    unit, plain = g.unit_box(b, *page_size()), g.plain_unit_box(b, *page_size())
    return boxes(spark, sf_dir).select(
        "doc_id", "n", unit.x.alias("ux"), unit.y.alias("uy"), unit.w.alias("uw"), unit.h.alias("uh"), plain.isNotNull().alias("has_extent"), plain["x"].alias("plain_x"),
        g.inside_page(b, *page_size(), 0.01).alias("inside"), g.has_pixel_center(frame, b).alias("pixel_center"), g.has_point(frame, *b.center, 0.5).alias("near_center"),
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """Each box with the next one of its document, columns o_..."""
    other = rows.select("doc_id", (F.col("n") - 1).alias("n"), *[F.col(c).alias(f"o_{c}") for c in "xywh"])
    return rows.join(other, ["doc_id", "n"])


@query(BOXES + """,
pos AS (SELECT *, greatest(w, 1) AS pw, greatest(h, 1) AS ph FROM boxes),
p AS (SELECT a.doc_id, a.n, a.x, a.y, a.pw AS w, a.ph AS h, b.x AS ox, b.y AS oy, b.pw AS ow, b.ph AS oh, (b.x + b.pw / 2) - (a.x + a.pw / 2) AS dx, (b.y + b.ph / 2) - (a.y + a.ph / 2) AS dy FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.n = a.n + 1),
d AS (SELECT *, CASE WHEN abs(dx) <= 1e-12 AND abs(dy) <= 1e-12 THEN NULL WHEN abs(dx) >= abs(dy) THEN 'horizontal' ELSE 'vertical' END AS axis,
  CASE WHEN abs(dx) <= 1e-12 AND abs(dy) <= 1e-12 THEN 0 WHEN CASE WHEN abs(dx) >= abs(dy) THEN dx ELSE dy END > 0 THEN 1 ELSE -1 END AS sign FROM p)
SELECT doc_id, n, axis, sign, greatest(0, CASE WHEN axis = 'horizontal' THEN CASE WHEN sign > 0 THEN ox - (x + w) ELSE x - (ox + ow) END ELSE CASE WHEN sign > 0 THEN oy - (y + h) ELSE y - (oy + oh) END END)::DOUBLE AS gap,
  ow * oh < w * h - 0.01 AND ox >= x - 2 AND oy >= y - 2 AND ox + ow <= x + w + 2 AND oy + oh <= y + h + 2 AS held FROM d""")
def box_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and gap from each box to the next one, and whether the first strictly holds it."""
    rows = boxes(spark, sf_dir).withColumns({"w": F.greatest("w", F.lit(1.0)), "h": F.greatest("h", F.lit(1.0))})
    a, b = g.Box.of(), g.Box.of("o_")
    axis, sign = g.direction(a, b)
    return neighbours(rows).select("doc_id", "n", axis.alias("axis"), sign.alias("sign"), g.directed_gap(a, b, axis, sign).cast("double").alias("gap"), g.strictly_has(a, b).alias("held"))


@query("""
t AS (SELECT p_partkey AS part, (p_size * 13)::DOUBLE AS w, (p_size * 17 + p_partkey % 90)::DOUBLE AS h, p_partkey % 3 = 0 AS same FROM part)
SELECT part, w * h / (595 * 842.0::DOUBLE) >= 0.9 OR (same AND w / 595 >= 0.75 AND h / 842 >= 0.75) AS covers, w * h / (595 * 842.0::DOUBLE) >= 0.85 AS extracted FROM t""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that cover their page, by area or by the page's own pixel size, and the variant by area alone."""
    parts = layout.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), (F.col("p_size") * 13).cast("double").alias("w"), (F.col("p_size") * 17 + F.col("p_partkey") % 90).cast("double").alias("h"), (F.col("p_partkey") % 3).alias("pixels")
    )
    b = g.Box(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h"))
    covers = g.covers_page(b, *page_size(), F.lit(0), F.lit(0), F.col("pixels"), F.col("pixels"))
    return parts.select("part", covers.alias("covers"), (b.area / (layout.PAGE_W * layout.PAGE_H) >= 0.85).alias("extracted"))


@query("""
o AS (SELECT o_custkey AS doc_id, o_orderpriority AS kind, o_orderstatus AS role, floor(o_totalprice / 50000)::BIGINT AS price, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS again, o_orderdate FROM orders)
SELECT doc_id, count(*) AS elements, count(*) FILTER (WHERE role = 'F') AS finished, count(DISTINCT kind) AS kinds,
  string_agg(kind, '|' ORDER BY o_orderdate, o_orderkey) FILTER (WHERE again = 1) AS reasons, count(DISTINCT sha256(role || ':' || price)) AS digests FROM o GROUP BY doc_id""")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by type and role, distinct parameter digests, and reasons once each in their first order."""
    o = layout.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    rows = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")))
    return o.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("elements"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_distinct("o_orderpriority").alias("kinds"),
        F.array_join(F.array_distinct(F.transform(rows, lambda r: r["o_orderpriority"])), "|").alias("reasons"),
        F.size(F.collect_set(F.sha2(F.concat_ws(":", "o_orderstatus", F.floor(F.col("o_totalprice") / 50000).cast("string")), 256))).cast("long").alias("digests"),
    )


@query("""
b AS (SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 11 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS n, l_returnflag AS kind FROM lineitem),
a AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_returnflag AS kind FROM lineitem),
s AS (SELECT doc_id, n, kind, sum(d) AS d FROM (SELECT *, 1 AS d FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL)
SELECT doc_id, bool_and(d = 0) AS same FROM s GROUP BY doc_id""")
def same_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a candidate run holds exactly the control's rows, repeated ones as often."""
    control = layout.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_returnflag").alias("kind"), "l_partkey")
    candidate = control.withColumn("n", F.when(F.col("l_partkey") % 11 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return compare.same_rows(control.drop("l_partkey"), candidate.drop("l_partkey"), ["doc_id"])


@query("""
e AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, 'o' || l_linenumber AS source, 'o' || (l_linenumber + 1) AS target FROM lineitem),
m AS (SELECT l_orderkey AS doc_id, 'o' || l_linenumber AS observed, min('r' || l_partkey) AS reference FROM lineitem WHERE l_quantity > 15 GROUP BY ALL)
SELECT e.doc_id, e.n, coalesce(a.reference, e.source) AS source, coalesce(b.reference, e.target) AS target
FROM e LEFT JOIN m a ON a.doc_id = e.doc_id AND a.observed = e.source LEFT JOIN m b ON b.doc_id = e.doc_id AND b.observed = e.target""")
def mapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of observed edges as the reviewed elements that they match; ends without a match stay as they are."""
    rows = layout.table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("o"), c.cast("string"))
    edges = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), name(F.col("l_linenumber")).alias("source"), name(F.col("l_linenumber") + 1).alias("target"))
    matches = rows.where("l_quantity > 15").select(F.col("l_orderkey").alias("doc_id"), name(F.col("l_linenumber")).alias("observed"), F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("reference"))
    matches = matches.groupBy("doc_id", "observed").agg(F.min("reference").alias("reference"))
    return score.mapped_edges(edges, matches, ["doc_id"])


@query("""
c AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, (l_partkey % 101)::DOUBLE AS a, (l_suppkey % 101)::DOUBLE AS b, (l_quantity::INT * 2)::DOUBLE AS c, (l_linenumber * 14)::DOUBLE AS d FROM lineitem)
SELECT doc_id, n, round(round(a * {0}, 6) + round(b * {1}, 6) + round(c * {2}, 6) + round(d * {3}, 6), 2) AS total FROM c""".format(*[w for w, _ in score.WEIGHTS.values()]))
def weighted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component scores weighed into a total."""
    parts = [F.col("l_partkey") % 101, F.col("l_suppkey") % 101, F.col("l_quantity").cast("int") * 2, F.col("l_linenumber") * 14]
    components = dict(zip(score.WEIGHTS, [p.cast("double") for p in parts]))
    return layout.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), score.overall(components).alias("total"))


@query(layout.TOKENS_SQL + """,
p AS (SELECT doc_id, page_number, string_agg(word, ' ' ORDER BY y, x, h, w, word) AS text, count(*) AS n FROM tokens GROUP BY ALL)
SELECT doc_id, count(*) AS pages, sum(n)::BIGINT AS words, sha256(string_agg(text, chr(10) || chr(10) ORDER BY page_number)) AS digest FROM p GROUP BY doc_id""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each page by place, pages joined by a blank line."""
    words = F.array_sort(F.collect_list(F.struct("y", "x", "h", "w", "word")))
    pages = layout.tokens(spark, sf_dir).groupBy("doc_id", "page_number").agg(F.array_join(F.transform(words, lambda t: t["word"]), " ").alias("text"), F.count(F.lit(1)).alias("n"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda t: t["text"])
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("words"), F.sha2(F.array_join(texts, "\n\n"), 256).alias("digest"))


@query("""
r AS (SELECT l_orderkey AS doc_id, 'kind_' || l_returnflag AS reason, min(l_linenumber) AS place FROM lineitem GROUP BY ALL)
SELECT doc_id, count(*) AS n, string_agg(reason, ',' ORDER BY place, reason) AS reasons FROM r GROUP BY doc_id""")
def ordered_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons of a document, each once, in the order in which they first occur."""
    rows = layout.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.concat(F.lit("kind_"), "l_returnflag").alias("reason"))
    found = compare.ordered_reasons(rows, ["doc_id"], "l_linenumber", "reason")
    return found.select("doc_id", F.size("reasons").cast("long").alias("n"), F.array_join("reasons", ",").alias("reasons"))


@query("""
r AS (SELECT DISTINCT l_orderkey AS doc_id, sha256('{"mode":' || (l_linenumber % 3) || ',"kind":"' || l_returnflag || '"}') AS digest FROM lineitem)
SELECT doc_id, count(*) AS n, count(*) > 1 AS mixed, string_agg(digest, ',' ORDER BY digest) AS digests FROM r GROUP BY doc_id""")
def parameter_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With which parameters a document's runs were made, as digests, and whether these differ."""
    runs = layout.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("int") % 3).alias("mode"), F.col("l_returnflag").alias("kind"))
    found = compare.parameter_digests(runs, ["doc_id"], ["mode", "kind"])
    return found.select("doc_id", F.size("digests").cast("long").alias("n"), (F.size("digests") > 1).alias("mixed"), F.array_join("digests", ",").alias("digests"))
