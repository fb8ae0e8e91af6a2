"""Queries over ruled pages: tables, roles, text membership, matching, suppression, line merging, the release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import Box, unit_box
from pagewright.operators import assign, gate, match, order, score, topology
from pagewright.operators import validate as v
from pagewright.sources import layout

PAGE = ["doc_id"]
W, H = layout.PAGE_W, layout.PAGE_H
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + layout.GRID_SQL.strip() + sql.rstrip()
        return f

    return add


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.grid_rects(spark, sf_dir).withColumnRenamed("element_id", "ref")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.grid_lines(spark, sf_dir).withColumnRenamed("element_id", "ref")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.grid_texts(spark, sf_dir).withColumnRenamed("element_id", "ref")


def found(spark: SparkSession, sf_dir: str) -> topology.Grids:
    return topology.grids(topology.usable(rects(spark, sf_dir), F.lit(W), F.lit(H)), PAGE)


#: The generator knows its grids: a page closes unless a cell is missing, columns are a third of the width.
CLOSED = """,
closed AS (SELECT * FROM ord WHERE doc_id % 7 <> 0),
cells AS (SELECT r.doc_id, r.element_id AS ref, r.r, r.c, CASE WHEN r.w = 200 THEN 2 ELSE 1 END AS colspan, r.x, r.y, r.w, r.h FROM rects r JOIN closed USING (doc_id) WHERE r.kind = 'cell')"""


@query(CLOSED + """
SELECT doc_id, ref, r AS row, c AS col, 1 AS rowspan, colspan, printf('p001-table-0000-cell-r%03d-c%03d', r, c) AS cell_id FROM cells""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with spans of every grid that closes."""
    cells = found(spark, sf_dir).cells
    return cells.select("doc_id", "ref", F.col("row").cast("int"), F.col("col").cast("int"), F.col("rowspan").cast("int"), F.col("colspan").cast("int"), "cell_id")


@query(CLOSED + """
SELECT doc_id, 'outer' AS outer_ref FROM ord WHERE doc_id % 7 = 0""")
def rejected_outers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer rectangles whose grid doesn't close."""
    return found(spark, sf_dir).rejected.select("doc_id", F.col("outer").alias("outer_ref"))


@query(CLOSED + """,
hits AS (SELECT t.doc_id, t.element_id AS ref, count(c.ref) AS hits, min(printf('p001-table-0000-cell-r%03d-c%03d', c.r, c.c)) FILTER (WHERE c.ref IS NOT NULL) AS one
  FROM texts t LEFT JOIN cells c ON c.doc_id = t.doc_id AND t.x + t.w / 2 BETWEEN c.x AND c.x + c.w AND t.y + t.h / 2 BETWEEN c.y AND c.y + c.h GROUP BY ALL)
SELECT doc_id, ref, CASE WHEN hits = 1 THEN one ELSE '' END AS cell_id, hits FROM hits""")
def text_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only cell that holds a text's centre."""
    return topology.text_cells(texts(spark, sf_dir), found(spark, sf_dir).cells, PAGE).fillna("", ["cell_id"])


@query(CLOSED + """
SELECT doc_id, element_id AS ref, CASE WHEN kind = 'frame' THEN 'page_frame' WHEN doc_id % 7 = 0 THEN 'unassigned' WHEN kind = 'outer' THEN 'table_outer_border' ELSE 'cell_rectangle' END AS role FROM rects
UNION ALL SELECT doc_id, element_id, CASE WHEN element_id = 'line-edge' THEN 'page_frame' WHEN element_id = 'line-stray' OR doc_id % 7 = 0 THEN 'page_decoration'
  WHEN element_id LIKE 'line-h%' THEN CASE WHEN y1 < 1 OR y1 > n * 20 - 1 THEN 'duplicated_supporting_primitive' ELSE 'row_boundary' END ELSE 'column_boundary' END FROM rules JOIN ord USING (doc_id)""")
def primitive_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rectangle and line is for."""
    g = found(spark, sf_dir)
    a = topology.rectangle_roles(rects(spark, sf_dir), g, PAGE, F.lit(W), F.lit(H)).select("doc_id", "ref", "role")
    return a.unionByName(topology.line_roles(lines(spark, sf_dir), g, PAGE, F.lit(W), F.lit(H)).select("doc_id", "ref", "role"))


@query(CLOSED + """
SELECT doc_id, 'y' AS axis, r AS "index", round(r * 20.0, 6)::DOUBLE AS start, round((r + 1) * 20.0, 6)::DOUBLE AS "end" FROM (SELECT doc_id, unnest(range(n)) AS r FROM closed)""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as intervals between boundaries."""
    axes = topology.spans_of_axes(found(spark, sf_dir), PAGE).where("axis = 'y'")
    return axes.select("doc_id", "axis", F.col("index").cast("int"), "start", "end")


@query(CLOSED + """,
edges AS (
  SELECT c.doc_id, c.ref, l.element_id AS line FROM cells c JOIN rules l ON l.doc_id = c.doc_id AND l.y1 = l.y2 AND least(abs(l.y1 - c.y), abs(l.y1 - c.y - c.h)) <= 1 AND least(l.x2, c.x + c.w) > greatest(l.x1, c.x)
  UNION ALL SELECT c.doc_id, c.ref, l.element_id FROM cells c JOIN rules l ON l.doc_id = c.doc_id AND l.x1 = l.x2 AND least(abs(l.x1 - c.x), abs(l.x1 - c.x - c.w)) <= 1 AND least(l.y2, c.y + c.h) > greatest(l.y1, c.y))
SELECT c.doc_id, c.ref, count(line) AS n, coalesce(min(line), '') AS first, coalesce(max(line), '') AS last FROM cells c LEFT JOIN edges USING (doc_id, ref) GROUP BY ALL""")
def cell_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that support an edge of each cell."""
    held = assign.edge_lines(found(spark, sf_dir).cells.select("doc_id", "ref", "x", "y", "w", "h"), lines(spark, sf_dir).select("doc_id", "ref", "x1", "y1", "x2", "y2"), PAGE)
    return held.select("doc_id", "ref", F.size("lines").cast("long").alias("n"), F.coalesce(F.array_min("lines"), F.lit("")).alias("first"), F.coalesce(F.array_max("lines"), F.lit("")).alias("last"))


@query(CLOSED + """,
edges AS (
  SELECT doc_id, 'containment' AS kind, count(*) AS n FROM cells GROUP BY doc_id
  UNION ALL SELECT c.doc_id, 'containment', count(*) FILTER (WHERE n = 1) FROM (SELECT t.doc_id, t.element_id, count(c.ref) AS n FROM texts t JOIN cells c ON c.doc_id = t.doc_id AND t.x + t.w / 2 BETWEEN c.x AND c.x + c.w AND t.y + t.h / 2 BETWEEN c.y AND c.y + c.h GROUP BY ALL) c GROUP BY ALL
  UNION ALL SELECT doc_id, 'adjacency', count(*) - n FROM cells JOIN ord USING (doc_id) GROUP BY doc_id, n
  UNION ALL SELECT doc_id, 'reading_order', n * 3 FROM ord)
SELECT doc_id, kind, sum(n)::BIGINT AS edges FROM edges GROUP BY ALL""")
def table_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment, neighbours in a row and reading order as edges."""
    e = topology.relations(found(spark, sf_dir), texts(spark, sf_dir), PAGE)
    return e.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("edges"))


def shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reviewed cells, and candidates that lie a little aside; every 11th is missing."""
    cells = rects(spark, sf_dir).where("kind = 'cell'").withColumn("type", F.lit("rectangle"))
    box = unit_box(Box.of(), F.lit(W), F.lit(H))
    expected = cells.select("doc_id", "type", "ref", box.x.alias("x"), box.y.alias("y"), box.w.alias("w"), box.h.alias("h"))
    moved = cells.where("(doc_id + r * 3 + c) % 11 <> 0").withColumn("x", F.col("x") + (F.col("doc_id") % 3) * 15.0).withColumn("ref", F.concat(F.lit("o-"), "ref"))
    return expected, moved.select("doc_id", "type", "ref", box.x.alias("x"), box.y.alias("y"), box.w.alias("w"), box.h.alias("h"))


@query()
def structure_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matching of structures, at least 50 of 100 alike."""
    pairs = score.structure_pairs(*shifted(spark, sf_dir), PAGE)
    won = match.greedy_match(pairs, PAGE, "expected", "observed", "similarity", 50.0, ["type"])
    return won.select("doc_id", "expected", "observed", F.round("similarity", 6).alias("similarity"))


@query(""",
boxes AS (SELECT doc_id, element_id || s AS ref, conf + s * 0.01 AS conf, x + s * 4.0 AS x, y, w, h FROM rects, range(3) t(s) WHERE kind = 'cell'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, w * h DESC, y, x, ref) AS rank FROM boxes),
runs AS (SELECT doc_id, list_reduce(list({'ref': [ref], 'x': [x], 'y': [y], 'w': [w], 'h': [h]} ORDER BY rank), lambda a, b:
   CASE WHEN len(list_filter(range(1, len(a.ref) + 1), lambda i: greatest(0, least(a.x[i] + a.w[i], b.x[1] + b.w[1]) - greatest(a.x[i], b.x[1])) * greatest(0, least(a.y[i] + a.h[i], b.y[1] + b.h[1]) - greatest(a.y[i], b.y[1])) / least(a.w[i] * a.h[i], b.w[1] * b.h[1]) >= 0.92
        OR greatest(0, least(a.x[i] + a.w[i], b.x[1] + b.w[1]) - greatest(a.x[i], b.x[1])) * greatest(0, least(a.y[i] + a.h[i], b.y[1] + b.h[1]) - greatest(a.y[i], b.y[1])) / (a.w[i] * a.h[i] + b.w[1] * b.h[1] - greatest(0, least(a.x[i] + a.w[i], b.x[1] + b.w[1]) - greatest(a.x[i], b.x[1])) * greatest(0, least(a.y[i] + a.h[i], b.y[1] + b.h[1]) - greatest(a.y[i], b.y[1]))) >= 0.75)) > 0 THEN a
   ELSE {'ref': a.ref || b.ref, 'x': a.x || b.x, 'y': a.y || b.y, 'w': a.w || b.w, 'h': a.h || b.h} END) AS kept FROM ranked GROUP BY doc_id)
SELECT doc_id, unnest(kept.ref) AS ref FROM runs""")
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of nearly equal boxes the best stays; three versions of each cell, 4 pt apart."""
    cells = rects(spark, sf_dir).where("kind = 'cell'").withColumn("s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    boxes = cells.select("doc_id", F.concat("ref", F.col("s").cast("string")).alias("ref"), (F.col("conf") + F.col("s") * 0.01).alias("conf"), (F.col("x") + F.col("s") * 4.0).alias("x"), "y", "w", "h")
    return match.suppress(boxes, PAGE, [F.desc("conf"), F.desc(Box.of().area), F.col("y"), F.col("x")]).select("doc_id", "ref")


@query(""",
raw AS (SELECT doc_id, y1 = y2 AS level, CASE WHEN y1 = y2 THEN (x1 + s * (x2 - x1) / 4)::BIGINT ELSE x1::BIGINT END AS x, CASE WHEN y1 = y2 THEN y1::BIGINT ELSE 0 END AS y, element_id FROM rules, range(4) t(s) WHERE element_id LIKE 'line-h%')
SELECT doc_id, count(DISTINCT element_id) AS lines, (300 * count(DISTINCT element_id))::BIGINT AS total FROM raw GROUP BY doc_id""")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruling lines cut in four with gaps of 3 pixels, put together again."""
    rules = lines(spark, sf_dir).where("ref LIKE 'line-h%'").withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    raw = rules.select("doc_id", F.lit(True).alias("level"), (F.col("s") * 75).cast("int").alias("x"), F.floor("y1").cast("int").alias("y"), F.when(F.col("s") == 3, 75).otherwise(72).cast("int").alias("w"), F.lit(1).alias("h"), F.lit(0.9).alias("occupancy"), F.lit(595).alias("axis_length"))
    m = order.merged_lines(raw, PAGE)
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("w").cast("long").alias("total"))


@query(CLOSED + """,
e AS (SELECT doc_id, 'c' || ref AS edge FROM cells), o AS (SELECT doc_id, 'c' || ref AS edge FROM cells WHERE (doc_id + r) % 4 <> 0)
SELECT doc_id, count(*) AS expected, count(o.edge) AS observed, round(CASE WHEN count(o.edge) = 0 THEN 0 ELSE 2.0 * count(o.edge) / (count(*) + count(o.edge)) END, 9)::DOUBLE AS f1 FROM e LEFT JOIN o USING (doc_id, edge) GROUP BY doc_id""")
def edge_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over sets of edges."""
    cells = found(spark, sf_dir).cells.select("doc_id", "row", F.lit("containment").alias("kind"), F.col("table_id").alias("source"), F.col("ref").alias("target"))
    n = score.edge_f1(cells, cells.where("(doc_id + row) % 4 <> 0"), PAGE)
    return n.select("doc_id", "expected", "observed", F.round("f1", 9).alias("f1"))


@query(""",
e AS (SELECT doc_id, element_id, x, y, w, h FROM rects),
issues AS (
  SELECT doc_id, element_id AS path, 'geometry_outside_page' AS code FROM e WHERE x + w > 595.01 OR y + h > 842.01
  UNION ALL SELECT doc_id, element_id, 'low_confidence_value' FROM rects WHERE conf > 1
  UNION ALL SELECT doc_id, element_id, 'reading_order_not_contiguous' FROM texts WHERE reading_order <> 0 AND doc_id % 13 = 0
  UNION ALL SELECT doc_id, element_id, 'duplicate_id' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN doc_id % 17 = 0 THEN 'same' ELSE element_id END ORDER BY element_id) AS n FROM rects) WHERE n > 1)
SELECT doc_id, code, count(*) AS n, min(path) AS first FROM issues GROUP BY ALL""")
def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken copies of the ruled pages, reported as issue rows."""
    e = rects(spark, sf_dir)
    t = texts(spark, sf_dir).withColumn("number", F.when((F.col("doc_id") % 13 == 0) & (F.col("reading_order") > 0), F.col("reading_order") + 1).otherwise(F.col("reading_order")))
    found_issues = v.issues(
        v.outside_page(e.withColumns({"page_w": F.lit(W), "page_h": F.lit(H)}), "ref"),
        v.broken(e, [("low_confidence_value", F.col("conf") > 1)], "ref"),
        v.not_contiguous(t, PAGE, "number", ["reading_order", "ref"], "ref"),
        v.repeated(e.withColumn("id", F.when(F.col("doc_id") % 17 == 0, "same").otherwise(F.col("ref"))), ["doc_id", "id"], ["ref"], "ref"),
    )
    return found_issues.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


MEASURED = """
m AS (SELECT 'stage-' || c_nationkey AS stage_id, 'fixture-' || c_custkey AS fixture_id, (c_custkey * 37 % 4000) / 100 + 62 AS score, c_custkey % 9 <> 0 AS integrity FROM customer),
p AS (SELECT 'stage-' || c_nationkey AS stage_id, 'fixture-' || c_custkey AS fixture_id, (c_custkey * 53 % 4000) / 100 + 60 AS score FROM customer WHERE c_custkey % 5 <> 0)"""


def measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = layout.table(spark, sf_dir, "customer")
    key = [F.concat(F.lit("stage-"), F.col("c_nationkey").cast("string")).alias("stage_id"), F.concat(F.lit("fixture-"), F.col("c_custkey").cast("string")).alias("fixture_id")]
    now = c.select(*key, ((F.col("c_custkey") * 37 % 4000) / 100 + 62).alias("score"), (F.col("c_custkey") % 9 != 0).alias("integrity"))
    return now, c.where("c_custkey % 5 <> 0").select(*key, ((F.col("c_custkey") * 53 % 4000) / 100 + 60).alias("score"))


@query()
def stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage passes only if each of its fixtures does."""
    d = gate.stage_decisions(gate.fixture_decisions(measured(spark, sf_dir)[0]))
    return d.select("stage_id", "fixtures", "minimum", F.round(F.col("total") * 100).cast("long").alias("hundredths"), "passed")


SQL["stage_gate"] = "WITH " + MEASURED.strip() + """
SELECT stage_id, count(*) AS fixtures, round(min(score), 6) AS minimum, round(sum(score) * 100)::BIGINT AS hundredths, bool_and(score >= 70 AND integrity) AS passed FROM m GROUP BY stage_id"""


@query()
def fixture_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with the change since the stage before."""
    now, before = measured(spark, sf_dir)
    rows = gate.with_previous(gate.fixture_decisions(now), before)
    return rows.select("stage_id", "fixture_id", "score", "passed", F.size("reasons").cast("long").alias("reasons"), F.coalesce("change", F.lit(0.0)).alias("change"))


SQL["fixture_changes"] = "WITH " + MEASURED.strip() + """
SELECT m.stage_id, m.fixture_id, m.score, m.score >= 70 AND integrity AS passed, (CASE WHEN m.score < 70 AND NOT integrity THEN 2 ELSE 1 END)::BIGINT AS reasons, coalesce(round(m.score - p.score, 6), 0) AS change FROM m LEFT JOIN p USING (stage_id, fixture_id)"""


@query()
def table_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's inference couldn't place, by code."""
    d = topology.diagnostics(found(spark, sf_dir), texts(spark, sf_dir), PAGE)
    return d.select("doc_id", "code", F.size("refs").cast("long").alias("n"), F.array_min("refs").alias("first"))


@query(CLOSED + """,
c AS (SELECT *, sum(colspan) OVER (PARTITION BY doc_id, r ORDER BY c) - colspan AS col FROM cells)
SELECT doc_id, ref, col::BIGINT AS col, first_value(ref) OVER (PARTITION BY doc_id, col, r // 2 ORDER BY r) AS owner FROM c""")
def carried_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns from spans, and the cell that a vertically merged one belongs to (two rows each)."""
    cells = found(spark, sf_dir).cells.select("doc_id", "row", F.col("col").alias("place"), F.col("colspan").alias("span"), "ref")
    # A cell goes on with the one above in every second row, if there is one that starts in its column.
    column = F.coalesce(F.sum("span").over(Window.partitionBy("doc_id", "row").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = cells.withColumn("_c", column)
    above = F.lag("row").over(Window.partitionBy("doc_id", "_c").orderBy("row"))
    marked = marked.withColumn("merge", F.when((F.col("row") % 2 == 1) & (above == F.col("row") - 1), "continue").otherwise("restart")).drop("_c")
    return order.carried_cells(marked, PAGE).select("doc_id", "ref", F.col("column").cast("long").alias("col"), "owner")
