"""Queries over word boxes: reading order, association, recovered text, confidences, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions import text as t
from pagewright.functions.geometry import Box
from pagewright.operators import assign, compare, order, score
from pagewright.sources import layout

PAGE = ["doc_id", "page_number"]
BASE = layout.TOKENS_SQL + "," + layout.candidate_sql() + "," + layout.REGIONS_SQL
QUERIES, SQL = {}, {}


def region_box() -> Box:
    return Box("rx", "ry", F.col("rr") - F.col("rx"), F.col("rb") - F.col("ry"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + sql.strip()
        return f

    return add


def micros(accuracy: str = "accuracy") -> Column:
    """Mean accuracy in millionths of a point, in whole numbers, so that no sum of fractions depends on its order."""
    return F.floor(F.sum(F.round(F.col(accuracy) * 1_000_000).cast("long")) / F.count(F.lit(1))).cast("long")


BLOCKS = """
hits AS (SELECT c.doc_id, c.page_number, c.word, c.x AS tx, c.y AS ty, c.word_no, r.line_no, row_number() OVER (PARTITION BY c.doc_id, c.line_no, c.word_no ORDER BY (rr - rx) * (rb - ry), r.line_no) AS n
  FROM cand c JOIN regions r USING (doc_id, page_number) WHERE c.x + c.w / 2 BETWEEN rx AND rr AND c.y + c.h / 2 BETWEEN ry AND rb),
found AS (SELECT doc_id, page_number, line_no, string_agg(word, '' ORDER BY tx, ty, word_no) AS text FROM hits WHERE n = 1 GROUP BY ALL),
blocks AS (SELECT r.doc_id, r.page_number, r.line_no, r.essential, f.text AS observed,
    round(greatest(0, 100 * (1 - levenshtein(r.txt, coalesce(f.text, '')) / greatest(length(r.txt), length(coalesce(f.text, ''))))), 6) AS accuracy
  FROM regions r LEFT JOIN found f USING (doc_id, page_number, line_no))"""


def blocks(spark: SparkSession, sf_dir: str, **run: int) -> DataFrame:
    """Reviewed lines with the accuracy of what a candidate run has in them."""
    tokens = layout.tokens(spark, sf_dir)
    regions = layout.reviewed(spark, sf_dir)
    held = assign.exclusive(layout.candidate(tokens, **run), regions.withColumnRenamed("line_no", "region_line"), PAGE, Box.of(), region_box(), ["region_line"], ["doc_id", "line_no", "word_no"])
    found = score.joined_text(held.select(*PAGE, F.col("region_line").alias("line_no"), "x", "y", "word_no", "word"), [*PAGE, "line_no"], ["x", "y", "word_no"], "word")
    return score.block_accuracy(regions.withColumnRenamed("txt", "text"), found, [*PAGE, "line_no"], normal=False)


@query(BASE + "," + BLOCKS + """
SELECT doc_id, count(*) AS blocks, (sum((accuracy * 1000000)::BIGINT) // count(*))::BIGINT AS accuracy_micros, count(*) FILTER (WHERE observed IS NOT NULL AND accuracy >= 60) AS covered,
  count(*) FILTER (WHERE essential AND NOT (observed IS NOT NULL AND accuracy >= 60)) AS missed_essential,
  CASE WHEN sum((accuracy * 1000000)::BIGINT) // count(*) >= 70000000 AND avg((observed IS NOT NULL AND accuracy >= 60)::INT) >= 0.6 AND count(*) FILTER (WHERE essential AND NOT (observed IS NOT NULL AND accuracy >= 60)) = 0 THEN 'pass' ELSE 'fail' END AS state
FROM blocks GROUP BY doc_id""")
def ocr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 over blocks: independent minima for accuracy and coverage, and the gate on essential blocks."""
    b = blocks(spark, sf_dir)
    told = b.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"), micros().alias("accuracy_micros"), F.count(F.when(F.col("covered"), 1)).alias("covered"), score.share(F.col("covered")).alias("c"), F.count(F.when(F.col("essential") & ~F.col("covered"), 1)).alias("missed_essential"),
    )
    failed = (F.col("accuracy_micros") < 70_000_000) | (F.col("c") < 60) | (F.col("missed_essential") > 0)
    return told.select("doc_id", "blocks", "accuracy_micros", "covered", "missed_essential", F.when(failed, "fail").otherwise("pass").alias("state"))


@query(BASE + """
SELECT doc_id, page_number, line_no, word_no, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no, x, y, w, h, word, word_no) - 1 AS reading_order FROM tokens""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows grown by overlap, then the order inside them."""
    tokens = layout.tokens(spark, sf_dir).withColumnsRenamed({"word": "text"}).withColumn("ref", F.format_string("%06d-%06d", "line_no", "word_no"))
    return order.reading_order(tokens, PAGE).select(*PAGE, "line_no", "word_no", F.col("reading_order").cast("long"))


@query(BASE + """
pts AS (SELECT doc_id, line_no, word_no, w, h, page_number, round(x * 72 / 144.0, 6) AS px, round(y * 72 / 144.0, 6) AS py, round((x + w) * 72 / 144.0, 6) AS pr, round((y + h) * 72 / 144.0, 6) AS pb, x, y FROM tokens)
SELECT doc_id, line_no, word_no, px, py, round(pr - px, 6) AS pw, round(pb - py, 6) AS ph, w * h AS area, x + w <= 1190 AND y + h <= 1684 AS inside,
  round(least(greatest(px / 595.0, 0), 1 - least(1.0, greatest(round(pr - px, 6) / 595.0, 1 / 595.0))), 9) AS ux, round(least(1.0, greatest(round(pr - px, 6) / 595.0, 1 / 595.0)), 9) AS uw,
  greatest(1.0, round(round(pb - py, 6) * 0.8, 6)) AS font
FROM pts""".replace("pts AS", ", pts AS", 1))
def token_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, shares of the page, page bounds and font size of every token."""
    px = g.point_box(Box.of(), F.lit(144.0), F.lit(144.0))
    rows = layout.tokens(spark, sf_dir).select("*", *[getattr(px, s).alias(f"p{s}") for s in "xywh"])
    u = g.unit_box(Box.of("p"), F.lit(595.0), F.lit(842.0))
    return rows.select(
        "doc_id", "line_no", "word_no", "px", "py", "pw", "ph", Box.of().area.alias("area"), g.inside_page(Box.of(), F.lit(1190), F.lit(1684)).alias("inside"),
        F.round(u.x, 9).alias("ux"), F.round(u.w, 9).alias("uw"), t.font_size(F.col("ph")).alias("font"),
    )


PAIRS = BASE + """, near AS (SELECT *, lead(line_no) OVER o AS b_line, lead(rx) OVER o AS b_x, lead(ry) OVER o AS b_y, lead(rr) OVER o AS b_r, lead(rb) OVER o AS b_b FROM regions WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY line_no)),
m AS (SELECT doc_id, line_no, b_line, rx, ry, rr, rb, b_x, b_y, b_r, b_b, greatest(0, least(rr, b_r) - greatest(rx, b_x)) AS ox, greatest(0, least(rb, b_b) - greatest(ry, b_y)) AS oy,
   rx + (rr - rx) / 2 AS acx, ry + (rb - ry) / 2 AS acy, b_x + (b_r - b_x) / 2 AS bcx, b_y + (b_b - b_y) / 2 AS bcy FROM near WHERE b_line IS NOT NULL)"""


@query(PAIRS + """
SELECT doc_id, line_no, b_line, ox AS overlap_x, round(oy / least(rb - ry, b_b - b_y), 9) AS row_overlap, round(ox * oy / ((rr - rx) * (rb - ry)), 9) AS shared,
  CASE WHEN acx = bcx AND acy = bcy THEN NULL WHEN abs(bcx - acx) >= abs(bcy - acy) THEN 'horizontal' ELSE 'vertical' END AS axis,
  ox * oy / ((rr - rx) * (rb - ry) + (b_r - b_x) * (b_b - b_y) - ox * oy) >= 0.75 OR ox * oy / least((rr - rx) * (rb - ry), (b_r - b_x) * (b_b - b_y)) >= 0.92 AS twin,
  (b_r - b_x) * (b_b - b_y) < (rr - rx) * (rb - ry) - 0.01 AND b_x >= rx - 1 AND b_y >= ry - 1 AND b_r <= rr + 1 AND b_b <= rb + 1 AS held
FROM m""")
def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How neighbouring lines of a page lie to each other."""
    regions = layout.reviewed(spark, sf_dir).withColumns({"x": F.col("rx"), "y": F.col("ry"), "w": region_box().w, "h": region_box().h})
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    pairs = regions.select("*", *[F.lead(c).over(w).alias(f"b_{c}") for c in ("line_no", "x", "y", "w", "h")]).where("b_line_no is not null")
    a, b = Box.of(), Box.of("b_")
    return pairs.select(
        "doc_id", "line_no", F.col("b_line_no").alias("b_line"), g.overlap(a.x, a.right, b.x, b.right).alias("overlap_x"), F.round(g.row_overlap(a, b), 9).alias("row_overlap"),
        F.round(g.shared_fraction(a, b), 9).alias("shared"), g.direction(a, b)[0].alias("axis"), g.nearly_same(a, b).alias("twin"), g.strictly_has(a, b).alias("held"),
    )


@query(BASE + """
SELECT doc_id, count(*) AS tokens, count(conf) AS known, count(*) - count(conf) AS missing, min(conf) AS least, round(avg(conf), 9) AS mean, max(conf) AS most,
  round(quantile_cont(conf, 0.1), 9) AS p10, round(quantile_cont(conf, 0.5), 9) AS median, round(quantile_cont(conf, 0.9), 9) AS p90, count(*) FILTER (WHERE conf < 0.3) AS low
FROM cand GROUP BY doc_id""")
def confidence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact statistics of known confidences, and how many are low."""
    c = layout.candidate(layout.tokens(spark, sf_dir))
    p = score.confidence_profile(c, ["doc_id"])
    low = score.low_confidence(c, 0.3).groupBy("doc_id").agg(F.count(F.lit(1)).alias("low"))
    rounded = [F.round(x, 9).alias(x) for x in ("mean", "p10", "median", "p90")]
    return p.join(low, "doc_id", "left").select("doc_id", "tokens", "known", "missing", "least", "most", *rounded, F.coalesce("low", F.lit(0)).alias("low"))


@query(BASE + """, ordered AS (SELECT *, lag(x) OVER o AS px, lag(w) OVER o AS pw, lag(y) OVER o AS py, lag(h) OVER o AS ph, lag(word_no) OVER o AS pn FROM cand WINDOW o AS (PARTITION BY doc_id, page_number, line_no ORDER BY x, y, w, h, word_no)),
marked AS (SELECT *, CASE WHEN pn IS NULL THEN 1 WHEN greatest(0, least(y + h, py + ph) - greatest(y, py)) / least(h, ph) < 0.45 OR greatest(0, x - px - pw) > greatest(h, ph) * 1.0 THEN 1 ELSE 0 END AS opens FROM ordered),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page_number ORDER BY line_no, x, y, w, h, word_no) - 1 AS group_index FROM marked)
SELECT doc_id, page_number, group_index::BIGINT AS group_index, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS members, min(conf) AS conf FROM numbered GROUP BY ALL""")
def grouped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a line joined until a lost token leaves too wide a gap."""
    c = layout.candidate(layout.tokens(spark, sf_dir)).withColumn("row_index", F.col("line_no")).withColumn("ref", F.format_string("%08d-%08d", "line_no", "word_no"))
    plan = order.planned_regions(order.region_groups(c, None, PAGE), PAGE)
    return plan.select(*PAGE, "group_index", "x", "y", "w", "h", F.size("members").cast("long").alias("members"), "conf")


@query(BASE + """
SELECT doc_id, page_number, line_no, band::BIGINT AS band FROM (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id, page_number ORDER BY ry, rx, line_no) AS band FROM (
    SELECT *, CASE WHEN ry > max(rb) OVER (PARTITION BY doc_id, page_number ORDER BY ry, rx, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 1 ELSE 0 END AS opens FROM regions))""")
def line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page in bands; an empty line parts them."""
    r = layout.reviewed(spark, sf_dir)
    return order.bands(r, PAGE, "ry", F.col("rb"), ("ry", "rx", "line_no")).select(*PAGE, "line_no", "band")


@query(BASE + """
SELECT doc_id, line_no, string_agg(CASE WHEN lag_x IS NULL THEN '' WHEN gap <= 0.01 THEN '' WHEN gap >= greatest(24.0, 32.0) THEN chr(9) WHEN regexp_matches(prev, '[A-Za-z0-9]$') AND regexp_matches(word, '^[A-Za-z0-9]') THEN ' ' WHEN regexp_matches(prev, '^[0-9]+[.)]$') AND regexp_matches(word, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || word, '' ORDER BY x, word_no) AS text
FROM (SELECT *, lag(x) OVER o AS lag_x, lag(word) OVER o AS prev, greatest(0, x - lag(x + w) OVER o) AS gap FROM cand WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY x, word_no)) GROUP BY ALL""")
def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of a line joined by tabs, spaces or nothing."""
    c = layout.candidate(layout.tokens(spark, sf_dir)).select("doc_id", F.col("line_no").alias("line_index"), F.col("word").alias("text"), "x", "w", F.lit(8.0).alias("font"), F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy("x", "word_no")).alias("place"))
    return order.line_texts(c, ["doc_id"]).select("doc_id", F.col("line_index").alias("line_no"), "text")


@query(BASE + """
SELECT doc_id, 'reading_order' AS kind, count(*) AS edges, sum(word_no + 1000 * line_no)::BIGINT AS sources, sum(nw + 1000 * nl)::BIGINT AS targets FROM (
  SELECT *, lead(word_no) OVER o AS nw, lead(line_no) OVER o AS nl FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY line_no, word_no)) WHERE nw IS NOT NULL GROUP BY doc_id""")
def reading_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between consecutive tokens of a document."""
    tokens = layout.tokens(spark, sf_dir).withColumn("ref", F.struct("word_no", "line_no"))
    e = order.next_edges(tokens, ["doc_id"], ["line_no", "word_no"], "reading_order")
    key = lambda c: F.sum(F.col(f"{c}.word_no") + 1000 * F.col(f"{c}.line_no"))
    return e.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("edges"), key("source").alias("sources"), key("target").alias("targets"))


@query(BASE + """
SELECT doc_id, page_number, line_no, word_no, min(r_line) AS region_line, count(r_line) AS hits FROM (
  SELECT c.*, r.line_no AS r_line FROM cand c LEFT JOIN regions r ON r.doc_id = c.doc_id AND r.page_number = c.page_number AND c.x + c.w / 2 BETWEEN rx AND rr AND c.y + c.h / 2 BETWEEN ry AND rb) GROUP BY ALL""")
def tokens_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reviewed line that has a token's centre."""
    tokens = layout.tokens(spark, sf_dir)
    c = layout.candidate(tokens)
    regions = layout.reviewed(spark, sf_dir).select(*PAGE, F.col("line_no").alias("region_line"), "rx", "ry", "rr", "rb")
    told = assign.holders(c, regions, PAGE, Box.of(), region_box())  # a page with a token has a region
    return told.select(*PAGE, "line_no", "word_no", F.array_min(F.transform("_held", lambda r: r["row"]["region_line"])).alias("region_line"), F.greatest(F.size("_held"), F.lit(0)).cast("long").alias("hits"))


@query(BASE + """, regs AS (SELECT * FROM regions WHERE line_no % 3 <> 2),
pairs AS (SELECT c.doc_id, c.line_no, c.word_no, r.line_no AS r_line, rx, ry, (rr - rx) * (rb - ry) AS area,
    c.line_no = r.line_no AND c.word_no % 4 = 0 AS named, c.x + (c.w - 1) / 2 >= rx AND c.x + (c.w - 1) / 2 < rr AND c.y + (c.h - 1) / 2 >= ry AND c.y + (c.h - 1) / 2 < rb AS center,
    greatest(0, least(c.x + c.w, rr) - greatest(c.x, rx)) * greatest(0, least(c.y + c.h, rb) - greatest(c.y, ry)) / (c.w * c.h) AS share
  FROM cand c JOIN regs r USING (doc_id, page_number)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, word_no ORDER BY CASE WHEN named THEN 1 WHEN center THEN 2 ELSE 3 END, CASE WHEN named THEN 0 WHEN center THEN area ELSE -share END, ry, rx, CASE WHEN named OR center THEN r_line ELSE -r_line END) AS n FROM pairs WHERE named OR center OR share >= 0.5)
SELECT c.doc_id, c.line_no, c.word_no, coalesce(r.r_line, -1) AS region_line, coalesce(NOT named, false) AS inferred FROM cand c LEFT JOIN ranked r ON r.doc_id = c.doc_id AND r.line_no = c.line_no AND r.word_no = c.word_no AND n = 1""")
def token_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of each token, named, by centre or by share; every third line has no region."""
    tokens = layout.tokens(spark, sf_dir)
    ref = lambda c: F.format_string("%08d", c)
    c = layout.candidate(tokens).withColumns({"parent_ref": F.when(F.col("word_no") % 4 == 0, ref("line_no")), "ref": F.format_string("%08d-%08d", "line_no", "word_no")})
    regions = layout.reviewed(spark, sf_dir).where("line_no % 3 <> 2").select(*PAGE, ref("line_no").alias("ref"), region_box().x.alias("x"), region_box().y.alias("y"), region_box().w.alias("w"), region_box().h.alias("h"))
    rows = assign.tokens_to_regions(c, regions, PAGE)
    return rows.select("doc_id", "line_no", "word_no", F.coalesce(F.col("region_ref").cast("int"), F.lit(-1)).alias("region_line"), F.coalesce("inferred", F.lit(False)).alias("inferred"))


@query(BASE + "," + BLOCKS + """
SELECT doc_id, count(*) AS anchors, count(*) FILTER (WHERE ok) AS recovered, coalesce(avg(ok::INT) * 100, 100.0) AS recall FROM (
  SELECT r.doc_id, contains(coalesce(a.text, ''), r.txt) AS ok FROM regions r LEFT JOIN (SELECT doc_id, string_agg(word, '' ORDER BY line_no, word_no) AS text FROM cand GROUP BY doc_id) a USING (doc_id) WHERE r.essential) GROUP BY doc_id""")
def anchor_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essential lines looked up in the whole recovered text."""
    tokens = layout.tokens(spark, sf_dir)
    whole = score.joined_text(layout.candidate(tokens), ["doc_id"], ["line_no", "word_no"], "word")
    wanted = layout.reviewed(spark, sf_dir).where("essential").select("doc_id", F.col("txt").alias("anchor"))
    a = score.anchors(whole, wanted, ["doc_id"], normal=False)
    return a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("anchors"), F.count(F.when(F.col("recovered"), 1)).alias("recovered"), score.share(F.col("recovered")).alias("recall"))


RUN = BASE + "," + layout.candidate_sql("control", 17, 19) + "," + BLOCKS
OTHER = BLOCKS.replace("hits", "hits2").replace("found", "found2").replace("blocks", "blocks2").replace("FROM cand c", "FROM control c")


@query(RUN + "," + OTHER + """,
a AS (SELECT doc_id, (sum((accuracy * 1000000)::BIGINT) // count(*))::BIGINT AS acc, 100 * avg((observed IS NOT NULL AND accuracy >= 60)::INT) AS cov, count(*) FILTER (WHERE essential AND NOT (observed IS NOT NULL AND accuracy >= 60)) AS miss FROM blocks2 GROUP BY doc_id),
b AS (SELECT doc_id, (sum((accuracy * 1000000)::BIGINT) // count(*))::BIGINT AS acc, 100 * avg((observed IS NOT NULL AND accuracy >= 60)::INT) AS cov, count(*) FILTER (WHERE essential AND NOT (observed IS NOT NULL AND accuracy >= 60)) AS miss FROM blocks GROUP BY doc_id),
l AS (SELECT p.doc_id, count(*) AS lost FROM blocks2 p JOIN blocks q USING (doc_id, page_number, line_no) WHERE (p.observed IS NOT NULL AND p.accuracy >= 60) AND NOT (q.observed IS NOT NULL AND q.accuracy >= 60) GROUP BY p.doc_id)
SELECT doc_id, b.acc - a.acc AS text_delta_micros, round(b.cov - a.cov, 6) AS block_delta, coalesce(lost, 0) AS lost_blocks,
  CASE WHEN b.acc - a.acc < 0 OR round(b.cov - a.cov, 6) < 0 OR coalesce(lost, 0) > 0 OR b.miss > a.miss THEN 'regressed' WHEN b.acc - a.acc < 1000000 THEN 'inconclusive' ELSE 'supported' END AS decision
FROM a JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)""")
def experiment_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate run against a control run, decided for each document."""
    key = [*PAGE, "line_no"]

    def side(name: str, b: DataFrame) -> DataFrame:
        return b.groupBy("doc_id").agg(micros().alias(f"{name}_acc"), score.share(F.col("covered")).alias(f"{name}_cov"), F.count(F.when(F.col("essential") & ~F.col("covered"), 1)).alias(f"{name}_miss"))

    control, candidate = blocks(spark, sf_dir, drop=17, spoil=19), blocks(spark, sf_dir)
    name = F.format_string("%d/%d", "page_number", "line_no").alias("block")
    change = compare.gained_lost(control.where("covered").select("doc_id", name), candidate.where("covered").select("doc_id", name), ["doc_id"], "block")
    rows = side("a", control).join(side("b", candidate), "doc_id").join(change, "doc_id", "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<string>")))
    text, block = (F.col("b_acc") - F.col("a_acc")), compare.delta(F.col("b_cov"), F.col("a_cov"))
    decision, _ = compare.decide({"text_character_accuracy": text / 1_000_000, "logical_block_coverage": block}, {"logical_block": F.col("lost")}, F.col("b_miss") > F.col("a_miss"), F.array().cast("array<string>"))
    return rows.select("doc_id", text.alias("text_delta_micros"), block.alias("block_delta"), F.size("lost").cast("long").alias("lost_blocks"), decision.alias("decision"))


@query(BASE + """
SELECT doc_id, line_no, length(txt) AS n, round((length(txt)) * 0.55, 6) AS advance, regexp_matches(txt, '^[0-9]+[.)]$') AS numbered, sha256('{"line":' || line_no || ',"text":"' || replace(replace(txt, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"}') AS digest,
  printf('p%03d-text-%04d', page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no)) - 1) AS element_id
FROM regions""")
def line_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advance widths, numbered prefixes, digests of canonical JSON and minted ids of lines."""
    r = layout.reviewed(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no")) - 1
    return r.select(
        "doc_id", "line_no", F.length("txt").cast("long").alias("n"), F.round(t.advance(F.col("txt")), 6).alias("advance"), t.is_numbered(F.col("txt")).alias("numbered"),
        t.json_digest(("text", F.col("txt")), ("line", F.col("line_no"))).alias("digest"), F.format_string("p%03d-text-%04d", "page_number", place).alias("element_id"),
    )


@query()
def line_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity ratio and edit runs of all lines that a run has spoilt, whatever their length."""
    # Texts that differ have an accuracy under 100 (rounding hides a change only beyond 200 million characters), so distances aren't worked out.
    differ = t.compact(F.col("text"), normal=False) != t.compact(F.col("observed"), normal=False)
    b = blocks(spark, sf_dir).where(F.col("observed").isNotNull() & differ).select("doc_id", "line_no", "text", "observed")
    b = b.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "line_no")  # few bytes, but long work: long lines are spread
    runs = t.text_differences(F.col("text"), F.col("observed"))
    return b.select("doc_id", "line_no", t.ratio_bound(F.col("text"), F.col("observed")).alias("bound"), t.ratio(F.col("text"), F.col("observed")).alias("ratio"), F.size(runs["missing"]).alias("missing"), F.size(runs["extra"]).alias("extra"))


@query(r"""n AS (SELECT page_id, html FROM pages) SELECT page_id, trim(regexp_replace(html, '[\x09-\x0D\x1C-\x20\x{85}\x{A0}]+', ' ', 'g')) AS spaced, length(regexp_replace(html, '[\x09-\x0D\x1C-\x20\x{85}\x{A0}]+', '', 'g')) AS compact FROM n""")
def normalised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC with white space collapsed or removed, over whole pages."""
    p = layout.table(spark, sf_dir, "pages")
    return p.select("page_id", t.spaced(F.col("html")).alias("spaced"), F.length(t.compact(F.col("html"))).cast("long").alias("compact"))


@query(BASE + """
SELECT doc_id, line_no, word_no, floor(x / 1.5)::BIGINT AS sx, ceil((x + w) / 1.5)::BIGINT - floor(x / 1.5)::BIGINT AS sw, greatest(0, x - 4)::BIGINT AS ux, least(2000, x - 4 + w) - greatest(0, x - 4) > 0 AS kept, greatest(1, floor(w * 1.5 + 0.5))::INT AS scaled
FROM tokens""")
def crop_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working pixels back to source pixels, padding taken off, scaled sizes."""
    b = Box.of()
    source = g.to_source(b, F.lit(1.5), F.lit(1.5), F.lit(0), F.lit(0), F.lit(1 << 40), F.lit(1 << 40))
    bare = g.unpadded(b, F.lit(4), F.lit(2000), F.lit(1 << 40))
    return layout.tokens(spark, sf_dir).select("doc_id", "line_no", "word_no", source.x.cast("long").alias("sx"), source.w.cast("long").alias("sw"), bare.x.cast("long").alias("ux"), (bare.w > 0).alias("kept"), g.scaled_side(b.w, F.lit(1.5)).alias("scaled"))
