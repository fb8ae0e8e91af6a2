"""Tables out of rectangles, lines and texts: outer borders, grids with spans, roles, axes and text membership.

Inputs have page columns and ref; rectangles and texts x, y, w, h, lines x1, y1, x2, y2. A grid stands if its cells
tile the outer rectangle by area, every cell edge lies on a boundary, and every slot is covered exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import FRAME_FRACTION, GRID_TOLERANCE, Box, Line, has_center, meets_table, on_page_frame, strictly_has
from pagewright.functions.text import minted
from pagewright.operators.assign import boxed, nearest, nearest_index, one_or_ambiguous
from pagewright.operators.match import by_page, cut
from pagewright.operators.order import boundaries

TILING = (0.8, 1.2)
LEAST_HELD = 2


@dataclass(frozen=True)
class Grids:
    """tables: outer, table_id; cells: outer, ref, row, col, rowspan, colspan; axes: outer, axis, index, at."""

    axes: DataFrame
    cells: DataFrame
    tables: DataFrame
    rejected: DataFrame
    ambiguous: DataFrame


def usable(rects: DataFrame, page_w: Column, page_h: Column) -> DataFrame:
    """Rectangles that don't frame the page (0.9 of its area or more)."""
    return rects.where(Box.of().area / (page_w * page_h) < FRAME_FRACTION)


def grids(rects: DataFrame, page: Sequence[str]) -> Grids:
    """Infer the grids of pages from usable rectangles; refs are unique in a page.

    A page's rectangles come together once, and each outer rectangle becomes a row with its members, axes and spans in arrays.
    That table is written out once; everything else is read from it without moving rectangles again.
    """
    p = list(page)
    key = [*p, "outer"]
    packed = rects.dropna(subset=p).groupBy(*p).agg(F.collect_list(F.struct("ref", *"xywh")).alias("_all"))
    pairs = packed.select(*p, "_all", F.explode("_all").alias("_o")).select(*p, "_o", F.explode("_all").alias("_i"))
    pairs = pairs.where((F.col("_o.ref") != F.col("_i.ref")) & strictly_has(boxed(F.col("_o")), boxed(F.col("_i"))))
    many = pairs.groupBy(*p, F.col("_o.ref").alias("outer")).agg(F.first("_o").alias("_o"), F.collect_list("_i").alias("_held")).where(F.size("_held") >= LEAST_HELD)
    # Outer rectangles hold at least two others and no other such one holds them. What several of them hold is shared.
    near = F.collect_list("_o").over(Window.partitionBy(*p))
    held_by = lambda of, i: F.filter(of, lambda o: (o["ref"] != i["ref"]) & strictly_has(boxed(o), boxed(i)))
    outers = many.withColumn("_near", near).where(F.size(held_by("_near", F.col("_o"))) == 0).withColumn("_near", near)
    alone = F.size("_near") == 1
    first = lambda i: F.array_min(F.transform(held_by("_near", i), lambda o: o["ref"])) == F.col("outer")
    rows = outers.select(
        *key, *[F.col(f"_o.{c}").alias(f"o_{c}") for c in "xywh"],
        F.when(alone, F.col("_held")).otherwise(F.filter("_held", lambda i: F.size(held_by("_near", i)) == 1)).alias("members"),
        F.when(~alone, F.transform(F.filter("_held", lambda i: (F.size(held_by("_near", i)) > 1) & first(i)), lambda i: i["ref"])).alias("shared"),
    )
    o = Box.of("o_")
    for name, lo, hi, start, end in (("xs", lambda m: m.x, lambda m: m.right, o.x, o.right), ("ys", lambda m: m.y, lambda m: m.bottom, o.y, o.bottom)):
        values = F.concat(F.transform("members", lambda m: lo(boxed(m))), F.transform("members", lambda m: hi(boxed(m))), F.array(start, end))  # noqa: B023
        rows = boundaries(rows, values, start, end, name)

    def spanned(m: Column) -> Column:
        b = boxed(m)
        at = {"row": ("ys", b.y), "row_end": ("ys", b.bottom), "col": ("xs", b.x), "col_end": ("xs", b.right)}
        return F.struct(*[m[c].alias(c) for c in ("ref", *"xywh")], *[nearest_index(F.col(axis), v).alias(n) for n, (axis, v) in at.items()])

    rows = rows.select(*key, *[f"o_{c}" for c in "xywh"], "shared", "xs", "ys", F.transform("members", spanned).alias("spans"))
    # Every slot once: spans are positive, their areas sum to the slots of the grid, and no slot is taken twice.
    tall, wide = (lambda s: s["row_end"] - s["row"]), (lambda s: s["col_end"] - s["col"])
    total = lambda value: F.aggregate("spans", value(None), lambda n, s: n + value(s))
    slots = F.flatten(F.transform("spans", lambda s: F.flatten(F.transform(F.sequence(s["row"], s["row_end"] - 1), lambda r: F.transform(F.sequence(s["col"], s["col_end"] - 1), lambda c: r * F.size("xs") + c)))))
    share = total(lambda s: F.lit(0.0) if s is None else boxed(s).area.cast("double")) / o.area
    rows = rows.withColumn("_slots", (F.size("xs") - 1) * (F.size("ys") - 1).cast("long"))
    whole = (F.size("spans") >= 2) & F.forall("spans", lambda s: F.coalesce((tall(s) > 0) & (wide(s) > 0), F.lit(False))) & share.between(*TILING) & (F.size("xs") >= 2) & (F.size("ys") >= 2)
    fits = total(lambda s: F.lit(0).cast("long") if s is None else tall(s) * wide(s)) == F.col("_slots")
    rows = rows.withColumn("good", F.when(whole, F.when(fits, F.size(F.array_distinct(slots)) == F.col("_slots"))))
    before = Window.partitionBy(*p).orderBy("o_y", "o_x", "o_h", "o_w", "outer").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("good", F.coalesce("good", F.lit(False))).withColumn("table_index", F.count(F.when(F.col("good"), 1)).over(before).cast("int") - 1)
    made = cut(rows.drop("_slots"))
    stood = made.where("good").withColumn("table_id", minted("p001-table-", F.col("table_index")))
    axes = [stood.select(*key, F.lit(axis).alias("axis"), F.posexplode(name).alias("index", "at"), "table_id").withColumn("index", F.col("index").cast("long")) for axis, name in (("x", "xs"), ("y", "ys"))]
    cells = stood.select(*key, "table_id", F.explode("spans").alias("s")).select(*key, *[f"s.{c}" for c in ("ref", "row", "row_end", "col", "col_end")], "table_id", *[f"s.{c}" for c in "xywh"])
    cells = cells.withColumns({"rowspan": F.col("row_end") - F.col("row"), "colspan": F.col("col_end") - F.col("col"), "cell_id": F.format_string("%s-cell-r%03d-c%03d", "table_id", "row", "col")})
    tables = stood.select(*key, *[f"o_{c}" for c in "xywh"], "table_index", "table_id")
    return Grids(axes[0].unionByName(axes[1]), cells, tables, made.where("not good").select(*key), made.select(*p, F.explode("shared").alias("ref")))


def text_cells(texts: DataFrame, cells: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, ref, cell_id, hits): the only cell with the text's centre; several are ambiguous, none is unassigned."""
    return one_or_ambiguous(texts, cells, page, has_center, "ref", "cell_id")


def rectangle_roles(rects: DataFrame, g: Grids, page: Sequence[str], page_w: Column, page_h: Column) -> DataFrame:
    """(page, ref, role, table_id, cell_id) for every rectangle."""
    p = list(page)
    tables = g.tables.select(*p, F.col("outer").alias("ref"), F.col("table_id").alias("t"))
    cells = g.cells.select(*p, "ref", F.col("table_id").alias("u"), "cell_id")
    role = F.when(Box.of().area / (page_w * page_h) >= FRAME_FRACTION, "page_frame").when(F.col("t").isNotNull(), "table_outer_border").when(F.col("u").isNotNull(), "cell_rectangle").otherwise("unassigned")
    rows = rects.join(by_page(tables), [*p, "ref"], "left").join(by_page(cells), [*p, "ref"], "left")
    return rows.select(*p, "ref", role.alias("role"), F.coalesce("t", "u").alias("table_id"), "cell_id")


def line_roles(lines: DataFrame, g: Grids, page: Sequence[str], page_w: Column, page_h: Column) -> DataFrame:
    """(page, ref, role, table_id, duplicate_of) for every line.

    A line on the page's edge is its frame; one that meets no table is decoration, one that meets several is unassigned.
    In its table it must lie on a boundary: on an outer one along the whole table it repeats the border.
    """
    p, line = list(page), Line.of()
    framed = lines.withColumn("_frame", on_page_frame(line, page_w, page_h))
    t = by_page(g.tables.select(*p, "outer", "table_id", "o_x", "o_y", "o_w", "o_h"))
    hits = framed.join(by_page(t), p, "left").withColumn("_t", F.when(~F.col("_frame") & meets_table(line, Box.of("o_")), F.col("outer")))
    met = hits.groupBy(*p, "ref").agg(F.count("_t").alias("hits"), F.min("_t").alias("outer"))
    one = framed.join(by_page(met), [*p, "ref"]).join(by_page(t.drop("table_id")), [*p, "outer"], "left")
    one = one.withColumns({"axis": F.when(line.level, F.lit("y")).otherwise(F.lit("x")), "value": line.at})
    marks = nearest(one.where("hits = 1").select(*p, "outer", "axis", "ref", "value"), g.axes.select(*p, "outer", "axis", "index", "at"), [*p, "outer", "axis"], ["ref"], "value")
    last = g.axes.groupBy(*p, "outer", "axis").agg(F.max("index").alias("last"))
    rows = one.join(by_page(marks.select(*p, "ref", "index")), [*p, "ref"], "left").join(by_page(last), [*p, "outer", "axis"], "left").join(by_page(g.tables.select(*p, "outer", "table_id")), [*p, "outer"], "left")
    o = Box.of("o_")
    start, end = F.when(line.level, o.x).otherwise(o.y), F.when(line.level, o.right).otherwise(o.bottom)
    spans_all = (line.start <= start + GRID_TOLERANCE) & (line.end >= end - GRID_TOLERANCE)
    role = (
        F.when(F.col("_frame"), "page_frame").when(F.col("hits") > 1, "unassigned").when(F.col("hits") == 0, "page_decoration").when(F.col("index").isNull(), "unassigned")
        .when(((F.col("index") == 0) | (F.col("index") == F.col("last"))) & spans_all, "duplicated_supporting_primitive").when(line.level, "row_boundary").otherwise("column_boundary")
    )
    named = rows.withColumn("role", role)
    own = F.col("role").isin("duplicated_supporting_primitive", "row_boundary", "column_boundary")
    return named.select(*p, "ref", "role", F.when(own, F.col("table_id")).alias("table_id"), F.when(F.col("role") == "duplicated_supporting_primitive", F.col("outer")).alias("duplicate_of"))


def spans_of_axes(g: Grids, page: Sequence[str]) -> DataFrame:
    """Rows and columns as intervals between neighbouring boundaries: (page, table_id, axis, index, start, end)."""
    order = Window.partitionBy(*page, "table_id", "axis").orderBy("index")
    return g.axes.withColumn("end", F.lead("at").over(order)).where("end is not null").select(*page, "table_id", "axis", "index", F.col("at").alias("start"), "end")


def relations(g: Grids, texts: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, kind, source, target): table to cell and cell to text containment, neighbours in a row, reading order."""
    p = list(page)
    held = text_cells(texts, g.cells, p)
    order = Window.partitionBy(*p, "table_id", "row").orderBy("col")
    parts = [
        g.cells.select(*p, F.lit("containment").alias("kind"), F.col("table_id").alias("source"), F.col("cell_id").alias("target")),
        held.where("cell_id is not null").select(*p, F.lit("containment").alias("kind"), F.col("cell_id").alias("source"), F.col("ref").alias("target")),
        g.cells.withColumn("target", F.lead("cell_id").over(order)).where("target is not null").select(*p, F.lit("adjacency").alias("kind"), F.col("cell_id").alias("source"), "target"),
        texts.withColumn("target", F.lead("ref").over(Window.partitionBy(*p).orderBy("reading_order", "ref"))).where("target is not null").select(*p, F.lit("reading_order").alias("kind"), F.col("ref").alias("source"), "target"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def diagnostics(g: Grids, texts: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, code, refs): ambiguous and unassigned texts, ambiguous rectangles, rejected outer rectangles."""
    held = text_cells(texts, g.cells, page)
    rows = held.where("hits <> 1").select(*page, F.when(F.col("hits") > 1, "ambiguous_text").otherwise("unassigned_text").alias("code"), "ref")
    rows = rows.unionByName(g.ambiguous.select(*page, F.lit("ambiguous_primitive").alias("code"), "ref")).unionByName(g.rejected.select(*page, F.lit("rejected_outer").alias("code"), F.col("outer").alias("ref")))
    return rows.groupBy(*page, "code").agg(F.array_sort(F.collect_list("ref")).alias("refs"))


def line_rectangles(contours: DataFrame, lines: DataFrame, page: Sequence[str], tolerance: float = 3.0) -> DataFrame:
    """Rectangles whose four edges lie on lines, from measured contours: (page, x, y, w, h, score), each box once.

    contours: page, ref, x, y, w, h in pixels and area; lines: page, ref, level, at, start, end, conf. Contours under 12
    pixels or filled to less than half are left out. Edges move to the nearest line; the score weighs the lines' mean
    confidence with .55 and how full the contour is with .45.
    A page's contours and lines come together as arrays and are worked on there: no edge becomes a row that is moved, sorted or joined.
    """
    p = list(page)
    b = Box.of()
    full = contours.where((b.w >= 12) & (b.h >= 12) & (F.col("area") >= b.w * b.h * 0.5))
    own = full.groupBy(*p).agg(F.collect_list(F.struct(*"xywh", F.least(F.lit(1.0), F.col("area") / F.greatest(F.lit(1.0), b.w * b.h)).alias("filled"))).alias("_own"))
    near = lines.groupBy(*p).agg(F.collect_list(F.struct("level", "ref", "at", "start", "end", "conf")).alias("_lines"))
    rows = own.join(by_page(near), p)

    def nearest_line(level: bool, v: Column) -> Column:
        best = F.array_min(F.transform(F.filter("_lines", lambda m: m["level"] == level), lambda m: F.struct(F.abs(m["at"] - v.cast("double")).alias("d"), m["at"].alias("at"))))
        return F.transform(F.array(best), lambda m: F.when(m["d"] <= tolerance, m["at"]))[0]  # one of one, so that it is worked out once

    def covering(level: bool, at: Column, start: Column, end: Column) -> Column:
        """The line that covers an edge: most confident, then longest, then least ref."""
        fits = F.filter("_lines", lambda m: (m["level"] == level) & (F.abs(m["at"] - at) <= tolerance) & (m["start"] <= start + tolerance) & (m["end"] >= end - tolerance))
        return F.array_min(F.transform(fits, lambda m: F.struct(m["conf"].isNull().alias("n"), (-m["conf"]).alias("c"), (m["start"] - m["end"]).alias("l"), m["ref"].alias("ref"), m["conf"].alias("conf"))))

    sides = lambda m: F.struct(nearest_line(False, m["x"]).alias("left"), nearest_line(False, m["x"] + m["w"] - 1).alias("right"), nearest_line(True, m["y"]).alias("top"), nearest_line(True, m["y"] + m["h"] - 1).alias("bottom"), m["filled"].alias("filled"))
    boxes = F.filter(F.transform("_own", sides), lambda m: (m["right"] > m["left"]) & (m["bottom"] > m["top"]))
    edges = lambda m: F.array(*[covering(False, m[s], m["top"], m["bottom"]) for s in ("left", "right")], *[covering(True, m[s], m["left"], m["right"]) for s in ("top", "bottom")])
    found = rows.select(*p, F.explode(F.transform(boxes, lambda m: F.struct(m.alias("box"), edges(m).alias("edges")))).alias("m")).where(F.forall("m.edges", lambda e: e.isNotNull()))
    held = F.when(F.exists("m.edges", lambda e: e["conf"].isNotNull()), F.aggregate("m.edges", F.lit(0.0), lambda n, e: n + F.coalesce(e["conf"], F.lit(0.0))) / 4)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.55 * held + 0.45 * F.col("m.box.filled"))), 6)
    box = F.col("m.box")
    told = found.select(*p, box["left"].alias("x"), box["top"].alias("y"), (box["right"] - box["left"] + 1).alias("w"), (box["bottom"] - box["top"] + 1).alias("h"), score.alias("score"))
    return told.groupBy(*p, "x", "y", "w", "h").agg(F.max("score").alias("score"))
