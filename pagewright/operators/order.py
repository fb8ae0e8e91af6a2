"""Orders, rows, bands and clusters of boxes.

Where a row depends only on what came before it, a window does it (gaps and islands). Where rows grow while they are
scanned, the boxes of one page go through a fold in an Arrow function; pages are the unit of parallelism.
Every order ends in an id, so results don't depend on the order of input.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.geometry import Box, gap_crossed, row_overlap
from pagewright.functions.text import advance, needs_space
from pagewright.operators.match import by_page

ROW_OVERLAP = 0.45
BAND_TOLERANCE = 3.0
EDGE_TOLERANCE = 1.0
SLOT_TOLERANCE = 0.01
LEAST_SEGMENT = 1.0

#: Sort keys; they differ in the order of width and height, and that is kept.
TOKEN_KEY = ("y", "x", "h", "w", "text", "ref")
IN_ROW_KEY = ("x", "y", "w", "h", "text", "ref")
REGION_KEY = ("y", "x", "w", "h", "ref")
ELEMENT_KEY = ("y", "x", "h", "w", "type", "ref")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _grow_rows(ys: pa.Array, hs: pa.Array) -> pa.Array:
    """For boxes in scan order, the row of each: the earliest row with the largest overlap ratio of at least 0.45."""
    out = []
    for y_list, h_list in zip(ys.to_pylist(), hs.to_pylist()):
        rows: list[list[float]] = []
        at = []
        for y, h in zip(y_list, h_list):
            best, chosen = ROW_OVERLAP, -1
            for i, (top, bottom) in enumerate(rows):
                smaller = min(h, bottom - top)
                share = max(0, min(y + h, bottom) - max(y, top)) / smaller if smaller else 0.0
                if share > best or (share == best and chosen < 0):
                    best, chosen = share, i
            if chosen < 0:
                rows.append([y, y + h])
                chosen = len(rows) - 1
            else:
                rows[chosen] = [min(rows[chosen][0], y), max(rows[chosen][1], y + h)]
            at.append(chosen)
        out.append(at)
    return pa.array(out, pa.list_(pa.int32()))


def box_rows(boxes: DataFrame, page: Sequence[str], key: Sequence[str] = TOKEN_KEY) -> DataFrame:
    """Add row_index, 0 for the first row of a page by (top, left, bottom). Needs columns x, y, w, h and those of key."""
    packed = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], F.struct(*boxes.columns).alias("row")))).alias("all"))
    rows = packed.select(*page, "all", _grow_rows(F.transform("all", lambda t: t["row"]["y"].cast("double")), F.transform("all", lambda t: t["row"]["h"].cast("double"))).alias("at"))
    flat = rows.select(*page, F.explode(F.arrays_zip("all", "at")).alias("z"))  # the page's own columns stay, so that rows aren't moved again
    flat = flat.select(*[F.col(c) if c in page else F.col(f"z.all.row.{c}").alias(c) for c in boxes.columns], F.col("z.at").alias("_row"))
    own = Window.partitionBy(*page, "_row")
    spread = flat.withColumns({"_top": F.min("y").over(own), "_left": F.min("x").over(own), "_bottom": F.max(F.col("y") + F.col("h")).over(own)})
    return spread.withColumn("row_index", F.dense_rank().over(Window.partitionBy(*page).orderBy("_top", "_left", "_bottom", "_row")) - 1).drop("_row", "_top", "_left", "_bottom")


def reading_order(tokens: DataFrame, page: Sequence[str]) -> DataFrame:
    """Add row_index and reading_order, 0 for the first token of a page."""
    order = Window.partitionBy(*page).orderBy("row_index", *IN_ROW_KEY)
    return box_rows(tokens, page).withColumn("reading_order", F.row_number().over(order) - 1)


def region_groups(regions: DataFrame, separators: DataFrame | None, page: Sequence[str], gap_ratio: float = 1.0, least_overlap: float = ROW_OVERLAP) -> DataFrame:
    """Decide for neighbours in a row whether they are read as one region.

    regions: x, y, w, h, ref, row_index and the page's columns; separators: vertical lines with ref, x1, y1, x2, y2.
    Adds left_ref, gap, overlap_ratio, blockers, reasons (empty: joined to the left one) and group_index in the page.
    """
    row = Window.partitionBy(*page, "row_index").orderBy("x", "y", "w", "h", "ref")
    before = regions.withColumns({"left_ref": F.lag("ref").over(row), **{f"l{c}": F.lag(c).over(row) for c in "xywh"}})
    left, right = Box.of("l"), Box.of()
    if separators is not None:
        s = separators.select(*[F.col(c).alias(f"s_{c}") for c in page], F.col("ref").alias("s_ref"), *[F.col(c).alias(f"s_{c}") for c in ("x1", "y1", "y2")])
        same = F.lit(True)
        for c in page:
            same = same & (F.col(c) == F.col(f"s_{c}"))
        crossed = before.where("left_ref is not null").join(by_page(s), same & gap_crossed(F.col("s_x1"), F.col("s_y1"), F.col("s_y2"), left, right))
        blockers = crossed.groupBy(*page, "ref").agg(F.array_sort(F.collect_set("s_ref")).alias("blockers"))
        before = before.join(by_page(blockers), [*page, "ref"], "left")
    else:
        before = before.withColumn("blockers", F.lit(None).cast("array<string>"))
    gap = F.greatest(F.lit(0), right.x - left.right)
    share = row_overlap(left, right)
    checks = F.array_compact(F.array(
        F.when(share < least_overlap, F.lit("overlap_too_small")), F.when(gap > F.greatest(left.h, right.h) * gap_ratio, F.lit("gap_too_wide")), F.when(F.size("blockers") > 0, F.lit("separator_between")),
    ))
    told = before.withColumns({"gap": F.when(F.col("left_ref").isNotNull(), gap), "overlap_ratio": F.round(share, 6), "reasons": F.when(F.col("left_ref").isNotNull(), checks)}).drop("lx", "ly", "lw", "lh")
    opens = (F.col("reasons").isNull() | (F.size("reasons") > 0)).cast("int")
    running = Window.partitionBy(*page).orderBy("row_index", "x", "y", "w", "h", "ref").rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn("group_index", F.sum(opens).over(running) - 1)


def planned_regions(grouped: DataFrame, page: Sequence[str]) -> DataFrame:
    """The union box, members from left to right and least confidence of each group."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "ref"))), lambda m: m["ref"])
    return grouped.groupBy(*page, "group_index").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        members.alias("members"), F.min("conf").alias("conf"),
    )


def boundaries(rows: DataFrame, values: Column, start: Column, end: Column, name: str, tolerance: float = EDGE_TOLERANCE) -> DataFrame:
    """Add an array: where a row's coordinates lie, clustered; a gap over the tolerance opens a new cluster.

    A cluster lies on the outer start or end if it holds that value, else on its mean.
    """
    rows = rows.withColumn("_values", F.sort_array(values))
    first = F.filter(F.sequence(F.lit(1), F.size("_values")), lambda i: (i == 1) | (F.element_at("_values", i) - F.element_at("_values", F.greatest(i - 1, F.lit(1))) > tolerance))
    rows = rows.withColumn("_first", F.when(F.size("_values") > 0, first).otherwise(F.array().cast("array<int>")))
    runs = F.transform("_first", lambda i, k: F.slice("_values", i, F.coalesce(F.get("_first", k + 1), F.size("_values") + 1) - i))
    mean = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda n, v: n + v) / F.size(c), 6)
    on = lambda c, side: F.exists(c, lambda v: F.abs(v - side) < 1e-9)
    at = F.transform(runs, lambda c: F.when(on(c, start), start).when(on(c, end), end).otherwise(mean(c)))
    return rows.withColumn(name, at).drop("_values", "_first")


def bands(elements: DataFrame, page: Sequence[str], top: str = "y", bottom: Column | None = None, key: Sequence[str] = ("y", "reading_order", "x", "z", "ref")) -> DataFrame:
    """Add band: an element opens a new one if its top is more than 3 pt below everything before it."""
    low = bottom if bottom is not None else F.col("y") + F.col("h")
    order = Window.partitionBy(*page).orderBy(*key)
    reach = F.max(low).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return elements.withColumn("_new", F.coalesce((F.col(top) > reach + BAND_TOLERANCE).cast("int"), F.lit(0))).withColumn("band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def slots(elements: DataFrame, band: Sequence[str], margin: Column, width: Column) -> DataFrame:
    """Merge overlapping elements of a band into slots, clipped to the content width: (band, slot, left, right, refs)."""
    left = F.least(width, F.greatest(F.lit(0.0), F.col("x") - margin))
    right = F.least(width, F.greatest(F.lit(0.0), F.col("x") + F.col("w") - margin))
    thin = right - left < LEAST_SEGMENT
    wide = F.least(width, left + LEAST_SEGMENT)
    e = elements.withColumns({
        "_left": F.when(thin & (wide <= left), F.greatest(F.lit(0.0), width - LEAST_SEGMENT)).otherwise(left),
        "_right": F.when(thin, F.when(wide <= left, width).otherwise(wide)).otherwise(right),
    })
    order = Window.partitionBy(*band).orderBy("x", "z", "ref")
    reach = F.max("_right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("_left") >= reach - SLOT_TOLERANCE).cast("int"), F.lit(0))
    numbered = e.withColumn("_open", opens).withColumn("slot", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*band, "slot").agg(F.min("_left").alias("left"), F.max("_right").alias("right"), F.array_sort(F.collect_list("ref")).alias("refs"))


def segments(slots: DataFrame, band: Sequence[str], width: Column) -> DataFrame:
    """Slots and the gaps between them as one row of segments: (band, start, width, slot), slot null for a gap."""
    order = Window.partitionBy(*band).orderBy("slot")
    cursor = F.greatest(F.coalesce(F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.lit(0.0))
    placed = slots.withColumn("cursor", cursor).withColumn("start", F.greatest("left", "cursor"))
    filled = placed.select(*band, "start", F.greatest(F.lit(LEAST_SEGMENT), F.col("right") - F.col("start")).alias("width"), "slot")
    gaps = placed.where(F.col("left") > F.col("cursor") + SLOT_TOLERANCE).select(*band, F.col("cursor").alias("start"), (F.col("left") - F.col("cursor")).alias("width"), F.lit(None).cast("long").alias("slot"))
    tail = placed.groupBy(*band).agg(F.max("right").alias("start")).withColumn("width", width - F.col("start")).where(F.col("width") > SLOT_TOLERANCE).select(*band, "start", "width", F.lit(None).cast("long").alias("slot"))
    return filled.unionByName(gaps).unionByName(tail)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _plan_lines(ys: pa.Array, hs: pa.Array) -> pa.Array:
    """For texts in scan order, the line of each: largest overlap ratio, then nearest centre, then highest, then first."""
    out = []
    for y_list, h_list in zip(ys.to_pylist(), hs.to_pylist()):
        lines: list[list[float]] = []
        at = []
        for y, h in zip(y_list, h_list):
            ranks = []
            for i, (top, bottom) in enumerate(lines):
                shared = min(bottom, y + h) - max(top, y)
                if shared >= -BAND_TOLERANCE:
                    ratio = max(0.0, shared) / max(1.0, min(bottom - top, h))
                    ranks.append((ratio, -abs(y + h / 2 - (top + bottom) / 2), -top, -i))
            if ranks:
                chosen = -max(ranks)[3]
                lines[chosen] = [min(lines[chosen][0], y), max(lines[chosen][1], y + h)]
            else:
                chosen = len(lines)
                lines.append([y, y + h])
            at.append(chosen)
        out.append(at)
    return pa.array(out, pa.list_(pa.int32()))


def text_lines(texts: DataFrame, container: Sequence[str]) -> DataFrame:
    """Add line_index and place: lines of a container by (top, left, least order, least ref), texts from left to right."""
    packed = texts.groupBy(*container).agg(F.array_sort(F.collect_list(F.struct("y", "x", "reading_order", "ref", F.struct(*texts.columns).alias("row")))).alias("all"))
    rows = packed.select("all", _plan_lines(F.transform("all", lambda t: t["y"].cast("double")), F.transform("all", lambda t: t["row"]["h"].cast("double"))).alias("at"))
    flat = rows.select(F.explode(F.arrays_zip("all", "at")).alias("z")).select("z.all.row.*", F.col("z.at").alias("_line"))
    own = Window.partitionBy(*container, "_line")
    spread = flat.withColumns({"_a": F.min("y").over(own), "_b": F.min("x").over(own), "_c": F.min("reading_order").over(own), "_d": F.min("ref").over(own)})
    numbered = spread.withColumn("line_index", F.dense_rank().over(Window.partitionBy(*container).orderBy("_a", "_b", "_c", "_d", "_line")) - 1)
    place = F.row_number().over(Window.partitionBy(*container, "line_index").orderBy("x", "reading_order", "y", "ref")) - 1
    return numbered.withColumn("place", place).drop("_line", "_a", "_b", "_c", "_d")


def line_texts(lines: DataFrame, container: Sequence[str], font: str = "font") -> DataFrame:
    """Join the texts of each line: a tab over a wide gap, a space between words, else nothing; and fit the font size.

    Gaps up to 0.01 pt never part. A tab needs a gap of 24 pt and of four font sizes. The font is the largest of the
    line's, but no larger than lets its advance fit the line's width (at least 0.5).
    """
    order = Window.partitionBy(*container, "line_index").orderBy("place")
    previous, prev_font, prev_right = F.lag("text").over(order), F.lag(font).over(order), F.lag(F.col("x") + F.col("w")).over(order)
    gap = F.greatest(F.lit(0.0), F.col("x") - prev_right)
    spaced = needs_space(F.col("_prev"), F.col("text"))
    e = lines.withColumns({"_prev": previous, "_gap": gap, "_tab": F.greatest(F.lit(24.0), F.greatest(prev_font, F.col(font)) * 4)})
    sep = F.when(F.col("_prev").isNull() | (F.col("_gap") <= SLOT_TOLERANCE), "").when(F.col("_gap") >= F.col("_tab"), "\t").when(spaced, " ").otherwise("")
    e = e.withColumns({"_sep": sep, "_adv": advance(F.col("text")) + F.when(F.col("_prev").isNotNull() & spaced, 0.55).otherwise(0.0)})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("_sep", "text").alias("t")))), lambda t: t["t"]), "")
    width, units = F.max(F.col("x") + F.col("w")) - F.min("x"), F.sum("_adv")
    fitted = F.when((units <= 0) | (width <= 0), F.max(font)).otherwise(F.least(F.max(font), F.greatest(F.lit(0.5), width / units)))
    return e.groupBy(*container, "line_index").agg(joined.alias("text"), fitted.alias("font"))


def next_edges(rows: DataFrame, container: Sequence[str], order: Sequence[str], kind: str, ref: str = "ref") -> DataFrame:
    """(container, kind, source, target) edges between consecutive rows."""
    w = Window.partitionBy(*container).orderBy(*order)
    return rows.withColumn("target", F.lead(ref).over(w)).where("target is not null").select(*container, F.lit(kind).alias("kind"), F.col(ref).alias("source"), "target")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _merge_lines(lines: pa.Array, gaps: pa.Array) -> pa.Array:
    """For raw lines in scan order (center, start, end, thickness, ...), the merged line that each one joins."""
    out = []
    for items, most in zip(lines.to_pylist(), gaps.to_pylist()):
        merged: list[dict] = []
        at = []
        for line in items:
            for i, m in enumerate(merged):
                gap = max(line["start"] - m["end"] - 1, m["start"] - line["end"] - 1, 0)
                middle = m["low"] + (m["high"] - m["low"] - 1) // 2
                if abs(middle - line["center"]) <= max(2, m["high"] - m["low"], line["thickness"]) and gap <= most:
                    m["start"], m["end"] = min(m["start"], line["start"]), max(m["end"], line["end"])
                    m["low"], m["high"] = min(m["low"], line["low"]), max(m["high"], line["low"] + line["thickness"])
                    at.append(i)
                    break
            else:
                merged.append({"start": line["start"], "end": line["end"], "low": line["low"], "high": line["low"] + line["thickness"]})
                at.append(len(merged) - 1)
        out.append(at)
    return pa.array(out, pa.list_(pa.int32()))


def merged_lines(raw: DataFrame, page: Sequence[str], gap_fraction: float = 0.01) -> DataFrame:
    """Merge collinear raw lines of a page and orientation. raw: level, x, y, w, h, occupancy, axis_length and page columns.

    Scanned by (centre, start, end), a line joins the first merged one whose centre is near and whose interval is at
    most 1 % of the page's axis away; boxes grow, occupancy is the largest.
    """
    level = F.col("level")
    item = F.struct(
        F.when(level, F.col("y") + F.expr("(h - 1) div 2")).otherwise(F.col("x") + F.expr("(w - 1) div 2")).alias("center"),
        F.when(level, F.col("x")).otherwise(F.col("y")).alias("start"), (F.when(level, F.col("x") + F.col("w")).otherwise(F.col("y") + F.col("h")) - 1).alias("end"),
        F.when(level, F.col("y")).otherwise(F.col("x")).alias("low"), F.when(level, F.col("h")).otherwise(F.col("w")).alias("thickness"), F.col("occupancy"),
    )
    most = F.greatest(F.lit(2), F.round(F.max("axis_length") * gap_fraction).cast("int"))
    packed = raw.groupBy(*page, "level").agg(F.array_sort(F.collect_list(item)).alias("all"), most.alias("most"))
    flat = packed.select(*page, "level", F.explode(F.arrays_zip("all", _merge_lines("all", "most").alias("at"))).alias("z")).select(*page, "level", "z.all.*", F.col("z.at").alias("line"))
    boxes = flat.groupBy(*page, "level", "line").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("low").alias("low"), F.max(F.col("low") + F.col("thickness")).alias("high"), F.max("occupancy").alias("occupancy"))
    x, y = F.when(level, F.col("start")).otherwise(F.col("low")), F.when(level, F.col("low")).otherwise(F.col("start"))
    along, across = F.col("end") - F.col("start") + 1, F.col("high") - F.col("low")
    return boxes.select(*page, "level", "line", x.alias("x"), y.alias("y"), F.when(level, along).otherwise(across).alias("w"), F.when(level, across).otherwise(along).alias("h"), "occupancy")


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row a key, the first in the given order. For the best score, order by it descending."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def first_uses(rows: DataFrame, key: Sequence[str], major: str, minor: str) -> DataFrame:
    """(key, n, major, minor): the number of rows of each key and the place of the first, by two ints of at least 0, in one aggregation without sorting."""
    place = F.shiftleft(F.col(major).cast("long"), 32) + F.col(minor)
    used = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_p"))
    return used.select(*key, "n", F.shiftright("_p", 32).cast("int").alias(major), F.col("_p").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias(minor))


def carried_cells(cells: DataFrame, table: Sequence[str]) -> DataFrame:
    """Of parsed table cells (row, place, span, merge: restart, continue or null, ref): column and the cell they belong to."""
    column = F.coalesce(F.sum("span").over(Window.partitionBy(*table, "row").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("column", column)
    own = F.when(F.coalesce(F.col("merge"), F.lit("")) != "continue", F.col("ref"))
    down = Window.partitionBy(*table, "column").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("owner", F.last(own, ignorenulls=True).over(down))


def out_of_step(rows: DataFrame, group: Sequence[str], number: str, first: int, order: Sequence[str]) -> DataFrame:
    """Rows whose number isn't their place in the group's order, counted from ``first``."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1 + first
    return rows.withColumn("expected", place).where(F.col(number) != F.col("expected"))


def block_order(bands: DataFrame, tables: DataFrame, page: Sequence[str]) -> DataFrame:
    """Bands and tables of a page in one order by (top, kind, ref)."""
    cols = [*page, "top", "ref"]
    both = bands.select(*cols, F.lit("band").alias("kind")).unionByName(tables.select(*cols, F.lit("table").alias("kind")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("top", "kind", "ref")) - 1)
