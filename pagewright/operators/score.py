"""Scores of recovered text, structure and geometry against reviewed truth.

Text is scored block by block, so the cost of edit distances follows the lengths of blocks, not of documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import Box, adjacency_kept, box_similarity, has_box
from pagewright.functions.text import accuracy, compact, spaced
from pagewright.operators.match import by_page

BLOCK_FLOOR = 60.0
#: Weight and minimum of each component of a baseline score.
WEIGHTS = {"text_accuracy": (0.45, 70.0), "logical_block_coverage": (0.20, 60.0), "structure_similarity": (0.20, 60.0), "geometry_similarity": (0.15, 50.0)}
OVERALL = 70.0
REDUNDANT_ROLES = ("cell_rectangle", "duplicated_supporting_primitive")


def joined_text(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], text: str = "text", sep: str = "") -> DataFrame:
    """(group, text): texts joined in order; nulls of an order key come last."""
    keys = []
    for i, o in enumerate(order):
        c = F.col(o) if isinstance(o, str) else o
        keys += [c.isNull().alias(f"n{i}"), c.alias(f"k{i}")]
    packed = F.array_sort(F.collect_list(F.struct(*keys, F.col(text).alias("t"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(packed, lambda s: s["t"]), sep).alias("text"))


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates for the smallest box around boxes."""
    b = Box.of(prefix)
    return [F.min(b.x).alias("x"), F.min(b.y).alias("y"), (F.max(b.right) - F.min(b.x)).alias("w"), (F.max(b.bottom) - F.min(b.y)).alias("h")]


def block_accuracy(reviewed: DataFrame, found: DataFrame, key: Sequence[str], floor: float = BLOCK_FLOOR, normal: bool = True) -> DataFrame:
    """reviewed (key, text) and found (key, text): adds observed, accuracy and covered (false without any text)."""
    other = found.select(*key, F.col("text").alias("observed"))
    rows = reviewed.join(by_page(other), list(key), "left")
    score = accuracy(compact(F.col("text"), normal), compact(F.coalesce("observed", F.lit("")), normal))
    return rows.withColumn("accuracy", score).withColumn("covered", F.col("observed").isNotNull() & (F.col("accuracy") >= floor))


def share(flag: Column) -> Column:
    """Percentage of true rows; 100 for none."""
    return F.coalesce(F.avg(flag.cast("int")) * 100, F.lit(100.0))


def f1(expected: Column, observed: Column, matched: Column) -> Column:
    """Of counts: 1 if both sides are empty, 0 if one is."""
    return F.when((expected == 0) & (observed == 0), 1.0).when((expected == 0) | (observed == 0), 0.0).otherwise(2.0 * matched / (expected + observed))


def edge_f1(expected: DataFrame, observed: DataFrame, group: Sequence[str], edge: Sequence[str] = ("kind", "source", "target")) -> DataFrame:
    """(group, expected, observed, matched, f1) over sets of edges."""
    a = expected.select(*group, *edge).distinct().withColumn("_a", F.lit(1))
    b = observed.select(*group, *edge).distinct().withColumn("_b", F.lit(1))
    n = a.join(by_page(b), [*group, *edge], "full_outer").groupBy(*group).agg(F.count("_a").alias("expected"), F.count("_b").alias("observed"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("matched"))
    return n.withColumn("f1", f1(F.col("expected"), F.col("observed"), F.col("matched")))


def anchors(texts: DataFrame, wanted: DataFrame, group: Sequence[str], normal: bool = True) -> DataFrame:
    """Adds recovered to each wanted (group, anchor): the compacted text has the compacted anchor in it."""
    t = texts.select(*group, compact(F.col("text"), normal).alias("_t"))
    return wanted.join(by_page(t), list(group), "left").withColumn("recovered", F.coalesce(F.contains("_t", compact(F.col("anchor"), normal)), F.lit(False))).drop("_t")


def spaced_anchors(texts: DataFrame, wanted: DataFrame, group: Sequence[str], normal: bool = True) -> DataFrame:
    """As anchors(), with white space collapsed instead of removed."""
    t = texts.select(*group, spaced(F.col("text"), normal).alias("_t"))
    return wanted.join(by_page(t), list(group), "left").withColumn("recovered", F.coalesce(F.contains("_t", spaced(F.col("anchor"), normal)), F.lit(False))).drop("_t")


def confidence_profile(tokens: DataFrame, group: Sequence[str], conf: str = "conf") -> DataFrame:
    """Counts and exact statistics of known confidences; statistics are null where none is known."""
    c = F.col(conf)
    cut = F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return tokens.groupBy(*group).agg(
        F.count(F.lit(1)).alias("tokens"), F.count(c).alias("known"), F.count(F.when(c.isNull(), 1)).alias("missing"), F.min(c).alias("least"), F.avg(c).alias("mean"), F.max(c).alias("most"), cut.alias("_cut"),
    ).withColumns({"p10": F.col("_cut")[0], "median": F.col("_cut")[1], "p90": F.col("_cut")[2]}).drop("_cut")


def low_confidence(tokens: DataFrame, threshold: float, conf: str = "conf") -> DataFrame:
    return tokens.where(F.col(conf).isNotNull() & (F.col(conf) < threshold))


def places(x: Column, n: int) -> Column:
    """x to n places as a whole number of them, halves away from zero.

    Spark's round() of n places takes the shortest decimal of x, so 16.775, which lies below its name, goes up; as elsewhere it goes down here.
    """
    return F.round(x * 10.0**n) / 10.0**n


def overall(components: Mapping[str, Column], weights: Mapping[str, tuple[float, float]] = WEIGHTS) -> Column:
    """Weighted sum; each score and each weighted part is rounded to 6 places, the sum to 2."""
    total = F.lit(0.0)
    for name, (weight, _) in weights.items():
        total = total + places(places(components[name], 6) * weight, 6)
    return places(total, 2)


def candidate_structures(elements: DataFrame, roles: DataFrame, page: Sequence[str]) -> DataFrame:
    """Elements other than texts, without primitives that only repeat a table's structure."""
    spare = roles.where(F.col("role").isin(*REDUNDANT_ROLES)).select(*page, "ref")
    return elements.where("type <> 'text'").join(by_page(spare), [*page, "ref"], "left_anti")


def mapped_edges(edges: DataFrame, matches: DataFrame, group: Sequence[str]) -> DataFrame:
    """Edges (group, source, target, more) with both ends mapped from observed to reference; others stay as they are."""
    out = edges
    for end in ("source", "target"):
        own = matches.select(*group, F.col("observed").alias(end), "reference")
        out = out.join(by_page(own), [*group, end], "left").withColumn(end, F.coalesce("reference", end)).drop("reference")
    return out.select(*edges.columns)


def structure_pairs(expected: DataFrame, observed: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, type, expected, observed, similarity 0..100) for structures of one type on a page, boxes as shares of the page."""
    o = observed.select(*page, "type", F.col("ref").alias("observed"), *[F.col(c).alias(f"o_{c}") for c in "xywh"])
    pairs = expected.select(*page, "type", F.col("ref").alias("expected"), *"xywh").join(by_page(o), [*page, "type"])
    return pairs.select(*page, "type", "expected", "observed", (100 * box_similarity(Box.of(), Box.of("o_"))).alias("similarity"))


def relationships(wanted: DataFrame, evidence: DataFrame, structures: DataFrame, page: Sequence[str]) -> DataFrame:
    """Judge reviewed relationships (kind, source, target) by what was found.

    evidence: region, x.. the reviewed box, f_x.. the found union box, first_key and last_key of reading order, and
    tokens. structures: item, s_x.. of the matched candidate. Reading order holds if all of the source comes before all
    of the target and no token is in both; containment if the matched structure holds the found text box; adjacency if
    direction and nearness are kept. Missing evidence fails.
    """
    p = list(page)
    boxes = [*"xywh", *[f"f_{c}" for c in "xywh"], "first_key", "last_key", "tokens"]
    a = evidence.select(*p, F.col("region").alias("source"), *[F.col(c).alias(f"a_{c}") for c in boxes])
    b = evidence.select(*p, F.col("region").alias("target"), *[F.col(c).alias(f"b_{c}") for c in boxes])
    s = structures.select(*p, F.col("item").alias("source"), *[F.col(f"s_{c}") for c in "xywh"])
    rows = wanted.join(by_page(a), [*p, "source"], "left").join(by_page(b), [*p, "target"], "left").join(by_page(s), [*p, "source"], "left")
    order = (F.col("a_last_key") < F.col("b_first_key")) & ~F.arrays_overlap("a_tokens", "b_tokens")
    inside = has_box(Box.of("s_"), Box.of("b_f_"), 1e-9)
    near = adjacency_kept(Box.of("a_"), Box.of("b_"), Box.of("a_f_"), Box.of("b_f_"))
    verdict = F.when(F.col("kind") == "reading_order", order).when(F.col("kind") == "containment", inside).otherwise(near)
    return rows.select(*wanted.columns, F.coalesce(verdict, F.lit(False)).alias("passed"))


def evidence(reviewed: DataFrame, found: DataFrame, page: Sequence[str], region: str = "region") -> DataFrame:
    """For relationships(): reviewed regions with what was found in each. found: region, ref, reading_order, x, y, w, h."""
    got = found.groupBy(*page, region).agg(*union_box(), F.min(F.struct("reading_order", "ref")).alias("first_key"), F.max(F.struct("reading_order", "ref")).alias("last_key"), F.collect_set("ref").alias("tokens"))
    got = got.select(*page, region, *[F.col(c).alias(f"f_{c}") for c in "xywh"], "first_key", "last_key", "tokens")
    return reviewed.join(by_page(got), [*page, region], "left")


def manual_checks(required: DataFrame, supplied: DataFrame, group: Sequence[str]) -> DataFrame:
    """Required checks with their status, pending if none was supplied; supplied ones that nobody asked for follow by name."""
    r = required.select(*group, "name", "position")
    rows = r.join(by_page(supplied), [*group, "name"], "full_outer").withColumn("status", F.coalesce("status", F.lit("pending")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("position").asc_nulls_last(), "name")) - 1).drop("position")


def state(failed: Column, unknown: Column) -> Column:
    return F.when(failed, "fail").when(unknown, "requires_human_review").otherwise("pass")


def gate_state(gates: DataFrame, group: Sequence[str], extra_failure: Column | None = None) -> DataFrame:
    """(group, state, failed, unknown) of gates whose passed is true, false or null for unknown."""
    told = gates.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))).alias("failed"), F.array_sort(F.collect_list(F.when(F.col("passed").isNull(), F.col("gate")))).alias("unknown"),
    )
    bad = F.size("failed") > 0
    return told.withColumn("state", state(bad if extra_failure is None else bad | extra_failure, F.size("unknown") > 0))


def worst_state(states: DataFrame, group: Sequence[str]) -> DataFrame:
    """Of layers: fail before review before pass."""
    rank = F.when(F.col("state") == "fail", 2).when(F.col("state") == "requires_human_review", 1).otherwise(0)
    worst = F.max(rank)
    return states.groupBy(*group).agg(F.when(worst == 2, "fail").when(worst == 1, "requires_human_review").otherwise("pass").alias("state"))


def accounting(events: DataFrame, group: Sequence[str]) -> DataFrame:
    """Of render events (no, element, outcome): elements of each outcome, each once, in order of their first event."""
    first = events.groupBy(*group, "outcome", "element").agg(F.min("no").alias("no"))
    return first.groupBy(*group, "outcome").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "element"))), lambda s: s["element"]).alias("elements"))
