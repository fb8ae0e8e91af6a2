"""Operators on hand-made frames, against sequential code, and in any order of input."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions import text as t
from pagewright.functions.geometry import Box
from pagewright.operators import assign, compare, gate, match, order, score, topology, validate
from pagewright.plans import tokens
from pagewright.sources import layout, records


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_boxes(spark):
    a, b = Box(*lit(0.0, 0.0, 2.0, 2.0)), Box(*lit(1.0, 1.0, 2.0, 2.0))
    r = one(
        spark, iou=g.iou(a, b), same=g.iou(a, a), share=g.shared_fraction(a, b), sim=g.box_similarity(a, a), axis=g.direction(a, Box(*lit(5.0, 0.5, 2.0, 2.0)))[0], still=g.direction(a, a)[0],
        inside=g.has_box(a, Box(*lit(0.0, 0.0, 2.005, 1.0)), 0.01), half=g.has_pixel_center(Box(*lit(0, 0, 4, 4)), Box(*lit(3, 3, 3, 1))), closed=g.has_center(Box(*lit(0, 0, 4, 4)), Box(*lit(3, 3, 2, 2))),
        cross=g.gap_crossed(F.lit(2.5), F.lit(0.0), F.lit(9.0), a, Box(*lit(3.0, 0.0, 1.0, 2.0))), px=g.points(F.lit(100), F.lit(96)),
    )
    assert r.iou == pytest.approx(1 / 7) and r.same == 1 and r.share == 0.25 and r.sim == 1
    assert (r.axis, r.still, r.inside, r.half, r.closed, r.cross, r.px) == ("horizontal", None, True, False, True, True, 75.0)


def test_unit_boxes_stay_on_the_page(spark):
    u = g.unit_box(Box(*lit(590.0, -5.0, 20.0, 0.0)), F.lit(600.0), F.lit(800.0))
    r = one(spark, x=u.x, y=u.y, w=u.w, h=u.h)
    assert (r.x + r.w, r.y, r.h) == (1.0, 0.0, 1 / 800)


def test_text_scalars(spark):
    r = one(
        spark, n=t.spaced(F.lit("　ｱ　b  c ")), c=t.compact(F.lit("a\x1cb c")), acc=t.accuracy(F.lit("abcd"), F.lit("abxd")), empty=t.accuracy(F.lit(""), F.lit("")),
        adv=t.advance(F.lit("a 日")), num=t.is_numbered(F.lit("12.")), sp=t.needs_space(F.lit("ab"), F.lit("cd")), cj=t.needs_space(F.lit("日"), F.lit("cd")), pre=t.needs_space(F.lit("3)"), F.lit("日")),
        conf=t.confidence(F.lit("-1")), ratio=t.ratio(F.lit("abcd"), F.lit("bcde")), bad=t.languages_ok(F.array(*lit("eng", "eng"))),
        d=t.text_differences(F.lit("kitten"), F.lit("sitting")),
    )
    assert (r.n, r.c, r.acc, r.empty, r.adv, r.num, r.sp, r.cj, r.pre, r.conf, r.ratio, r.bad) == ("ア b c", "abc", 75.0, 100.0, 1.55, True, True, False, True, None, 0.75, False)
    assert r.d.missing == ["k", "e"] and r.d.extra == ["s", "i", "g"]


def boxes(rng, n, page=1):
    return [(page, f"b{page}-{i:03d}", rng.randrange(0, 300), rng.randrange(0, 200), rng.randrange(5, 60), rng.randrange(4, 20), f"t{i}", rng.random()) for i in range(n)]


BOXES = "page int, ref string, x int, y int, w int, h int, text string, conf double"


def sequential_rows(rows):
    out = []
    for r in sorted(rows, key=lambda r: (r[3], r[2], r[5], r[4], r[6], r[1])):
        best = None
        for i, row in enumerate(out):
            shared = max(0, min(r[3] + r[5], row["b"]) - max(r[3], row["t"])) / min(r[5], row["b"] - row["t"])
            if shared >= 0.45 and (best is None or shared > best[0]):
                best = (shared, i)
        if best is None:
            out.append({"t": r[3], "b": r[3] + r[5], "l": r[2], "items": [r]})
        else:
            row = out[best[1]]
            row.update(t=min(row["t"], r[3]), b=max(row["b"], r[3] + r[5]), l=min(row["l"], r[2]))
            row["items"].append(r)
    out.sort(key=lambda row: (row["t"], row["l"], row["b"]))
    return [r[1] for row in out for r in sorted(row["items"], key=lambda r: (r[2], r[3], r[4], r[5], r[6], r[1]))]


def test_reading_order_is_the_sequential_one_for_any_input_order(spark):
    rng = random.Random(1)
    pages = [boxes(rng, 60, p) for p in (1, 2)]
    rows = [r for p in pages for r in p]
    rng.shuffle(rows)
    got = order.reading_order(spark.createDataFrame(rows, BOXES).repartition(5), ["page"]).collect()
    for p, want in zip((1, 2), pages):
        assert [r.ref for r in sorted((r for r in got if r.page == p), key=lambda r: r.reading_order)] == sequential_rows(want)


def test_greedy_matching_is_the_sequential_one(spark):
    rng = random.Random(2)
    pairs = [(p, f"l{rng.randrange(9)}", f"r{rng.randrange(9)}", rng.randrange(5) / 4) for p in (1, 2) for _ in range(40)]
    pairs = list({(p, a, b): (p, a, b, s) for p, a, b, s in pairs}.values())
    got = match.greedy_match(spark.createDataFrame(pairs, "page int, a string, b string, s double"), ["page"], "a", "b", "s", 0.25).collect()
    want = set()
    for p in (1, 2):
        used = set()
        for _, a, b, s in sorted((x for x in pairs if x[0] == p and x[3] >= 0.25), key=lambda x: (-x[3], x[1], x[2])):
            if ("l", a) not in used and ("r", b) not in used:
                used |= {("l", a), ("r", b)}
                want.add((p, a, b, s))
    assert {tuple(r) for r in got} == want


def test_suppression_is_the_sequential_one(spark):
    rng = random.Random(3)
    rows = [(1, f"b{i:03d}", rng.randrange(0, 40), rng.randrange(0, 20), 30, 12, "", rng.randrange(4) / 4) for i in range(50)]
    got = {r.ref for r in match.suppress(spark.createDataFrame(rows, BOXES), ["page"], [F.desc("conf")]).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[1])):
        def twin(k, r=r):
            shared = max(0, min(k[2] + k[4], r[2] + r[4]) - max(k[2], r[2])) * max(0, min(k[3] + k[5], r[3] + r[5]) - max(k[3], r[3]))
            return shared / (k[4] * k[5] + r[4] * r[5] - shared) >= 0.75 or shared / min(k[4] * k[5], r[4] * r[5]) >= 0.92
        if not any(map(twin, kept)):
            kept.append(r)
    assert got == {k[1] for k in kept}


def test_suppression_moves_boxes_once_and_takes_no_rounds(spark):
    boxes = spark.createDataFrame([(1, "a", 0, 0, 30, 12, 0.9), (1, "b", 2, 0, 30, 12, 0.8), (1, "c", 4, 0, 30, 12, 0.7), (2, "a", 0, 0, 30, 12, 0.1), (None, "a", 0, 0, 30, 12, 0.9)], "page int, ref string, x int, y int, w int, h int, conf double")
    kept = match.suppress(boxes.repartition(3, "page"), ["page"], [F.desc("conf")])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "round-" not in plan and plan.count("Exchange ") <= 3  # one exchange, shown at each place that reads it
    assert kept.columns == boxes.columns and {(r.page, r.ref) for r in kept.collect()} == {(1, "a"), (2, "a")}


def test_words_are_moved_once_and_the_first_use_wins(spark):
    from pagewright.operators import order
    from pagewright.plans import audit, parts, records
    from tests.conftest import SF

    for query in (records.content_registry, audit.render_accounting, parts.page_texts):
        assert query(spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1, query.__name__
    rows = spark.createDataFrame([(1, "a", 3, 9), (1, "a", 2, 70000), (1, "a", 2, 5), (1, "b", 0, 0), (2, "a", 2147483647, 2147483647)], "doc_id int, key string, line_no int, word_no int")
    assert {tuple(r) for r in order.first_uses(rows, ["doc_id", "key"], "line_no", "word_no").collect()} == {(1, "a", 3, 2, 5), (1, "b", 1, 0, 0), (2, "a", 1, 2147483647, 2147483647)}


def test_tokens_go_to_regions_in_tiers(spark):
    tokens = spark.createDataFrame([(1, "a", 0, 0, 10, 10, "r2"), (1, "b", 0, 0, 10, 10, None), (1, "c", 95, 0, 30, 10, None), (1, "d", 500, 500, 5, 5, None)], "page int, ref string, x int, y int, w int, h int, parent_ref string")
    regions = spark.createDataFrame([(1, "r1", 0, 0, 100, 100), (1, "r2", 0, 0, 100, 100), (1, "r3", 90, 0, 20, 100), (1, "r4", 90, 0, 20, 100)], "page int, ref string, x int, y int, w int, h int")
    got = {r.ref: (r.region_ref, r.inferred) for r in assign.tokens_to_regions(tokens, regions, ["page"]).collect()}
    assert got == {"a": ("r2", False), "b": ("r1", True), "c": ("r3", True), "d": (None, None)} or got["c"] == ("r4", True)


def test_grids_with_spans_and_gaps(spark):
    cells = [(1, "o", 0.0, 0.0, 200.0, 40.0), (1, "a", 0.0, 0.0, 200.0, 20.0), (1, "b", 0.3, 20.0, 100.0, 20.0), (1, "c", 100.0, 20.4, 100.0, 19.6), (2, "o", 0.0, 0.0, 200.0, 40.0), (2, "a", 0.0, 0.0, 100.0, 40.0), (2, "b", 100.0, 0.0, 100.0, 15.0), (3, "x", 0.0, 0.0, 9.0, 9.0)]
    rows = spark.createDataFrame(random.Random(4).sample(cells, len(cells)), "page int, ref string, x double, y double, w double, h double")
    found = topology.grids(rows, ["page"])
    got = {(r.page, r.ref): (r.row, r.col, r.rowspan, r.colspan) for r in found.cells.collect()}
    assert got == {(1, "a"): (0, 0, 1, 2), (1, "b"): (1, 0, 1, 1), (1, "c"): (1, 1, 1, 1)}
    assert [tuple(r) for r in found.rejected.collect()] == [(2, "o")]


def test_lines_of_text_and_segments(spark):
    texts = spark.createDataFrame([(1, "a", 0.0, 0.0, 20.0, 10.0, "12.", 0, 8.0), (1, "b", 22.0, 1.0, 20.0, 10.0, "word", 1, 8.0), (1, "c", 100.0, 0.0, 30.0, 10.0, "far", 2, 8.0), (1, "d", 0.0, 30.0, 9.0, 10.0, "next", 3, 8.0)], "page int, ref string, x double, y double, w double, h double, text string, reading_order int, font double")
    got = order.line_texts(order.text_lines(texts, ["page"]), ["page"]).orderBy("line_index").collect()
    assert [r.text for r in got] == ["12. word\tfar", "next"]
    e = texts.withColumn("z", F.lit(0)).where("y < 5")
    parts = order.segments(order.slots(e, ["page"], F.lit(10.0), F.lit(150.0)), ["page"], F.lit(150.0)).orderBy("start").collect()
    assert sum(p.width for p in parts) == pytest.approx(150) and sum(p.slot is None for p in parts) == 3


def test_manual_checks_states_and_gates(spark):
    required = spark.createDataFrame([(1, "b", 0), (1, "a", 1)], "doc int, name string, position int")
    supplied = spark.createDataFrame([(1, "a", "passed"), (1, "z", "failed")], "doc int, name string, status string")
    rows = score.manual_checks(required, supplied, ["doc"]).orderBy("place").collect()
    assert [(r.name, r.status) for r in rows] == [("b", "pending"), ("a", "passed"), ("z", "failed")]
    gates = spark.createDataFrame([(1, "g", True), (2, "g", None), (3, "g", False), (3, "h", None)], "doc int, gate string, passed boolean")
    assert {r.doc: r.state for r in score.gate_state(gates, ["doc"]).collect()} == {1: "pass", 2: "requires_human_review", 3: "fail"}
    m = spark.createDataFrame([("s", "a", 90.0, True), ("s", "b", 69.9, True), ("t", "a", 70.0, True)], "stage_id string, fixture_id string, score double, integrity boolean")
    assert {r.stage_id: r.passed for r in gate.stage_decisions(gate.fixture_decisions(m)).collect()} == {"s": False, "t": True}


def test_decisions(spark):
    def decision(gain, lost=(), failed=()):
        d, reasons = compare.decide({"text": F.lit(gain)}, {"anchor": F.array(*lit(*lost)).cast("array<string>")}, F.lit(False), F.array(*lit(*failed)).cast("array<string>"))
        return one(spark, d=d, r=reasons)

    assert decision(2.0).d == "supported" and decision(0.5).d == "inconclusive" and decision(-1.0).d == "regressed"
    assert decision(2.0, ["x"]).r == ["regression:lost_anchor:x"] and decision(-1.0, (), ["context"]).d == "invalid"
    with pytest.raises(Exception, match="can't be trusted"):
        one(spark, c=compare.chosen(F.lit("invalid"), "b"))


def test_relationships(spark):
    reviewed = spark.createDataFrame([(1, "p", 0.0, 0.0, 0.2, 0.1), (1, "q", 0.3, 0.0, 0.2, 0.1)], "doc int, region string, x double, y double, w double, h double")
    found = spark.createDataFrame([(1, "p", "t1", 0, 0.0, 0.0, 0.2, 0.1), (1, "q", "t2", 1, 0.32, 0.0, 0.2, 0.1)], "doc int, region string, ref string, reading_order int, x double, y double, w double, h double")
    wanted = spark.createDataFrame([(1, k, a, b) for k, a, b in [("reading_order", "p", "q"), ("reading_order", "q", "p"), ("adjacency", "p", "q"), ("containment", "s", "q"), ("containment", "none", "q")]], "doc int, kind string, source string, target string")
    structures = spark.createDataFrame([(1, "s", 0.3, 0.0, 0.4, 0.2)], "doc int, item string, s_x double, s_y double, s_w double, s_h double")
    got = score.relationships(wanted, score.evidence(reviewed, found, ["doc"]), structures, ["doc"]).collect()
    assert {(r.kind, r.source): r.passed for r in got} == {("reading_order", "p"): True, ("reading_order", "q"): False, ("adjacency", "p"): True, ("containment", "s"): True, ("containment", "none"): False}


def test_issues(spark):
    e = spark.createDataFrame([("d", "a", "text", 0.0, 0.0, 5.0, 5.0, None, 0, None, 0.5), ("d", "b", "blob", -1.0, 0.0, 5.0, 0.0, "x", 1, None, 1.5)], "doc_id string, ref string, type string, x double, y double, w double, h double, text string, reading_order int, asset_id string, conf double")
    got = {(r.path, r.code) for r in validate.broken(e, validate.element_rules(), "ref").collect()}
    assert got == {("a", "text_missing"), ("b", "negative_position"), ("b", "empty_box"), ("b", "unknown_type"), ("b", "confidence_range")}


def test_records_are_read_strictly(spark):
    good = '{"ir_version":"0.1.0","document_id":"d","generator":{"name":"n","version":"1"},"pages":[{"id":"p","number":1,"size":{"width":5.0,"height":5.0,"unit":"pt"},"elements":[{"id":"e","type":"text","bbox":{"x":0,"y":0,"width":1,"height":1},"text":"t","reading_order":0}]}],"assets":[]}'
    raw = spark.createDataFrame([("a", good), ("b", "[1]"), ("c", "{"), ("d", '{"x":NaN}')], "path string, content string")
    p = records.parsed(raw)
    assert {r.path: r.bad for r in p.collect()} == {"a": False, "b": True, "c": True, "d": True}
    assert [(r.ref, r.text, r.w) for r in records.elements(p.where("NOT bad")).collect()] == [("e", "t", 1.0)]
    again = records.parsed(records.to_json(p.where("NOT bad")).withColumnRenamed("json", "content"))
    assert again.where("NOT bad").count() == 1
    assert {r.code for r in records.field_issues(raw.where("path in ('b', 'c')")).collect()} == {"not_an_object"}


def test_create_only_publishing(spark, tmp_path):
    df = spark.range(3)
    target = f"{tmp_path}/out"
    records.publish(df, target)
    with pytest.raises(Exception, match="exists"):
        records.publish(df, target)
    assert records.published(spark, target, df.schema).count() == 3
    with pytest.raises(FileNotFoundError):
        records.published(spark, f"{tmp_path}/none", df.schema)


def test_row_rules_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("d", ["a", "b"], ["90", "-1"], [0, 1], [0, 0], [4, 4], [5, 5])], "doc string, text array<string>, conf array<string>, left array<int>, top array<int>, width array<int>, height array<int>").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = records.engine_rows(source).withColumn("conf", t.confidence(F.col("conf"))).writeStream.format("memory").queryName("words").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.text, r.conf) for r in spark.sql("SELECT * FROM words").collect()} == {("a", 0.9), ("b", None)}


def test_candidate_runs_lose_and_spoil(spark):
    tokens = spark.createDataFrame([(0, 1, 0, i, "word", 0, 0, 24, 10) for i in range(40)], "doc_id long, page_number int, line_no int, word_no int, word string, x long, y long, w long, h long")
    c = layout.candidate(tokens).collect()
    assert len(c) == 36 and sum(r.word[0] == "#" for r in c) == 3 and sum(r.conf is None for r in c) == 1
    assert all(r.conf is None or math.isfinite(r.conf) for r in c)


def runs_of_the_whole_table(x, y):
    """The reference's rules over the whole cost table."""
    cost = [list(range(len(y) + 1))]
    for i, c in enumerate(x, 1):
        cost.append([i])
        for j, d in enumerate(y, 1):
            cost[i].append(min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (c != d)))
    edits, i, j = [], len(x), len(y)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            edits.append(None if x[i] == y[j] else (x[i], y[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            edits.append((x[i], ""))
        else:
            j -= 1
            edits.append(("", y[j]))
    blocks = [[]]
    for e in reversed(edits):
        blocks.append([]) if e is None else blocks[-1].append(e)
    sides = [["".join(e[k] for e in b) for b in blocks] for k in (0, 1)]
    return tuple([r for r in side if r] for side in sides)


def test_edit_runs_are_those_of_the_whole_table():
    rng = random.Random(6)
    for n in [*range(25)] * 12 + [600]:
        x, y = ("".join(rng.choices("abc", k=rng.randint(n // 2, n))) for _ in "xy")
        assert t.edit_runs(x, y) == runs_of_the_whole_table(x, y)


def test_all_spoilt_lines_are_compared_in_full(spark):
    from tests.conftest import SF

    lines = tokens.blocks(spark, SF).where("observed IS NOT NULL AND accuracy < 100").select("doc_id", "line_no", "text", "observed").collect()
    got = {(r.doc_id, r.line_no): r for r in tokens.line_differences(spark, SF).collect()}
    assert len(got) == len(lines) and any(min(len(r.text), len(r.observed)) > 400 for r in lines)
    assert all(None not in r for r in got.values())
    for r in sorted(lines, key=lambda r: (len(r.text), r.doc_id, r.line_no))[::40]:
        if len(r.text) < 1500:
            own = got[r.doc_id, r.line_no]
            missing, extra = runs_of_the_whole_table(r.text, r.observed)
            assert (own.ratio, own.missing, own.extra) == (difflib.SequenceMatcher(None, r.text, r.observed, autojunk=False).ratio(), len(missing), len(extra))


def test_grids_of_several_outers_share_a_rectangle(spark):
    cells = [(1, f"{t}{i}", x + 50.0 * i, 0.0, 50.0, 20.0) for t, x in (("a", 0.0), ("b", 300.0)) for i in range(2)]
    outers = [(1, "oa", 0.0, 0.0, 100.0, 20.0), (1, "ob", 300.0, 0.0, 100.0, 20.0), (2, "p", 0.0, 0.0, 60.0, 20.0), (2, "q", 20.0, 0.0, 60.0, 20.0), (2, "s", 25.0, 0.0, 10.0, 20.0), (2, "t", 40.0, 0.0, 10.0, 20.0)]
    rows = spark.createDataFrame(random.Random(4).sample(cells + outers, 10), "page int, ref string, x double, y double, w double, h double")
    found = topology.grids(rows, ["page"])
    assert {(r.outer, r.table_id) for r in found.tables.collect()} == {("oa", "p001-table-0000"), ("ob", "p001-table-0001")}
    assert {(r.ref, r.outer, r.col) for r in found.cells.collect()} == {("a0", "oa", 0), ("a1", "oa", 1), ("b0", "ob", 0), ("b1", "ob", 1)}
    assert sorted(r.ref for r in found.ambiguous.collect()) == ["s", "t"] and sorted(r.outer for r in found.rejected.collect()) == ["p", "q"]


@pytest.mark.parametrize("name", ["text_membership", "cell_support", "structure_matches", "edge_f1", "line_rectangles"])
def test_tables_by_page_are_never_broadcast(spark, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_totals_of_large_stages_are_exact(spark):
    rows = spark.range(100_000).select(F.lit("s").alias("stage_id"), F.col("id").cast("string").alias("fixture_id"), (F.col("id") % 3 + 70.0).alias("score"), F.lit(True).alias("passed"))
    assert gate.stage_decisions(rows).first().total == 7_099_999.0


def test_words_are_placed_without_moving_rows(spark, tmp_path):
    """Places of words and boxes of lines are worked out in their line; before, each word went through a window by line."""
    lines = ["", " ", "a", "  two  words ", "x" * 7 + " " + " ".join("w" * (i % 5) for i in range(300)), "end "]
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "\n".join(["é b"] * 45))], schema).write.parquet(str(tmp_path / "documents.parquet"))
    tokens = layout.tokens(spark, str(tmp_path))
    wanted = set()
    for doc, text in ((1, lines), (3, ["? b"] * 45)):
        for n, line in enumerate(text):
            at = 0
            for k, word in enumerate(line.split(" ")):
                if word:
                    wanted.add((doc, n // 40 + 1, n, k, word, 6 * at, n % 40 * 14 + k % 3, 6 * len(word), 10))
                at += len(word) + 1
    assert sorted(map(tuple, tokens.collect())) == sorted(wanted)
    own = layout.regions(tokens)
    assert sorted(map(tuple, layout.reviewed(spark, str(tmp_path)).select(own.columns).collect())) == sorted(map(tuple, own.collect()))
    assert "Exchange" not in tokens._jdf.queryExecution().executedPlan().toString()


def test_exclusive_makes_no_pairs(spark):
    """The least area, then the order; a token on an edge of two bands; regions meet tokens as one row a page."""
    regions = spark.createDataFrame([(1, 0, 0, 100, 64, 7), (1, 0, 0, 100, 64, 3), (1, 0, 32, 50, 40, 9), (2, 0, 0, 9, 9, 1)], "page int, rx int, ry int, rw int, rh int, no int")
    tokens = spark.createDataFrame([(1, 1, 10, 59, 4, 10), (1, 2, 90, 27, 4, 10), (1, 3, 200, 0, 4, 4), (3, 4, 0, 0, 1, 1)], "page int, k int, x int, y int, w int, h int")
    held = assign.exclusive(tokens, regions, ["page"], Box.of(), Box("rx", "ry", "rw", "rh"), ["no"], ["k"])
    assert sorted((r.k, r.no) for r in held.collect()) == [(1, 9), (2, 3)]
    every = assign.in_every(tokens, regions, ["page"], Box.of(), Box("rx", "ry", "rw", "rh"))
    assert sorted((r.k, r.no) for r in every.collect()) == [(1, 3), (1, 7), (1, 9), (2, 3), (2, 7)]
    assert "Window" not in held._jdf.queryExecution().executedPlan().toString()


def test_line_rectangles_moves_no_edges(spark):
    """Edges were rows, sorted and joined four times; now a page is one row. The most confident, longest, first line covers an edge, unknown confidences last."""
    contours = spark.createDataFrame([(1, "a", 1.0, 1.0, 99.0, 49.0, 4851.0), (1, "b", 2.0, 0.0, 99.0, 50.0, 2500.0), (1, "c", 0.0, 0.0, 99.0, 11.0, 1089.0), (2, "d", 0.0, 0.0, 99.0, 50.0, 4950.0)], "page int, ref string, x double, y double, w double, h double, area double")
    rows = [(1, "l1", False, 0.0, 0.0, 50.0, 0.2), (1, "l2", False, 100.0, 0.0, 50.0, 1.0), (1, "l3", True, 0.0, 0.0, 100.0, 1.0), (1, "l4", True, 50.0, 0.0, 100.0, None), (1, "l5", True, 50.0, -1.0, 100.0, 0.4), (1, "l6", False, 1.0, -2.0, 52.0, 0.2), (2, "l7", False, 0.0, 0.0, 50.0, 1.0)]
    lines = spark.createDataFrame(rows, "page int, ref string, level boolean, at double, start double, end double, conf double")
    found = topology.line_rectangles(contours, lines, ["page"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan
    assert [tuple(r) for r in found.collect()] == [(1, 1.0, 0.0, 100.0, 51.0, round(0.55 * (0.2 + 1 + 1 + 0.4) / 4 + 0.45, 6))]
