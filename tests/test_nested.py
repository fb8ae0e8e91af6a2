"""Strict reading of nested values, references of table records, missing records, and distances of long texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import baseline, compare
from pagewright.plans import nested as plans
from pagewright.sources import evaluation_record, nested, topology_record
from pagewright.sources.nested import Rule, canonical_digest, nodes, strict_issues

RULES = [Rule("$", "object", ("a", "d"), ("c",)), Rule("$.a", "array"), Rule("$.a[]", "object", ("n",)), Rule("$.a[].n", "integer", least=2, most=9), Rule("$.d", "number", above=1), Rule("$.c", "string", allowed=("x", "y"))]


def frame(spark, *contents):
    rows = [(i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "doc_id long, content string")


def told(spark, content, rules=RULES):
    return sorted((r.path, r.code) for r in strict_issues(frame(spark, content), "doc_id", "content", rules).collect())


@pytest.mark.parametrize("content, issues", [
    ({"a": [{"n": 2}, {"n": 9}], "d": 1.5, "c": "y"}, []), ({"a": [], "d": 2}, []), ({"a": [{"n": 1}, {}], "d": 1}, [("$.a[0].n", "out_of_range"), ("$.a[1].n", "missing_field"), ("$.d", "out_of_range")]),
    ({"a": [{"n": 2.5, "z": {"n": 1}}], "d": "2"}, [("$.a[0].n", "wrong_type"), ("$.a[0].z", "unknown_field"), ("$.d", "wrong_type")]), ({"a": {"n": 1}, "d": 2, "c": "q"}, [("$.a", "wrong_type"), ("$.c", "not_allowed")]),
    ({"a": None, "d": True}, [("$.a", "wrong_type"), ("$.d", "wrong_type")]), ("[1]", [("$", "wrong_type")]), ('{"a":', [("$", "not_json")]), ("", [("$", "not_json")]), (None, [("$", "wrong_type")]),
])
def test_issues_have_path_and_code(spark, content, issues):
    assert told(spark, content) == sorted(issues)


def test_every_value_is_a_row_once(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(6 if depth else 3)
        return [rng.randrange(9), "text", rng.random() < 0.5][kind] if kind < 3 else [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 3 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}

    def paths(v, at="$"):
        below = [(f".{k}", x) for k, x in v.items()] if isinstance(v, dict) else [(f"[{i}]", x) for i, x in enumerate(v)] if isinstance(v, list) else []
        return [at] + [p for step, x in below for p in paths(x, at + step)]

    values = [value(4) for _ in range(40)]
    got = {}
    for r in nodes(frame(spark, *values), "doc_id", "content", 4).collect():
        got.setdefault(r.doc_id, []).append(r.path)
    assert {i: sorted(p) for i, p in got.items()} == {i: sorted(paths(v)) for i, v in enumerate(values)}


def test_digests_ignore_order_and_named_fields(spark):
    a, b, c = {"x": 1, "y": [{"ids": ["p"], "z": 2}]}, {"y": [{"z": 2, "ids": ["q", "r"]}], "x": 1}, {"x": 1, "y": [{"z": 3}]}
    d = [r.digest for r in canonical_digest(frame(spark, a, b, c), "doc_id", "content", 5, ["ids"]).orderBy("doc_id").collect()]
    assert d[0] == d[1] != d[2]
    plain = [r.digest for r in canonical_digest(frame(spark, a, b), "doc_id", "content", 5).orderBy("doc_id").collect()]
    assert plain[0] != plain[1]


def record(**changes):
    source = {"stage": "derived", "provider": "p", "provider_version": "1", "source_element_ids": ["r0", "r1"], "parameters_digest": "0" * 64}
    box = {"x": 0, "y": 0, "width": 10, "height": 20}
    axis = [{"id": "a0", "index": 0, "start": 0, "end": 10.5}]
    cell = {"id": "c0", "row_index": 0, "column_index": 0, "rowspan": 1, "colspan": 1, "bbox": box, "supporting_element_ids": ["r1"], "text_element_ids": ["w1"], "confidence": 1, "provenance": source | {"source_element_ids": ["r1"]}}
    table = {"id": "t0", "bbox": box, "logical_grid": {"rows": 1, "columns": 1}, "rows": axis, "columns": axis, "cells": [cell], "supporting_element_ids": ["r0", "r1"], "confidence": 0.5, "provenance": source}
    out = {
        "schema_version": "1.0", "provider": "p", "provider_version": "1", "coordinate_space": "document-ir-points", "boundary_tolerance_pt": 1, "tables": [table],
        "primitive_roles": [{"element_id": "r1", "role": "cell_rectangle", "table_id": "t0", "cell_id": "c0"}], "diagnostics": {d: [] for d in topology_record.DIAGNOSTICS},
    }
    text = json.dumps(out, separators=(",", ":"))
    for old, new in changes.values():
        assert old in text
        text = text.replace(old, new, 1)
    return text


def read(spark, *contents):
    return topology_record.read_topologies(frame(spark, *contents), "doc_id", "content", "p", "1")


def test_sound_records_are_typed_and_broken_ones_left_out(spark):
    typed, issues = read(spark, record(), record(x=('"index":0', '"index":-1')), record(x=('"end":10.5', '"end":0')), "{}", record(x=('"provider":"p"', '"provider":"q"')))
    assert [r.doc_id for r in typed.collect()] == [0] and typed.first().topology.tables[0].cells[0].provenance.stage == "derived"
    found = {(r.doc_id, r.path, r.code) for r in issues.collect()}
    assert {(1, "$.tables[0].rows[0].index", "out_of_range"), (2, "$.tables[0].rows[0]", "invalid_axis"), (4, "$.provider", "not_allowed")} <= found
    assert sum(f[0] == 3 and f[2] == "missing_field" for f in found) == 8


def test_references(spark):
    typed, _ = read(
        spark, record(), record(x=('"text_element_ids":["w1"]', '"text_element_ids":["w1","w1","r1"]')), record(x=('"supporting_element_ids":["r1"]', '"supporting_element_ids":["r2"]')),
        record(x=('"cell_id":"c0"', '"cell_id":"c0","duplicate_of_element_id":"w1"')), record(x=('"cell_id":"c0"', '"cell_id":"c9"')),
    )
    ids = [("r0", "rectangle"), ("r1", "rectangle"), ("r2", "line"), ("w1", "text")]
    elements = spark.createDataFrame([(d, r, k) for d in range(5) for r, k in ids], "doc_id long, ref string, type string")
    cell = "$.tables[0].cells[0]"
    assert {(r.doc_id, r.path, r.code) for r in topology_record.reference_issues(typed, elements, "doc_id").collect()} == {
        (1, f"{cell}.text_element_ids[1]", "duplicate_id"), (1, f"{cell}.text_element_ids[2]", "unknown_element"), (2, f"{cell}.supporting_element_ids", "invalid_support_reference"),
        (2, f"{cell}.provenance.source_element_ids", "invalid_provenance"), (3, "$.primitive_roles[0].duplicate_of_element_id", "invalid_role_reference"), (4, "$.primitive_roles[0]", "invalid_role_reference"),
    }


def test_missing_records_are_inferred_once(spark):
    pages = spark.createDataFrame([(i,) for i in range(6)], "doc_id long")
    held = spark.createDataFrame([(0, "old")], "doc_id long, topology string")
    asked = []

    def infer(lacking):
        asked.append(sorted(r.doc_id for r in lacking.collect()))
        return lacking.where("doc_id % 2 = 1").withColumn("topology", F.lit("new"))

    once = topology_record.infer_missing(pages, held, infer, ["doc_id"])
    again = topology_record.infer_missing(pages, once.drop("inferred"), infer, ["doc_id"])
    rows = lambda d: {(r.doc_id, r.topology) for r in d.collect()}
    assert rows(once) == rows(again) == {(0, "old"), (1, "new"), (3, "new"), (5, "new")} and asked == [[1, 2, 3, 4, 5], [2, 4]]


def test_bags_have_witnesses(spark):
    frame = lambda *v: spark.createDataFrame([(1, x) for x in v], "doc_id long, v string")
    r = compare.bag_difference(frame("a", "a", "b"), frame("a", "c", "b"), ["doc_id"], F.col("v")).first()
    assert (r.same, r.control_only, r.candidate_only, r.control_rows) == (False, "a", "c", 3)
    assert compare.bag_difference(frame("a", None), frame(None, "a"), ["doc_id"], F.coalesce("v", F.lit(""))).first().same


def test_long_distances(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(0, 14))) for _ in "ab")
        assert t.edit_distance(a, b) == plain(a, b), (a, b)
    long = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    other = "x" + long[:20_000] + "zz" + long[20_010:]
    frame = spark.createDataFrame([(long, other), ("ab", "b"), ("", ""), (long, "")], "a string, b string")
    got = [r[0] for r in frame.select(t.whole_accuracy(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(100 * (1 - t.edit_distance(long, other) / 40_000), abs=1e-3), 50.0, 100.0, 0.0] and t.edit_distance(long, other) <= 13


def test_short_numbers(spark):
    values = [0.0, 100.0, 68.25, 54.716981, 5.0, 33.333333, 0.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(baseline.short_number(F.col("v"))).collect()
    assert [r[0] for r in rows] == [f"{v:g}" for v in values]


def test_texts_are_read_as_variants_are(spark):
    """The one pass over a text tells the values that the walk over variants tells, on odd texts too."""
    texts = [
        '{"a":[1,2.0,"x",null,true,{"b":[]}],"c":{"d":{"e":{"f":1}}}}', "null", "7", "[]", '""', "", " ", "{", "[1,]", '{"a":1,"a":2}', "NaN", "[Infinity]", "01", "-0", "9223372036854775807", "9223372036854775808",
        "1e2", "1e400", "-1.50", '"\\u00e9 \\n"', '{"":{"é":1}}', None, "tru", '{"a" : false }', "'a'", "[1] ", '"a\nb"', "1" * 1001, '{"a":"\\ud83d\\ude00"}',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    told = lambda d: sorted((r.k, r.path, r.shape, r.kind, r.scalar if r.kind == "string" else None, sorted(r["keys"] or [])) for r in d.collect())
    assert told(nested.text_nodes(rows, "k", "t", 3)) == told(nested.nodes(rows, "k", "t", 3))


def plan_of(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_digests_are_made_in_one_pass(spark):
    """Values went through a row each, once a level; now a text is read and told in one go, and what lies deeper than the rules counts too."""
    deep = '{"a":' * 12 + "%s" + "}" * 12
    texts = ['{"a":1,"b":1.50}', '{"b":1.5, "a":1}', '{"a":1.0,"b":1.5}', '{"a":1,"a":1}', "{", None, "null", deep % 1, deep % 2, '{"a" : {"ids":[9]},"c":":"}', '{"c":":","a":{}}']
    found = canonical_digest(frame(spark, *texts), "doc_id", "content", 5, ["ids"])
    d = [r.digest for r in found.orderBy("doc_id").collect()]
    assert d[0] == d[1] and d[3] == d[4] and d[5] == d[6] and d[9] == d[10] and len(set(d)) == 7
    assert "Generate" not in plan_of(found) and "Aggregate" not in plan_of(found)


def test_records_are_read_without_being_written_or_moved(spark):
    """Texts, issues and typed rows were written out and joined; every value was a row. Each side is one pass now."""
    typed, issues = read(spark, record(), record(x=('"index":0', '"index":-1')), record()[:-1] + ',"provider":"p"}', record().replace(",", " , ").replace(":", " :\n"), '{"a":":::"}')
    assert [r.doc_id for r in typed.collect()] == [0, 3] and {r.doc_id for r in issues.collect()} == {1, 2, 4}
    for d in (typed, issues):
        assert not any(x in plan_of(d) for x in ("Join", "Exchange", "FileScan"))


def test_records_of_orders_are_moved_once(spark):
    from tests.conftest import SF

    for name in ("record_issues", "record_references"):
        plan = plan_of(plans.QUERIES[name](spark, SF))
        assert plan.count("Exchange") == 1 and "Join" not in plan
    assert plan_of(plans.QUERIES["topology_differences"](spark, SF)).count("REPARTITION_BY_NUM") == 2


def test_odd_patterns_and_spelt_numbers_are_judged_as_before(spark):
    rules = [Rule("$", "object", ("a", "b")), Rule("$.a", "string", pattern=r"^\p{Lu}+$"), Rule("$.b", "integer", allowed=("1", "10")), Rule("$.c", "string", pattern="^x$")]
    assert told(spark, {"a": "ÄB", "b": 10}, rules) == [] and told(spark, {"a": "äb", "b": 2}, rules) == [("$.a", "bad_format"), ("$.b", "not_allowed")]
    assert told(spark, '{"a":"A","b":1,"c":"x"}', rules) == [("$.c", "unknown_field")] and told(spark, "1" * 1001, rules) == [("$", "not_json")]


def test_references_are_read_without_being_written(spark):
    """Texts and issues of references and reports were written out, and every value was a row; now each side is one pass over the texts."""
    element = {"id": "e1", "type": "text", "page_number": 1}
    edge = {"kind": "adjacency", "source": "e1", "target": "e2"}
    whole = {"reference_id": "r", "ir_version": "1", "reviewed": True, "elements": [element, element | {"id": "e2", "bbox": None}], "relationships": [edge], "essential_text_anchors": ["a"]}
    texts = [whole, whole | {"elements": [element, element]}, whole | {"relationships": [edge, edge, edge | {"target": "e1"}]}, whole | {"elements": [element | {"page_number": 0}]}, "{"]
    parts = evaluation_record.read_references(frame(spark, *texts))
    assert [(r.doc_id, r["index"], r.ref) for r in parts[1].orderBy("index").collect()] == [(0, 0, "e1"), (0, 1, "e2")] and [len(p.collect()) for p in (parts[0], parts[2], parts[3])] == [1, 1, 1]
    assert sorted((r.doc_id, r.path, r.code) for r in parts[4].collect()) == [
        (1, "$.elements", "duplicate_id"), (2, "$.relationships", "duplicate_relationship"), (2, "$.relationships[2]", "one_end"), (3, "$.elements[0].page_number", "out_of_range"), (4, "$", "not_json"),
    ]
    report = {"reference_id": "r", "overall_score": 1, "components": [], "elements": {"matched": [], "missing": [], "unexpected": []}, "hard_gates": [], "state": "pass", "reasons": [], "required_human_checks": []}
    typed, issues = evaluation_record.read_reports(frame(spark, report, report | {"state": "odd"}))
    assert [(r.doc_id, r.report.state) for r in typed.collect()] == [(0, "pass")] and [(r.doc_id, r.code) for r in issues.collect()] == [(1, "not_allowed")]
    for d in (*parts, typed, issues):
        assert not any(x in plan_of(d) for x in ("Join", "Exchange", "FileScan"))
