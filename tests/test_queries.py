"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "extracted_elements", "extraction_rejects", "extracted_assets", "region_candidates", "enriched_selection",
    "language_decisions", "relabelled_decisions", "built_references", "unknown_essentials", "package_states",
    "references_read_back", "reference_record_issues", "reports_read_back",
    "target_recovery", "singleton_rows", "inferred_topologies", "topology_differences", "record_issues", "record_references", "recognition_quality",
    "source_baselines", "element_matches", "snapshot_regions", "restoration_scores", "ocr_quality", "reading_order", "token_regions",
    "grouped_regions", "line_texts", "experiment_decisions", "primitive_roles", "suppressed_boxes", "document_issues", "stage_gate",
    "parsed_elements", "changed_fields", "selections", "layer_states", "covered_edges", "slot_segments", "contract_gates", "padding_decisions",
    "text_assignments", "truth_issues", "provenance_issues", "run_field_issues", "score_issues", "crop_issues", "resize_issues", "option_issues",
    "line_rectangles", "anchor_recall", "unit_boxes", "box_neighbours", "page_images", "element_counts", "same_outcomes", "mapped_edges",
    "weighted_totals", "page_texts", "ordered_reasons", "parameter_digests",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_its_sql(spark, con, name):
    got, want = driver.queries()[name](spark, SF).toPandas(), con.sql(driver.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
