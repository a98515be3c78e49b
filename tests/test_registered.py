"""Registered queries against their check SQL, and the shape of some plans."""

import pytest

from folioscope.catalog import all_queries, all_sql
from folioscope.catalog import inputs as I
from folioscope.operators import ledger as lg_
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUICK = ["A2_type_gate", "A14_move_page", "B5_frontmatter_tags", "B7_wikilinks", "C5_consistency_diff", "D1_run_report_counts",
         "E1_apply_limit", "E3_supersede", "E4_slug_winner", "F2_phrase_search", "F4_all_nearest", "J3_sweep_orphans",
         "J5_classify_responses", "J9_synthesize", "J11_index_page", "K3_apply_changes", "K5_rolling_summary", "K3_moves", "F2_phrase_search_indexed", "C7_kept_broken_links", "A1_scan_sources", "K5_on_time_and_late"]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, con, name):
    assert compare(spark, con, name, all_queries()[name], all_sql()[name], SF_DIR) is None


def test_names_match():
    assert set(all_sql()) <= set(all_queries())


@pytest.mark.parametrize("name", ["C1_ledger_lookup", "D5_sweep_decision", "J1_plan_ingest", "C5_consistency_diff", "K3_apply_changes"])
def test_no_cross_join_or_single_task_window(spark, name):
    plan = all_queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Window" not in plan


def test_scan_reads_only_needed_columns(spark):
    df = lg_.status_report(I.ledger(spark, SF_DIR)).drop("share")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan  # hashes of unused columns are not computed
