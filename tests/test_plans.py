"""Physical plans are the ones wanted: pruned scans, pushed filters, no needless Python or cross joins."""

from __future__ import annotations

import re

import pytest

from threadloom.plans import registry

SF = "/root/testdata/sf0.001"
PYTHON = {
    "file_states", "error_loops", "shell_operations", "summary_sections", "verification_gaps", "verification_scores", "verification_messages",
    "repaired_summaries", "semantic_gaps", "semantic_stems", "critical_context",
    "session_topics", "session_chunks", "canonical_arguments", "scrubbed_arguments", "repaired_reports", "dry_run_completions",
    "bounded_arguments", "truncated_patches", "section_identities", "pinned_paths", "change_sections", "open_loop_sections",
}


def plan_of(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - PYTHON))
def test_stays_in_the_jvm(spark, name):
    plan = plan_of(spark, name)
    assert not re.search("MapIn|ArrowEval|BatchEvalPython|InPandas", plan)


def test_scans_are_pruned(spark):
    plan = plan_of(spark, "token_estimate_by_source")
    assert re.search(r"ReadSchema: struct<text:string,source:string>", plan)
    plan = plan_of(spark, "explored_range")
    assert "PushedFilters" in plan and "GreaterThanOrEqual(turn,2)" in plan


def test_cross_joins_are_of_single_rows(spark):
    allowed = {"canary_assessment", "dashboard_summary", "bm25_matches", "context_recall"}
    for name in registry.queries():
        if re.search("CartesianProduct", plan_of(spark, name)):
            assert name in allowed, name
