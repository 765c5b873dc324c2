"""Registered queries beside their SQL at the smallest scale.

All of them run with ``ALL_QUERIES=1``; otherwise one or two of each kind.
``python tests/compare.py`` runs all of them at any scale.
"""

from __future__ import annotations

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SOME = (
    "detect_email detect_address detect_password card_validity scan_text scan_structured floor_before_arbitration scan_summary"
    " redact_text synthetic_values token_round_trip condition_in condition_gt combine_priority_ordered obligation_union replay_as_of"
    " simulate_change resolve_urn principal_enrichment scan_labels label_suggestions decide_requests route_or_deny capped_results"
    " redeem_approvals park_for_approval contradiction_correction seal_chain seal_segmented verify_tampered verify_checkpoint tool_assets flatten_messages split_messages"
    " redact_deep scan_deep route_rejections sampled_read metrics_stream label_metrics"
).split()
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    _, problem = compare(spark, con, sf, name)
    assert not problem


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert set(SOME) <= set(names)
    assert entry.entry(spark).columns
