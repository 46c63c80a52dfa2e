"""Mails are read for their fields once, however often drafts and links are used."""

import pytest

from tallyhouse.plans import evidence  # noqa: F401
from tallyhouse.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["evidence_matches", "evidence_links", "debits_with_evidence"])
def test_no_pattern_is_read_again(spark, name):
    assert "regexp_extract" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
