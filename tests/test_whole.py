"""Registered queries against their SQL where a list has many parts."""

import functools

import pytest
from oracle import compare, connect

from folioscope.catalog import all_queries, all_sql
from folioscope.plans import corpus

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,plan", [("J9_synthesize", "synthesize"), ("J10_digest_recent", "digest_recent"), ("J11_index_page", "build_index_page")])
def test_pages_of_many_parts_are_one_row(spark, monkeypatch, name, plan):
    monkeypatch.setattr(corpus, plan, functools.partial(getattr(corpus, plan), lines_per_part=3))
    assert compare(spark, connect(SMALL), name, all_queries()[name], all_sql()[name], SMALL) is None
