"""The union of issues holds every issue."""

from folioscope.catalog import all_queries

SMALL = "/root/testdata/sf0.001"


def test_issues_are_rows(spark):
    lint, union = (all_queries()[q](spark, SMALL) for q in ("J8_lint", "H2_union_of_issues"))
    assert set(union.columns) == {"path", "kind", "message"}
    assert union.where("kind <> 'parse'").count() == lint.count() and union.where("kind = 'parse'").count() > 0
