"""Exploded rows are never sent whole to every task, however few Spark takes them for."""

from folioscope.llm import linededup, neardocs, simhash
from folioscope.llm.common import Shared

_JOINS = ("BroadcastHashJoin", "BroadcastNestedLoopJoin")


def _sent(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if any(j in x for j in _JOINS)]


def test_lookups_of_fingerprints_are_not_broadcast(spark):
    distinct = Shared(spark).put("distinct", spark.range(40).selectExpr("id * 1099511627791 AS fp"))
    _, stars, links = simhash.near_prints(Shared(spark), distinct)
    assert _sent(stars) == [] and _sent(links) == []


def test_buckets_are_not_broadcast(spark, monkeypatch):
    sent, put = {}, Shared.put

    def seen(self, name, df):
        sent[name] = _sent(df)
        return put(self, name, df)

    monkeypatch.setattr(Shared, "put", seen)
    docs = spark.createDataFrame([(i, " ".join(f"word{(i // 2) * 7 + j}" for j in range(30))) for i in range(20)], "doc_id long, text string")
    neardocs.near_copies(docs).count()
    linededup.without_duplicates(docs).count()
    assert sent["set-buckets"] == [] and sent["buckets"] == []
