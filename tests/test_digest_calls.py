"""Calls of a digest function: how much of a task's text is held in Python at once."""

import resource

import pandas as pd
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.plans import ingest


def test_only_the_rows_of_a_call_are_objects(spark):
    def measured(part):
        import gc

        held = sum(len(x) for x in gc.get_objects() if isinstance(x, pd.DataFrame))
        return pd.DataFrame({"page_content": [f"{len(part)} {held} {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10}"] * len(part), "error_class": None, "message": None})

    rows = spark.range(0, 1000, 1, 1).select(F.format_string("/in/%05d.txt", "id").alias("source_path"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"),
                                             F.encode(F.repeat(F.lit("text "), 20000), "UTF-8").alias("content"))
    got = ingest.digest_sources(rows, measured).collect()
    assert len(got) == 1000 and {r.source_path for r in got} == {f"/in/{i:05}.txt" for i in range(1000)} and all(r.error_class is None and r.message is None for r in got)
    size, held, peak = (max(x) for x in zip(*[map(int, r.page_content.split()) for r in got]))
    print(f"rows in data frames {held}, peak {peak} MB")
    assert size == 32 and held <= 3 * 32


def test_a_failed_call_may_be_tried_again(spark):
    def broken(part):
        if (part["source_path"] == "/in/00033.txt").any():
            raise ValueError("no")
        return pd.DataFrame({"page_content": part["content"].map(lambda x: x.decode()), "error_class": [None] * len(part), "message": [None] * len(part)})

    rows = spark.range(0, 70, 1, 1).select(F.format_string("/in/%05d.txt", "id").alias("source_path"), F.lit("h").alias("content_hash"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    got = {r.source_path: r for r in ingest.digest_sources(rows, broken).collect()}
    assert [p for p, r in sorted(got.items()) if r.error_class] == [f"/in/{i:05}.txt" for i in range(32, 64)]
    assert got["/in/00040.txt"].message == "no" and got["/in/00069.txt"].page_content == "69"


def test_outcomes_hold_one_copy_of_a_page(spark):
    plan = spark.createDataFrame([("/in/a.txt", "h", "/in", "digest", None)], "source_path string, content_hash string, source_dir string, action string, prev_attempts int")
    results = spark.createDataFrame([("/in/a.txt", "h", "---\ntitle: a\n---\n" + "text " * 1000, None, None)], ingest.RESULT)
    done = ingest.outcomes(plan, results, spark.createDataFrame([], schemas.LEDGER))
    row = done.collect()[0]
    assert row.error_class is None and row.header["title_text"] == "a"
    assert sum("text text" in str(v) for v in row) == 1


def test_bytes_of_a_batch_move_once(spark):
    from folioscope.streaming import ingest as si

    at = "timestamp'2024-01-01 00:00:00' as mtime"
    batch = spark.createDataFrame([("/in", p, bytearray(c), len(c), None) for p, c in (("a", b"1"), ("a", b"1"), ("b", b"2"), ("b", b"3"))], schemas.SOURCES)
    batch = batch.unionByName(batch.drop("mtime").selectExpr("*", at).where("source_path = 'b'"))
    wanted = batch.where("mtime is null and content in (X'31', X'32')").select("source_path", F.lit(1).alias("seen_in"), "mtime", F.xxhash64("content").alias("_tie")).distinct()
    wanted = spark.createDataFrame(wanted.collect(), wanted.schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = si._contents(batch, si.open_store(spark, f"{si.written(wanted, 'w').inputFiles()[0]}-none"), wanted, 1)
        assert sorted((r.source_path, bytes(r.content), r.mtime) for r in found.collect()) == [("a", b"1", None), ("b", b"2", None)]
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert len(moved) == 4 and sum("_tie" in x for x in moved) == 2, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
