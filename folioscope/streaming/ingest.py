"""Scheduled ingest over a landing folder, and its settle queue."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import schemas
from folioscope.functions import text as tx
from folioscope.operators import gates
from folioscope.operators.changes import latest_per_key
from folioscope.operators.ledger import KEY
from folioscope.plans import ingest
from folioscope.session import written
from folioscope.sources.runs import RunStore


def _with(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in more]])


# a file that waits is known by name, size, time and hash; its bytes lie with the run that first saw them
PENDING = T.StructType([*[f for f in schemas.SOURCES.fields if f.name != "content"], T.StructField("content_hash", T.StringType()),
                        T.StructField("seen_in", T.IntegerType()), T.StructField("settled", T.BooleanType())])
TABLES = {
    "ledger": (schemas.LEDGER, KEY, None),
    "pages": (_with(schemas.PAGES, ("removed", T.BooleanType())), ["path"], "removed"),
    "pending": (PENDING, ["source_path"], "settled"),
    "contents": (schemas.SOURCES, ["source_path"], None),
}


def open_store(spark: SparkSession, root: str) -> RunStore:
    return RunStore(spark, root, TABLES)


# what a later run may decide otherwise: it waits for time, for its turn, for another try or another model
OPEN = ("deferred", "not-examined", "digest", "already-refused", "exhausted")


def _observed(batch: DataFrame, waiting: DataFrame, number: int) -> DataFrame:
    """The newest observation of each file, without its bytes; of equally new ones the one of the greatest hash."""
    names = ["source_dir", "source_path", "size", "mtime"]
    new = batch.select(*names, F.lit(None).cast("string").alias("content_hash"), F.lit(number).alias("seen_in"), F.xxhash64("content").alias("_tie"))
    old = waiting.select(*names, "content_hash", "seen_in", F.lit(None).cast("long").alias("_tie"))
    order = F.struct("mtime", "seen_in", "_tie")
    return latest_per_key(new.unionByName(old).withColumn("_order", order), ["source_path"], "_order").drop("_order")


def _contents(batch: DataFrame, store: RunStore, wanted: DataFrame, number: int) -> DataFrame:
    """``wanted`` (observations) with their bytes: from the batch, or from the runs that first saw them."""
    # plain columns for a time that may be null: joined and then told apart by the same key, the bytes move once
    keyed = lambda rows: rows.withColumns({"_none": F.col("mtime").isNull(), "_at": F.coalesce("mtime", F.timestamp_seconds(F.lit(0)))})
    key = ["source_path", "_none", "_at", "_tie"]
    here = keyed(batch.select("source_path", "mtime", "content", F.xxhash64("content").alias("_tie"))).drop("mtime")
    new = keyed(wanted.where(F.col("seen_in") == number)).join(here, key).dropDuplicates(key).select(*wanted.columns, "content")
    # at most one number a run
    runs = [r[0] for r in wanted.where(F.col("seen_in") != number).select("seen_in").distinct().collect()]
    kept = store.rows("contents", runs).select("source_path", F.col("run").alias("seen_in"), "content")
    return new.unionByName(wanted.where(F.col("seen_in") != number).join(kept, ["source_path", "seen_in"]).select(*wanted.columns, "content"))


def ingest_batch(
    batch: DataFrame, store: RunStore, types: DataFrame, model: str, now: dt.datetime,
    batch_id: int | None = None, origin: str = "scheduled", limit: int = 0,
    fn: Callable | None = None, schema_text: str = "",
) -> None:
    """One run: plan, digest, record; its rows are appended and appear together.

    Files whose outcome may still change wait in ``pending`` and are planned again by every run: those still
    settling or not reached, those that failed or were refused, and those out of attempts (another model may
    take them).  Names, sizes and times decide first; only what passes is hashed, once, and
    bytes are read again only to be digested.  A batch at or below the last finished one is skipped: a replay
    after a lost driver must not spend a second attempt on a failing file.
    """
    if batch_id is not None and batch_id <= store.info().get("batch_id", -1):
        return
    number = (store.runs() or [0])[-1] + 1
    at = F.lit(now).cast("timestamp")
    batch = batch.select(*[f.name for f in schemas.SOURCES.fields])
    seen = written(gates.gate(_observed(batch, store.read("pending"), number), types, at), "seen")
    unread = seen.where((F.col("gate") == "pass") & F.col("content_hash").isNull()).select("source_path", "seen_in", "mtime", "_tie")
    hashes = written(_contents(batch, store, unread, number).select("source_path", tx.content_hash(F.col("content")).alias("_hash")), "hashes")
    sources = written(seen.join(hashes, "source_path", "left").withColumn("content_hash", F.coalesce("content_hash", "_hash")).drop("_hash"), "sources")
    # the ledger rows of these files; names of pages are checked against all
    ledger, pages = store.read("ledger"), store.read("pages")
    plan = written(
        ingest.plan_ingest(sources.drop("seen_in", "_tie"), types, ledger.join(sources.select("source_path"), "source_path", "left_semi"), pages, model, at, limit), "plan")
    todo = plan.where(F.col("action") == "digest").select(*KEY).join(sources.select("source_path", "content_hash", "source_dir", "size", "mtime", "seen_in", "_tie"), KEY)
    results = written(ingest.digest_sources(_contents(batch, store, todo, number).drop("seen_in", "_tie"), fn, schema_text=schema_text), "results")
    done = written(ingest.outcomes(plan, results, ledger), "outcomes")

    new_rows = ingest.ledger_rows(done, model, origin, at)
    won = done.where(F.col("error_class").isNull()).select("source_path")
    mine = ledger.join(won, "source_path", "left_semi")
    aged = mine.where(F.col("status") == "success").join(new_rows.select(*KEY), KEY, "left_anti").withColumn("status", F.lit("superseded"))
    waits = plan.where(F.col("action").isin(*OPEN)).select("source_path").join(won, "source_path", "left_anti")
    open_ = sources.join(waits, "source_path", "left_semi")
    settled = store.read("pending").join(waits, "source_path", "left_anti")
    first_seen = open_.where(F.col("seen_in") == number)
    names = [f.name for f in PENDING.fields if f.name != "settled"]
    # what waits as before is not written again
    fresh = open_.select(*names).exceptAll(store.read("pending").select(*names))
    store.append({
        "contents": _contents(batch, store, first_seen.select("source_dir", "source_path", "size", "mtime", "seen_in", "_tie"), number),
        "ledger": new_rows.unionByName(aged.select(*new_rows.columns)),
        "pages": ingest.new_pages(done, at).withColumn("removed", F.lit(False)),
        "pending": fresh.withColumn("settled", F.lit(False)).unionByName(settled.select(*names).withColumn("settled", F.lit(True))),
    }, info={"now": now.isoformat()} | ({} if batch_id is None else {"batch_id": batch_id}))


def sweep(store: RunStore, dirs: DataFrame, snapshot: DataFrame) -> None:
    """A run of its own: archive the pages of files that are gone (``ingest.sweep_orphans``), before what is there is planned."""
    ledger, pages = store.read("ledger"), store.read("pages")
    found = written(ingest.sweep_orphans(ledger, dirs, snapshot, pages.select("path")), "swept")
    acted = found.where(F.col("action") == "archived")
    rows = ledger.join(acted.select(F.col("path").alias("source_path"), "content_hash"), KEY, "left_semi").withColumn("status", F.lit("superseded"))
    target = acted.groupBy(F.col("wiki_page").alias("path")).agg(F.min("archived_page").alias("_to"))
    moved = pages.join(target, "path")
    away = moved.drop("_to").withColumn("removed", F.lit(True))
    put = moved.withColumn("path", F.col("_to")).drop("_to").withColumn("removed", F.lit(False))
    store.append({"ledger": rows, "pages": away.unionByName(put.select(*away.columns))})


def run_ingest(
    spark: SparkSession, landing: str, store: RunStore, types: DataFrame, model: str, checkpoint: str,
    now: Callable[[], dt.datetime], fn: Callable | None = None, limit: int = 0, files_per_batch: int | None = None,
    schema_text: str = "", dirs: DataFrame | None = None, snapshot: DataFrame | None = None,
) -> None:
    """Sweep, then take in everything that has landed since the last call, and what is pending, then stop.

    ``dirs`` and ``snapshot`` tell what the source folders hold now; without them nothing is swept.
    """
    if dirs is not None and snapshot is not None:
        sweep(store, dirs, snapshot)
    reader = spark.readStream.schema(schemas.SOURCES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(landing).writeStream
        .foreachBatch(lambda df, i: ingest_batch(df, store, types, model, now(), i, "scheduled", limit, fn, schema_text))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    before = store.runs()
    query.awaitTermination()
    if store.runs() == before:  # nothing landed, but time has passed or a failure may be tried again
        ingest_batch(spark.createDataFrame([], schemas.SOURCES), store, types, model, now(), None, "scheduled", limit, fn, schema_text)
