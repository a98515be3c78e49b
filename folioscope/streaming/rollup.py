"""Rolling summary of a stream of indexed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.changes import latest_per_key

ROWS = "kind string, window_start timestamp, n long, batch_id long"


def windowed_counts(stream: DataFrame, time: str, kind: str, window: str = "7 days", late: str | None = None) -> DataFrame:
    """Rows per kind and window.

    However late a row is, it counts: the state holds a number for each kind and window.  To
    bound the state by time as well, ``late`` says how far behind the newest row may be; older rows are left out.
    """
    timed = stream.withWatermark(time, late) if late else stream
    return (
        timed.groupBy(F.window(time, window).alias("w"), F.col(kind).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("kind", F.col("w.start").alias("window_start"), "n"))


def run_rollup(
    spark: SparkSession, stream: DataFrame, time: str, kind: str, out: str, checkpoint: str, window: str = "7 days",
    late: str | None = None,
) -> DataFrame:
    """Drain ``stream`` into ``out`` and return the current count of each window.

    Each batch writes only the windows it changed, in a folder of its own that
    a replay overwrites; the newest row of a window is its count.
    """
    def save(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        windowed_counts(stream, time, kind, window, late).writeStream.outputMode("update")
        .foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema(ROWS).parquet(f"{out}/batch=*")
    return latest_per_key(rows, ["kind", "window_start"], "batch_id").drop("batch_id")


def run_member_rollup(
    spark: SparkSession, stream: DataFrame, time: str, kind: str, member: str, out: str, checkpoint: str, delay: str = "7 days",
    window: str = "7 days",
) -> tuple[DataFrame, DataFrame]:
    """Drain ``stream``; ``(members, late)``, both ``kind, window_start, member, time``: what each window holds, and what came too late for it.

    A window is closed once a row has been seen in an earlier batch that is ``delay`` past its end; rows for closed windows
    are late and kept in a table of their own, so on-time and late rows together are all rows.  Batches append and a replay overwrites
    its own folder.  No state grows with the stream: what a batch needs to know of those before it is one time each.
    """
    def save(df: DataFrame, batch_id: int) -> None:
        rows = df.select(F.col(kind).alias("kind"), F.window(time, window).alias("_w"), F.col(member).alias("member"), F.col(time).alias("time"))
        horizon = _seen(spark, out, batch_id).agg(F.max("newest").alias("newest")).select((F.col("newest") - F.expr(f"INTERVAL {delay}")).alias("horizon"))
        # one row
        closed = rows.crossJoin(F.broadcast(horizon)).withColumn("late", F.coalesce(F.col("_w.end") <= F.col("horizon"), F.lit(False)))
        closed.select("kind", F.col("_w.start").alias("window_start"), "member", "time", "late").write.mode("overwrite").partitionBy("late").parquet(f"{out}/rows/batch={batch_id}")
        df.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    kinds = dict(stream.dtypes)
    schema = f"kind {kinds[kind]}, window_start timestamp, member {kinds[member]}, time timestamp, batch int, late boolean"
    rows = spark.read.schema(schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch=*")
    columns = ["kind", "window_start", "member", "time"]
    return rows.where(~F.col("late")).select(*columns), rows.where("late").select(*columns)


def _seen(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """The newest time of each batch before ``batch_id``."""
    schema = "newest timestamp, batch int"
    if not batch_id:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{out}/seen").parquet(f"{out}/seen/batch=*").where(F.col("batch") < batch_id)
