"""Cheap checks a source file passes before its content is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import paths as pt

# fixed values: settle window, size cap and attempts
SETTLE_SECONDS = 120
MAX_FILE_BYTES = 32 << 20
MAX_ATTEMPTS = 3


def allowed_types(spark, types: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(source_dir, types)``; a folder named twice counts once."""
    rows = [(d, [t.lower().lstrip(".") for t in ts]) for d, ts in types.items()]
    return spark.createDataFrame(rows, "source_dir string, types array<string>").dropDuplicates(["source_dir"])


def file_type(path: Column) -> Column:
    """Lower-case extension without its dot."""
    return F.lower(F.regexp_extract(pt.base_name(path), r"\.([^.]*)\z", 1))


def gate(sources: DataFrame, types: DataFrame, now: Column, max_bytes: int = MAX_FILE_BYTES,
         settle_seconds: int = SETTLE_SECONDS) -> DataFrame:
    """Add ``gate`` (``pass``, ``skipped``, ``deferred``) and its ``gate_error``.

    The order is type, size, age.  Only names, sizes and times are looked at.
    ``types`` has one row per configured folder and is read by a hash join.
    """
    known = sources.join(types, "source_dir", "left")
    wrong_type = ~F.coalesce(F.array_contains("types", file_type(F.col("source_path"))), F.lit(False))
    too_big = F.col("size") > max_bytes
    unsettled = (F.unix_micros(now) - F.unix_micros("mtime")) < settle_seconds * 1_000_000
    return known.withColumns({
        "gate": F.when(wrong_type | too_big, "skipped").when(unsettled, "deferred").otherwise("pass"),
        "gate_error": F.when(wrong_type, "type not allowed").when(too_big, "exceeds max file size")
        .when(unsettled, "within settle window").otherwise(""),
    }).drop("types")
