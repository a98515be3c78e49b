"""Tables that runs append to: plain Parquet by run id, the newest row of a key stands.

A run writes its rows under ``<table>/run=N`` and then one marker ``finished/N``.  Readers take the
runs that have a marker, so the tables of a run appear together.  A run that was lost leaves folders
without a marker; the next one has the same number and writes them anew.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.changes import last_changes


class RunStore:
    """``tables`` maps a name to ``(schema, key columns, mark)``; rows whose boolean ``mark`` is true take their key away."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[T.StructType, list[str], str | None]]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def runs(self) -> list[int]:
        """Numbers of the finished runs."""
        fs, folder = self._path("finished")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())

    def info(self) -> dict:
        """What the last finished run noted."""
        done = self.runs()
        return json.loads(self.spark.read.text(f"{self.root}/finished/{done[-1]}", wholetext=True).first()[0]) if done else {}

    def rows(self, table: str, runs: list[int] | None = None) -> DataFrame:
        """All rows of finished runs (or of some of them), with ``run``."""
        schema = T.StructType([*self.tables[table][0].fields, T.StructField("run", T.IntegerType())])
        folders = [f"{self.root}/{table}/run={n}" for n in (self.runs() if runs is None else runs)]
        fs = self._path(table)[0]
        there = [f for f in folders if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f))]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*there)

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        """The newest row of each key; with ``keys`` (some key columns), of those only."""
        schema, by, mark = self.tables[table]
        rows = self.rows(table)
        if keys is not None:
            rows = rows.join(keys, keys.columns, "left_semi")
        newest = last_changes(rows, by, "run")
        return (newest.where(~F.col(mark)) if mark else newest).select(*[f.name for f in schema.fields if f.name != mark])

    def append(self, made: dict[str, DataFrame], info: dict | None = None) -> int:
        """One run: rows of each table (a key once at most), then the marker.  Fails if another writer has finished this run."""
        done = self.runs()
        number, noted = (done[-1] + 1 if done else 1), self.info()
        for table, rows in made.items():
            names = self.tables[table][0].fields
            rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in names]).write.mode("overwrite").parquet(f"{self.root}/{table}/run={number}")
        self.finish(number, {**noted, **(info or {})})
        return number

    def finish(self, number: int, info: dict) -> None:
        fs, path = self._path(f"finished/{number}")
        if fs.exists(path):
            raise RuntimeError(f"run {number} was finished by another writer")
        stream = fs.create(path, False)
        stream.write(bytearray(json.dumps(info).encode()))
        stream.close()
