"""Resolved links that are kept up: a change resolves again only the link texts it can touch.

A page can be found under two keys, its path and its folded file name; a link text looks for four, in order.
Stored per version, by the hash of what is looked up: which pages lie under a key (``pages``), which link texts look for a
key (``names``, the reverse map), and what each link text resolves to (``resolved``); and the links of each page (``refs``).
A change batch reads the buckets of the keys it touches, resolves the texts found there and those that are new, and appends a version.
The newest version of a key's row stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import paths as pt
from folioscope.operators.changes import latest_per_key
from folioscope.operators.rows import unnest
from folioscope.operators.skew import lookup_join
from folioscope.session import broadcast_if_small, written

BUCKETS = 64
SCHEMAS = {"pages": "key string, path string, type string, there boolean", "names": "key string, link string", "resolved": "link string, target string",
           "refs": "path string, links array<string>, there boolean"}


def page_keys(path: Column) -> Column:
    base = F.lower(F.regexp_replace(pt.base_name(path), r"\.md\z", ""))
    return F.array(F.concat(F.lit("p:"), path), F.concat(F.lit("b:"), base))


def link_keys(link: Column) -> Column:
    """The keys a link text looks for, in order: ``link.md``, ``sources/link.md``, ``link``, then the file name."""
    path = lambda p: F.concat(F.lit("p:"), p)
    return F.array(path(F.concat(link, F.lit(".md"))), path(pt.clean(F.concat(F.lit("sources/"), link, F.lit(".md")))), path(link), F.concat(F.lit("b:"), F.lower(link)))


class LinkIndex:
    """The kept links of a corpus, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def versions(self) -> list[int]:
        """Finished versions: those whose page links, which are written last, are complete."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/refs")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[8:]) for s in fs.listStatus(folder)
                      if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, of: DataFrame | None = None, key: str = "key") -> DataFrame:
        """Rows of all versions; with ``of`` (a stored column ``key``) only of the buckets its values are in."""
        schema = SCHEMAS[table] + ", version int" + ("" if table == "refs" else ", bucket int")
        folders = [f"{self.root}/{table}/version={v}" for v in self.versions()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*folders)
        if of is None:
            return rows
        # at most BUCKETS numbers
        buckets = [r[0] for r in of.select(self._bucket(key)).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets)).join(broadcast_if_small(of.select(key).distinct()), key, "left_semi")

    def _write(self, rows: DataFrame, table: str, version: int, by: str | None = "key") -> None:
        path = f"{self.root}/{table}/version={version}"
        if by is None:
            rows.write.mode("overwrite").parquet(path)
        else:
            rows.withColumn("bucket", self._bucket(by)).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)

    def apply(self, changes: DataFrame, version: int) -> None:
        """One batch: ``path, type, links`` and ``op`` (``upsert`` or ``delete``), a row a path at most; a finished version is skipped."""
        done = self.versions()
        if version in done:
            return
        if done and version < done[-1]:
            raise ValueError(f"version {version} is older than {done[-1]}")
        there = F.col("op") == "upsert"
        rows = written(changes.select("path", F.coalesce("type", F.lit("")).alias("type"), F.when(there, F.col("links")).alias("links"), there.alias("there")), "changed")
        keyed = written(unnest(rows, page_keys(F.col("path")), "key", "path", "type", "there").select("key", "path", "type", "there"), "keyed")
        texts = written(unnest(rows, "links", "link").distinct(), "texts")
        # texts no page had before look for keys of their own
        new = written(texts.join(self._read("resolved", texts, "link").select("link").distinct(), "link", "left_anti"), "new")
        names = unnest(new, link_keys(F.col("link")), "key", "link").select("key", "link").distinct()
        touched = self._read("names", keyed).select("link").unionByName(new.select("link")).distinct()
        asked = written(touched.select("link", F.posexplode(link_keys(F.col("link"))).alias("order", "key")), "asked")
        found = self._read("pages", asked).select("key", "path", "there", "version").unionByName(keyed.select("key", "path", "there", F.lit(version).alias("version")))
        now = latest_per_key(found, ["key", "path"], "version").where("there")
        first = now.groupBy("key").agg(F.min("path").alias("target"))
        best = asked.join(first, "key").groupBy("link").agg(F.min_by("target", "order").alias("target"))
        self._write(asked.select("link").distinct().join(best, "link", "left"), "resolved", version, "link")
        self._write(names, "names", version)
        self._write(keyed, "pages", version)
        self._write(rows.select("path", "links", "there"), "refs", version, None)

    def resolved(self) -> DataFrame:
        """``(link, target)`` of the link texts that name a page."""
        return latest_per_key(self._read("resolved").select("link", "target", "version"), ["link"], "version").where(F.col("target").isNotNull()).select("link", "target")

    def links(self) -> DataFrame:
        """``(path, link)`` of the pages there are."""
        rows = self._read("refs")
        newest = rows.groupBy("path").agg(F.max("version").alias("version"))
        return unnest(rows.where("there").join(newest, ["path", "version"], "left_semi"), "links", "link", "path")

    def pages(self) -> DataFrame:
        """``(path, type)`` of the pages there are."""
        rows = self._read("pages").where(F.col("key").startswith("p:"))
        return latest_per_key(rows.select("path", "type", "there", "version"), ["path"], "version").where("there").select("path", "type")

    def broken(self) -> DataFrame:
        links = self.links()
        return lookup_join(links, self.resolved(), "link", "left").where(F.col("target").isNull()).select("path", "link")

    def orphans(self) -> DataFrame:
        """Pages no link resolves to, but for the two special pages and sources.  Texts no page has any more do not count."""
        used = self.resolved().join(self.links().select("link").distinct(), "link", "left_semi").select(F.col("target").alias("path")).distinct()
        kept = self.pages().where(~F.col("path").isin(pt.SCHEMA_PAGE, pt.INDEX_PAGE) & (F.col("type") != "source"))
        return kept.select("path").join(used, "path", "left_anti")

    def edges(self) -> DataFrame:
        """One row per resolved link."""
        return lookup_join(self.links(), self.resolved(), "link").select(F.col("path").alias("source"), "target")
