"""Folders of files as tables.

Spark's own file index hides names that start with ``_`` or ``.`` and follows
links, so folders are listed by tasks: mounted ones directly, URIs through the client of their file system.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import written

LISTED = "source_dir string, source_path string, size long, mtime timestamp, error string"


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as a frame; ``mtime``, whole microseconds or None, becomes a column of times at once and not file by file."""
    frame = pd.DataFrame(rows, columns=columns)
    return frame.assign(mtime=frame["mtime"].astype("Int64").astype("datetime64[us]") if frame["mtime"].isna().any() else frame["mtime"].to_numpy("int64").view("datetime64[us]"))


def _local(folder: str) -> str | None:
    """The mounted path of a folder, or None where only a file system client reaches it."""
    if "://" not in folder and not folder.startswith("file:"):
        return folder
    return "/" + folder.split(":", 1)[1].lstrip("/") if folder.startswith("file:") else None


def _remote(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _children(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """``(name, is_folder, size, mtime in microseconds)`` of what lies directly in a folder, links left out, names of any form."""
    mounted = _local(folder)
    if mounted is not None:
        with os.scandir(mounted) as entries:
            for e in entries:
                if e.is_symlink():
                    continue
                stat = e.stat(follow_symlinks=False)
                yield e.name, e.is_dir(follow_symlinks=False), stat.st_size, stat.st_mtime_ns // 1000
        return
    from pyarrow import fs

    client, path = _remote(folder)
    if client.get_file_info(path).type == fs.FileType.NotFound:
        raise FileNotFoundError(2, "No such file or directory", folder)
    for info in client.get_file_info(fs.FileSelector(path)):
        yield info.base_name, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1000


def _reader(path: str):
    """An open stream over a file of a mounted or a remote folder."""
    mounted = _local(path)
    if mounted is not None:
        return open(mounted, "rb")
    client, name = _remote(path)
    return client.open_input_stream(name)


def scan_sources(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Plain files directly in each folder; one error row per unreadable folder.

    ``source_dir, source_path, size, mtime, error``.  A folder named twice is
    listed once; each is listed by its own task, be it mounted or a URI.
    """
    distinct = list(dict.fromkeys(f.rstrip("/") or "/" for f in folders))
    columns = ["source_dir", "source_path", "size", "mtime", "error"]

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for folder in frame["source_dir"]:
                rows = []
                try:
                    for name, is_dir, size, mtime in _children(folder):
                        if is_dir:
                            continue
                        rows.append((folder, f"{folder.rstrip('/')}/{name}", size, mtime, None))
                        if len(rows) == 10_000:
                            yield _frame(rows, columns)
                            rows = []
                except OSError as exc:
                    kind = "missing" if isinstance(exc, FileNotFoundError) else "error"
                    rows.append((folder, None, None, None, f"{kind}: {exc.strerror}"))
                yield _frame(rows, columns)

    if not distinct:
        return spark.createDataFrame([], LISTED)
    return spark.createDataFrame([(f,) for f in distinct], "source_dir string").repartition(len(distinct)).mapInPandas(listing, LISTED)


def folder_states(listing: DataFrame) -> DataFrame:
    """``(source_dir, state)``: ok, missing or error."""
    worst = F.max(F.when(F.col("error").startswith("missing"), 1).when(F.col("error").isNotNull(), 2).otherwise(0))
    return listing.groupBy("source_dir").agg(worst.alias("w")).select(
        "source_dir", F.when(F.col("w") == 0, "ok").when(F.col("w") == 1, "missing").otherwise("error").alias("state"))


def with_content(rows: DataFrame, path: str = "source_path") -> DataFrame:
    """Read the files of ``rows`` on the executors; ``content`` is null if gone.

    Call it after the gates, so that only wanted files are opened.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    names = [f.name for f in schema.fields]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for i in range(len(frame)):  # one file per batch: files may be large
                part = frame.iloc[[i]].copy()
                try:
                    with _reader(part[path].iloc[0]) as f:
                        data = f.read()
                except OSError:
                    data = None
                part["content"] = pd.Series([data], index=part.index, dtype=object)
                yield part[names]

    return rows.mapInPandas(read, schema)


def with_hash(rows: DataFrame, path: str = "source_path", chunk: int = 1 << 20) -> DataFrame:
    """Add ``content_hash``, read ``chunk`` bytes at a time: no task holds a whole file.  Null if the file is gone."""
    schema = T.StructType([*rows.schema.fields, T.StructField("content_hash", T.StringType())])

    def digest(name: str) -> str | None:
        running = hashlib.sha256()
        try:
            with _reader(name) as f:
                while part := f.read(chunk):
                    running.update(part)
        except OSError:
            return None
        return running.hexdigest()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(content_hash=pd.Series([digest(p) for p in frame[path]], index=frame.index, dtype=object))[[f.name for f in schema.fields]]

    return rows.mapInPandas(hashed, schema)


def scan_pages(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Markdown files below ``root`` as ``path, size, mtime`` (paths are relative).

    Folders are listed level by level: those found on one level are dealt to all tasks on the
    next, so a deep or lopsided tree is no task's own.  Excluded folders are not entered.
    """
    hidden = [e.rstrip("/") for e in exclude]

    def kept(rel: str) -> bool:
        return not any(rel == h or rel.startswith(h + "/") for h in hidden)

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for here in frame["folder"]:
                rows = []
                for name, is_dir, size, mtime in _children(f"{root.rstrip('/')}/{here}" if here else root):
                    rel = f"{here}/{name}" if here else name
                    if kept(rel) and (is_dir or name.lower().endswith(".md")):
                        rows.append((rel, is_dir, size, mtime))
                    if len(rows) == 10_000:
                        yield _frame(rows, ["path", "is_dir", "size", "mtime"])
                        rows = []
                yield _frame(rows, ["path", "is_dir", "size", "mtime"])

    frontier, n, files, depth = spark.createDataFrame([("",)], "folder string"), 1, None, 0
    while n:
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        listed = written(frontier.repartition(tasks).mapInPandas(level, "path string, is_dir boolean, size long, mtime timestamp"), f"level-{depth}")
        found = listed.where(~F.col("is_dir")).select("path", "size", "mtime")
        files = found if files is None else files.unionByName(found)
        frontier, depth = listed.where("is_dir").select(F.col("path").alias("folder")), depth + 1
        n = frontier.count()
    return files


def write_pages(pages: DataFrame, root: str) -> None:
    """Each page as a file below ``root``, written by tasks."""
    made: set[str] = set()  # folders, by a worker

    def put(target: str, data: bytes) -> None:
        mounted = _local(target)
        if mounted is None:
            client, name = _remote(target)
            client.create_dir(os.path.dirname(name), recursive=True)
            with client.open_output_stream(name) as f:
                f.write(data)
            return
        if (folder := os.path.dirname(mounted)) not in made:
            os.makedirs(folder, exist_ok=True)
            made.add(folder)
        draft = f"{mounted}.{os.getpid()}.tmp"
        with open(draft, "wb") as f:
            f.write(data)
        os.replace(draft, mounted)  # a repeated task leaves one whole file

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                put(f"{root.rstrip('/')}/{path}", content.encode("utf-8"))
            yield pd.DataFrame({"n": [len(frame)]})

    pages.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The link graph as two JSON-lines datasets."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")
