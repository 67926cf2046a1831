"""Scans of folder trees that stop in time and say what they left out.

A scan goes down by levels. The folders of a level are dealt to tasks, which list them through
the file system of their URI; what they find is the next level. A task gives up a folder after
a time of its own, no folder is begun after the deadline, and every stop is one row that says
where and why. Contents are read only of the files that are left in the end.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TimedOut
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

#: Names that scans pass over by default; a pattern with ``*.`` is an ending.
IGNORED = (".DS_Store", "Thumbs.db", "desktop.ini", "*.tmp", "*.temp", "node_modules", ".git", "__pycache__", ".cache")
FOUND = "kind string, path string, length long, modified timestamp, reason string, message string"


@dataclass(frozen=True)
class Entry:
    """One entry of a folder."""

    path: str
    folder: bool
    length: int | None = None
    modified: float | None = None


def with_scheme(path: str) -> str:
    """Spark writes ``file:/x``; a path without a scheme is local."""
    path = re.sub(r"^file:/+", "/", path)
    return f"file://{path}" if path.startswith("/") else path


def list_folder(path: str) -> list[Entry]:
    """A folder's entries without symbolic links, by the file system of its URI."""
    fs, inner = pafs.FileSystem.from_uri(with_scheme(path))
    local = isinstance(fs, pafs.LocalFileSystem)
    out = []
    for x in fs.get_file_info(pafs.FileSelector(inner, recursive=False)):
        if local and os.path.islink(x.path):
            continue
        folder = x.type == pafs.FileType.Directory
        at = x.path if local else f"{path.rstrip('/')}/{x.base_name}"
        out.append(Entry(at, folder, None if folder else x.size, x.mtime_ns / 1e9 if x.mtime_ns else None))
    return out


def ignored(name: str, patterns: tuple[str, ...]) -> bool:
    return any(name.endswith(p[1:]) if p.startswith("*.") else name == p for p in patterns)


@dataclass(frozen=True)
class Scan:
    """What a scan found: ``files`` (path, length, modified), ``folders`` (path) and ``stops`` (path, reason, message).

    Reasons are ``deadline``, ``timeout``, ``maxDepth``, ``maxFiles`` and ``error``; without a stop the scan is whole.
    """

    files: DataFrame
    folders: DataFrame
    stops: DataFrame

    @property
    def partial(self) -> bool:
        return not self.stops.isEmpty()


def scan_tree(spark: SparkSession, folder: str, *, ignore: tuple[str, ...] = IGNORED, max_depth: int | None = None, max_files: int | None = None, deadline_s: float = 60.0, folder_timeout_s: float = 5.0, lister: Callable[[str], list[Entry]] = list_folder, folders_a_task: int = 64) -> Scan:
    """Files below ``folder``: those of upper levels first, and of a level those that are first by path.

    ``max_depth`` 0 is the folder alone. A folder that takes longer than ``folder_timeout_s`` or
    cannot be read is left out, and so is what has not begun ``deadline_s`` after the start; all
    else is there. The loop is one round a level, whatever the number of folders.
    """
    deadline = time.time() + deadline_s

    def list_some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(max_workers=1)
        for batch in batches:
            rows: list[tuple] = []
            for path in batch["path"]:
                if time.time() > deadline:
                    rows.append(("stop", path, None, None, "deadline", None))
                    continue
                try:
                    for e in pool.submit(lister, path).result(timeout=folder_timeout_s):
                        if not ignored(e.path.rstrip("/").rsplit("/", 1)[-1], ignore):
                            at = None if e.modified is None else pd.Timestamp(e.modified, unit="s").floor("us")
                            rows.append(("folder" if e.folder else "file", e.path, e.length, at, None, None))
                except (TimedOut, TimeoutError):
                    rows.append(("stop", path, None, None, "timeout", f"no answer in {folder_timeout_s} s"))
                    pool = ThreadPoolExecutor(max_workers=1)  # the old thread still waits for its answer
                except OSError as e:
                    rows.append(("stop", path, None, None, "error", str(e)[:500]))
            out = pd.DataFrame(rows, columns=["kind", "path", "length", "modified", "reason", "message"])
            yield out.astype({"length": "Int64", "modified": "datetime64[us]"})
        pool.shutdown(wait=False)

    level = spark.createDataFrame([(folder,)], "path string")
    found, depth, files_left, n = None, 0, max_files, 1
    stop = lambda df, reason: df.select(F.lit("stop").alias("kind"), "path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("message"))
    while n:
        rows = cut_lineage(level.repartition(max(1, -(-n // folders_a_task))).mapInPandas(list_some, FOUND))
        below = rows.where("kind = 'folder'").select("path")
        counts = rows.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "folder").alias("folders")).first()
        if files_left is not None and counts["files"] > files_left:
            kept = rows.where("kind = 'file'").orderBy("path").limit(files_left)
            rows = kept.unionByName(rows.where("kind <> 'file'")).unionByName(stop(spark.createDataFrame([(folder,)], "path string"), "maxFiles"))
        found = rows if found is None else found.unionByName(rows)
        n = counts["folders"]
        if files_left is not None and (files_left := files_left - counts["files"]) < 0:
            break
        if n and max_depth is not None and depth >= max_depth:
            found = found.unionByName(stop(below, "maxDepth"))
            break
        level, depth = below, depth + 1
    found = cut_lineage(found)
    of = lambda kind, *columns: found.where(F.col("kind") == kind).select(*columns)
    return Scan(of("file", "path", "length", "modified"), of("folder", "path"), of("stop", "path", "reason", "message"))


def with_contents(files: DataFrame, *, path_col: str = "path") -> DataFrame:
    """``files`` with their ``content``, read in tasks, one file at a time; null for a file that has gone or cannot be read."""

    def read(path: str | None) -> bytes | None:
        if path is None:
            return None
        try:
            fs, inner = pafs.FileSystem.from_uri(with_scheme(path))
            with fs.open_input_stream(inner) as stream:
                return stream.read()
        except OSError:
            return None

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.iloc[k : k + 1]
                yield one.assign(content=[read(one[path_col].iloc[0])])

    rows = files.drop("content")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(fill, f"{schema}, content binary")
