"""Files that columns refer to: paths inside a database's folder, imports, and reading through Spark."""

from __future__ import annotations

import hashlib
import os
import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folder import Folder


def checked_path(path: str) -> str:
    """The path in canonical form; ValueError if it is empty, absolute, leads out of the folder or has a colon."""
    p = path.strip().replace("\\", "/")
    if not p or p.startswith("/") or ":" in p:
        raise ValueError(f"bad path {path!r}")
    p = posixpath.normpath(p)
    if p in (".", "..") or p.startswith("../"):
        raise ValueError(f"bad path {path!r}")
    return p


def is_bad_path(c: Column) -> Column:
    p = F.replace(F.trim(c), F.lit("\\"), F.lit("/"))
    depth = F.aggregate(
        F.split(p, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda a, x: F.struct((a["at"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(x == "..", -1).otherwise(0)).alias("low")),
    )
    return (p == "") | p.startswith("/") | p.contains(":") | (depth["low"] < 0) | (depth["at"] <= 0)


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """path (within the folder), content, size and hash of all its files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(f"{folder.rstrip('/')}/")
    path = F.substring(F.col("path"), F.instr("path", root) + F.length(root), F.length("path"))
    return files.select(path.alias("path"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def read_at(files: DataFrame, offset: int, length: int) -> DataFrame:
    """path and the bytes from offset, at most length of them, of files with so many; ValueError for a negative offset or no length."""
    if offset < 0 or length <= 0:
        raise ValueError("offset must be 0 or more and length above 0")
    return files.where(F.col("size") > offset).select("path", F.substring("content", offset + 1, length).alias("bytes"))


class Import:
    """A file of the driver's machine on its way into a folder: staged and hashed, then promoted, or undone."""

    def __init__(self, folder: Folder, local: str, relative: str) -> None:
        self.folder, self.path = folder, checked_path(relative)
        self.staged, self.old = (f".staged/{uuid.uuid4().hex}{end}" for end in ("", ".old"))
        with open(local, "rb") as f:
            self.hash = hashlib.file_digest(f, "sha256").hexdigest()
        self.size = folder.take(os.path.abspath(local), self.staged)

    def promote(self) -> Callable[[], None]:
        """Puts the file in place; the result puts back what was there."""
        if self.folder.exists(self.path):
            self.folder.move(self.path, self.old)
        else:
            self.folder.make(posixpath.dirname(self.path))
        self.folder.move(self.staged, self.path)
        return self.undo

    def undo(self) -> None:
        if self.folder.exists(self.old):
            self.folder.move(self.old, self.path, True)
        else:
            self.folder.remove(self.path)

    def forget(self) -> None:
        """Deletes what was there before, once the import is committed."""
        self.folder.remove(self.old)
