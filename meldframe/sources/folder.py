"""Folders on any file system that Spark reaches, by Hadoop's FileSystem in the driver's JVM: the same place for driver and executors."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, str(path).rstrip("/")

    def at(self, name: str = "") -> str:
        return f"{self.path}/{name}" if name else self.path

    def sub(self, name: str) -> Folder:
        return Folder(self.spark, self.at(name))

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name))
        return path.getFileSystem(self._conf()), path

    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def exists(self, name: str = "") -> bool:
        fs, path = self._place(name)
        return fs.exists(path)

    def names(self, name: str = "") -> list[str]:
        """What lies directly in a folder, by name; nothing if there is no such folder."""
        fs, path = self._place(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def files(self, name: str = "") -> list[str]:
        """All files below, as paths within this folder."""
        fs, path = self._place(name)
        if not fs.exists(path):
            return []
        root, found, out = self._place("")[0].makeQualified(self._place("")[1]).toString(), fs.listFiles(path, True), []
        while found.hasNext():
            out.append(found.next().getPath().toString()[len(root) + 1 :])
        return sorted(out)

    def make(self, name: str = "") -> None:
        fs, path = self._place(name)
        fs.mkdirs(path)

    def read_text(self, name: str) -> str:
        fs, path = self._place(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Replaces a file in one step: until then readers see the one before."""
        part = f"{name}.{uuid.uuid4().hex}"
        fs, path = self._place(part)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.move(part, name, True)

    def move(self, name: str, to: str, replace: bool = False) -> None:
        """Renames a file or folder within the folder in one step."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        (_, old), (_, new) = self._place(name), self._place(to)
        kind = getattr(hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        context = hadoop.FileContext.getFileContext(old.toUri(), self._conf())
        context.rename(context.makeQualified(old), context.makeQualified(new), how)

    def take(self, local: str, name: str) -> int:
        """Copies a file of the driver's machine into the folder; gives its size."""
        fs, path = self._place(name)
        fs.mkdirs(path.getParent())
        fs.copyFromLocalFile(False, True, self.spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}" if local.startswith("/") else local), path)
        return fs.getFileStatus(path).getLen()

    def remove(self, name: str = "") -> None:
        fs, path = self._place(name)
        fs.delete(path, True)

    def copy_files(self, name: str, to: Folder, at_once: int = 8) -> None:
        """Copies all files below a folder, some at a time, as streams between file systems."""

        def one(file: str) -> None:
            (fs, path), (fs2, path2) = self._place(file), to._place(file)
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, fs2, path2, False, True, self._conf())

        files = self.files(name)
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(one, files))


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; under /tmp if that is unset and all runs on this machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{at or '/tmp/checkpoints'}/meldframe/query-{uuid.uuid4().hex}"
