"""Small files and folders on whatever file system Spark uses: local, HDFS, object stores."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Tree:
    """Paths are strings; one without a scheme is of Spark's default file system."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str, folders: bool = True) -> list[str]:
        """The folders (or all entries) in a folder, by name."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() or not folders) if fs.exists(p) else []

    def files(self, path: str) -> list[str]:
        """Every file below a folder, as paths relative to it."""
        fs, p = self._at(path)
        out, it, base = [], fs.listFiles(p, True), fs.makeQualified(p).toString().rstrip("/") + "/"
        while it.hasNext():
            out.append(it.next().getPath().toString().removeprefix(base))
        return sorted(out)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces a small file whole: readers see the old one or the new one."""
        fs, p = self._at(path)
        part = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(part, True)
        try:
            self.jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
        finally:
            stream.close()
        over = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        part, p = fs.makeQualified(part), fs.makeQualified(p)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(part, p, over)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, path: str, to: str) -> None:
        """Moves a folder or file to a name that is free."""
        fs, p = self._at(path)
        if fs.exists(self._at(to)[1]) or not fs.rename(p, self._at(to)[1]):
            raise OSError(f"can't move {path} to {to}")

    def fetch(self, path: str, local: str) -> None:
        fs, p = self._at(path)
        fs.copyToLocalFile(False, p, self.jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True)

    def put(self, local: str, path: str) -> None:
        fs, p = self._at(path)
        fs.copyFromLocalFile(False, True, self.jvm.org.apache.hadoop.fs.Path(f"file://{local}"), p)
