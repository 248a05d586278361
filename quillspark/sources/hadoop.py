"""Files through Hadoop's file systems, so that local and shared storage are the same to the library."""

from __future__ import annotations

from pyspark.sql import SparkSession


class FileSystem:
    """The file system that a path names, its scheme or the default one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def is_dir(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self._path(path)).isDirectory()

    def make_dir(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        """Names within a directory, sorted; none if it doesn't exist."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def files(self, pattern: str) -> list[str]:
        """All files under the paths that a glob pattern matches, sorted, as they were named (with a scheme if the pattern has one)."""
        out = []
        for s in self._fs.globStatus(self._path(pattern)) or ():
            if s.isFile():
                out.append(s.getPath())
            else:
                each = self._fs.listFiles(s.getPath(), True)
                while each.hasNext():
                    out.append(each.next().getPath())
        plain = "://" not in pattern and not pattern.startswith("file:")
        return sorted(p.toUri().getPath() if plain and p.toUri().getScheme() in (None, "file") else p.toString() for p in out)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new file; it is an error if it exists, so that of two writers only one succeeds."""
        stream = self._fs.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
