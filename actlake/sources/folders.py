"""Folders of the shared file system: names, moves and removal, by the file system that Spark uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folders:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        at, files = self._at(path)
        return files.exists(at)

    def names(self, path: str) -> list[str]:
        """Names of what is in a folder, in order; none if there is no such folder."""
        at, files = self._at(path)
        return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []

    def move(self, old: str, new: str) -> None:
        """Renames; an error if that can't be done or the new name is taken."""
        (a, files), (b, _) = self._at(old), self._at(new)
        if files.exists(b) or not files.rename(a, b):
            raise OSError(f"{old} can't be moved to {new}")

    def remove(self, path: str) -> None:
        at, files = self._at(path)
        files.delete(at, True)

    def make(self, path: str) -> None:
        at, files = self._at(path)
        files.mkdirs(at)

    def put(self, path: str, text: str) -> None:
        """A small file that is there whole or not at all."""
        at, files = self._at(f"{path}.part")
        out = files.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.move(f"{path}.part", path)

    def copy(self, old: str, new: str) -> None:
        """Copies a file or folder; for small ones, as it goes through the driver."""
        (a, files), (b, _) = self._at(old), self._at(new)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(files, a, files, b, False, self.conf)
