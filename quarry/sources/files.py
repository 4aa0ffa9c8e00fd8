"""Small files and folders on whatever file system Spark reads: local disks, HDFS, object stores."""

from __future__ import annotations

import hashlib
import re
import tempfile
import time

from pyspark.sql import SparkSession

from ..errors import QueryError


_PLACES: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a temporary one only where none is set and all runs on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise QueryError("invalid_request", "set spark.checkpoint.dir to a folder that driver and executors share")
        place = _PLACES.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quarry-"))
    return f"{place.rstrip('/')}/quarry-{spark.sparkContext.applicationId}"


class Files:
    """Paths are strings, with or without a scheme; without one they are on Spark's default file system."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing if there is none."""
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def changed(self, path: str) -> float:
        """The time of the last change, in seconds."""
        fs, where = self._at(path)
        return fs.getFileStatus(where).getModificationTime() / 1000

    def read(self, path: str) -> str | None:
        """A text file's content; none if it isn't there."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str | bytes, overwrite: bool = False) -> bool:
        """Writes a new file; without ``overwrite`` false if there is one, which is decided by the file system: of several writers one makes it."""
        fs, where = self._at(path)
        try:
            if not overwrite and fs.getUri().getScheme() == "file":  # Hadoop's local files are looked for and then made, which two can do
                fs.mkdirs(where.getParent())
                self._jvm.java.nio.file.Files.createFile(self._jvm.java.io.File(where.toUri().getPath()).toPath(), self._gateway.new_array(self._jvm.java.nio.file.attribute.FileAttribute, 0))
                overwrite = True
            stream = fs.create(where, overwrite)
        except Exception:  # noqa: BLE001  what it is called differs by file system
            if fs.exists(where):
                return False
            raise
        try:
            stream.write(text.encode() if isinstance(text, str) else text)
        finally:
            stream.close()
        return True

    def listing(self, path: str) -> str:
        """A digest of the names and lengths of a folder's files, at any depth; those that begin with a dot or underscore are left out, as Spark does."""
        fs, where = self._at(path)
        found, digest = [], hashlib.sha256()
        if fs.exists(where):
            base, files = fs.makeQualified(where).toString(), fs.listFiles(where, True)
            while files.hasNext():
                status = files.next()
                name = status.getPath().toString()[len(base) :]
                if not re.search(r"/[._]", name):
                    found.append(f"{name} {status.getLen()}\n")
        for line in sorted(found):
            digest.update(line.encode())
        return digest.hexdigest()

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def claim(self, folder: str, stale: float) -> int | None:
        """A token for the sole use of a folder, larger than all before; none while another holds one that is neither released nor older than ``stale`` seconds.

        Tokens are files that only one can create. Who holds the largest one goes on; one whose claim was taken over finds that out by ``holds``.
        """
        last = max((int(n) for n in self.names(f"{folder}/claims") if n.isdigit()), default=0)
        if self.claimed(folder, stale):
            return None
        return last + 1 if self.create(f"{folder}/claims/{last + 1:012d}", "") else None

    def release(self, folder: str, token: int) -> None:
        self.create(f"{folder}/claims/{token:012d}.released", "", overwrite=True)

    def holds(self, folder: str, token: int) -> bool:
        """Whether no later token than this one has been given."""
        return max((int(n) for n in self.names(f"{folder}/claims") if n.isdigit()), default=0) == token

    def claimed(self, folder: str, stale: float) -> bool:
        """Whether somebody is at work in a folder."""
        names = self.names(f"{folder}/claims")
        last = max((int(n) for n in names if n.isdigit()), default=0)
        return bool(last) and f"{last:012d}.released" not in names and time.time() - self.changed(f"{folder}/claims/{last:012d}") <= stale
