"""Durable notes of a job, in whatever store its tables are in.

A note is a small JSON file that appears whole or not at all, and is never replaced: it is written aside and renamed, and
the rename fails if the name is taken. So notes can say which steps of a job are done, and the number in a note's
name can decide between two writers.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Journal:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self._store = Store(spark)
        self.path = path.rstrip("/")

    def put(self, name: str, value: object = None) -> bool:
        """Make a note; False if the name is taken."""
        aside = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        self._store.write(aside, json.dumps(value))
        if self._store.rename(aside, f"{self.path}/{name}"):
            return True
        self._store.delete(aside)
        return False

    def get(self, name: str) -> object:
        return json.loads(self._store.read(f"{self.path}/{name}"))

    def names(self) -> list[str]:
        """All notes by name."""
        return sorted(n for n in self._store.names(self.path) if not n.startswith("."))

    def drop(self, name: str) -> None:
        self._store.delete(f"{self.path}/{name}")


class Store:
    """File operations through the session's file systems."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        options = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        self._no_options = spark.sparkContext._gateway.new_array(options, 0)

    def _path(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self._conf)

    def of_uri(self, uri: str) -> str:
        """The path that a URI of Spark's file metadata names."""
        return self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(uri)).toString()

    def qualified(self, path: str) -> str:
        place, files = self._path(path)
        return files.makeQualified(place).toString()

    def write(self, path: str, text: str) -> None:
        place, files = self._path(path)
        files.mkdirs(place.getParent())
        out = files.create(place, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        place, files = self._path(path)
        source = files.open(place)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def exists(self, path: str) -> bool:
        place, files = self._path(path)
        return files.exists(place)

    def age(self, path: str) -> float:
        """Seconds since the last change, by this machine's clock."""
        place, files = self._path(path)
        return time.time() - files.getFileStatus(place).getModificationTime() / 1000

    def names(self, folder: str) -> list[str]:
        place, files = self._path(folder)
        return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []

    def files(self, folder: str) -> list[str]:
        """Data files anywhere below a folder, relative to it."""
        place, files = self._path(folder)
        if not files.exists(place):
            return []
        root, found, out = files.makeQualified(place).toString(), files.listFiles(place, True), []
        while found.hasNext():
            name = found.next().getPath().toString()
            if not name.rsplit("/", 1)[1].startswith(("_", ".")):
                out.append(name.removeprefix(root).lstrip("/"))
        return sorted(out)

    def rename(self, source: str, target: str) -> bool:
        """Move a file without replacing one; False if there is one, or the source is not there."""
        place, files = self._path(target)
        files.mkdirs(place.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf)
        try:
            context.rename(self._path(source)[0], place, self._no_options)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "FileNotFoundException"):
                return False
            raise
        return True

    def delete(self, path: str) -> bool:
        place, files = self._path(path)
        return files.delete(place, True)

    def drop_if_empty(self, folder: str) -> None:
        """Delete a folder that holds no visible files."""
        place, files = self._path(folder)
        if files.exists(place) and not any(not s.getPath().getName().startswith(".") for s in files.listStatus(place)):
            files.delete(place, True)
