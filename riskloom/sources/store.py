"""Paths on any file system that Spark reads: local, HDFS or an object store.

Small files (JSON, Markdown, figures) are read and written by the driver; tables are written
and hashed by executors (artifacts). Nothing here opens a local file of its own.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

from riskloom.errors import fail


class Place:
    """A file or folder. A path without a scheme lies in Hadoop's default file system."""

    def __init__(self, path: Any, spark: SparkSession | None = None) -> None:
        self.spark = spark or SparkSession.active()
        self._jvm = self.spark.sparkContext._jvm
        raw = self._jvm.org.apache.hadoop.fs.Path(str(path))
        self._fs = raw.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self._path = self._fs.makeQualified(raw)

    @property
    def uri(self) -> str:
        return self._path.toString()

    @property
    def name(self) -> str:
        return self._path.getName()

    @property
    def parent(self) -> Place:
        return Place(self._path.getParent().toString(), self.spark)

    def __truediv__(self, name: str) -> Place:
        return Place(f"{self.uri.rstrip('/')}/{name}", self.spark)

    def __str__(self) -> str:
        return self._path.toUri().getPath() if self.uri.startswith("file:") else self.uri

    def __fspath__(self) -> str:
        return os.fspath(str(self))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Place) and other.uri == self.uri

    def __hash__(self) -> int:
        return hash(self.uri)

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def is_file(self) -> bool:
        return self.exists() and self._fs.getFileStatus(self._path).isFile()

    def is_dir(self) -> bool:
        return self.exists() and self._fs.getFileStatus(self._path).isDirectory()

    def size(self) -> int:
        return self._fs.getFileStatus(self._path).getLen()

    def children(self) -> list[Place]:
        """What lies in the folder, by name."""
        return sorted((Place(s.getPath().toString(), self.spark) for s in self._fs.listStatus(self._path)), key=lambda p: p.name)

    def mkdirs(self) -> Place:
        self._fs.mkdirs(self._path)
        return self

    def hidden_sibling(self) -> Place:
        """A name beside this one that no reader takes for data, new at each call."""
        return self.parent / f".{self.name}-{uuid.uuid4().hex}"

    def moved_to(self, other: Place) -> None:
        """One rename; what is there already is never replaced."""
        if other.exists() or not self._fs.rename(self._path, other._path):
            raise fail("OUTPUT_COLLISION", f"{other.name} exists already.")

    def delete(self) -> None:
        self._fs.delete(self._path, True)

    def read_bytes(self) -> bytes:
        stream = self._fs.open(self._path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_text(self) -> str:
        return self.read_bytes().decode("utf-8")

    def first_line(self) -> str:
        stream = self._fs.open(self._path)
        try:
            charset = self._jvm.java.nio.charset.StandardCharsets.UTF_8
            return self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, charset)).readLine() or ""
        finally:
            stream.close()

    def write_bytes(self, value: bytes) -> None:
        stream = self._fs.create(self._path, False)
        try:
            stream.write(bytearray(value))
        finally:
            stream.close()

    def write_text(self, value: str) -> None:
        self.write_bytes(value.encode("utf-8"))

    def write_json(self, value: Any, replace: bool = False) -> None:
        """With `replace`, a file that is there gives way in one step."""
        target = self.hidden_sibling() if replace else self
        target.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n")
        if replace:
            kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
            how = self.spark.sparkContext._gateway.new_array(kinds, 1)
            how[0] = kinds.OVERWRITE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path.toUri()).rename(target._path, self._path, how)

    def sha256(self) -> str:
        """Of one file, read as a stream."""
        stream = self._fs.open(self._path)
        try:
            return self._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()


def place_of(path: Any, spark: SparkSession | None = None) -> Place:
    return path if isinstance(path, Place) else Place(path, spark)


def load_json(path: Place, code: str) -> dict[str, Any]:
    """The JSON object in a file; any fault has the given code."""
    try:
        raw = json.loads(path.read_text())
    except (Py4JError, UnicodeDecodeError, json.JSONDecodeError) as e:
        raise fail(code, f"{path.name} can't be read: {e}") from e
    if not isinstance(raw, dict):
        raise fail(code, f"{path.name} must hold a JSON object.")
    return raw
