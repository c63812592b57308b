"""Blobs by their content: a file for each, named by its sha256, on any file system that Spark opens."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldwright.operators import identity


class Corrupt(ValueError):
    """A blob's bytes are not what its name says."""


class Store:
    """put, get and has of single blobs, for the driver; a pool over max_bytes (0: no bound) loses its oldest.

    Names that aren't 64 lower-case hexadecimal digits are never made into a path: they are absent. Tables are not
    for this store: Spark writes those itself.
    """

    def __init__(self, spark: SparkSession, root: str, max_bytes: int = 0, now: Callable[[], float] = time.time):
        self.spark, self.root, self.max_bytes, self.now = spark, root.rstrip("/"), max_bytes, now
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _of(self, name: str):
        return self._path(f"{self.root}/{name[:2]}/{name}") if re.fullmatch("[0-9a-f]{64}", name) else None

    def put(self, blob: bytes) -> str:
        """The blob's name. What is there already is only kept if it is whole; else it is written anew."""
        name = hashlib.sha256(blob).hexdigest()
        p = self._of(name)
        if not self._fs.exists(p) or self._bytes(p) != blob:
            part = self._path(f"{self.root}/{name[:2]}/.{uuid.uuid4().hex}")  # renamed when whole, so that nobody reads a part
            out = self._fs.create(part, True)
            out.write(bytearray(blob))
            out.close()
            self._fs.delete(p, False)
            if not self._fs.rename(part, p) and not self._fs.exists(p):
                raise OSError(f"{p} could not be written")
        self._touch(p)
        self._evict(name)
        return name

    def get(self, name: str) -> bytes:
        p = self._of(name)
        if p is None or not self._fs.exists(p):
            raise KeyError(name)
        blob = self._bytes(p)
        if hashlib.sha256(blob).hexdigest() != name:
            raise Corrupt(name)
        self._touch(p)
        return blob

    def has(self, name: str) -> bool:
        p = self._of(name)
        return p is not None and self._fs.exists(p)

    def index(self) -> DataFrame:
        """hash, size, mtime of all blobs, from their files' names and times; no bytes are read."""
        found = [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for d in self._list(self._path(self.root)) if d.isDirectory() for f in self._list(d.getPath()) if not f.getPath().getName().startswith(".")]
        return self.spark.createDataFrame(found, "hash string, size long, mtime long")

    def _list(self, p) -> list:
        return list(self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _bytes(self, p) -> bytes:
        src = self._fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(src))
        finally:
            src.close()

    def _touch(self, p) -> None:
        self._fs.setTimes(p, int(self.now() * 1000), -1)

    def _evict(self, keep: str) -> None:
        if self.max_bytes > 0:
            for r in identity.evicted(self.index(), self.max_bytes, [keep]).collect():  # the blobs to delete, a name each
                self._fs.delete(self._of(r.hash), False)
