"""A numbered commit log in a shared folder: whole files appear under a number that is still free, or not at all."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from chronodoc.session import hadoop


class CommitConflict(RuntimeError):
    """Another writer committed the same version first."""


@dataclass(frozen=True)
class Base:
    """What a writer read before it started: the newest version, its content, and the number it may commit."""

    version: int
    content: dict
    number: int


class CommitLog:
    """Versions 1, 2, ... of a table, each a small JSON file ``<path>/<version>.json``.

    A commit is written under a temporary name, closed, and only then given its number, by an operation that fails if the
    number is taken: a hard link where the folder is a local one, elsewhere a rename without overwrite (atomic on HDFS).
    A file under a number is therefore always whole, and of two writers that read the same version exactly one
    succeeds, at whatever point of the other's work. A file that is no JSON (damaged from outside) counts as
    absent; its number is not used again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs, self.dir = hadoop(spark, path)

    def versions(self) -> list[int]:
        if not self.fs.exists(self.dir):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.dir)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict | None:
        _, p = hadoop(self.spark, f"{self.path}/{version:012d}.json")
        jvm = self.spark.sparkContext._jvm
        stream = self.fs.open(p)
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def begin(self) -> Base:
        """The state a writer starts from; commit to ``number`` fails if anyone committed after this call."""
        numbers = self.versions()
        for v in reversed(numbers):
            content = self.read(v)
            if content is not None:
                return Base(v, content, numbers[-1] + 1)
        return Base(0, {}, max(numbers, default=0) + 1)

    def latest(self) -> tuple[int, dict]:
        """(highest version, its content); (0, {}) for a new table."""
        base = self.begin()
        return base.version, base.content

    def commit(self, version: int, content: dict) -> int:
        name, temporary = f"{self.path}/{version:012d}.json", f"{self.path}/_{uuid.uuid4().hex}.tmp"
        self.fs.mkdirs(self.dir)
        _, tmp = hadoop(self.spark, temporary)
        _, final = hadoop(self.spark, name)
        out = self.fs.create(tmp, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        try:
            self._name(tmp, final)
        except Exception as e:
            if not self.fs.exists(final):
                raise
            raise CommitConflict(f"version {version} of {self.path} is taken") from e
        finally:
            self.fs.delete(tmp, False)
        return version

    def _name(self, tmp, final) -> None:
        jvm = self.spark.sparkContext._jvm
        if self.fs.getScheme() == "file":
            paths = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, tmp)]
            jvm.java.nio.file.Files.createLink(*paths)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.dir.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(tmp, final, none)
