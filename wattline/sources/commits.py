"""Tables that grow by parts, each of which is there as a whole or not at all, and numbers that are given out once.

A part is written beside the table, under a name that readers skip, and then renamed in one step to ``part=<token>``.
A token that is there already is not written again, so an append may be retried.  If two writers rename to
one token, the later part ends inside the first one's folder under its skipped name: nobody reads it.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

HIDDEN = "_new-"


class Folder:
    """Files of a folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.at().getFileSystem(self.conf)

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return bool(self.files.exists(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        """Names in the folder, in order; none where there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(f.getPath().getName() for f in self.files.listStatus(self.at(name)))

    def move(self, old: str, new: str) -> bool:
        return bool(self.files.rename(self.at(old), self.at(new)))

    def delete(self, name: str) -> bool:
        return bool(self.files.delete(self.at(name), True))

    def create(self, name: str) -> bool:
        """Make an empty file; False if it is there already.  Of several that try at once one gets True."""
        path = self.at(name)
        self.files.mkdirs(path.getParent())
        if self.files.getUri().getScheme() == "file":  # Hadoop's local files look first and create then: two steps
            made = self.jvm.java.io.File(path.toUri().getPath()).createNewFile()
            return bool(made)
        try:
            self.files.create(path, False).close()
        except Py4JJavaError as failed:
            if self.exists(name):
                return False
            raise failed
        return True

    def write(self, name: str, text: str) -> None:
        """A file with ``text`` that appears in one step; a file of that name must not be there."""
        beside = f"{HIDDEN}{uuid.uuid4().hex}"
        out = self.files.create(self.at(beside), False)
        out.write(bytearray(text.encode()))
        out.close()
        self.move(beside, name)

    def read(self, name: str) -> str:
        size = self.files.getFileStatus(self.at(name)).getLen()
        stream = self.files.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode()
        finally:
            stream.close()


def append_part(df: DataFrame, path: str, by: str, token: str | None = None) -> bool:
    """Add ``df`` to the table; False if ``token`` was added before.  Without a token every append counts."""
    folder = Folder(df.sparkSession, path)
    target, beside = f"part={token or uuid.uuid4().hex}", f"{HIDDEN}{uuid.uuid4().hex}"
    if folder.exists(target):
        return False
    df.write.partitionBy(by).parquet(f"{folder.path}/{beside}")
    folder.move(beside, target)
    late = [n for n in (beside, f"{target}/{beside}") if folder.exists(n)]
    for name in late:
        folder.delete(name)
    return not late


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all parts that are there, or an empty table before the first."""
    folder = Folder(spark, path)
    parts = [n for n in folder.names() if n.startswith("part=")]
    if not parts:
        return spark.createDataFrame([], schema)
    kept = spark.createDataFrame([], schema).columns
    table = spark.read.schema(f"{schema}, part string").option("basePath", path).parquet(*[f"{folder.path}/{p}" for p in parts])
    return table.select(*kept)


def take_numbers(spark: SparkSession, path: str, series: str, count: int, first: int = 0) -> list[int]:
    """``count`` numbers of a series that nobody else gets, from ``first`` on: each is taken by creating its file."""
    folder, out = Folder(spark, path), []
    place = f"_numbers/{series.encode().hex() or '_'}"
    taken = folder.names(place)
    number = max([first, *(int(n) + 1 for n in taken if n.isdigit())])
    while len(out) < count:
        if folder.create(f"{place}/{number:012d}"):
            out.append(number)
        number += 1
    return out
