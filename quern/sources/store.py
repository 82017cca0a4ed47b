"""Versioned tables: every change is a new folder of Parquet, made visible by one small marker file.

A version's data is written first; its marker, which names the folder, is
created last and never overwritten, so readers see whole versions only and of
two writers of the same version one fails.  Old versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file of ``write_clustered``, about: narrow ones take a task some 100 MB to sort.
FILE_ROWS = 1 << 20


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass
class Store:
    spark: SparkSession
    path: str
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _marks(self) -> dict[int, str]:
        """Folder by number; empty where a writer ended before it named one."""
        fs, p = self._fs(f"{self.path}/versions")
        if not fs.exists(p):
            return {}
        out = {}
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.isdigit():
                stream = fs.open(s.getPath())
                out[int(name)] = bytes(stream.readAllBytes()).decode()
                stream.close()
        return out

    def versions(self) -> list[tuple[int, str]]:
        """(number, folder) of the versions made visible, in order."""
        return sorted((n, name) for n, name in self._marks().items() if name)

    def version(self) -> int:
        return max((n for n, _ in self.versions()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, by default the last."""
        every = dict(self.versions())
        number = max(every, default=0) if version is None else version
        if number not in every:
            raise FileNotFoundError(f"{self.path} has no version {number}")
        return self.spark.read.parquet(f"{self.path}/data/{every[number]}")

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """A new version with these rows; ``after`` is the version that they were made from."""
        base = self.version()
        if after is not None and after != base:
            raise Conflict(f"{self.path} is at version {base}, not {after}")
        name = uuid.uuid4().hex
        out = df
        if self.partition_by:
            out = out.repartition(*self.partition_by)
        if self.sort_by:  # row groups then have narrow ranges, which filters skip by
            out = out.sortWithinPartitions(*self.partition_by, *self.sort_by)
        writer = out.write.partitionBy(*self.partition_by) if self.partition_by else out.write
        writer.parquet(f"{self.path}/data/{name}")
        return self._mark(base, name)

    def _mark(self, base: int, name: str) -> int:
        """Makes the folder the version after ``base``: the marker is itself the file that only one writer can make.

        A writer that dies before it writes the folder's name leaves an empty
        marker, which readers and later writers pass over.
        """
        marks = self._marks()
        if max((n for n, held in marks.items() if held), default=0) != base:
            raise Conflict(f"{self.path} has a version after {base} by now")
        number = max(marks, default=0) + 1
        fs, p = self._fs(f"{self.path}/versions/{number}")
        try:
            stream = fs.create(p, False)
        except Exception as e:
            raise Conflict(f"version {number} of {self.path} has been made meanwhile") from e
        stream.write(name.encode())
        stream.close()
        if max(self._marks()) != number:  # passed over while it was empty
            fs.delete(p, False)
            raise Conflict(f"{self.path} has a version after {number} by now")
        return number

    def change(self, *steps: Callable[[DataFrame], DataFrame]) -> int:
        """Applies changes (see ``operators.dml``) to the last version and makes a new one."""
        base = self.version()
        df = self.read(base)
        for s in steps:
            df = s(df)
        return self.write(df, base)

    def append(self, rows: DataFrame) -> int:
        return self.write(rows) if not self.version() else self.change(lambda df: df.unionByName(rows, allowMissingColumns=True))

    def rollback(self, version: int) -> int:
        """A new version with the rows of an old one."""
        return self.write(self.read(version))

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Changes made inside become one version at the end, or none if there is an error."""
        base = self.version()
        t = Transaction(self.read(base) if base else None)
        yield t
        if t.changed:
            self.write(t.table, base)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last versions, and what writers left that ended before their version was visible.  Not for use beside a writer."""
        every = self.versions()
        live = {name for _, name in every[-keep:]} if keep else set()
        for number, name in every:
            if name not in live:
                fs, p = self._fs(f"{self.path}/versions/{number}")
                fs.delete(p, False)
        fs, p = self._fs(f"{self.path}/data")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in live:
                fs.delete(s.getPath(), True)


@dataclass
class Transaction:
    """A table under change, with named points to return to."""

    table: DataFrame | None
    changed: bool = False
    points: dict[str, DataFrame | None] = field(default_factory=dict)

    def apply(self, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
        for s in steps:
            self.table = s(self.table)
            self.changed = True
        return self.table

    def savepoint(self, name: str) -> None:
        self.points[name] = self.table

    def rollback_to(self, name: str) -> None:
        """Back to the point; later points are gone."""
        self.table = self.points[name]
        names = list(self.points)
        for n in names[names.index(name) + 1 :]:
            del self.points[n]

    def release(self, name: str) -> None:
        del self.points[name]


def write_clustered(df: DataFrame, path: str, sort: Sequence[str], partition_by: Sequence[str] = (), files: int | None = None) -> None:
    """Files with narrow ranges of the sort columns: what an index would be for, scans skip.

    Each file is sorted by one task, so by default their number goes by the
    rows, which are counted first.  Rows that are equal in the sort columns are
    dealt by a hash of the other columns, else a common value would be one task's.
    """
    files = files or max(1, -(-df.count() // FILE_ROWS))
    keys = [*partition_by, *sort]
    rest = [f.name for f in df.schema if f.name not in keys and not re.search("map<|variant", f.dataType.simpleString())]  # what Spark can hash
    out = df.repartitionByRange(files, *keys, *([F.xxhash64(*[F.col(f"`{c}`") for c in rest])] if rest else [])).sortWithinPartitions(*keys)
    (out.write.partitionBy(*partition_by) if partition_by else out.write).parquet(path)
