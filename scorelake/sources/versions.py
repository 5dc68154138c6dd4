"""Tables that are replaced as a whole: a folder per version, and a pointer that readers resolve.

A rewrite goes to a folder of its own. It becomes the current version when a pointer with the next
number appears, by one rename: readers see the old version or the new one, never a mixture. A reader that
resolved the old version keeps reading its files, as nothing is deleted before drop_before() is called.
Two writers that start from the same version both try to make the same pointer; the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has published a version in the meantime."""


class Versions:
    """The versions of one table below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *names: str):
        return self._hadoop.fs.Path("/".join((self.root, *names)))

    def _system(self):
        return self._path().getFileSystem(self._conf)

    def new_folder(self) -> str:
        """A new folder for a version's files; no reader knows it yet."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def numbers(self) -> list[int]:
        """Numbers of the published versions, ascending."""
        system, where = self._system(), self._path("pointers")
        if not system.exists(where):
            return []
        names = (f.getPath().getName() for f in system.listStatus(where))
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self, before: int | None = None) -> int | None:
        """The greatest published number, below a bound if one is given."""
        found = [n for n in self.numbers() if before is None or n < before]
        return found[-1] if found else None

    def content(self, number: int) -> dict:
        """What was published under a number."""
        stream = self._system().open(self._path("pointers", f"{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def publish(self, content: dict, number: int | None = None, again: bool = False) -> int:
        """Makes content the current version, as the given number or the next one.

        A number that exists is a conflict, unless the same work is done again.
        """
        number = (self.latest() or 0) + 1 if number is None else number
        made = self._path("making", uuid.uuid4().hex)
        system = self._system()
        stream = system.create(made, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        system.mkdirs(self._path("pointers"))
        rename = self._hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if again else rename.NONE
        files = self._hadoop.fs.FileContext.getFileContext(system.getUri(), self._conf)
        try:
            files.rename(made, self._path("pointers", f"{number:012d}"), how)
        except Py4JJavaError as failure:
            system.delete(made, False)
            if "FileAlreadyExists" in failure.java_exception.getClass().getName():
                raise Conflict(f"version {number} of {self.root} exists") from failure
            raise
        return number

    def replace(self, rows: DataFrame, write: Callable[[DataFrame, str], None] | None = None, after: int | None = None) -> int:
        """Writes rows as the version after the given one (by default the current); rows may read the current one."""
        after = (self.latest() or 0) if after is None else after
        folder = self.new_folder()
        if write is None:
            rows.write.parquet(folder)
        else:
            write(rows, folder)
        return self.publish({"folders": [folder]}, after + 1)

    def folder(self, number: int | None = None) -> str:
        """The folder of a version, by default the current one."""
        number = self.latest() if number is None else number
        if number is None:
            raise FileNotFoundError(f"{self.root} has no version")
        return self.content(number)["folders"][0]

    def read(self, number: int | None = None) -> DataFrame:
        """A version's rows, by default the current one's."""
        return self.spark.read.parquet(self.folder(number))

    def drop_before(self, keep: int = 2) -> int:
        """Deletes versions but the newest ones, with the folders that only they name; returns how many folders."""
        numbers = self.numbers()
        old, new = numbers[:-keep], numbers[-keep:]
        named = {f for n in new for f in self.content(n)["folders"]}
        gone = {f for n in old for f in self.content(n)["folders"]} - named
        system = self._system()
        for n in old:
            system.delete(self._path("pointers", f"{n:012d}"), False)
        for folder in gone:
            system.delete(self._hadoop.fs.Path(folder), True)
        return len(gone)
