"""Files of a stored table: a folder per day, in it one per batch; changes of them that can be repeated.

A change replaces files of some (day, batch) pairs. The new files are written beside the table, under
a name that readers skip. Then a list of the old files is put in place by one rename: from that
moment the change is made, and ``finish_changes`` completes it, now or after a stop. Pairs of a
stream's batches that were changed are marked as settled, so that a micro-batch which is repeated
later does not bring back what the change removed.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import SparkSession

from ..schema import BATCH

# (day, batch) pairs that one change replaces at once; more are replaced in several changes.
PAIRS = 1000
_SETTLED, _CHANGE, _NEXT, _OLD = "_settled", "_change-", "_next-", "_old-"

Pair = tuple[dt.date, int]


class Folder:
    """The files of a stored table."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
        self.root = path.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _at(self, *names: str):
        return self._path("/".join([self.root, *names]))

    def _names(self, *names: str) -> list[str]:
        place = self._at(*names)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def names(self) -> list[str]:
        return self._names()

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    @staticmethod
    def _pair(pair: Pair) -> tuple[str, str]:
        return f"log_date={pair[0].isoformat()}", f"{BATCH}={pair[1]}"

    def days(self) -> list[dt.date]:
        return [dt.date.fromisoformat(n[9:]) for n in self._names() if n.startswith("log_date=") and n[9] != "_"]

    def batches(self, day: dt.date) -> list[int]:
        names = self._names(f"log_date={day.isoformat()}")
        return [int(n[len(BATCH) + 1 :]) for n in names if n.startswith(f"{BATCH}=") and "_HIVE_" not in n]

    def files(self, pair: Pair) -> dict[str, tuple[int, int]]:
        """Name, size and time of every file of a pair, as far as readers see it."""
        place = self._at(*self._pair(pair))
        if not self.fs.exists(place):
            return {}
        found = [s for s in self.fs.listStatus(place) if s.getPath().getName()[0] not in "_."]
        return {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in found}

    def paths(self, pair: Pair, names: list[str]) -> list[str]:
        return [self._at(*self._pair(pair), n).toString() for n in names]

    def new_change(self) -> str:
        return uuid.uuid4().hex

    def staging(self, change: str) -> str:
        """Where the new files of a change are written, in the layout of the table."""
        return f"{self.root}/{_NEXT}{change}"

    def commit(self, change: str, old: dict[Pair, list[str]]) -> None:
        """Makes a change: from here on it is completed, also after a stop."""
        listed = [[d.isoformat(), b, names] for (d, b), names in old.items()]
        draft = self._at(f"{_NEXT}{change}", "_list")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(listed).encode()))
        finally:
            out.close()
        self._move(draft, self._at(f"{_CHANGE}{change}"))

    def _move(self, source, target) -> None:
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(source, target):
            raise RuntimeError(f"{source} could not be moved to {target}")

    def _read(self, name: str) -> list:
        stream = self.fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def changes(self) -> list[str]:
        """Changes that were made but not completed."""
        return [n[len(_CHANGE) :] for n in self._names() if n.startswith(_CHANGE)]

    def finish(self, change: str) -> None:
        """Completes a change; every step may have been done before."""
        listed = self._read(f"{_CHANGE}{change}")
        for day, batch, _ in listed:
            if batch >= 0:
                self.settle((dt.date.fromisoformat(day), batch))
        for day, batch, names in listed:
            pair = self._pair((dt.date.fromisoformat(day), batch))
            for name in names:
                self.swap_out(change, pair, name)
            self.swap_in(change, pair)
        for day in self._names(f"{_NEXT}{change}"):  # pairs without old files, as of a compaction
            if day.startswith("log_date="):
                for batch in self._names(f"{_NEXT}{change}", day):
                    self.swap_in(change, (day, batch))
        for day in {day for day, _, _ in listed}:
            self.drop_empty(dt.date.fromisoformat(day))
        for left in (f"{_NEXT}{change}", f"{_OLD}{change}", f"{_CHANGE}{change}"):  # the list goes last
            self.fs.delete(self._at(left), True)

    def swap_out(self, change: str, pair: tuple[str, str], name: str) -> None:
        old = self._at(*pair, name)
        if self.fs.exists(old):
            self._move(old, self._at(f"{_OLD}{change}", *pair, name))

    def swap_in(self, change: str, pair: tuple[str, str]) -> None:
        for name in self._names(f"{_NEXT}{change}", *pair):
            if name[0] not in "_.":
                self._move(self._at(f"{_NEXT}{change}", *pair, name), self._at(*pair, name))

    def discard(self, change: str) -> None:
        """Removes what was written for a change that is not made."""
        self.fs.delete(self._at(f"{_NEXT}{change}"), True)

    def settle(self, pair: Pair) -> None:
        self.fs.create(self._at(_SETTLED, str(pair[1]), pair[0].isoformat()), True).close()

    def settled(self, batch: int) -> list[dt.date]:
        """Days on which rows of a batch were changed after it was stored."""
        return [dt.date.fromisoformat(n) for n in self._names(_SETTLED, str(batch))]

    def forget(self, below: int) -> None:
        """Removes the marks of the batches below one that a stream has completed: those are never repeated."""
        for name in self._names(_SETTLED):
            if int(name) < below:
                self.fs.delete(self._at(_SETTLED, name), True)

    def drop_empty(self, day: dt.date) -> None:
        """Removes the batch folders without files, and the day if nothing is left."""
        place = self._at(f"log_date={day.isoformat()}")
        if self.fs.exists(place):
            for folder in [*(s.getPath() for s in self.fs.listStatus(place) if s.isDirectory()), place]:
                if not len(self.fs.listStatus(folder)):
                    self.fs.delete(folder, False)  # not if something was added meanwhile


def finish_changes(spark: SparkSession, path: str) -> Folder:
    """Completes changes of a table that were stopped half way; every writer calls it first."""
    files = Folder(spark, path)
    for change in files.changes():
        files.finish(change)
    return files
