"""A ledger beside an event table: which writer has taken which ids, and what is written.

Every writer takes a range of ids by creating the next numbered file, which exactly one
writer can do, so that two never share an id and none has to read the table. Rows of a
named batch are kept in the ledger until the table holds them: a batch that comes again
after a failure gets the same ids, and only what is missing is written.
"""

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Within one process files of a local disk are created one at a time.
_ONE_AT_A_TIME = threading.Lock()
#: Seconds in which a writer that has created its file fills it.
PATIENCE = 30


class Ledger:
    """Entries ``{name, first, rows, kept}``; the ids ``first`` to ``first + rows - 1`` are taken."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.folder = f"{path.rstrip('/')}-ledger"
        self.jvm = spark._jvm
        hadoop = spark._jsc.hadoopConfiguration()
        self.files = self._path("").getFileSystem(hadoop)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self) -> bool:
        return self.files.exists(self._path(""))

    def _create(self, name: str, entry: dict, again: bool = False) -> bool:
        """Write a file that must not be there yet, unless ``again``; False if it is."""
        with _ONE_AT_A_TIME:
            if not again and self.files.exists(self._path(name)):
                return False
            try:
                out = self.files.create(self._path(name), again)
            except Exception as error:
                if not again and self.files.exists(self._path(name)):
                    return False  # another writer was first
                raise error
            out.write(bytearray(json.dumps(entry).encode()))
            out.close()
        return True

    def _read(self, name: str) -> dict | None:
        if not self.files.exists(self._path(name)):
            return None
        for _ in range(PATIENCE * 10):
            stream = self.files.open(self._path(name))
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text:
                return json.loads(text)
            time.sleep(0.1)
        raise RuntimeError(f"{self.folder}/{name} is empty: remove it if no writer is at work")

    @staticmethod
    def _claim(number: int) -> str:
        return f"claim-{number:012d}"

    def _latest(self) -> tuple[int, dict | None]:
        """Number and entry of the last claim; the hint may lag behind a few."""
        number = (self._read("latest") or {"number": 0})["number"]
        while self.files.exists(self._path(self._claim(number + 1))):
            number += 1
        return number, self._read(self._claim(number)) if number else None

    def take(self, rows: int, first_free: Callable[[], int], name: str = "", kept: str = "") -> dict:
        """Take the next ``rows`` ids; ``first_free`` reads the table, for a first entry only."""
        start = None
        while True:
            number, last = self._latest()
            if last is None or last["first"] is None:
                start = first_free() if start is None else start
                first = start
            else:
                first = last["first"] + last["rows"]
            entry = {"name": name, "first": first, "rows": rows, "kept": kept}
            if self._create(self._claim(number + 1), entry):
                self._create("latest", {"number": number + 1}, again=True)
                return entry

    def ids_given_elsewhere(self) -> None:
        """Rows with ids of their own were added: the next writer reads the table once."""
        while self.exists():
            number, _ = self._latest()
            if self._create(self._claim(number + 1), {"name": "", "first": None, "rows": 0, "kept": ""}):
                self._create("latest", {"number": number + 1}, again=True)
                return

    def find(self, name: str) -> dict | None:
        """The claim of a batch that has been begun. Looked for from the last one back."""
        if self._read(f"begun-{name}") is None:
            return None
        number, entry = self._latest()
        while entry is not None and entry["name"] != name:
            number -= 1
            entry = self._read(self._claim(number)) if number else None
        return entry

    def is_done(self, name: str) -> bool:
        return self.files.exists(self._path(f"done-{name}"))

    def keep(self, rows: DataFrame, name: str) -> str:
        """Write the rows of a batch into the ledger; their path."""
        path = f"{self.folder}/rows-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._create(f"begun-{name}", {"kept": path}, again=True)
        return path

    def done(self, name: str, entry: dict | None) -> None:
        """The table holds the batch; its kept rows go."""
        self._create(f"done-{name}", entry or {"rows": 0}, again=True)
        if entry and entry["kept"]:
            self.files.delete(self.jvm.org.apache.hadoop.fs.Path(entry["kept"]), True)

    def copy_to(self, path: str) -> None:
        """The same entries beside another table that holds the same rows."""
        if self.exists():
            target = Ledger(self.spark, path)
            hadoop = self.spark._jsc.hadoopConfiguration()
            self.jvm.org.apache.hadoop.fs.FileUtil.copy(
                self.files, self._path(""), target.files, target._path(""), False, hadoop
            )
