"""A table that micro-batches add to, in few files however many batches there were.

Each micro-batch writes its own rows as one table. LIMIT tables of a level are merged into
one of the next, so after n batches there are some LIMIT x log(n) tables, and a row has been
rewritten log(n) times. Which tables make up the state after a batch stands in that batch's
manifest, a small file that appears by a rename: readers see the state before a batch or
after it, never half of it. Paths come from the manifest, no folder of tables is listed.

A batch that runs again after a failure starts from the manifest of the batch before it and
puts the same result in place. Manifests and tables that neither this batch nor the one
before it needs are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of one level that are merged into one.
LIMIT = 8


class StateLog:
    """Rows with ``keys`` and the columns of ``merged``, each with the aggregate that puts
    rows of equal keys together (sum, max, ...); keys may be NULL."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], merged: dict[str, Column], schema: str, limit: int = LIMIT):
        self.spark, self.folder = spark, folder
        self.keys, self.merged, self.schema, self.limit = keys, merged, schema, limit
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _manifests(self) -> list[int]:
        """Batches with a manifest, of which there are only the last few."""
        if not self._files.exists(self._path("manifests")):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._path("manifests"))]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith("."))

    def _tables(self, batch_id: int) -> list[tuple[str, int]]:
        """Name and level of each table of the state after a batch."""
        text = self.spark.read.text(f"{self.folder}/manifests/{batch_id:012d}.json", wholetext=True).first()["value"]
        return [tuple(entry) for entry in json.loads(text)]

    def _state(self, before: int | None) -> tuple[int | None, list[tuple[str, int]]]:
        known = [batch for batch in self._manifests() if before is None or batch < before]
        return (known[-1], self._tables(known[-1])) if known else (None, [])

    def _read(self, tables: list[tuple[str, int]]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{name}" for name, _ in tables])

    def _merge(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[how.alias(name) for name, how in self.merged.items()])

    def rows(self, before: int | None = None) -> DataFrame:
        """The state after the last batch, or as it was before batch ``before``; rows of
        equal keys are still apart (see ``merged_rows``), so filters reach the files."""
        return self._read(self._state(before)[1])

    def merged_rows(self, before: int | None = None) -> DataFrame:
        return self._merge(self.rows(before))

    def append(self, batch_id: int, rows: DataFrame) -> None:
        """Add a batch's rows; they may hold each key once only, or several times."""
        last, tables = self._state(batch_id)
        tables = [*tables, (self._written(rows), 0)]
        level = 0
        while sum(own == level for _, own in tables) >= self.limit:
            full = [entry for entry in tables if entry[1] == level]
            name = self._written(self._merge(self._read(full)))
            tables = [entry for entry in tables if entry[1] != level] + [(name, level + 1)]
            level += 1
        self._publish(batch_id, tables)
        self._clean(batch_id, last)

    def _written(self, rows: DataFrame) -> str:
        name = f"tables/{uuid.uuid4().hex}"
        # Sorted by keys, so that a filter on one passes over files by their statistics.
        rows.select(*self.keys, *self.merged).sortWithinPartitions(*self.keys).write.parquet(f"{self.folder}/{name}")
        return name

    def _publish(self, batch_id: int, tables: list[tuple[str, int]]) -> None:
        draft, final = self._path(f"manifests/.{batch_id:012d}-{uuid.uuid4().hex}"), self._path(f"manifests/{batch_id:012d}.json")
        stream = self._files.create(draft, True)
        stream.write(json.dumps(tables).encode())
        stream.close()
        if self._files.exists(final):
            self._files.delete(final, False)
        if not self._files.rename(draft, final):
            raise OSError(f"could not publish {final}")

    def _clean(self, batch_id: int, last: int | None) -> None:
        """Delete what only batches before ``last`` needed, and what a failed run left."""
        needed = {name for batch in (batch_id, last) if batch is not None for name, _ in self._tables(batch)}
        for batch in self._manifests():
            if batch not in (batch_id, last):
                self._files.delete(self._path(f"manifests/{batch:012d}.json"), False)
        for status in self._files.listStatus(self._path("tables")):
            if f"tables/{status.getPath().getName()}" not in needed:
                self._files.delete(status.getPath(), True)
