"""A keyed table that a stream keeps: versions on shared storage, merged associatively.

The state is a folder. Every micro-batch writes what it adds under its own id (``delta/batch=<id>``); now
and then a compaction merges the latest version and the deltas behind it into ``version=<id>``. The
table is the latest version plus the deltas of later batches, merged when it is read. A batch that is run
again overwrites its own delta, or is left out if a version holds it already, so nothing counts twice. A folder
counts only when its write has ended (``_SUCCESS``); what a failed write left is overwritten.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.files import file_system


class KeyedState:
    """``merge`` maps a union of state rows to state rows, one for each key; it must be associative."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.schema, self.merge = spark, root.rstrip("/"), schema, merge

    def _numbers(self, kind: str) -> list[int]:
        """Ids of the complete folders of a kind: names on storage, no data."""
        system, path, _ = file_system(self.root)
        folder, prefix = (f"{path}/delta", "batch=") if kind == "delta" else (path, "version=")
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        ids = [int(m[1]) for f in found if (m := re.fullmatch(rf"{prefix}(\d+)", f.base_name))]
        return sorted(i for i in ids if system.get_file_info(f"{folder}/{prefix}{i}/_SUCCESS").type == fs.FileType.File)

    def version(self) -> int:
        """The last batch that the latest version holds; -1: there is no version."""
        return max(self._numbers("version"), default=-1)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """The rows that batch ``batch_id`` adds; without effect if a version holds the batch."""
        if batch_id > self.version():
            self.merge(rows).select(self.schema.names).write.mode("overwrite").parquet(f"{self.root}/delta/batch={batch_id}")

    def read(self, upto: int | None = None) -> DataFrame:
        """The table as it is, or as it was after batch ``upto`` (while the versions and deltas for it are kept)."""
        version = max((v for v in self._numbers("version") if upto is None or v <= upto), default=-1)
        later = [b for b in self._numbers("delta") if b > version and (upto is None or b <= upto)]
        paths = ([f"{self.root}/version={version}"] if version >= 0 else []) + [f"{self.root}/delta/batch={b}" for b in later]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows if not later else self.merge(rows).select(self.schema.names)

    def compact(self) -> int:
        """Merge everything up to the last batch into a version of its own; the version's number."""
        last = max(self._numbers("delta"), default=-1)
        if last > self.version():
            self.read(last).write.mode("overwrite").parquet(f"{self.root}/version={last}")
        return self.version()

    def tidy(self, keep: int = 2) -> None:
        """Remove the state's own versions but the latest ``keep``, and the deltas that the oldest of those holds."""
        versions = self._numbers("version")
        kept = versions[-keep:]
        system, path, _ = file_system(self.root)
        for v in versions[:-keep]:
            system.delete_dir(f"{path}/version={v}")
        for b in self._numbers("delta"):
            if kept and b <= kept[0]:
                system.delete_dir(f"{path}/delta/batch={b}")
