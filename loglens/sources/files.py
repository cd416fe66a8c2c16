"""Log files on storage -> lines, by a data source that plans byte ranges.

* ``scan_rows`` gives (path, block, row, line_text): the line's place is the byte range it begins in and its
  place there. Ranges are planned on the driver from file names and sizes alone; a file of any size is read by
  many tasks, in chunks, and small files share a task.
* Line numbers are resolved late: ``number_lines`` counts the lines of the ranges in front of a hit, only in files of several
  ranges that have hits behind the first. ``scan_lines`` numbers every line.
* Options of the original tool: recursive or one level, hidden names (any part of the path that starts with a
  dot), size cap, binary files (NUL in the first 4096 bytes, which each task reads for itself),
  allowed roots. Names that start with ``_`` are read.
* Lines end at ``\\n``, ``\\r\\n`` or ``\\r`` bytes, also where such a pair lies across two ranges. UTF-8 bytes that are
  not valid are dropped from the lines; ``encoding="latin-1"`` reads every byte as a character.

Targets are paths or URIs that pyarrow's file systems open (``file:``, ``s3://``, ``gs://``, ``hdfs://``); the tasks open
them too, so a plain path must lie on storage that all executors see.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.gcparse import executor_from_path, service_from_path
from ..session import broadcast_if_small, checkpoint_dir, stored

BINARY_SNIFF_BYTES = 4096
BLOCK_BYTES = 64 << 20
_CHUNK = 4 << 20
_BEHIND = 64 << 10                                   # read behind a range at first: most last lines end there
_ROWS = 10_000
_SCHEMA = "path string, block bigint, row bigint, line_text string"


def path_allowed(target: str, allowed_roots: list[str] | None) -> bool:
    if ".." in str(target):
        return False
    if allowed_roots is None:
        return True
    return any(str(target).startswith(r) for r in allowed_roots)


def file_system(target: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path on it, what to put in front of its paths)."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        if target.startswith("file:"):
            return fs.LocalFileSystem(), "/" + target[5:].lstrip("/"), ""
        system, path = fs.FileSystem.from_uri(target)
        return system, path, target[:len(target) - len(path)] if target.endswith(path) else ""
    return fs.LocalFileSystem(), target, ""


def _hidden(path: str) -> bool:
    return any(p.startswith(".") and p not in (".", "..") for p in path.split("/"))


def list_files(target: str, recursive: bool, include_hidden: bool) -> list[tuple[str, int]]:
    """(path, size) of the target itself or the files under it, sorted; a missing target has none."""
    system, path, front = file_system(target)
    path = path.rstrip("/") or "/"
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound or not include_hidden and _hidden(path):
        return []
    if info.type == fs.FileType.File:
        return [(front + path, info.size)]
    found = system.get_file_info(fs.FileSelector(path, recursive=recursive))
    return sorted((front + f.path, f.size) for f in found if f.type == fs.FileType.File
                  and (include_hidden or not _hidden(f.path[len(path):])))


def segments(f, start: int, end: int, size: int, chunk: int = _CHUNK) -> Iterator[bytes]:
    """Bytes of the lines that begin in [start, end), in pieces that end where a line does.

    A pair ``\\r\\n`` is never cut. The last piece of a file may lack its line end.
    """
    base = max(0, start - 1)
    f.seek(base)
    data, skipping = bytearray(), start > 0
    while True:
        got = f.read(chunk)
        data += got
        last = not got or base + len(data) >= size
        if skipping:                                 # behind the first line end at start - 1 or later
            at = _line_end(data, 0, last)
            if at is None:
                if last:
                    return
                base += max(0, len(data) - 1)        # a CR at the end may go on
                del data[:max(0, len(data) - 1)]
                continue
            base += at
            del data[:at]
            skipping = False
        if base >= end:
            return
        if base + len(data) >= end:                  # the first line end at end - 1 or later closes the range
            at = _line_end(data, max(0, end - 1 - base), last)
            if at is not None or last:
                if piece := bytes(data[:at]):
                    yield piece
                return
        elif last:
            if data:
                yield bytes(data)
            return
        cut = max(data.rfind(b"\n"), data.rfind(b"\r", 0, max(0, len(data) - 1))) + 1
        if cut and data[cut - 1] == 13 and cut < len(data) and data[cut] == 10:
            cut += 1
        if cut and base + cut <= end - 1:
            yield bytes(data[:cut])
            base += cut
            del data[:cut]


_END = re.compile(rb"\r\n|\n|\r")


def _line_end(data: bytearray, at: int, last: bool) -> int | None:
    """Index behind the first line end that begins at ``at`` or later; None if it isn't known yet."""
    m = _END.search(data, at)
    if m is None or m.group() == b"\r" and m.end() == len(data) and not last:
        return None
    return m.end()


def lines_in(piece: bytes, encoding: str) -> list[str]:
    text = piece.decode(encoding, "ignore").replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    if not lines[-1]:                                # behind the last line end, or an end of invalid bytes only
        lines.pop()
    return lines


def count_in(piece: bytes) -> int:
    """Lines of a piece, as they count for the numbers of those behind it."""
    ends = piece.count(b"\n") + piece.count(b"\r") - piece.count(b"\r\n")
    return ends + (piece[-1] not in b"\r\n")


def is_binary(f) -> bool:
    f.seek(0)
    return b"\0" in f.read(BINARY_SNIFF_BYTES)


@dataclass
class Ranges(InputPartition):
    """(path, start, end, size) of the ranges that one task reads."""
    ranges: list


class LogFiles(DataSource):
    """Lines of files with the byte range they begin in; ``count=true`` gives a row for each range with its number of lines in ``row``."""

    @classmethod
    def name(cls):
        return "loglens_files"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return LogFilesReader(self.options)


class LogFilesReader(DataSourceReader):
    def __init__(self, options):
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.target = options["target"]
        self.recursive, self.hidden = flag("recursive", True), flag("includeHidden", False)
        self.skip_binary, self.count = flag("skipBinary", True), flag("count", False)
        self.encoding = options.get("encoding", "utf-8")
        self.block = int(options.get("blockBytes", BLOCK_BYTES))
        self.tasks = int(options.get("tasks", 1 << 30))
        self.most = int(options["maxBytesPerFile"]) if options.get("maxBytesPerFile") else None

    def partitions(self):
        """Small ranges share a task, up to ``BLOCK_BYTES``, but for what spreads them over ``tasks``."""
        found = [(path, size) for path, size in list_files(self.target, self.recursive, self.hidden)
                 if size and (self.most is None or size <= self.most) and not (self.count and size <= self.block)]
        most = max(self.block, min(BLOCK_BYTES, -(-sum(size for _, size in found) // self.tasks)))
        parts, now, load = [], [], 0
        for path, size in found:
            for start in range(0, size, self.block):
                end = min(size, start + self.block)
                if now and load + end - start > most:
                    parts.append(Ranges(now))
                    now, load = [], 0
                now.append((path, start, end, size))
                load += end - start
        return parts + [Ranges(now)] if now else parts or [Ranges([])]

    def read(self, partition):
        held, n = [], 0
        for path, ranges in groupby(partition.ranges, lambda r: r[0]):
            system, at, _ = file_system(path)
            with system.open_input_file(at) as f:
                if self.skip_binary and is_binary(f):
                    continue
                for _, start, end, size in ranges:
                    pieces = segments(f, start, end, size, chunk_for(start, end))
                    if self.count:
                        yield (path, start, sum(map(count_in, pieces)), None)
                        continue
                    row = 0
                    for piece in pieces:
                        lines = lines_in(piece, self.encoding)
                        for a in range(0, len(lines), _ROWS):
                            some = lines[a:a + _ROWS]
                            if n + len(some) > _ROWS:
                                yield _batch(held)
                                held, n = [], 0
                            held.append((path, start, row, some))
                            n += len(some)
                            row += len(some)
        if held:
            yield _batch(held)


def chunk_for(start: int, end: int) -> int:
    """Bytes to read at a time for a range: little more than the range."""
    return min(_CHUNK, end - start + _BEHIND)


def _batch(held: list) -> pa.RecordBatch:
    """Runs (path, block, first row, lines) as rows."""
    sizes = [len(x[3]) for x in held]
    return pa.RecordBatch.from_arrays(
        [pa.array([p for x, n in zip(held, sizes) for p in [x[0]] * n], pa.string()),
         pa.array([s for x, n in zip(held, sizes) for s in [x[1]] * n], pa.int64()),
         pa.array([i for x, n in zip(held, sizes) for i in range(x[2], x[2] + n)], pa.int64()),
         pa.array([t for x in held for t in x[3]], pa.string())],
        names=["path", "block", "row", "line_text"])


def _read(spark: SparkSession, target: str, options: dict) -> DataFrame:
    spark.dataSource.register(LogFiles)
    given = {k: str(v) for k, v in {"tasks": 4 * spark.sparkContext.defaultParallelism, **options}.items() if v is not None}
    return spark.read.format("loglens_files").options(target=target, **given).load()


def _options(recursive, include_hidden, max_bytes_per_file, skip_binary, encoding, block_bytes) -> dict:
    if encoding not in ("utf-8", "latin-1"):
        raise ValueError("encoding is utf-8 or latin-1")
    return {"recursive": recursive, "includeHidden": include_hidden, "maxBytesPerFile": max_bytes_per_file,
            "skipBinary": skip_binary, "encoding": encoding, "blockBytes": block_bytes}


def scan_rows(spark: SparkSession, target: str, *, recursive: bool = True, include_hidden: bool = False,
              max_bytes_per_file: int | None = None, skip_binary: bool = True, encoding: str = "utf-8",
              block_bytes: int = BLOCK_BYTES, allowed_roots: list[str] | None = None) -> DataFrame:
    """(path, block, row, line_text) of every line under ``target``; see :func:`number_lines`."""
    if not path_allowed(target, allowed_roots):
        return spark.createDataFrame([], _SCHEMA)
    return _read(spark, target, _options(recursive, include_hidden, max_bytes_per_file, skip_binary, encoding, block_bytes))


def _numbered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with line_no; ``counts``: (path, block, n) of files of several ranges."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")))
    extra = [c for c in rows.columns if c not in ("path", "block", "row", "line_text")]
    got = rows.join(broadcast_if_small(first, 150), ["path", "block"], "left")
    return got.select("path", (F.coalesce("_first", F.lit(0)) + F.col("row") + 1).cast("bigint").alias("line_no"), "line_text", *extra)


def number_lines(hits: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hits of a search over :func:`scan_rows` with their line numbers: (path, line_no, line_text, ...).

    ``block_bytes`` is the scan's. The hits are written once; only ranges in front of a hit are counted.
    """
    hits = stored(hits)
    block = hits.where("block > 0").groupBy("path").agg(F.max("block").alias("last"))
    ranges = block.select("path", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(block_bytes).cast("bigint"))).alias("block"), "last")

    def count(batches):
        f, held = None, None
        try:
            for b in batches:
                n = []
                for path, start, last in zip(*(c.to_pylist() for c in b.columns)):
                    if start == last:                # nothing is asked for behind it
                        n.append(0)
                        continue
                    if path != held:
                        if f is not None:
                            f.close()
                        system, at, _ = file_system(path)
                        f, held = system.open_input_file(at), path
                    end = start + block_bytes
                    n.append(sum(map(count_in, segments(f, start, end, f.size(), chunk_for(start, end)))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["path", "block", "n"])
        finally:
            if f is not None:
                f.close()

    # The ranges of a stretch of a file are counted by one task, in their order.
    stretch = F.floor(F.col("block") / max(BLOCK_BYTES, block_bytes))
    counted = ranges.repartition("path", stretch).sortWithinPartitions("path", "block").mapInArrow(count, "path string, block bigint, n bigint")
    return _numbered(hits, counted)


def scan_lines(spark: SparkSession, target: str, *, recursive: bool = True, include_hidden: bool = False,
               max_bytes_per_file: int | None = None, skip_binary: bool = True, encoding: str = "utf-8",
               block_bytes: int = BLOCK_BYTES, allowed_roots: list[str] | None = None) -> DataFrame:
    """(path, line_no, line_text) of every line under ``target``. Files of several ranges are read twice, once to count."""
    if not path_allowed(target, allowed_roots):
        return spark.createDataFrame([], "path string, line_no bigint, line_text string")
    options = _options(recursive, include_hidden, max_bytes_per_file, skip_binary, encoding, block_bytes)
    counts = _read(spark, target, {**options, "count": True}).select("path", "block", F.col("row").alias("n"))
    return _numbered(_read(spark, target, options), counts)


def search_files(spark: SparkSession, target: str, patterns, *, block_bytes: int = BLOCK_BYTES, scan: dict | None = None, **grep) -> DataFrame:
    """grep over files: lines are searched as they are read, only hits get their number. ``limit`` takes the first by (path, line_no)."""
    from ..operators.search import grep as find
    limit = grep.pop("limit", None)
    out = number_lines(find(scan_rows(spark, target, block_bytes=block_bytes, **(scan or {})), patterns, **grep), block_bytes)
    return out if limit is None else out.orderBy("path", "line_no").limit(int(limit))


def write_log_tree(lines: DataFrame, root: str | None = None) -> str:
    """Write (path, line_no, line_text) rows as text files, one file per
    original log path, in ``service=<svc>/exe=<executor-ip|driver>/``
    folders under ``root`` (default: a fresh folder in the checkpoint dir)."""
    spark = lines.sparkSession
    root = root or os.path.join(checkpoint_dir(spark), f"logs-{uuid.uuid4().hex}")
    exe = executor_from_path(F.col("path"))
    (lines.select(F.coalesce(service_from_path(F.col("path")), F.lit("none")).alias("service"),
                  F.when(exe.isin("driver", "unknown"), exe)
                  .otherwise(F.concat(F.lit("executor-"), exe)).alias("exe"),
                  "path", "line_no", "line_text")
     .repartition("path")
     .sortWithinPartitions("service", "exe", "line_no")
     .select("service", "exe", "line_text")
     .write.partitionBy("service", "exe").mode("errorifexists").text(root))
    return root
