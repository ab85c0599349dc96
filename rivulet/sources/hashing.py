"""Content hashes of files of any size, read by the executors in ranges of bytes.

The hash of a file is the digest of the digests of its ranges, in order, so that a large
file is hashed by many tasks and never held anywhere. Size and time only decide
whether a file is read again.
"""

from __future__ import annotations

import hashlib
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, and bytes held at once.
RANGE, PIECE = 64 << 20, 4 << 20


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """A path or URI as pyarrow opens it; what has no scheme is in the local (or mounted) file system."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def readable(path: str) -> bool:
    """Whether executors can open the path themselves."""
    try:
        open_path(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def whole_hash(ranges: list[str]) -> str:
    """The hash of a file from those of its ranges."""
    return hashlib.md5("".join(ranges).encode()).hexdigest()


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        found = []
        for path in paths:
            fs, at = open_path(path)
            info = fs.get_file_info(at)
            found.append((info.size, info.mtime_ns) if info.type == pafs.FileType.File else (None, None))
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["path", "size", "mtime"])


def file_states(paths: DataFrame) -> DataFrame:
    """(path, size, mtime) of each distinct path of ``paths``; null if there is no such file."""
    return paths.select("path").distinct().mapInArrow(_states, "path string, size long, mtime long")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = []
        for path, start in zip(paths, starts, strict=True):
            fs, at = open_path(path)
            h, left = hashlib.md5(), RANGE
            with fs.open_input_file(at) as source:
                source.seek(start)
                while left and (data := source.read(min(PIECE, left))):
                    h.update(data)
                    left -= len(data)
            found.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(starts, pa.int64()), pa.array(found)], names=["path", "start", "hash"])


def content_hashes(files: DataFrame) -> DataFrame:
    """(path, hash) of files (path, size); a null size has a null hash. A row for each range of a file is dealt out, by number."""
    starts = F.expr(f"sequence(0L, greatest(size - 1, 0L), {RANGE}L)")
    ranges = files.where("size IS NOT NULL").select("path", F.explode(starts).alias("start"))
    n = max(1, min(files.where("size IS NOT NULL").agg(F.sum(F.ceil(F.greatest(F.col("size"), F.lit(1)) / RANGE))).first()[0] or 1, 10_000))
    hashed = ranges.repartitionByRange(int(n), "path", "start").mapInArrow(_ranges, "path string, start long, hash string")
    each = F.transform(F.array_sort(F.collect_list(F.struct("start", "hash"))), lambda x: x["hash"])
    return files.select("path").join(hashed.groupBy("path").agg(F.md5(F.array_join(each, "")).alias("hash")), "path", "left")


def watched(paths: DataFrame) -> DataFrame:
    """(path, size, mtime, hash) of each distinct path."""
    states = file_states(paths)
    return states.join(content_hashes(states), "path")


def changed(known: DataFrame) -> DataFrame:
    """Paths of ``known`` (path, size, mtime, hash) whose content is another one by now, or that have gone; only what differs in size or time is read."""
    now = file_states(known).select("path", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"))
    both = known.join(now, "path")
    differs = both.where("NOT (size <=> size_now AND mtime <=> mtime_now)")
    hashes = content_hashes(differs.select("path", F.col("size_now").alias("size"))).select("path", F.col("hash").alias("hash_now"))
    return differs.join(hashes, "path").where("NOT hash <=> hash_now").select("path")


def driver_hash(stream, size: int) -> str:
    """As :func:`content_hashes`, of a stream that only the driver can open; it is read in pieces."""
    ranges, done = [], 0
    while done < max(size, 1):
        h, left = hashlib.md5(), RANGE
        while left and (data := stream.read(min(PIECE, left))):
            h.update(data)
            left -= len(data)
        ranges.append(h.hexdigest())
        done += RANGE
    return whole_hash(ranges)


def hash_files(spark: SparkSession, files: list[tuple[str, int]]) -> dict[str, str]:
    """Hashes of files (path, size) that executors can open."""
    rows = spark.createDataFrame(files, "path string, size long")
    return {r["path"]: r["hash"] for r in content_hashes(rows).collect()}  # a row for each watched file


def url_state(url: str, timeout: float = 30) -> str | None:
    """What tells versions of a URL apart: its ETag, or else its time of change and size; null if it cannot be reached."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as answer:
            tag = answer.headers.get("ETag")
            return f"etag {tag}" if tag else f"modified {answer.headers.get('Last-Modified')} {answer.headers.get('Content-Length')}"
    except OSError:
        return None
