"""Files of any size as windows: a data source whose partitions are byte ranges.

A cell holds at most 2 GB, so a version file beyond that cannot be one row. Each
window is a row read by its own task, by the file system's ranged reads; nothing but
the listing is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import natural_key

#: Bytes of a window: a multiple of every fixed chunk size in use.
WINDOW = 64 << 20


class _Range(InputPartition):
    def __init__(self, path: str, window: int, offset: int, size: int):
        self.path, self.window, self.offset, self.size = path, window, offset, size


class _Reader(DataSourceReader):
    def __init__(self, folder: str, window: int):
        self.folder, self.window = folder, window

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File]
        # An empty file is one empty window, so that its version is there.
        return [
            _Range(f.path, k, k * self.window, min(self.window, f.size - k * self.window))
            for f in files
            for k in range(max(1, -(-f.size // self.window)))
        ]

    def read(self, partition: _Range) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_file(partition.path) as file:
            content = file.read_at(partition.size, partition.offset) if partition.size else b""
        yield partition.path, partition.window, partition.offset, content


class WindowSource(DataSource):
    """``spark.read.format("file_windows").option("window", bytes).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "file_windows"

    def schema(self) -> str:
        return "path string, window long, offset long, content binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("window", WINDOW)))


def version_windows(spark: SparkSession, folder: str, window: int = WINDOW) -> DataFrame:
    """(version, window, offset, content) of the files below ``folder`` (a URI), versions in natural order of their paths."""
    spark.dataSource.register(WindowSource)
    windows = spark.read.format("file_windows").option("window", window).load(folder)
    # The listing is paths only; the driver holds it to plan the scan anyway.
    names = windows.where("window = 0").select("path").withColumn("k", natural_key(F.col("path"))).sort("k", "path")
    numbers = spark.createDataFrame([(i, r[0]) for i, r in enumerate(names.collect())], "version long, path string")
    return windows.join(F.broadcast(numbers), "path").select("version", "window", "offset", "content")


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks of windows numbered over their version: ``seq`` of a later window is larger; a window's end is always a cut."""
    return chunks.withColumn("seq", F.shiftleft(F.col("window"), 32) + F.col("seq")).drop("window")
