"""Raw binary files through Spark's own writer and commit protocol, on any file system Spark can write.

Every row of a partition is a frame of bytes; a partition becomes one file that holds its frames in row order, each
followed by the writer's line feed. Formats built on this allow for that byte between frames.

The writer takes strings: a cast from binary to string copies the bytes unchecked, and the text writer writes a string's
bytes as they are. A test writes every byte value and reads it back, as other releases might not keep to this.
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_frames(frames: DataFrame, path: str, column: str = "frame") -> None:
    """Write the binary ``column`` of ``frames``; a cast from binary to string keeps the bytes as they are."""
    frames.select(F.col(column).cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """``(part, path)`` of each file, without reading any; part is the number of the partition that wrote it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), "path")


class RangeFile:
    """Positioned reads of a file by URI or path."""

    def __init__(self, uri: str) -> None:
        parsed = urlparse(uri)
        if parsed.scheme in ("", "file"):
            self.file = open(unquote(parsed.path) if parsed.scheme else uri, "rb")
            self.size = self.file.seek(0, 2)
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            self.file = store.open_input_file(path)
            self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.file.close()
