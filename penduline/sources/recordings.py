"""Recordings: what a reader says of files. This engine brings no decoder; a reader is a function that takes the bytes of a file
and gives its metadata or its frames, and runs where the files are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: bytes -> fps, frame_count, width, height; None, or an exception, if the bytes are no recording.
Reader = Callable[[bytes], tuple[float, int, int, int] | None]


def probe(spark: SparkSession, path: str, reader: Reader | None = None) -> DataFrame:
    """(path, size_bytes, fps, frame_count, width, height, last_frame_time, code) of each file of a path or pattern.

    code: video_open_failed where there is no reader or it fails on the file, invalid_video_metadata where fps isn't above 0 or
    there is no frame or size; else null. Whole files are read, one at a time; Spark lists no
    empty files, so they give no row."""
    def one(content: bytes) -> tuple:
        try:
            said = reader(content) if reader else None
        except Exception:
            said = None
        if said is None:
            return None, None, None, None, None, "video_open_failed"
        fps, count, width, height = said
        fine = fps and fps > 0 and count and count > 0 and width and width > 0 and height and height > 0
        return fps, count, width, height, (count - 1) / fps if fine else None, None if fine else "invalid_video_metadata"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, *one(bytes(c))) for p, n, c in zip(batch["path"], batch["length"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "fps", "frame_count", "width", "height", "last_frame_time", "code"]).astype(
                {"frame_count": "Int64", "width": "Int64", "height": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.mapInPandas(run, "path string, size_bytes bigint, fps double, frame_count bigint, width int, height int, last_frame_time double, code string")


def frames(spark: SparkSession, path: str, decoder: Callable[[bytes], Iterator[bytes]]) -> DataFrame:
    """(path, frame, content) of all frames a decoder gives of each file; a file on which it fails gives one row with the
    frame -1 and no content."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                held: list[tuple[str, int, bytes | None]] = []
                try:
                    for k, picture in enumerate(decoder(bytes(c))):
                        held.append((p, k, picture))
                        if len(held) == 64:
                            yield pd.DataFrame(held, columns=["path", "frame", "content"])
                            held = []
                except Exception:
                    held.append((p, -1, None))
                if held:
                    yield pd.DataFrame(held, columns=["path", "frame", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, frame int, content binary")
