"""A folder of archives as a stream: every new file is walked once, with the same reader as a batch.

The file source hands over whole files with their contents; the walk is a
narrow map, so the stream keeps no state and any sink's guarantees hold.
"""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession

from ..sources.archive import SCHEMA, event_batches
from ..sources.walk import Options, walk

FILES = "path string, modificationTime timestamp, length long, content binary"


#: Bytes of new files that one batch of the stream takes; a larger file is a batch of its own.
TRIGGER_BYTES = 1 << 30


def watch(spark: SparkSession, folder: str, globs: list[str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The tagged rows of ``archive.scan``, as a streaming DataFrame; ``archive`` is the file's URI.

    A batch takes files by their bytes, so that the number of batches, each of which lists the
    folder and logs what was seen, doesn't grow with the number of files; ``files_per_trigger`` bounds their number instead.
    """
    options = Options(tuple(globs or ()))

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_buffer()
                yield from event_batches(walk(io.BytesIO(data), len(data), options), 0, path)

    files = spark.readStream.format("binaryFile").schema(FILES).option(*(("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else ("maxBytesPerTrigger", TRIGGER_BYTES))).load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)
