"""A run's table while it is being written: a segment is what one task reads - inputs, or ranges of such - and published as the task ends.

The write goes on in a thread of its own.  Tasks move their file to its place
when they commit, under a name with the number of their partition, so what is
there is whole, and a task that runs again replaces what it left.  The reader
takes segments by number, or as they come, and holds one batch of rows at a time.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from ..sources.ranged import opened
from .scratch import scratch_path

BATCH = 4096


class Segments:
    def __init__(self, df: DataFrame, tag: str):
        self.spark: SparkSession = df.sparkSession
        self.path, self.schema = scratch_path(self.spark, tag), df.schema
        self.group, self.error = f"segments-{uuid.uuid4().hex}", None
        self.cancelled = False
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._folder, self._store = folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._thread = threading.Thread(target=self._write, args=(df,), daemon=True)
        self._thread.start()

    def _write(self, df: DataFrame) -> None:
        try:
            self.spark.sparkContext.setJobGroup(self.group, "a run's segments", interruptOnCancel=True)
            df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)
        except BaseException as e:  # noqa: BLE001  told by finish
            self.error = e

    def published(self) -> dict[int, str]:
        """Files by the number of their partition."""
        if not self._store.exists(self._folder):
            return {}
        files = [s.getPath() for s in self._store.listStatus(self._folder)]
        return {int(m[1]): f.toString() for f in files if (m := re.match(r"part-(\d+)-", f.getName()))}

    def files(self, ordered: bool) -> Iterator[str]:
        """The segments by number or as they are published, each as soon as it is there."""
        told, wait = 0, 0.02
        given: set[int] = set()
        while True:
            done = not self._thread.is_alive()
            found = self.published()
            ready = [k for k in sorted(found) if k not in given]
            if ordered and not done:  # a partition without rows has no file, which shows when all is written
                ready = [k for i, k in enumerate(ready) if k == told + i]
            for k in ready:
                given.add(k)
                told = k + 1
                yield found[k]
            if done and not ready:
                break
            if not ready:
                time.sleep(wait)
                wait = min(0.5, wait * 1.5)
            else:
                wait = 0.02
        if self.error is not None and not self.cancelled:
            raise self.error

    def rows(self, columns: list[str], ordered: bool) -> Iterator[list[dict]]:
        """Rows in batches, those of an input or range together and in order; an empty batch ends what is of one."""
        for file in self.files(ordered):
            last = None
            with opened(re.sub("^file:/+", "/", file)) as f:
                for batch in pq.ParquetFile(f).iter_batches(BATCH, columns=columns):
                    for own, rows in groupby(batch.to_pylist(), key=itemgetter("item_index", "part")):
                        if last not in (None, own):
                            yield []
                        last = own
                        yield list(rows)
            yield []

    def cancel(self) -> None:
        """Stop the reading."""
        self.cancelled = True
        while self._thread.is_alive():
            self.spark.sparkContext.cancelJobGroup(self.group)
            self._thread.join(0.2)

    def finish(self) -> DataFrame:
        """The whole table, when it is written."""
        self._thread.join()
        if self.error is not None:
            raise self.error
        return self.spark.read.schema(self.schema).parquet(self.path)
