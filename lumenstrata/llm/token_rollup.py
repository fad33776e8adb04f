"""Token counts as delta-maintained rollups.

Counts per document are kept as signed entries, one folder a batch; the totals
by source, language and tokenizer version are the sums of the batches' deltas
and are never recomputed from texts.  A batch is written to a folder of its own
and published by creating the next manifest, a small file that names all valid
folders and committed batches.  A manifest is created only if it is not there
yet, so of two drivers one commits and the other looks again; a batch that is
committed already, or whose first attempt died, changes nothing twice.  Folders
that have become many are compacted into one: what holds now, and its totals.
(On a store without exclusive creation, run one committing driver at a time.)

Defined results: null texts count 0 tokens and one document, null sources and
languages are groups of their own; inserting a known document revises it;
deleting or revising an unknown document does as much as there is to do;
several changes of one document in a batch count in the order given, else the
last by the change's own columns; where that one inserts, all rows that insert
the document at its place in the order count; every row without an id is a
document of its own, which later changes don't name (deleting one does
nothing); an empty batch is a valid batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

KEYS = ("source", "lang", "version")
ENTRIES = "doc_id long, source string, lang string, version string, d_docs long, d_tokens long"
#: Folders from which they are compacted before a commit.
FAN_IN = 8
DELTAS = "source string, lang string, version string, d_docs long, d_tokens long"


class BpeCounter:
    """Token counts of a byte-level BPE by rank file."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


def count_words(text: str) -> int:
    return len(text.encode().split())


def count_tokens(docs: DataFrame, counters: dict[str, Callable[[], Callable[[str], int]]], text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, source, lang, version, n_tokens): one row per document and tokenizer version.

    ``counters`` maps a version to a factory that runs once per task.
    """
    versions = sorted(counters)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def make():
        made = [counters[v]() for v in versions]

        def each(texts, _):
            rows = [[c(t.decode()) if t else 0 for c in made] for t in texts]
            return [pa.array(rows, pa.list_(pa.int64()))]

        return each

    counted = map_text(own, [("counts", T.ArrayType(T.LongType()))], "text", make).drop("text")
    named = F.explode(F.arrays_zip(F.array(*map(F.lit, versions)).alias("version"), F.col("counts").alias("n_tokens"))).alias("c")
    return counted.select("doc_id", "source", "lang", named).select("doc_id", "source", "lang", "c.version", "c.n_tokens")


class TokenRollup:
    """Committed batches of signed counts below one folder."""

    def __init__(self, spark: SparkSession, path: str, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path.rstrip("/"), fan_in
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _manifest(self) -> tuple[int, dict]:
        """The number of the next manifest, and the last whole one."""
        root = self._p(f"{self.path}/manifests")
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(root)), reverse=True) if self._fs.exists(root) else []
        names = [n for n in names if n.isdigit()]
        for name in names:
            stream = self._fs.open(self._p(f"{self.path}/manifests/{name}"))
            try:
                said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                return int(names[0]) + 1, said
            except ValueError:  # its driver died while it was written
                continue
            finally:
                stream.close()
        return int(names[0]) + 1 if names else 0, {"batches": [], "folders": []}

    def _publish(self, number: int, said: dict) -> bool:
        """Create a manifest; False if there is one of that number."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self._p(f"{self.path}/manifests/{number:012d}"), False)
        except Py4JJavaError as e:
            if "exist" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        return True

    def batches(self) -> list[str]:
        return sorted(self._manifest()[1]["batches"])

    def _read(self, part: str, schema: str, folders: list[str] | None = None) -> DataFrame:
        folders = self._manifest()[1]["folders"] if folders is None else folders
        paths = [f"{self.path}/data/{f}/{part}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, tag: str, entries: DataFrame) -> str:
        """Entries and their deltas in a folder of their own."""
        folder = f"{tag}-{uuid.uuid4().hex}"
        entries.write.parquet(f"{self.path}/data/{folder}/entries")
        written = self._read("entries", ENTRIES, [folder])
        written.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(f"{self.path}/data/{folder}/deltas")
        return folder

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._p(f"{self.path}/data/{folder}"), True)

    # counts

    def entries(self, folders: list[str] | None = None) -> DataFrame:
        return self._read("entries", ENTRIES, folders)

    def state(self, folders: list[str] | None = None) -> DataFrame:
        """The counts that hold now, one row per document and version."""
        now = self.entries(folders).groupBy("doc_id", *KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        return now.filter("d_docs <> 0 or d_tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes; False, with nothing done, if it is already committed.

        ``changes``: doc_id, source, lang, version, n_tokens and op (insert,
        revise or delete; a null op inserts); an optional ``seq`` orders the
        changes of one document.
        """
        while True:
            number, said = self._manifest()
            if batch in said["batches"]:
                return False
            if len(said["folders"]) >= self.fan_in:
                self.compact()
                continue
            folder = self._write("batch", self._entries_of(changes, said["folders"]))
            if self._publish(number, {"batches": [*said["batches"], batch], "folders": [*said["folders"], folder]}):
                return True
            self._drop(folder)  # another driver came first: what holds now may be something else

    def _entries_of(self, changes: DataFrame, folders: list[str]) -> DataFrame:
        """What a batch adds, and what it takes back of the counts that hold."""
        own = changes.withColumns({"op": F.coalesce(F.lower("op"), F.lit("insert")), "seq": F.col("seq") if "seq" in changes.columns else F.lit(0)})
        total = F.sum(F.coalesce("n_tokens", F.lit(0))).alias("total")
        new = own.groupBy("doc_id", *KEYS, "op", "seq").agg(F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n"), total)
        change = F.struct("seq", "n_tokens", "source", "lang", "op")
        last = new.filter("doc_id is not null").groupBy(F.col("doc_id").alias("i"), F.col("version").alias("v")).agg(F.max(change).alias("last"))
        same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("version").eqNullSafe(F.col("v"))
        new = new.join(last, same, "left").drop("i", "v")  # rows without an id, which may be many, are nowhere one group
        each = F.col("doc_id").isNull() | (F.col("op") == "insert") & (F.col("last.op") == "insert") & F.col("seq").eqNullSafe(F.col("last.seq"))
        plus = new.filter((F.col("op") != "delete") & (each | change.eqNullSafe(F.col("last"))))
        one = F.lit(1).cast("long"), F.coalesce("n_tokens", F.lit(0))
        entries = plus.select("doc_id", *KEYS, F.when(each, F.col("n")).otherwise(one[0]).alias("d_docs"), F.when(each, F.col("total")).otherwise(one[1]).cast("long").alias("d_tokens"))
        if folders:
            touched = last.select("i", "v")
            minus = self.state(folders).join(touched, same, "left_semi")
            entries = entries.unionByName(minus.withColumns({"d_docs": -F.col("d_docs"), "d_tokens": -F.col("d_tokens")}))
        return entries

    def compact(self) -> bool:
        """Put all folders into one; False if another driver changed them meanwhile."""
        number, said = self._manifest()
        if len(said["folders"]) < 2:
            return True
        folder = self._write("compact", self.state(said["folders"]))
        if not self._publish(number, {"batches": said["batches"], "folders": [folder]}):
            self._drop(folder)
            return False
        for old in said["folders"]:
            self._drop(old)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens): sums of the committed deltas."""
        out = self._read("deltas", DELTAS).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 or n_tokens <> 0")
