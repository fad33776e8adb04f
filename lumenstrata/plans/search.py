"""A search as DataFrames over the tagged scan: its hits, its members, its diagnostics and its verdict.

The scan always runs to the end of every input: limits and early answers cut
what is shown, never what is read, since the verdict says whether everything
was.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lines import display_path
from ..sources import archive
from ..sources.matching import Wanted
from ..sources.resolve import Resolved
from ..sources.walk import FIRST_FILL
from .scratch import remove
from .segments import Segments
from .spec import SearchSpec

MEMBER = ["item_index", "member_index"]


def joined_ranges(table: DataFrame, windows: bool) -> DataFrame:
    """A run's table with the ranges of plain inputs put together: lines are numbered, muted behind a NUL, and end where a range failed.

    A range has one row of figures; their running sums, a row a range as well,
    are what the lines are joined with.
    """
    key = ["item_index", "part"]
    ranges = table.filter("rec_type = 'range'").select(*key, F.col("line_no").alias("_n"), F.col("n").alias("_nul"), F.col("muted").alias("_failed"))
    if windows:
        edge = table.filter("rec_type = 'line' and part is not null").groupBy(*key).agg(F.min("line_no").alias("_first"), F.max("line_no").alias("_end"))
        ranges = ranges.join(edge, key, "left")
    before = Window.partitionBy("item_index").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("item_index")
    ranges = ranges.withColumns({
        "_base": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_nul_at": F.min("_nul").over(whole), "_muted": F.min("_nul").over(before).isNotNull() | F.coalesce(F.min("_nul").over(whole) < FIRST_FILL, F.lit(False)),
        "_gone": F.coalesce(F.bool_or("_failed").over(before), F.lit(False)),
    })
    if windows:
        ranges = ranges.withColumn("_last", F.max(F.col("_end") + F.col("_base")).over(before))
    out = table.join(ranges.drop("_n", "_nul", "_failed", "_end"), key, "left")
    later = F.col("part").isNotNull() & (F.col("_gone") | (F.col("rec_type") == "binary") & (F.col("byte_offset") != F.col("_nul_at")))
    out = out.filter(~F.coalesce(later, F.lit(False)) | F.col("rec_type").isin("member", "end"))
    is_line = (F.col("rec_type") == "line") & F.col("part").isNotNull()
    if windows:
        apart = F.coalesce(F.col("line_no") + F.col("_base") - F.col("_last") > 1, F.lit(False))
        out = out.withColumn("group_break", F.when(is_line & (F.col("line_no") == F.col("_first")), apart).otherwise(F.col("group_break")))
    out = out.withColumns({"line_no": F.when(is_line, F.col("line_no") + F.col("_base")).otherwise(F.col("line_no")), "muted": F.when(is_line, F.col("muted") | F.col("_muted")).otherwise(F.col("muted"))})
    return out.select(*table.columns)


@dataclass
class Run:
    """The parts of a run.  ``table`` reads every input once: what is shown of it, and all records that are no lines."""

    spec: SearchSpec
    resolved: Resolved
    scanned: DataFrame
    #: Some inputs are read in ranges; all partitions of the scan hold inputs, in order, or ranges of such.
    ranged: bool = False
    streams: bool = False
    #: Errors of the inputs whose rows have been given.
    told_errors: int = 0

    def display(self, sep: str | None = None) -> Column:
        return display_path(F.col("archive"), F.col("member"), sep or self.spec.separator)

    def selected(self) -> DataFrame:
        """``scanned`` with kind and group_break, without the lines that are not shown; ``n_lines`` and ``n`` are the lines and matches that a row stands for."""
        s = self.spec
        if s.what == "whole":
            return self.scanned  # its reader has left out the others
        return self.scanned.drop("hit").withColumns({"kind": F.when(F.col("rec_type").isin("line", "hits"), "match"), "group_break": F.lit(False)})

    @cached_property
    def segments(self) -> Segments:
        """The run itself: from here on it reads."""
        return Segments(self.selected(), "run")

    @cached_property
    def table(self) -> DataFrame:
        """All that ``selected`` gives, written once."""
        out = self.segments.finish()
        return joined_ranges(out, self.spec.what == "whole") if self.ranged else out

    def rows(self) -> Iterator[list[dict]]:
        """The table's rows in batches, an input's together, while other inputs are still read; an empty batch ends an input or a range of one.

        Inputs come in their order, or as they end if the run is not to be sorted and none is read in ranges.
        Where Spark's own reader takes part, they come in order when all is read.
        """
        columns = ["rec_type", *MEMBER, "archive", "member", "line_no", "byte_offset", "line", "eol", "muted", "severity", "spans", "n_lines", "n", "part", "kind", "group_break"]
        if self.streams:
            yield from self.segments.rows(columns, self.spec.sort or self.ranged)
            return
        batch: list[dict] = []
        for r in self.segments.finish().select(columns).orderBy(*MEMBER, "line_no").toLocalIterator(True):
            batch.append(r.asDict())
            if len(batch) == 1024:
                yield batch
                batch = []
        yield batch
        yield []

    def close(self) -> None:
        """Remove what the run has written, the copy of standard input included."""
        if "segments" in self.__dict__:
            if self.segments.error is None:
                self.segments.cancel()
            remove(self.scanned.sparkSession, self.segments.path)
            del self.segments
            self.__dict__.pop("table", None)
        for item in self.resolved.items:
            if item.display == "<stdin>":
                remove(self.scanned.sparkSession, item.path if item.remote else f"file://{item.path}")

    def hits(self) -> DataFrame:
        """Lines to show, in no order: kind, group_break, display and the rest of the line's columns."""
        return self.table.filter("rec_type = 'line'").withColumn("display", self.display())

    def counts(self) -> DataFrame:
        """(item_index, member_index, display, n): lines, or with -o matches, of members that have any; with -m, of the first so many lines."""
        s = self.spec
        hits = self.table.filter("kind = 'match'").withColumn("display", self.display())
        if s.max_count and s.what == "whole":  # windows hold further hits
            rank = F.row_number().over(Window.partitionBy(*MEMBER).orderBy("line_no"))
            hits = hits.withColumn("_k", rank).filter(F.col("_k") <= s.max_count)
        n = F.sum("n") if s.only_matching and not s.invert else F.sum("n_lines")
        return hits.groupBy(*MEMBER, "display").agg(n.cast("long").alias("n"))

    def members(self) -> DataFrame:
        return archive.members(self.table).withColumn("display", self.display())

    def binary_matches(self) -> DataFrame:
        """Members whose hits are in muted lines: what the notice says about them."""
        found = self.hits().filter("muted and kind = 'match'").select(*MEMBER).distinct()
        return self.table.filter("rec_type = 'binary'").select(*MEMBER, "archive", "member", F.col("byte_offset").alias("offset")).join(found, MEMBER).withColumn("display", self.display())

    def diagnostics(self) -> DataFrame:
        """Errors and notes; an input without either or a match, whose format can't tell a whole stream from a cut one, gets a note."""
        said = archive.diagnostics(self.table)
        clear = F.count_if((F.col("rec_type") == "diag") & (F.col("severity") == "error") | (F.col("kind") == "match")) == 0
        ends = self.table.groupBy("item_index", "archive").agg(F.max(F.when(F.col("rec_type") == "end", F.col("message"))).alias("message"), clear.alias("clear")).filter("clear and message is not null")
        note = ends.select("item_index", "archive", F.lit(None).cast("long").alias("member_index"), F.lit(None).cast("string").alias("member"), F.lit("note").alias("severity"), F.lit("UNVERIFIED_END").alias("code"), "message")
        return said.unionByName(note)

    def outcomes(self) -> DataFrame:
        return archive.outcomes(self.table)

    def figures(self) -> DataFrame:
        """One row: what the verdict is made of, over every record of the run."""
        s = self.spec
        end = F.col("rec_type") == "end"
        hit = F.col("rec_type") == "member" if s.list_members else F.col("kind") == "match"
        total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
        return self.table.agg(
            F.coalesce(F.bool_or(hit), F.lit(False)).alias("matched"), F.count_if((F.col("rec_type") == "diag") & (F.col("severity") == "error")).alias("errors"), F.count_if(end).alias("ends"),
            F.count_if(F.col("rec_type") == "member").alias("members"), total("seen").alias("seen"), (F.count_if(hit) if s.list_members else total(F.when(hit, F.col("n_lines")))).alias("matched_lines"), total(F.when(F.col("kind") == "match", F.col("n"))).alias("matches"),
            F.count_distinct(F.when(F.col("kind") == "match", F.struct(*MEMBER))).alias("searches_with_match"), total(F.when(F.col("rec_type").isin("end", "part", "range"), F.col("byte_offset"))).alias("bytes_searched"),
        )

    def verdict(self) -> dict:
        """matched, partial, exit_code and the figures of the run."""
        s, row = self.spec, self.figures().first()
        errors = [*self.resolved.errors]
        if len(self.resolved.items) > row["ends"]:
            errors.append(("WORKER_DIED", "an input was not walked to its end"))
        if s.globs and not row["members"] and row["seen"] and not row["errors"]:
            errors.append(("MEMBER_GLOB_EMPTY", "the globs leave no member of any archive"))
        partial = bool(errors) or row["errors"] > 0
        return {
            "matched": row["matched"], "partial": partial, "exit_code": 2 if partial else 0 if row["matched"] else 1, "errors": errors,
            "stats": {"searches": row["members"], "searches_with_match": row["searches_with_match"], "matched_lines": row["matched_lines"], "matches": row["matches"], "bytes_searched": row["bytes_searched"]},
        }


def search(spark: SparkSession, spec: SearchSpec, range_bytes: int | None = None) -> Run:
    """A run over the named inputs.  A literal that every hit holds is looked for before lines are cut; plain inputs beyond ``range_bytes`` are read in ranges."""
    literal = None if spec.invert or spec.list_members or spec.what == "whole" else spec.match.needed
    m = spec.match
    wanted = None
    if not spec.list_members:
        patterns = dict(patterns=m.patterns, fixed=m.fixed, ignore_case=m.ignore_case, smart_case=m.smart_case, word=m.word, invert=m.invert, crlf=m.crlf)
        wanted = Wanted(**patterns, what=spec.what, spans=spec.spans, limit=spec.max_count, together=spec.mode == "quiet")
    scanned, found = archive.scan(spark, spec.paths, spec.archive_globs, spec.globs, spec.text, spec.crlf, lines=not spec.list_members, literal=literal or "", wanted=wanted, around=max(spec.lines_before, spec.lines_after), range_bytes=range_bytes, ordered=spec.sort, windows=(spec.lines_before, spec.lines_after, spec.max_count or None) if wanted and spec.what == "whole" else None)
    ranged = wanted is not None and not wanted.limit and any(archive.in_ranges(i, range_bytes) for i in found.items if not i.remote or archive.reachable(i.path))
    return Run(spec, found, scanned, ranged, all(not i.remote or archive.reachable(i.path) for i in found.items))
