"""Line operators over any DataFrame with a text column.

A row is a member: its text is cut into lines inside the row, all positional
work (limits, context, offsets) is done by array expressions over those lines,
and only the selected lines are exploded.  Nothing is shuffled, whatever the
keys, and a member is never spread over tasks that would have to meet again.
Arrays that belong together are zipped, not indexed inside lambdas: what a
lambda refers to from outside may be evaluated again for every element.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running_sum
from ..functions.regex_dialect import compile_patterns, needed_literal, plain_literal


@dataclass(frozen=True)
class Match:
    """What a line must match."""

    patterns: tuple[str, ...]
    fixed: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    word: bool = False
    invert: bool = False
    crlf: bool = False

    @classmethod
    def of(cls, *patterns: str, **options) -> Match:
        return cls(tuple(patterns), **options)

    @property
    def java(self) -> str:
        return compile_patterns(list(self.patterns), self.fixed, self.ignore_case, self.smart_case, self.word)

    @property
    def literal(self) -> str | None:
        return plain_literal(list(self.patterns), self.fixed, self.ignore_case, self.smart_case, self.word)

    @property
    def needed(self) -> str | None:
        """A literal that every line with a match holds."""
        return needed_literal(list(self.patterns), self.fixed, self.ignore_case, self.smart_case, self.word)

    def matched(self, line: Column) -> Column:
        """The body of a line under ``--crlf``: without one trailing carriage return."""
        return F.regexp_replace(line, "\\r$", "") if self.crlf else line

    def hit(self, line: Column) -> Column:
        """Whether a line is selected, the inversion included."""
        literal, needed = self.literal, self.needed
        if literal:
            found = F.contains(line, F.lit(literal))
        else:
            found = F.rlike(self.matched(line), F.lit(self.java))
            found = F.contains(line, F.lit(needed)) & found if needed else found
        return ~found if self.invert else found

    def may_hit(self, text: Column) -> Column | None:
        """A test of the whole text that every text with a hit passes, to be applied before lines are cut."""
        needed = self.needed
        return F.contains(text, F.lit(needed)) if needed and not self.invert else None


def line_array(text: Column) -> Column:
    """The lines of a text: split at line feeds, without the empty piece behind the last one."""
    pieces = F.split(text, "\n", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def lines_from_text(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line), one row a line."""
    t = F.col(text)
    pieces = F.split(F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t), "\n", -1)
    cut = df.filter(t != "").select(*keys, F.posexplode(pieces).alias("_n", "line"))
    return cut.select(*keys, (F.col("_n") + 1).cast("long").alias("line_no"), "line")


def match_lines(df: DataFrame, keys: list[str], m: Match, text: str = "text") -> DataFrame:
    """(keys, line_no, line) of the selected lines; a literal is looked for in generated code, a pattern by ``spans``."""
    if not m.literal:
        from .spans import selected_lines

        return selected_lines(df, keys, m, text)
    return lines_from_text(prefiltered(df, m, text), keys, text).filter(m.hit(F.col("line")))


def prefiltered(df: DataFrame, m: Match, text: str) -> DataFrame:
    """Members that can have a hit."""
    test = m.may_hit(F.col(text))
    return df if test is None else df.filter(test)


def count_lines(df: DataFrame, keys: list[str], m: Match, text: str = "text", limit: int | None = None) -> DataFrame:
    """(keys, n) of members with at least one selected line, at most ``limit`` counted."""
    n = F.size(F.filter(line_array(F.col(text)), lambda x: m.hit(x))).cast("long")
    if limit is not None:
        n = F.least(n, F.lit(limit).cast("long"))
    return prefiltered(df, m, text).select(*keys, n.alias("n")).filter("n > 0")


def count_matches(df: DataFrame, keys: list[str], m: Match, text: str = "text") -> DataFrame:
    """(keys, n) of single matches, several a line."""
    each = F.transform(line_array(F.col(text)), lambda x: F.regexp_count(m.matched(x), F.lit(m.java)).cast("long"))
    return prefiltered(df, m, text).select(*keys, F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).filter("n > 0")


def members_with_match(df: DataFrame, keys: list[str], m: Match, text: str = "text", without: bool = False) -> DataFrame:
    """The members with a selected line, or those without one."""
    has = F.exists(line_array(F.col(text)), lambda x: m.hit(x))
    return df.filter(~F.coalesce(has, F.lit(False))).select(*keys) if without else prefiltered(df, m, text).filter(has).select(*keys)


def only_matching(df: DataFrame, keys: list[str], m: Match, text: str = "text", offsets: bool = False) -> DataFrame:
    """(keys, line_no, match_no, match), one row a non-empty match; with ``offsets`` also its byte offset in the line."""
    if offsets:
        from .spans import matching_lines

        each = matching_lines(df, keys, m, text).select(*keys, "line_no", F.posexplode("matches").alias("_n", "x")).filter("x.text <> ''")
        return each.select(*keys, "line_no", (F.col("_n") + 1).cast("long").alias("match_no"), F.col("x.text").alias("match"), "x.start", "x.end")
    lines = match_lines(df, keys, m, text)
    found = F.regexp_extract_all(m.matched(F.col("line")), F.lit(m.java), F.lit(0))
    out = lines.select(*keys, "line_no", F.posexplode(found).alias("_n", "match"))
    return out.filter("match <> ''").select(*keys, "line_no", (F.col("_n") + 1).cast("long").alias("match_no"), "match")


def context_lines(df: DataFrame, keys: list[str], m: Match, before: int = 0, after: int = 0, limit: int | None = None, text: str = "text") -> DataFrame:
    """(keys, line_no, line, kind, group_break): selected lines with their context, overlapping windows merged.

    With ``limit`` only the first so many hits of a member open a window;
    further hits inside the last one are still of kind ``match``.
    """
    rows = prefiltered(df, m, text).select(*keys, line_array(F.col(text)).alias("_l"))
    hits = F.array_remove(F.transform("_l", lambda x, i: F.when(m.hit(x), i + 1).otherwise(0)), 0)
    rows = rows.withColumn("_k", hits if limit is None else F.slice(hits, 1, limit))
    # windows ascend, so their lines do too
    around = F.transform("_k", lambda k: F.sequence(F.greatest(k - before, F.lit(1)), F.least(k + after, F.size("_l"))))
    rows = rows.withColumn("_s", F.array_distinct(F.flatten(around))).filter(F.size("_s") > 0)
    pairs = F.arrays_zip(F.col("_s").alias("n"), F.slice(F.concat(F.array(F.get("_s", F.lit(0))), F.col("_s")), 1, F.size("_s")).alias("p"))
    item = F.transform(pairs, lambda z: F.struct(z["n"].cast("long").alias("line_no"), F.get("_l", z["n"] - 1).alias("line"), (z["n"] - z["p"] > 1).alias("group_break")))
    shown = rows.select(*keys, F.explode(item).alias("x"))
    return shown.select(*keys, "x.line_no", "x.line", F.when(m.hit(F.col("x.line")), "match").otherwise("context").alias("kind"), "x.group_break")


def max_count(df: DataFrame, keys: list[str], m: Match, limit: int, text: str = "text") -> DataFrame:
    """(keys, line_no, line): the first ``limit`` selected lines of each member."""
    if limit <= 0:
        return match_lines(df, keys, m, text).filter(F.lit(False))
    hits = F.filter(F.transform(line_array(F.col(text)), lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line"))), lambda x: m.hit(x["line"]))
    return prefiltered(df, m, text).select(*keys, F.explode(F.slice(hits, 1, limit)).alias("h")).select(*keys, "h.line_no", "h.line")


def byte_offsets(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, byte_offset, line): where every line starts in its member."""
    rows = df.withColumn("_l", line_array(F.col(text)))
    rows = rows.withColumn("_b", F.transform("_l", lambda x: (F.octet_length(x) + 1).cast("long")))
    rows = rows.withColumn("_o", running_sum(F.col("_b"), inclusive=False))
    cut = rows.select(*keys, F.posexplode(F.arrays_zip("_l", "_o")).alias("_n", "x"))
    return cut.select(*keys, (F.col("_n") + 1).cast("long").alias("line_no"), F.col("x._o").alias("byte_offset"), F.col("x._l").alias("line"))


def member_stats(df: DataFrame, keys: list[str], m: Match, text: str = "text") -> DataFrame:
    """(keys, matched_lines, matches, bytes_searched, has_match) of every member."""
    zero = F.lit(0).cast("long")
    count = lambda x: F.regexp_count(m.matched(x), F.lit(m.java)).cast("long")
    # of an inverted search, lines without a match: no matches in them
    each = lambda x: F.when(m.hit(x), F.lit(0).cast("long") if m.invert else F.greatest(count(x), F.lit(1).cast("long")))
    rows = df.select(*keys, F.octet_length(text).cast("long").alias("bytes_searched"), F.array_compact(F.transform(line_array(F.col(text)), each)).alias("_c"))
    return rows.select(*keys, F.size("_c").cast("long").alias("matched_lines"), F.aggregate("_c", zero, lambda s, x: s + x).alias("matches"), "bytes_searched", (F.size("_c") > 0).alias("has_match"))


def run_summary(stats: DataFrame) -> DataFrame:
    """One row: searches, those with a match, and the sums of the members' figures."""
    zero = F.lit(0).cast("long")
    return stats.agg(
        F.count(F.lit(1)).alias("searches"), F.coalesce(F.sum(F.col("has_match").cast("long")), zero).alias("searches_with_match"), F.coalesce(F.sum("bytes_searched"), zero).alias("bytes_searched"),
        F.coalesce(F.sum("matched_lines"), zero).alias("matched_lines"), F.coalesce(F.sum("matches"), zero).alias("matches"),
    )


def display_path(archive: Column, member: Column, separator: str = ":") -> Column:
    """archive, separator, member; the archive alone for an anonymous member."""
    return F.when(member == "", archive).otherwise(F.concat(archive, F.lit(separator), member))


def json_events(df: DataFrame, path: Column, m: Match, text: str = "text") -> DataFrame:
    """(path, seq, event): JSON lines of every member with a match - begin, its matches, end - with byte offsets."""
    from .spans import matching_lines

    rows = matching_lines(df.select(path.alias("path"), text), ["path"], m, text, totals=True)
    name = F.struct(F.col("path").alias("text")).alias("path")
    subs = F.transform("matches", lambda x: F.struct(F.struct(x["text"].alias("text")).alias("match"), x["start"].alias("start"), x["end"].alias("end")))
    match = F.struct(F.lit("match").alias("type"), F.struct(name, F.struct(F.concat("line", F.lit("\n")).alias("text")).alias("lines"), F.col("line_no").alias("line_number"), F.col("byte_offset").alias("absolute_offset"), subs.alias("submatches")).alias("data"))
    begin = F.struct(F.lit("begin").alias("type"), F.struct(name).alias("data"))
    end = F.struct(F.lit("end").alias("type"), F.struct(name, F.struct(F.col("member_lines").alias("matched_lines"), F.col("member_matches").alias("matches")).alias("stats")).alias("data"))
    event = lambda seq, body: F.struct(seq.cast("long").alias("seq"), F.to_json(body).alias("event"))
    events = F.array(F.when(F.col("first"), event(F.lit(0), begin)), event(F.col("line_no"), match), F.when(F.col("last"), event(F.lit(1 << 62), end)))
    return rows.select("path", F.inline(F.array_compact(events)))


def capped(df: DataFrame, keys: list[str], order: list[str], limit: int = 100) -> DataFrame:
    """The first ``limit`` rows of each key, with ``more``: how many the key has besides."""
    from pyspark.sql import Window

    first = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= limit).drop("_rank")
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    joined = first.join(total, keys)
    return joined.withColumn("more", F.greatest(F.col("_c") - limit, F.lit(0)).cast("long")).drop("_c")


def identity_rows(items: DataFrame, identity: list[str], position: str, name: str) -> DataFrame:
    """Every item with the first of its identity, in columns (first_position, first_name), and how many items there are of it.

    A row an item, so an identity of any number of names holds no more than its
    smallest item and a count; a null identity is one like any other.
    """
    taken = [f"_{c}" for c in identity]
    first = items.groupBy(*identity).agg(F.min(F.struct(position, name)).alias("_f"), F.count(F.lit(1)).alias("n_names"))
    first = first.select(*(F.col(c).alias(t) for c, t in zip(identity, taken)), F.col("_f")[position].alias("first_position"), F.col("_f")[name].alias("first_name"), "n_names")
    same = [items[c].eqNullSafe(first[t]) for c, t in zip(identity, taken)]
    return items.join(first, same).drop(*taken)


def first_of_identity(items: DataFrame, identity: list[str], position: str, name: str) -> DataFrame:
    """Items that are the first of their identity, with the other names of it as ``aliases``."""
    groups = items.groupBy(*identity).agg(F.array_sort(F.collect_list(F.struct(position, name))).alias("g"))
    return groups.select(F.col("g")[0][position].alias(position), F.col("g")[0][name].alias(name), F.transform(F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), lambda x: x[name]).alias("aliases"))


def verdict(found: DataFrame, matched: Column, failed: Column) -> DataFrame:
    """One row (matched, partial, exit_code): 2 if anything was not read, else 0 with a match and 1 without."""
    agg = found.agg(F.coalesce(F.bool_or(matched), F.lit(False)).alias("matched"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("partial"))
    return agg.withColumn("exit_code", F.when(F.col("partial"), 2).when(F.col("matched"), 0).otherwise(1))
