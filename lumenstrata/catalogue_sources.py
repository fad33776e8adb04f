"""Queries over archives on disk: the documents are packed into archives, and a run reads them as a user's would.

Archive ``k`` of a kind holds the documents whose id divided by ``MEMBERS`` is
``k``, so archives are of bounded size; a document is the member
``logs/<lang>/<id>.log``.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import ORACLES, QUERIES, SPANNED, _context, _docs, _lines, _spans_sql, query
from .plans.scratch import scratch_path
from .plans.search import Run, search
from .plans.spec import parse
from .sources import archive as sources
from .sources.build import archive as packed_as
from .sources.resolve import resolve

MEMBERS = 64
SUFFIX = {"plain": "log"}
#: SQL for the name of a document's archive and member.
NAMED = "lpad((doc_id // 64)::VARCHAR, 6, '0')", "'logs/' || lang || '/' || doc_id::VARCHAR || '.log'"


def pack(docs: DataFrame, folder: str, kind: str, body: Column | None = None, wrap: Callable[[bytes], bytes] | None = None, around: Callable[[bytes], bytes] | None = None, place: str = "") -> str:
    """Write the documents as archives below ``folder``, which all executors see.

    ``body`` is a member's content, ``wrap`` changes it, ``around`` changes a whole
    archive, ``place`` names a folder by an SQL expression over ``k``.
    """
    rows = docs.select(
        F.floor(F.col("doc_id") / MEMBERS).cast("long").alias("k"), "doc_id", F.format_string("logs/%s/%d.log", "lang", "doc_id").alias("name"),
        (F.encode(F.col("text"), "UTF-8") if body is None else body).alias("data"),
    )
    rows = rows.withColumn("place", F.expr(place or "''"))
    suffix = SUFFIX.get(kind, kind)

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        members = [(name, (wrap or bytes)(data)) for name, data in zip(t["name"].to_pylist(), t["data"].to_pylist())]
        whole = b"\n".join(data for _, data in members) if kind == "plain" else packed_as(members, kind)
        path = os.path.join(folder, t["place"][0].as_py(), f"{t['k'][0].as_py():06d}.{suffix}")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{os.getpid()}", "wb") as f:  # a task that runs again replaces what it left
            f.write((around or bytes)(whole))
        os.replace(f"{path}.{os.getpid()}", path)
        return pa.table({"path": [path]})

    rows.groupBy("k").applyInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return folder


def run(spark: SparkSession, sf_dir: str, kind: str, *args: str, scheme: str = "", **how) -> Run:
    folder = scratch_path(spark, "archives").removeprefix("file://")
    pack(_docs(spark, sf_dir), folder, kind, **how)
    return search(spark, parse([*args, scheme + folder]))


def named(df: DataFrame) -> DataFrame:
    """``df`` with the archive's number as ``k`` and the member's ``doc_id``."""
    return df.withColumns({"k": F.regexp_extract("archive", r"([0-9]{6})[.][^/]*$", 1), "doc_id": F.regexp_extract("member", r"([0-9]+)[.]log$", 1).cast("long")})


def shown(r: Run, *more: str) -> DataFrame:
    return named(r.hits()).select("doc_id", "line_no", F.col("line").cast("string").alias("line"), *more)


def _hits_sql(test: str = "contains(line, 'ation')", more: str = "") -> str:
    return f"WITH {_lines()} SELECT doc_id, line_no, line{more} FROM l WHERE {test}"


for _kind in ("tar", "zip", "tar.gz", "tar.bz2", "tar.xz", "tar.zst", "tar.lz4", "tar.lz4l", "tar.Z"):
    _name = "archive_scan_" + _kind.removeprefix("tar.").lower()
    QUERIES[_name], ORACLES[_name] = (lambda spark, sf_dir, kind=_kind: shown(run(spark, sf_dir, kind, "ation"))), _hits_sql()


# what a run reads


@query(f"SELECT {NAMED[0]} AS k, {NAMED[1]} AS member, 'tar.gz' AS outer_format FROM documents")
def source_list(spark, sf_dir):
    """-T"""
    r = run(spark, sf_dir, "tar.gz", "-T")
    return named(r.members()).select("k", "member", F.replace("outer_format", F.lit("gzip"), F.lit("gz")).alias("outer_format"))


@query(f"SELECT {NAMED[1]} AS member FROM documents WHERE regexp_matches({NAMED[1]}, '^logs/(de|fr)/.*$') AND NOT doc_id % 10 = 7")
def source_member_glob(spark, sf_dir):
    """-g on whole member paths, the last rule that fits wins"""
    return run(spark, sf_dir, "tar.zst", "-T", "-g", "logs/{de,fr}/*", "-g", "!*7.log").members().select("member")


@query(f"WITH {_lines()} SELECT doc_id, line_no, line FROM l WHERE contains(line, 'ation') AND (doc_id // 64) % 4 = 2")
def source_archive_glob(spark, sf_dir):
    """--archive-glob with a slash, judged below the named folder"""
    return shown(run(spark, sf_dir, "zip", "--archive-glob", "two/*.zip", "ation", place="element_at(array('zero', 'one', 'two', 'one/two'), cast(k % 4 + 1 as int))"))


@query(f"SELECT DISTINCT {NAMED[0]} AS k, (doc_id // 64) % 3 = 0 AS linked FROM documents")
def source_aliases(spark, sf_dir):
    """A file with several names is read once"""
    folder = pack(_docs(spark, sf_dir), scratch_path(spark, "archives").removeprefix("file://"), "tar")
    for name in sorted(os.listdir(folder)):
        if int(name[:6]) % 3 == 0:
            os.makedirs(f"{folder}/zz", exist_ok=True)
            os.link(f"{folder}/{name}", f"{folder}/zz/again-{name}")
    found = resolve([folder])
    return spark.createDataFrame([(os.path.basename(i.path)[:6], bool(i.aliases)) for i in found.items], "k string, linked boolean")


@query(_hits_sql())
def source_by_scheme(spark, sf_dir):
    """Inputs that only Spark opens"""
    return shown(run(spark, sf_dir, "tar.gz", "ation", scheme="file://"))


@query(f"WITH p AS (SELECT doc_id // 64 AS k, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY k), {_lines('p', 'k')} SELECT lpad(k::VARCHAR, 6, '0') AS k, line_no, line FROM l WHERE contains(line, 'ation')")
def source_plain(spark, sf_dir):
    """Plain files are one anonymous member each"""
    r = run(spark, sf_dir, "plain", "ation")
    return named(r.hits()).select("k", "line_no", F.col("line").cast("string").alias("line"))


@query(_hits_sql("regexp_matches(line, '[a-z]+ation')"))
def source_zip_runs(spark, sf_dir):
    """Zips in runs of entries"""
    folder = pack(_docs(spark, sf_dir), scratch_path(spark, "archives").removeprefix("file://"), "zip")
    return shown(search(spark, parse(["[a-z]+ation", folder]), range_bytes=10_000))


_JOINED = "p AS (SELECT doc_id // 64 AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY ALL), "


@query(_context("regexp_matches(line, '[a-z]+ation')", 2, 1).replace("WITH ", "WITH " + _JOINED, 1).replace("FROM documents", "FROM p").replace("FROM p GROUP BY ALL", "FROM documents GROUP BY ALL"))
def source_plain_ranges(spark, sf_dir):
    """Plain files in many ranges each: line numbers, windows and breaks go on over their edges"""
    folder = pack(_docs(spark, sf_dir), scratch_path(spark, "archives").removeprefix("file://"), "plain")
    found = search(spark, parse(["-B", "2", "-A", "1", "[a-z]+ation", folder]), range_bytes=20_000).hits()
    return named(found).select(F.col("k").cast("long").alias("doc_id"), "line_no", F.col("line").cast("string").alias("line"), "kind", "group_break")


@query(_hits_sql())
def source_nested(spark, sf_dir):
    """Members are taken out of one level of compression"""
    import gzip

    return shown(run(spark, sf_dir, "tar.xz", "ation", wrap=gzip.compress))


@query(f"WITH {_lines()} SELECT doc_id, count(*) * 2 AS n FROM l WHERE contains(line, 'ation') GROUP BY doc_id")
def source_concatenated(spark, sf_dir):
    """An archive behind another one in a file"""
    return shown(run(spark, sf_dir, "tar.gz", "ation", around=lambda b: b + b)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"WITH c AS (SELECT doc_id, replace(text, '. ', '.' || chr(13) || chr(10)) AS text FROM documents), " + _lines("c") + r" SELECT doc_id, line_no, regexp_replace(line, '\r$', '') AS line FROM l WHERE regexp_matches(regexp_replace(line, '\r$', ''), 'the\.$')")
def source_crlf(spark, sf_dir):
    return shown(run(spark, sf_dir, "tar.gz", "--crlf", r"the\.$", body=F.encode(F.replace("text", F.lit(". "), F.lit(".\r\n")), "UTF-8")))


@query(_hits_sql("regexp_matches(line, '^[A-Z][a-z]*ation')"))
def source_marked_utf16(spark, sf_dir):
    """Members in UTF-16 or UTF-8 with a byte order mark are read as UTF-8 behind it"""
    utf8, utf16 = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")), F.encode("text", "UTF-16")
    return shown(run(spark, sf_dir, "zip", "^[A-Z][a-z]*ation", body=F.when(F.col("doc_id") % 2 == 0, utf8).otherwise(utf16)))


# what it shows


@query(f"WITH {_lines()}, o AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM l) SELECT doc_id, line_no, byte_offset, line FROM o WHERE contains(line, 'ation')")
def source_offsets(spark, sf_dir):
    return shown(run(spark, sf_dir, "tar.bz2", "ation"), "byte_offset")


@query(_context("regexp_matches(line, '[a-z]+ation')", 2, 1))
def source_context(spark, sf_dir):
    return shown(run(spark, sf_dir, "tar.gz", "-B", "2", "-A", "1", "[a-z]+ation"), "kind", "group_break")


@query(_context("contains(line, 'tion')", 0, 2, 1))
def source_max_count_context(spark, sf_dir):
    return shown(run(spark, sf_dir, "tar.zst", "-m", "1", "-A", "2", "tion"), "kind", "group_break")


@query(_context("NOT contains(line, 'tion')", 0, 3, 1))
def source_invert_max_count_after(spark, sf_dir):
    return shown(run(spark, sf_dir, "tar.lz4", "-v", "-m", "1", "-A", "3", "tion"), "kind", "group_break")


@query(f"WITH c AS ({_context("contains(line, 'ation')", 1, 0)}) SELECT {NAMED[0]} || '.tar.gz:' || {NAMED[1]} || CASE kind WHEN 'match' THEN ':' ELSE '-' END || line_no::VARCHAR || CASE kind WHEN 'match' THEN ':' ELSE '-' END || line AS text, group_break FROM c JOIN documents USING (doc_id)")
def source_rendered(spark, sf_dir):
    """Standard output, a row a line, and where ``--`` goes before it inside a member"""
    from .render import standard

    r = run(spark, sf_dir, "tar.gz", "-B", "1", "ation")
    return standard(r).select(F.regexp_replace("text", "^.*/(?=[0-9]{6}[.]tar[.]gz:)", "").alias("text"), "group_break")


@query(f"WITH {_lines()} SELECT doc_id, count(*) AS n FROM l WHERE contains(line, 'tion') GROUP BY doc_id")
def source_count(spark, sf_dir):
    return _counts(run(spark, sf_dir, "tar.gz", "-c", "tion"))


@query(f"WITH {_lines()} SELECT doc_id, sum(len(regexp_extract_all(line, 't[a-z]')))::BIGINT AS n FROM l GROUP BY doc_id HAVING n > 0")
def source_count_matches(spark, sf_dir):
    return _counts(run(spark, sf_dir, "tar.gz", "-c", "-o", "t[a-z]"))


@query(f"WITH {_lines()}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM l WHERE regexp_matches(line, 't[a-z]')) SELECT doc_id, sum(len(regexp_extract_all(line, 't[a-z]')))::BIGINT AS n FROM h WHERE r <= 2 GROUP BY doc_id")
def source_count_matches_capped(spark, sf_dir):
    """-c -o -m: the matches of the first so many lines"""
    return _counts(run(spark, sf_dir, "tar.gz", "-c", "-o", "-m", "2", "t[a-z]"))


def _counts(r: Run) -> DataFrame:
    return r.counts().select(F.regexp_extract("display", r"([0-9]+)[.]log$", 1).cast("long").alias("doc_id"), "n")


@query(f"WITH {_lines()} SELECT DISTINCT {NAMED[0]} || '.zip|' || {NAMED[1]} AS display FROM l JOIN documents USING (doc_id) WHERE regexp_matches(line, '^Re.*on')")
def source_files(spark, sf_dir):
    """-l with another separator"""
    r = run(spark, sf_dir, "zip", "-l", "--archive-sep", "|", "^Re.*on")
    return r.counts().select(F.regexp_extract("display", "[^/]*[|].*$", 0).alias("display"))


@query(f"SELECT {NAMED[0]} AS k, doc_id, (strlen(text) + 1)::BIGINT AS offset FROM documents WHERE doc_id % 5 = 0")
def source_binary_notice(spark, sf_dir):
    """A NUL makes a member binary: hits behind it, or in its member if it comes early, are told in a notice"""
    nul = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("0A00")), F.encode(F.lit("binary station"), "UTF-8"))
    r = run(spark, sf_dir, "tar.gz", "station", body=F.when(F.col("doc_id") % 5 == 0, nul).otherwise(F.encode("text", "UTF-8")))
    return named(r.binary_matches()).select("k", "doc_id", "offset")


def _events(r: Run) -> DataFrame:
    """The matches that ``--json`` tells, a row each."""
    found = r.hits().filter("kind = 'match'").withColumn("pairs", F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)))
    one = lambda i: F.struct((i / 2 + 1).cast("long").alias("match_no"), F.get("spans", i).alias("start"), F.get("spans", i + 1).alias("end"))
    return named(found).select("doc_id", "line_no", F.explode(F.transform("pairs", one)).alias("x")).select("doc_id", "line_no", "x.*")


@query(_spans_sql(_lines(), SPANNED))
def source_json_spans(spark, sf_dir):
    """--json: submatches of five patterns"""
    folder, out = scratch_path(spark, "archives").removeprefix("file://"), None
    pack(_docs(spark, sf_dir), folder, "tar.zst")
    runs = {name: search(spark, parse(["--json", "-e", pattern, folder])) for name, pattern in SPANNED.items()}
    for r in runs.values():
        r.segments  # noqa: B018  all begin to read
    for name, r in runs.items():
        found = _events(r).withColumn("name", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


@query(
    rf"""WITH {_lines()}, t AS (SELECT doc_id, line_no, regexp_extract_all(line, '[\pL\pM\p{{Nd}}\p{{Pc}}]+|[^\pL\pM\p{{Nd}}\p{{Pc}}]+') AS p FROM l WHERE contains(line, 'on') OR contains(line, 'ré')),
    x AS (SELECT doc_id, line_no, generate_subscripts(p, 1) AS k, unnest(p) AS piece FROM t), y AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc_id, line_no ORDER BY k)::BIGINT AS e FROM x)
    SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k) AS match_no, e - strlen(piece) AS start, e AS "end" FROM y WHERE piece IN ('on', 'ré')"""
)
def source_json_words(spark, sf_dir):
    """--json -w: words by Unicode's rules, beside letters that are not ASCII"""
    return _events(run(spark, sf_dir, "zip", "--json", "-w", "-e", "on", "-e", "ré"))


@query(rf"WITH {_lines()}, m AS (SELECT doc_id, line_no, regexp_extract_all(line, '[\x00-\x1f\x21-\x7f]+tion[^a-z \x80-\x{{10ffff}}]*') AS g FROM l) SELECT doc_id, line_no, generate_subscripts(g, 1)::BIGINT AS match_no, unnest(g) AS match FROM m")
def source_only_matching(spark, sf_dir):
    """-o over bytes that are not UTF-8: they match nothing, and what stands between them is cut out as it is"""
    r = run(spark, sf_dir, "tar.xz", "-o", r"[^ ]+tion[^a-z ]*", body=F.encode("text", "ISO-8859-1"))
    found = named(r.hits()).select("doc_id", "line_no", "line", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.slice("spans", i + 1, F.lit(2)))).alias("_n", "s"))
    part = F.expr("substring(line, cast(s[0] + 1 as int), cast(s[1] - s[0] as int))")
    return found.select("doc_id", "line_no", (F.col("_n") + 1).cast("long").alias("match_no"), part.cast("string").alias("match"))


@query("SELECT false AS matched, false AS partial, 1 AS exit_code, count(*) AS searches, 0::BIGINT AS matched_lines FROM documents")
def source_searches_nothing(spark, sf_dir):
    """-m 0 matches nothing, and still reads every archive to its end"""
    r = run(spark, sf_dir, "tar.gz", "-m", "0", "ation")
    v = r.verdict()
    return r.figures().select("matched", F.lit(v["partial"]).alias("partial"), F.lit(v["exit_code"]).alias("exit_code"), F.col("members").alias("searches"), "matched_lines")


@query("SELECT false AS matched, true AS partial, 2 AS exit_code, count(DISTINCT doc_id // 64) AS errors FROM documents")
def source_searches_nothing_of_cut_archives(spark, sf_dir):
    """-m 0 over archives that lack their last bytes"""
    r = run(spark, sf_dir, "tar.gz", "-m", "0", "ation", around=lambda b: b[:-6])
    v = r.verdict()
    return r.figures().select("matched", F.lit(v["partial"]).alias("partial"), F.lit(v["exit_code"]).alias("exit_code"), "errors")


@query(f"WITH {_lines()} SELECT DISTINCT {NAMED[0]} AS k, {NAMED[1]} AS member, 1::BIGINT AS n_lines FROM l JOIN documents USING (doc_id) WHERE contains(line, 'tion')")
def source_early_stop(spark, sf_dir):
    """-l: a row a member, whatever it holds"""
    r = run(spark, sf_dir, "tar.bz2", "-l", "tion", wrap=lambda b: b * 3)
    return named(r.table.filter("kind = 'match'")).select("k", "member", "n_lines")


# whether all was read


@query(
    f"""WITH {_lines()}, m AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, 'ation')) AS ml, sum(len(regexp_extract_all(line, 'ation'))) AS mm FROM l GROUP BY doc_id)
    SELECT bool_or(ml > 0) AS matched, count(*) AS searches, sum((ml > 0)::INT)::BIGINT AS searches_with_match, sum(ml)::BIGINT AS matched_lines, sum(mm)::BIGINT AS matches, sum(strlen(text))::BIGINT AS bytes_searched
    FROM documents LEFT JOIN m USING (doc_id)"""
)
def source_figures(spark, sf_dir):
    """The JSON summary's figures"""
    figures = run(spark, sf_dir, "tar.xz", "--json", "ation").figures()
    return figures.select("matched", F.col("members").alias("searches"), "searches_with_match", "matched_lines", "matches", "bytes_searched")


@query("SELECT true AS matched, true AS partial, 2 AS exit_code, count(DISTINCT doc_id // 64) AS errors FROM documents")
def source_verdict_of_cut_archives(spark, sf_dir):
    """Every archive lacks its last bytes: matches count, the exit code is 2"""
    r = run(spark, sf_dir, "tar.gz", "ation", around=lambda b: b[:-6])
    verdict = r.verdict()
    return r.figures().select(F.lit(verdict["matched"]).alias("matched"), F.lit(verdict["partial"]).alias("partial"), F.lit(verdict["exit_code"]).alias("exit_code"), "errors")


@query(f"SELECT {NAMED[0]} AS k, count(*) AS members_seen, count(*) FILTER (WHERE lang = 'en') AS members_searched, 0::BIGINT AS n_errors, true AS walked FROM documents GROUP BY k")
def source_outcomes(spark, sf_dir):
    r = run(spark, sf_dir, "tar.gz", "-g", "logs/en/*", "ation")
    out = r.outcomes().withColumn("member", F.lit(""))
    return named(out).select("k", "members_seen", "members_searched", "n_errors", "walked")


@query(f"SELECT {NAMED[0]} AS k, 'error' AS severity, 'STILL_COMPRESSED' AS code, count(*) AS n FROM documents GROUP BY ALL")
def source_still_compressed(spark, sf_dir):
    """Two levels of compression are an error, a member each"""
    import gzip

    return _codes(run(spark, sf_dir, "tar", "ation", wrap=lambda b: gzip.compress(gzip.compress(b))))


@query(f"SELECT {NAMED[0]} AS k, 'note' AS severity, 'NESTED_TAR' AS code, count(*) AS n FROM documents GROUP BY ALL")
def source_nested_archives(spark, sf_dir):
    """An archive in an archive is searched as one binary, with a note"""
    return _codes(run(spark, sf_dir, "zip", "ation", wrap=lambda b: packed_as([("inner", b)], "tar")))


@query(f"SELECT DISTINCT {NAMED[0]} AS k, 'note' AS severity, 'UNVERIFIED_END' AS code, 1::BIGINT AS n FROM documents")
def source_unverified_end(spark, sf_dir):
    """A format without a length or checksum, and no match: a note says so"""
    return _codes(run(spark, sf_dir, "tar.Z", "no such line anywhere"))


@query(f"SELECT DISTINCT {NAMED[0]} AS k, 'error' AS severity, 'TAR_NO_END' AS code, 1::BIGINT AS n FROM documents")
def source_tar_without_end(spark, sf_dir):
    """A tar that stops between two members"""
    return _codes(run(spark, sf_dir, "tar", "ation", around=lambda b: b.rstrip(b"\0") + bytes(-len(b.rstrip(b"\0")) % 512)))


@query(f"SELECT DISTINCT {NAMED[0]} AS k, 'error' AS severity, 'UNREADABLE_FORMAT' AS code, 1::BIGINT AS n FROM documents")
def source_unreadable(spark, sf_dir):
    """A known format that is not read is an error, never text"""
    return _codes(run(spark, sf_dir, "tar", "ation", around=lambda b: b"7z\xbc\xaf\x27\x1c" + b))


@query(f"WITH c AS (SELECT {NAMED[0]} AS k, count(*) * 3 AS c FROM documents GROUP BY k) SELECT k, 'error' AS severity, 'STILL_COMPRESSED' AS code, least(c, 100)::BIGINT AS n FROM c UNION ALL SELECT k, 'error', 'CAPPED_ERRORS', 1 FROM c WHERE c > 100")
def source_capped_errors(spark, sf_dir):
    """The first hundred errors of an archive, then how many more"""
    import gzip

    return _codes(run(spark, sf_dir, "tar.gz", "ation", body=F.encode("lang", "UTF-8"), wrap=lambda b: gzip.compress(gzip.compress(b)), around=_three_times))


def _three_times(data: bytes) -> bytes:
    import gzip

    return gzip.compress(gzip.decompress(data) * 3)


def _codes(r: Run) -> DataFrame:
    said = r.diagnostics().withColumn("member", F.coalesce("member", F.lit("")))
    return named(said).groupBy("k", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT {NAMED[0]} AS k, 'error' AS severity, 'ZIP_UNCOVERED' AS code, 1::BIGINT AS n FROM documents")
def source_zip_uncovered(spark, sf_dir):
    """Bytes of a zip that stand in no entry"""
    return _codes(run(spark, sf_dir, "zip", "ation", around=lambda b: b + b"and more"))


@query(f"SELECT {NAMED[0]} AS k, 'error' AS severity, 'ZIP_ENCRYPTED' AS code, count(*) AS n FROM documents GROUP BY ALL")
def source_zip_encrypted(spark, sf_dir):
    """Entries that need a password are errors, and the walk goes on"""
    return _codes(run(spark, sf_dir, "zip", "ation", around=_locked))


def _locked(data: bytes) -> bytes:
    """A zip whose entries say that they are encrypted."""
    import io
    import zipfile

    out, z = bytearray(data), zipfile.ZipFile(io.BytesIO(data))
    at = z.start_dir
    for info in z.infolist():
        out[info.header_offset + 6] |= 1
        out[at + 8] |= 1
        at += 46 + len(info.orig_filename.encode()) + len(info.extra) + len(info.comment)
    return bytes(out)


@query(_hits_sql())
def source_behind_zeros(spark, sf_dir):
    """A tar behind blocks of zeros, compressed or not"""
    packed = shown(run(spark, sf_dir, "tar.gz", "ation", around=_behind_zeros))
    return packed.intersect(shown(run(spark, sf_dir, "tar", "ation", around=lambda b: bytes(4096) + b)))


def _behind_zeros(data: bytes) -> bytes:
    import gzip

    return gzip.compress(bytes(4096) + gzip.decompress(data))


@query("SELECT false AS matched, true AS partial, 2 AS exit_code, 'MEMBER_GLOB_EMPTY' AS code")
def source_glob_keeps_nothing(spark, sf_dir):
    """Globs that leave no member of any archive are an error of the run"""
    v = run(spark, sf_dir, "tar.gz", "-g", "*.none", "ation").verdict()
    return spark.createDataFrame([(v["matched"], v["partial"], v["exit_code"], v["errors"][0][0])], "matched boolean, partial boolean, exit_code int, code string")


@query("""WITH a AS (SELECT DISTINCT doc_id // 64 AS k FROM documents) SELECT code, sum(n)::BIGINT AS n FROM (SELECT 'PATH_MISSING' AS code, count(*) FILTER (WHERE k % 3 = 0) AS n FROM a
    UNION ALL SELECT 'EMPTY_DIR', count(*) FILTER (WHERE k % 3 = 1) FROM a UNION ALL SELECT 'WALK_ERROR', count(*) FILTER (WHERE k % 3 = 2) FROM a) GROUP BY code HAVING sum(n) > 0""")
def source_path_errors(spark, sf_dir):
    """Of the archives of the documents one third is named where it is not, one third has a folder of its own that was emptied, one third is a link to what is gone"""
    folder = pack(_docs(spark, sf_dir), scratch_path(spark, "archives").removeprefix("file://"), "tar")
    paths = []
    for name in sorted(os.listdir(folder)):
        own = f"{folder}/{name}"
        if int(name[:6]) % 3 == 0:
            paths.append(f"{own}.moved")
        else:
            os.makedirs(f"{own}.d")
            if int(name[:6]) % 3 == 2:
                os.symlink(f"{own}.moved", f"{own}.d/link")
            paths.append(f"{own}.d")
    found = resolve(paths)
    return spark.createDataFrame([(code,) for code, _ in found.errors], "code string").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(_hits_sql())
def source_stream(spark, sf_dir):
    """A folder of archives as a stream, read until nothing new is there"""
    from .streaming.watch import watch

    folder = pack(_docs(spark, sf_dir), scratch_path(spark, "archives").removeprefix("file://"), "tar.gz")
    out = scratch_path(spark, "stream")
    found = watch(spark, folder).filter("rec_type = 'line'").filter(F.contains(F.col("line").cast("string"), F.lit("ation")))
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return named(spark.read.parquet(out)).select("doc_id", "line_no", F.col("line").cast("string").alias("line"))


@query(ORACLES["source_plain"])
def source_follow(spark, sf_dir):
    """Plain files that grow while they are followed: one half of each, then the rest, over a restart"""
    from .operators.lines import Match
    from .streaming.follow import follow

    folder, out = scratch_path(spark, "archives").removeprefix("file://"), scratch_path(spark, "stream")
    for grown in (lambda b: b[: len(b) // 2], lambda b: b + b"\n"):
        pack(_docs(spark, sf_dir), folder, "plain", around=grown)
        stream = follow(spark, folder, Match.of("ation")).filter("rec_type = 'line'").writeStream.format("parquet")
        q = stream.option("path", out).option("checkpointLocation", f"{out}-state").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    found = spark.read.parquet(out).withColumn("member", F.lit(""))
    return named(found).select("k", "line_no", F.col("line").cast("string").alias("line"))


__all__ = ["pack", "run", "sources"]
