"""Every query of the engine over the driver's tables, with its DuckDB counterpart.

``documents`` plays the archives: ``source`` is an archive, a document one of
its members, the text its lines.  Patterns here keep to the syntax and classes
on which the two regular expression engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.escapes import escape_column, one_line, truncate_column
from .functions.globs import Globs
from .operators import lines as L
from .operators.lines import Match

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(table: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """A common table expression ``l`` of lines."""
    return f"""l AS (SELECT {keys}, generate_subscripts(p, 1)::BIGINT AS line_no, unnest(p) AS line FROM
      (SELECT {keys}, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM (SELECT {keys}, string_split({text}, chr(10)) AS p FROM {table})))"""


def _context(hit: str, before: int, after: int, limit: int | None = None) -> str:
    kept = f"(h AND hits <= {limit})" if limit else "h"
    return f"""WITH {_lines()}, r AS (SELECT *, ({hit}) AS h FROM l),
      k AS (SELECT *, count(*) FILTER (WHERE h) OVER (PARTITION BY doc_id ORDER BY line_no) AS hits FROM r),
      s AS (SELECT *, max(CASE WHEN {kept} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN {after} PRECEDING AND {before} FOLLOWING) AS shown FROM k)
      SELECT doc_id, line_no, line, CASE WHEN h THEN 'match' ELSE 'context' END AS kind,
      coalesce(line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 1, false) AS group_break FROM s WHERE shown = 1"""


def _match_sql(hit: str) -> str:
    return f"WITH {_lines()} SELECT doc_id, line_no, line FROM l WHERE {hit}"


# filters


@query(_match_sql("regexp_matches(line, 'ation|tion')"))
def match_lines(spark, sf_dir):
    return L.match_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("ation|tion"))


@query(_match_sql("contains(line, 'the.')"))
def match_fixed(spark, sf_dir):
    return L.match_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("the.", fixed=True))


@query(_match_sql("contains(line, 'License')"))
def match_literal(spark, sf_dir):
    return L.match_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("License"))


@query(_match_sql("regexp_matches(line, 'idiot') OR regexp_matches(line, 'th[aeiou]{2}r') OR regexp_matches(line, '^An')"))
def match_multi(spark, sf_dir):
    return L.match_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("idiot", "th[aeiou]{2}r", "^An"))


@query(_match_sql("regexp_matches(line, '(?i)LICENSE')"))
def match_ignore_case(spark, sf_dir):
    return L.match_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("LICENSE", ignore_case=True))


@query(_match_sql("regexp_matches(line, '(?i)license')"))
def match_smart_case(spark, sf_dir):
    return L.match_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("license", smart_case=True))


@query(_match_sql("regexp_matches(line, 'License')"))
def match_smart_case_upper(spark, sf_dir):
    return L.match_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("License", smart_case=True))


@query(f"WITH {_lines()}" + r" SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '(^|[^\p{L}\p{M}\p{N}_])(idiot|the)($|[^\p{L}\p{M}\p{N}_])')")
def match_word(spark, sf_dir):
    return L.match_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("idiot|the", word=True))


@query(_match_sql("NOT regexp_matches(line, 'tion')"))
def match_invert(spark, sf_dir):
    return L.match_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("tion", invert=True))


@query("WITH c AS (SELECT doc_id, replace(text, '. ', '.' || chr(13) || chr(10)) AS text FROM documents), " + _lines("c") + r" SELECT doc_id, line_no, line FROM l WHERE regexp_matches(regexp_replace(line, '\r$', ''), 'the\.$')")
def match_crlf(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\r\n")))
    return L.match_lines(docs, ["doc_id"], Match.of(r"the\.$", crlf=True))




@query(_match_sql("regexp_matches(line, '[a-z][a-z]ation|^[A-Z][a-z]*[.]$')"))
def match_many(spark, sf_dir):
    """Several hundred patterns at once"""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return L.match_lines(_docs(spark, sf_dir), ["doc_id"], Match.of(*(a + b + "ation" for a in letters for b in letters), "^[A-Z][a-z]*[.]$"))


@query(_match_sql("false"))
def match_nothing(spark, sf_dir):
    return L.max_count(_docs(spark, sf_dir), ["doc_id"], Match.of("tion"), 0)


# output modes


@query(f"WITH {_lines()}, m AS (SELECT doc_id, line_no, regexp_extract_all(line, '[a-z]+ation') AS g FROM l) SELECT doc_id, line_no, generate_subscripts(g, 1)::BIGINT AS match_no, unnest(g) AS match FROM m")
def only_matching(spark, sf_dir):
    return L.only_matching(_docs(spark, sf_dir), ["doc_id"], Match.of("[a-z]+ation"))


@query(
    f"""WITH {_lines()}, m AS (SELECT doc_id, line_no, regexp_extract_all(line, 'th[a-z]+tion') AS g, regexp_split_to_array(line, 'th[a-z]+tion') AS s FROM l WHERE regexp_matches(line, 'th[a-z]+tion')),
    x AS (SELECT doc_id, line_no, generate_subscripts(g, 1)::BIGINT AS match_no, unnest(g) AS match, unnest(s[:len(g)]) AS gap FROM m),
    y AS (SELECT *, sum(strlen(gap) + strlen(match)) OVER (PARTITION BY doc_id, line_no ORDER BY match_no)::BIGINT AS e FROM x)
    SELECT doc_id, line_no, match_no, match, (e - strlen(match))::BIGINT AS start, e AS "end" FROM y"""
)
def only_matching_offsets(spark, sf_dir):
    return L.only_matching(_docs(spark, sf_dir), ["doc_id"], Match.of("th[a-z]+tion"), offsets=True)


@query(f"WITH {_lines()} SELECT doc_id, count(*) AS n FROM l WHERE contains(line, 'tion') GROUP BY doc_id")
def count_lines(spark, sf_dir):
    return L.count_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("tion"))


@query(f"WITH {_lines()} SELECT doc_id, sum(len(regexp_extract_all(line, 'tion')))::BIGINT AS n FROM l GROUP BY doc_id HAVING n > 0")
def count_matches(spark, sf_dir):
    return L.count_matches(_docs(spark, sf_dir), ["doc_id"], Match.of("tion"))


@query(f"WITH {_lines()} SELECT doc_id, count(*) AS n FROM l WHERE NOT contains(line, 'tion') GROUP BY doc_id")
def count_inverted(spark, sf_dir):
    return L.count_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("tion", invert=True))


@query(f"WITH {_lines()} SELECT doc_id, least(count(*), 3)::BIGINT AS n FROM l WHERE contains(line, 'tion') GROUP BY doc_id")
def count_capped(spark, sf_dir):
    return L.count_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("tion"), limit=3)


@query(f"WITH {_lines()} SELECT DISTINCT doc_id, source FROM l JOIN documents USING (doc_id) WHERE regexp_matches(line, '^Re.*on')")
def files_with_matches(spark, sf_dir):
    return L.members_with_match(_docs(spark, sf_dir), ["doc_id", "source"], Match.of("^Re.*on"))


@query(f"WITH {_lines()} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE regexp_matches(line, '^Re.*on'))")
def files_without(spark, sf_dir):
    return L.members_with_match(_docs(spark, sf_dir), ["doc_id"], Match.of("^Re.*on"), without=True)


@query("SELECT regexp_matches(text, 'no such line') AS found FROM (SELECT string_agg(text, chr(10)) AS text FROM documents)")
def exists_quiet(spark, sf_dir):
    hits = L.members_with_match(_docs(spark, sf_dir), ["doc_id"], Match.of("no such line"))
    return hits.agg((F.count(F.lit(1)) > 0).alias("found"))


@query(f"WITH {_lines()} SELECT doc_id, line_no, line FROM l")
def line_numbers(spark, sf_dir):
    return L.lines_from_text(_docs(spark, sf_dir), ["doc_id"])


@query(f"WITH {_lines()} SELECT doc_id, line_no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset, line FROM l")
def byte_offsets(spark, sf_dir):
    return L.byte_offsets(_docs(spark, sf_dir), ["doc_id"])


# positions


@query(_context("regexp_matches(line, 'ation')", 2, 0))
def context_before(spark, sf_dir):
    return L.context_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("ation"), before=2)


@query(_context("regexp_matches(line, 'ation')", 0, 1))
def context_after(spark, sf_dir):
    return L.context_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("ation"), after=1)


@query(_context("regexp_matches(line, 'ation')", 2, 1))
def context_both(spark, sf_dir):
    return L.context_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("ation"), before=2, after=1)


@query(f"WITH c AS ({_context("regexp_matches(line, 'ation')", 1, 1)}) SELECT doc_id, (1 + sum(group_break::INT))::BIGINT AS groups, count(*) AS lines FROM c GROUP BY doc_id")
def context_groups(spark, sf_dir):
    shown = L.context_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("ation"), before=1, after=1)
    return shown.groupBy("doc_id").agg((1 + F.sum(F.col("group_break").cast("long"))).alias("groups"), F.count(F.lit(1)).alias("lines"))


@query(f"WITH {_lines()} SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l WHERE contains(line, 'tion')) WHERE k <= 2")
def max_count(spark, sf_dir):
    return L.max_count(_docs(spark, sf_dir), ["doc_id"], Match.of("tion"), 2)


@query(_context("contains(line, 'tion')", 0, 2, 1))
def max_count_context(spark, sf_dir):
    return L.context_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("tion"), after=2, limit=1)


@query(_context("NOT contains(line, 'tion')", 0, 3, 1))
def invert_max_count_after(spark, sf_dir):
    return L.context_lines(_docs(spark, sf_dir), ["doc_id"], Match.of("tion", invert=True), after=3, limit=1)


# selection of members


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?s)^(?:.*\\.example\\.(?:com|org)/.*)$')")
def member_glob(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").filter(Globs(["*.example.{com,org}/*"]).column(F.col("url")))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(?s)^.*[?]page=.*$')")
def member_glob_negated(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").filter(Globs(["!*[?]page=*"]).column(F.col("url")))


@query("SELECT page_id, url FROM pages WHERE CASE WHEN contains(url, '/fr/1') THEN true WHEN contains(url, '/fr/') THEN false WHEN starts_with(url, 'https:') THEN true ELSE false END")
def member_glob_last_wins(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").filter(Globs(["https:*", "!*/fr/*", "*/fr/1*"]).column(F.col("url")))


@query(f"WITH {_lines(keys='doc_id, source')} SELECT source, doc_id, line_no FROM l WHERE regexp_matches(source, '^src1[0-4]$') AND contains(line, 'tion')")
def archive_glob(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter(Globs(["src1[0-4]"]).column(F.col("source")))
    return L.match_lines(docs, ["doc_id", "source"], Match.of("tion")).select("source", "doc_id", "line_no")


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, array_to_string(list(source ORDER BY doc_id)[2:], ',') AS aliases FROM documents GROUP BY text")
def alias_dedup(spark, sf_dir):
    items = _docs(spark, sf_dir).select(F.sha2(F.encode("text", "UTF-8"), 256).alias("k"), "doc_id", "source")
    return L.first_of_identity(items, ["k"], "doc_id", "source").withColumn("aliases", F.array_join("aliases", ","))


@query("SELECT doc_id, source, min(doc_id) OVER w AS first_position, first_value(source) OVER (PARTITION BY text ORDER BY doc_id) AS first_name, count(*) OVER w AS n_names FROM documents WINDOW w AS (PARTITION BY text)")
def alias_rows(spark, sf_dir):
    """Names of one identity as rows in place of an array"""
    items = _docs(spark, sf_dir).select(F.sha2(F.encode("text", "UTF-8"), 256).alias("k"), "doc_id", "source")
    return L.identity_rows(items, ["k"], "doc_id", "source").drop("k")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN source ELSE source || ':' || 'doc/' || doc_id::VARCHAR END AS display FROM documents")
def display_path(spark, sf_dir):
    member = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    return _docs(spark, sf_dir).select("doc_id", L.display_path(F.col("source"), member).alias("display"))


@query("SELECT source || ':' || doc_id::VARCHAR AS display FROM documents WHERE regexp_matches(doc_id::VARCHAR, '^[0-9]*5$')")
def list_members(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("member", F.col("doc_id").cast("string"))
    return docs.filter(Globs(["*5"]).column(F.col("member"))).select(one_line(L.display_path(F.col("source"), F.col("member"))).alias("display"))


# figures and verdicts


@query(
    f"""WITH {_lines()}, m AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, 'ation'))::BIGINT AS matched_lines, sum(len(regexp_extract_all(line, 'ation')))::BIGINT AS matches FROM l GROUP BY doc_id)
    SELECT doc_id, matched_lines, matches, strlen(text)::BIGINT AS bytes_searched, matched_lines > 0 AS has_match FROM documents JOIN m USING (doc_id)"""
)
def member_stats(spark, sf_dir):
    return L.member_stats(_docs(spark, sf_dir), ["doc_id"], Match.of("ation"))


@query(
    f"""WITH {_lines()}, m AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, 'ation')) AS ml, sum(len(regexp_extract_all(line, 'ation'))) AS mm FROM l GROUP BY doc_id)
    SELECT count(*) AS searches, sum((ml > 0)::INT)::BIGINT AS searches_with_match, sum(strlen(text))::BIGINT AS bytes_searched, sum(ml)::BIGINT AS matched_lines, sum(mm)::BIGINT AS matches FROM documents JOIN m USING (doc_id)"""
)
def json_summary(spark, sf_dir):
    return L.run_summary(L.member_stats(_docs(spark, sf_dir), ["doc_id"], Match.of("ation")))


@query("SELECT bool_or(toxic = 1) AS matched, bool_or(quality = 0) AS partial, CASE WHEN bool_or(quality = 0) THEN 2 WHEN bool_or(toxic = 1) THEN 0 ELSE 1 END AS exit_code FROM labels")
def run_verdict(spark, sf_dir):
    return L.verdict(spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("toxic") == 1, F.col("quality") == 0)


@query("SELECT user_id, event_id, greatest(c - 5, 0)::BIGINT AS more FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE k <= 5")
def capped_diags(spark, sf_dir):
    return L.capped(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id"), ["user_id"], ["event_id"], 5)


@query(f"WITH {_lines(keys='doc_id, source')} SELECT source, count(DISTINCT doc_id) AS members, count(*) AS lines FROM l WHERE contains(line, 'ation') GROUP BY source")
def archives_with_hit(spark, sf_dir):
    hits = L.count_lines(_docs(spark, sf_dir), ["source", "doc_id"], Match.of("ation"))
    return hits.groupBy("source").agg(F.count_distinct("doc_id").alias("members"), F.sum("n").alias("lines"))


@query(f"WITH {_lines()}, t AS (SELECT unnest(regexp_extract_all(line, '[a-z]+ation')) AS token FROM l) SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 20")
def top_tokens(spark, sf_dir):
    found = L.only_matching(_docs(spark, sf_dir), ["doc_id"], Match.of("[a-z]+ation"))
    return found.groupBy(F.col("match").alias("token")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(20)


@query(f"WITH {_lines()} SELECT DISTINCT regexp_extract(line, '^[A-Z][a-z]+') AS word FROM l WHERE regexp_matches(line, '^[A-Z][a-z]+')")
def distinct_tokens(spark, sf_dir):
    return L.only_matching(_docs(spark, sf_dir), ["doc_id"], Match.of("^[A-Z][a-z]+")).select(F.col("match").alias("word")).distinct()


# names and texts


@query("SELECT doc_id, replace(replace(text, chr(10), '\\x0a'), chr(13), '\\x0d') AS name FROM documents")
def escape_names(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", one_line(F.col("text")).alias("name"))


@query("SELECT doc_id, replace(replace(replace(replace('a' || chr(27) || '[1m' || replace(replace(text, ' t', chr(155) || chr(8238)), '. ', chr(13) || '. ') || chr(7) || chr(9), chr(27), '\\x1b'), chr(7), '\\x07'), chr(155), '\\u{9b}'), chr(8238), '\\u{202e}').replace(chr(13), '\\x0d') AS shown FROM documents")
def escape_controls(spark, sf_dir):
    """C0, C1 and direction controls, and carriage returns that end no line"""
    text = F.replace(F.replace("text", F.lit(" t"), F.lit("\x9b\u202e")), F.lit(". "), F.lit("\r. "))
    return _docs(spark, sf_dir).select("doc_id", escape_column(F.concat(F.lit("a\x1b[1m"), text, F.lit("\x07\t"))).alias("shown"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 1024 THEN text ELSE left(text, n) || '…' END AS name FROM (SELECT doc_id, text, list_max(list_filter(range(250, 1025), lambda k: strlen(left(text, k)) <= 1024)) AS n FROM documents)")
def name_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", truncate_column(F.col("text")).alias("name"))


# conversations and events as logs

_EVENTS = "e AS (SELECT user_id, string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || event_type || ' ' || event_id::VARCHAR, chr(10) ORDER BY event_id) AS text FROM events GROUP BY user_id)"


def _event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "event_type", F.col("event_id").cast("string"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.struct("event_id", line.alias("line")).alias("x"))
    return events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


@query(f"WITH {_EVENTS}, {_lines('e', 'user_id')} SELECT user_id, line_no, line FROM l WHERE regexp_matches(line, '^[0-9-]+T(0[89]|1[0-5]):[0-5][0-9]')")
def time_window_regex(spark, sf_dir):
    return L.match_lines(_event_logs(spark, sf_dir), ["user_id"], Match.of("^[0-9-]+T(0[89]|1[0-5]):[0-5][0-9]"))


@query(f"WITH {_lines('conversations', 'conv_id, turn, role')} SELECT conv_id, turn, role, line_no, line FROM l WHERE regexp_matches(line, '(?i)the[a-z]*[.]')")
def conversation_search(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return L.match_lines(turns, ["conv_id", "turn", "role"], Match.of("the[a-z]*[.]", ignore_case=True))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-z]+ [a-z]+')")
def table_filter(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").filter(F.rlike("p_name", F.lit(Match.of("^[a-z]+ [a-z]+").java))).select("p_partkey", "p_name")


@query(
    f"""WITH {_lines(keys='doc_id, source')}, o AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM l),
    h AS (SELECT source || ':' || doc_id::VARCHAR AS path, line_no, off, len(regexp_extract_all(line, 'ation'))::BIGINT AS n, strlen(regexp_extract(line, '^(.*?)ation', 1))::BIGINT AS first FROM o WHERE contains(line, 'ation'))
    SELECT path, line_no AS seq, 'match' AS type, off AS absolute_offset, n, first AS first_start FROM h
    UNION ALL SELECT path, 0, 'begin', NULL, NULL, NULL FROM h GROUP BY path UNION ALL SELECT path, {1 << 62}, 'end', NULL, sum(n)::BIGINT, NULL FROM h GROUP BY path"""
)
def json_events(spark, sf_dir):
    path = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    events = L.json_events(_docs(spark, sf_dir), path, Match.of("ation"))
    schema = "type string, data struct<absolute_offset:long,submatches:array<struct<start:long>>,stats:struct<matches:long>>"
    e = events.withColumn("e", F.from_json("event", schema))
    n = F.when(F.col("e.type") == "match", F.size("e.data.submatches").cast("long")).otherwise(F.col("e.data.stats.matches"))
    return e.select("path", "seq", F.col("e.type").alias("type"), F.col("e.data.absolute_offset").alias("absolute_offset"), n.alias("n"), F.get("e.data.submatches", F.lit(0))["start"].alias("first_start"))


MARKED = "regexp_replace(line, '(' || pattern || ')', chr(10) || '\\1' || chr(10), 'g')"


def _spans_sql(lines: str, patterns: dict[str, str]) -> str:
    """(keys, pattern, match_no, start, end) of all matches: each is put between line feeds, which no line holds."""
    named = ", ".join(f"('{k}', '{v}')" for k, v in patterns.items())
    return f"""WITH {lines}, q AS (SELECT * FROM (VALUES {named}) AS v(name, pattern)),
    m AS (SELECT doc_id, line_no, name, string_split({MARKED}, chr(10)) AS p FROM l, q WHERE regexp_matches(line, pattern)),
    x AS (SELECT doc_id, line_no, name, generate_subscripts(p, 1) AS k, unnest(p) AS piece FROM m),
    y AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc_id, line_no, name ORDER BY k)::BIGINT AS e FROM x)
    SELECT doc_id, line_no, name, (k // 2)::BIGINT AS match_no, e - strlen(piece) AS start, e AS "end" FROM y WHERE k % 2 = 0"""


#: Anchors, empty matches, alternatives by preference and lazy repetition; RE2 reads them as the dialect does.
SPANNED = {"last": "[a-z]+[.]?$", "first": "^[A-Z][a-z]*", "edge": "^|ation", "preferred": "a(?:b|bc|t)i?|th", "lazy": "n[a-z]*?o+?"}


@query(_spans_sql(_lines(), SPANNED))
def match_spans(spark, sf_dir):
    """Where the matches of five patterns stand in their lines, in bytes"""
    from .operators.spans import matching_lines

    docs, out = _docs(spark, sf_dir), None
    for name, pattern in SPANNED.items():
        found = matching_lines(docs, ["doc_id"], Match.of(pattern)).select("doc_id", "line_no", F.lit(name).alias("name"), F.posexplode("matches").alias("_n", "x"))
        found = found.select("doc_id", "line_no", "name", (F.col("_n") + 1).cast("long").alias("match_no"), "x.start", "x.end")
        out = found if out is None else out.unionByName(found)
    return out


# formats by content

#: Leading bytes and what they say; a dictionary size and the rest of a bare LZMA header, a whole text cpio header.
HEADS = [
    ("1F8B08", "gzip"), ("1F9D90", "compress"), ("504B0304", "zip"), ("504B0506", "zip"), ("28B52FFD", "zstd"), ("04224D18", "lz4"), ("02214C18", "lz4"), ("502A4D1800000000" + "04224D18", "lz4"),
    ("5F2A4D18FFFFFF00", "zstd"), ("FD377A585A00", "xz"), ("425A6839314159265359", "bzip2"), ("425A6831177245385090", "bzip2"), ("425A6839202020", "plain"), ("4C5A495001", "unreadable:lzip"),
    ("377ABCAF271C", "unreadable:7z"), ("526172211A07", "unreadable:rar"), ("894C5A4F000D0A1A0A", "unreadable:lzop"), ("303730373037" + "30" * 70, "unreadable:cpio"),
    ("5D00008000" + "FF" * 8 + "00", "unreadable:lzma"), ("5D00008101" + "FF" * 8 + "00", "plain"), ("", "plain"),
]


@query("SELECT doc_id, ([" + ", ".join(f"'{kind}'" for _, kind in HEADS) + f"])[doc_id % {len(HEADS)} + 1] AS format FROM documents")
def format_sniff(spark, sf_dir):
    from pyspark.sql import types as T

    from .sources.sniff import SNIFF_LENGTH, sniff

    heads = F.array(*(F.lit(head) for head, _ in HEADS))
    raw = F.concat(F.unhex(F.get(heads, (F.col("doc_id") % len(HEADS)).cast("int"))), F.encode("text", "UTF-8"))

    @F.pandas_udf(T.StringType())
    def of(column):
        return column.map(lambda b: sniff(bytes(b)))

    return _docs(spark, sf_dir).select("doc_id", of(F.substring(raw, 1, SNIFF_LENGTH)).alias("format"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_sources  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalogue_sources  # noqa: F401

    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_both(spark, sf_dir)
