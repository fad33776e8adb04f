import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenstrata.functions import escapes
from lumenstrata.functions.arrays import running_sum
from lumenstrata.functions.globs import BadGlob, Globs, glob_to_regex
from lumenstrata.functions.regex_dialect import BadPattern, compile_patterns, needed_literal

CASES = [
    ("é", r"^\w$", {}, True), ("٣", r"\d", {}, True), ("É", "é", {"ignore_case": True}, True), ("a\r", "a$", {}, False), ("a\rb", "a.b", {}, True), ("a\x85b", "a.b", {}, True),
    ("A", "[[:upper:]]", {}, True), ("É", "[[:upper:]]", {}, False), ("日", r"\p{Han}", {}, True), ("a", "(?P<x>a)", {}, True), ("aab", "a++b", {}, True), ("x", "[[:^alpha:]]", {}, False),
    ("5", "[[:^alpha:]]", {}, True), ("b", r"[a-z--[aeiou]]", {}, True), ("a", r"^[a-z--[aeiou]]$", {}, False), ("a.b", "a.b", {"fixed": True}, True), ("axb", "a.b", {"fixed": True}, False),
    ("caté", "cat", {"word": True}, False), ("cat-é", "cat", {"word": True}, True), ("Foo", "foo", {"smart_case": True}, True), ("foo", "Foo", {"smart_case": True}, False),
    ("aXb", r"a\Sb", {"smart_case": True}, True), ("a}b]", "}b]", {}, True), ("tab\t", r"\t$", {}, True), ("x", r"\p{Lu}|\pL", {}, True), ("ab", r"a{1,2}b", {}, True), ("é", r"\x{E9}", {}, True),
    ("a b", r"\bb\b", {}, True), ("v\x0b", r"v\v", {}, True), ("#x", "#x", {}, True), ("a&&b", "[&]{2}", {}, True),
]


def test_dialect(spark):
    rows = [(i, text, p, o, want) for i, (text, p, o, want) in enumerate(CASES)]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "i int, t string")
    tests = F.coalesce(*(F.when(F.col("i") == i, F.rlike("t", F.lit(compile_patterns([p], **o)))) for i, _, p, o, _ in rows))
    got = {r["i"]: r["x"] for r in df.select("i", tests.alias("x")).collect()}
    assert [(r[1:4], got[r[0]]) for r in rows if got[r[0]] != r[4]] == []


@pytest.mark.parametrize("bad", [r"(a)\1", "a(?=b)", "(?<=a)b", "x{", "(", "a)", "*a", "[a", r"a\n", "a\nb", "[z", r"\y", "a{3,2}", "(?<!a)", "(?>a)", r"\Z", "(?U)a", r"\p{NoSuch=x}"])
def test_refused(bad):
    with pytest.raises(BadPattern):
        compile_patterns([bad])


GLOBS = [
    (["*.log"], "logs/a.log", True), (["*.log"], "a.txt", False), (["!*.log"], "a.txt", True), (["!*.log"], "x/a.log", False), (["*.log", "!a*"], "a.log", False),
    (["!a*", "*.log"], "a.log", True), (["logs/*"], "./logs/x/y", True), (["**/x"], "a/b/x", True), (["**/x"], "x", True), (["a/**"], "a/b/c", True), (["a/**/b"], "a/b", True),
    (["a/**/b"], "a/x/y/b", True), (["{a,b}.log"], "b.log", True), (["[!a].log"], "b.log", True), (["[!a].log"], "a.log", False), ([r"\!x"], "!x", True), (["?.log"], "é.log", True),
    (["etc/x"], "/etc/x", True), (["etc/x"], "../etc/x", True), ([r"a\*"], "a*", True), ([r"a\*"], "ab", False),
]


def test_globs(spark):
    assert [(g, p) for g, p, want in GLOBS if Globs(g).match(p) != want] == []
    df = spark.createDataFrame([(i, p) for i, (_, p, _) in enumerate(GLOBS)], "i int, p string")
    test = F.coalesce(*(F.when(F.col("i") == i, Globs(g).column(F.col("p"))) for i, (g, _, _) in enumerate(GLOBS)))
    got = {r["i"]: r["x"] for r in df.select("i", test.alias("x")).collect()}
    assert [GLOBS[i] for i in got if got[i] != GLOBS[i][2]] == []


@pytest.mark.parametrize("bad", ["[a", "{a", "a}", "[z-a]", "a\\"])
def test_bad_globs(bad):
    with pytest.raises(BadGlob):
        glob_to_regex(bad)


def test_running_sum(spark):
    for values in ([], [3], list(range(1000)), [5] * 129):
        row = spark.createDataFrame([(values,)], "v array<long>").select(running_sum(F.col("v")).alias("a"), running_sum(F.col("v"), False).alias("b")).first()
        total, a, b = 0, [], []
        for v in values:
            b.append(total)
            total += v
            a.append(total)
        assert (row["a"], row["b"]) == (a, b)


@settings(max_examples=50, deadline=None)
@given(st.text())
def test_escaped_text_is_safe_and_invertible(s):
    shown = escapes.escape_text(s)
    assert not escapes._UNSAFE.search(shown)
    back = re.sub(r"\\x([0-9a-f]{2})|\\u\{([0-9a-f]+)\}", lambda m: chr(int(m[1] or m[2], 16)), shown)
    assert back == s or "\\" in s
    assert escapes.escape_bytes(s.encode("utf-8", "replace")).decode() == escapes.escape_text(s.encode("utf-8", "replace").decode())


def test_escapes(spark):
    cases = ["a\x1b[1mb", "tab\tx", "cr\rx", "crlf\r\nx", "\x07", "é\x9bz", "a‮b", "", "plain"]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", escapes.escape_column(F.col("t")).alias("s"))
    assert all(r["s"] == escapes.escape_text(r["t"]) for r in df.collect())
    assert escapes.escape_bytes(b"a\x9b\xff\x1b") == b"a\\x9b\xff\\x1b"
    assert escapes.escape_json('"\x7f\x9b"') == '"\\u007f\\u009b"'


def test_names_are_cut_between_characters(spark):
    names = ["x" * 1024, "x" * 1025, "é" * 600, "日" * 400, "😀" * 300, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", escapes.truncate_column(F.col("n")).alias("s"))
    for r in df.collect():
        assert r["s"] == escapes.truncate_name(r["n"])
        assert len(r["s"].removesuffix("…").encode()) <= 1024


def test_sizes():
    assert [escapes.parse_size(x) for x in ("1", "2K", "3m", "1G")] == [1, 2048, 3 << 20, 1 << 30]
    with pytest.raises(ValueError):
        escapes.parse_size("x")


@pytest.mark.parametrize(
    "pattern, want",
    [("[a-z]+ation", "ation"), ("ation|tion", None), ("a+b", "a"), ("xa+b", "xa"), ("ab?cd", "cd"), ("ab*c", "a"), ("a{0}bc", "bc"), ("(?i)abc", None), ("(?:ab)?cde", "cde"), (r"the\.$", "the."), (r"\bword\b", "word"),
     (r"\p{L}x", None), ("[]a]bc", "bc"), (r"[^\]x]yz", "yz"), ("a.b", "a"), ("^", None), (r"a\{2", "a{2")],
)
def test_needed_literals(pattern, want):
    assert needed_literal([pattern]) == want
    if want:
        assert needed_literal([pattern], ignore_case=True) is None and needed_literal([pattern, "x"]) is None


@settings(max_examples=200, deadline=None)
@given(st.text("ab.+*?|()[]{}1\\^$", max_size=7), st.lists(st.text("ab1.", max_size=8), max_size=6))
def test_needed_literals_are_needed(pattern, lines):
    try:
        compiled = re.compile(pattern)
    except re.error:
        return
    needed = needed_literal([pattern])
    assert all(needed in x for x in lines if needed and compiled.search(x)), (pattern, needed)
