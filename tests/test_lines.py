from pyspark.sql import functions as F

from lumenstrata.operators import lines as L
from lumenstrata.operators.lines import Match

TEXTS = {
    "none": None, "empty": "", "newline": "\n", "one": "a", "ended": "a\nNEEDLE\n", "open": "a\nNEEDLE", "blank": "\n\nNEEDLE\n\n", "crlf": "NEEDLE\r\nx\r\n", "tail": "a\nNEEDLE\nb\nc\nNEEDLE\nd",
}


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(texts.items()), "k string, text string")


def test_lines(spark):
    got: dict = {}
    for r in L.lines_from_text(frame(spark), ["k"]).collect():
        got.setdefault(r["k"], []).append((r["line_no"], r["line"]))
    for k, t in TEXTS.items():
        want = (t or "").split("\n")
        want = want[:-1] if want[-1] == "" else want
        assert sorted(got.get(k, [])) == [(i + 1, x) for i, x in enumerate(want)]


def shown(df, k):
    return [f"{r['line_no']}{':' if r['kind'] == 'match' else '-'}{r['line']}" for r in sorted(df.filter(F.col("k") == k).collect(), key=lambda r: r["line_no"])]


def both(spark, m, **kw):
    yield L.context_lines(frame(spark), ["k"], m, **kw)


def test_inverted_limits_with_context(spark):
    for df in both(spark, Match.of("NEEDLE", invert=True), after=1, limit=1):
        assert shown(df, "tail") == ["1:a", "2-NEEDLE"]
    for df in both(spark, Match.of("NEEDLE", invert=True), after=3, limit=1):
        assert shown(df, "tail") == ["1:a", "2-NEEDLE", "3:b", "4:c"]


def test_context(spark):
    for df in both(spark, Match.of("NEEDLE"), before=1, after=1):
        assert shown(df, "tail") == ["1-a", "2:NEEDLE", "3-b", "4-c", "5:NEEDLE", "6-d"]
        assert [r["line_no"] for r in df.filter("group_break").collect()] == []
    for df in both(spark, Match.of("NEEDLE"), after=1):
        assert sorted((r["k"], r["line_no"]) for r in df.filter("group_break").collect()) == [("tail", 5)]


def test_counts_and_crlf(spark):
    df = spark.createDataFrame([("x", "GET GET x/GET/none\nnone\n"), ("c", "one NEEDLE\r\nNEEDLE two\r\n")], "k string, text string")
    assert [(r["k"], r["n"]) for r in L.count_matches(df, ["k"], Match.of("GET")).collect()] == [("x", 3)]
    assert [(r["k"], r["n"]) for r in L.count_lines(df, ["k"], Match.of("GET")).collect()] == [("x", 1)]
    assert L.match_lines(df, ["k"], Match.of("NEEDLE$")).count() == 0
    assert [r["line"] for r in L.match_lines(df, ["k"], Match.of("NEEDLE$", crlf=True)).collect()] == ["one NEEDLE\r"]


def test_plans_shuffle_nothing(spark, capsys):
    df = frame(spark)
    for out in (L.match_lines(df, ["k"], Match.of("N")), L.context_lines(df, ["k"], Match.of("N"), 2, 2, 1), L.byte_offsets(df, ["k"]), L.count_matches(df, ["k"], Match.of("N"))):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_long_members(spark):
    """The work for a line does not grow with the number of lines."""
    import time

    df = frame(spark, {"x": "\n".join("hit" if i % 50 == 0 else f"line {i}" for i in range(60_000))})
    began = time.time()
    assert L.context_lines(df, ["k"], Match.of("hit"), 2, 2).count() == 1200 * 5 - 2
    assert L.byte_offsets(df, ["k"]).count() == 60_000
    assert time.time() - began < 90


def test_identities_as_rows(spark):
    items = spark.createDataFrame([(3, "c", "x"), (1, "a", "x"), (2, "b", None), (5, "e", None), (4, "d", "y")], "pos int, name string, k string")
    got = sorted((r["pos"], r["name"], r["first_position"], r["first_name"], r["n_names"]) for r in L.identity_rows(items, ["k"], "pos", "name").collect())
    assert got == [(1, "a", 1, "a", 2), (2, "b", 2, "b", 2), (3, "c", 1, "a", 2), (4, "d", 4, "d", 1), (5, "e", 2, "b", 2)]
    many = spark.range(300_000).select(F.lit("same").alias("k"), F.col("id").alias("pos"), F.concat(F.lit("n"), "id").alias("name"))
    assert L.identity_rows(many, ["k"], "pos", "name").filter("first_name = 'n0' and n_names = 300000").count() == 300_000
