"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four regular kinds (email, ip, card, phone) are the seeds.  The words around a
seed induce lexical patterns; pattern-instance graphs are then scored in turns,
until no new instance is believed: a pattern by the share of its instances that
are believed, an instance by the patterns that hold it.  Identifier-like words,
and runs of such words, that a base rule misses but high-confidence patterns
hold become spans of the patterns' kind.  Contexts are the words within
``CONTEXT`` characters to either side, over neighbouring identifier-like words.

Offsets are code points, end exclusive.  A span list is an array of
(kind, start, end) in the order of ``KINDS``, then start.

Defined results: null and empty texts have no spans; rows alike in id and text
get the same spans; base spans are never changed by what the patterns add; an
added span overlaps no base span and no other added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, materialize

KINDS = ("email", "ip", "card", "phone")
#: The base rules.  Against the plain forms these can't backtrack: a run is tried from its first character or from the end of the previous match only, repeated groups are possessive.
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
VALID_IP = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
#: What a text must hold for a kind's search to start.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Identifier-like words: with a digit, between white space, trimmed of outer punctuation; and runs of two or more.
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
RUN = CANDIDATE + r"(?:\x20[^\s0-9]*+[0-9]\S*+)++"
#: Characters to either side of a span from which context words are taken, least characters of a discovered instance.
CONTEXT, LEAST_LENGTH = 64, 5
#: Code points of a stretch in which spans of one text meet.
STRETCH = 256
LEAST_SUPPORT, LEAST_CONFIDENCE = 3, 0.7
#: Code points of a block in which a text is rebuilt, bytes of discovered spans that may be broadcast.
BLOCK, BROADCAST_BYTES = 4096, 16 << 20
SPAN = "array<struct<kind:int,start:long,end:long>>"


def _running(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of longs, in blocks, so that long arrays cost little more than short ones."""
    n, size = F.size(lengths), 256
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / size).cast("int"))), lambda b: F.slice(lengths, b * size + 1, F.lit(size)))
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    offsets = F.aggregate(blocks, F.array(zero), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + total(b)))
    inner = F.transform(F.arrays_zip(blocks.alias("b"), F.slice(offsets, 1, F.size(blocks)).alias("o")), lambda z: F.transform(z["b"], lambda x, i: z["o"] + total(F.slice(z["b"], 1, i))))
    return F.flatten(inner)


def _luhn(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise((F.try_to_number(d, F.lit("9")).cast("int") * 2)))
    total = F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(F.coalesce(d, F.lit(0))))
    return F.when((n >= 13) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def valid(kind: str, text: Column) -> Column:
    return {"email": lambda: F.lit(True), "ip": lambda: F.rlike(text, F.lit(VALID_IP)), "card": lambda: _luhn(text), "phone": lambda: _digits(text).between(9, 15)}[kind]()


def _search(df: DataFrame, text: str, pattern: str, out: str, hint: Column | None = None) -> DataFrame:
    """Add ``out``: array of (start, match, before, after) of every match, leftmost and non-overlapping.

    ``before`` and ``after`` are up to ``CONTEXT`` characters of what is around it: the gap, the neighbouring match and the gap behind that.
    """
    some = F.col(text).isNotNull() if hint is None else F.col(text).isNotNull() & hint
    t = F.col(text)
    df = df.withColumn("_m", F.when(some, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.col("_g")))
    df = df.withColumn("_l", F.transform(F.arrays_zip(F.col("_m").alias("m"), F.col("_g").alias("g")), lambda z: (F.coalesce(F.length(z["m"]), F.lit(0)) + F.length(z["g"])).cast("long")))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, _running(F.col("_l"))))
    # zipped, not indexed: what a lambda refers to from outside may be evaluated again for every element
    n = F.size("_m")
    none = F.array(F.lit(""))
    zipped = F.arrays_zip(
        F.col("_m").alias("m"), F.slice("_s", 1, n).alias("s"), F.slice("_g", 1, n).alias("g"), F.slice("_g", 2, n).alias("h"), F.slice(F.concat(none, F.col("_m")), 1, n).alias("m0"),
        F.slice(F.concat(none, F.col("_g")), 1, n).alias("g0"), F.slice(F.concat(F.col("_m"), none), 2, n).alias("m1"), F.slice(F.concat(F.col("_g"), none), 3, n).alias("h1"),
    )
    near, far = lambda x: F.right(x, F.lit(CONTEXT)), lambda x: F.left(x, F.lit(CONTEXT))
    item = F.transform(
        F.when(n > 0, zipped),
        lambda z: F.struct(
            (z["s"] + F.length(z["g"])).cast("long").alias("start"), z["m"].alias("match"), near(F.concat(near(z["g0"]), near(z["m0"]), near(z["g"]))).alias("before"),
            far(F.concat(far(z["h"]), far(z["m1"]), far(z["h1"]))).alias("after"),
        ),
    )
    item = F.coalesce(item, F.array().cast("array<struct<start:long,match:string,before:string,after:string>>"))
    return df.withColumn(out, item).drop("_m", "_g", "_l", "_s")


def find_base(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", candidates: bool = True) -> DataFrame:
    """(id, key, seeds, cands): validated seeds and identifier-like words with their surroundings; ``key`` is a hash of the text."""
    df = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    df = df.withColumn("key", F.xxhash64("text")).withColumn("digits", F.coalesce(F.rlike("text", F.lit("[0-9]")), F.lit(False)))
    for kind in KINDS:
        hint = F.lit(True) if HINTS[kind] is None else F.contains("text", F.lit(HINTS[kind]))
        df = _search(df, "text", PATTERNS[kind], f"_{kind}", hint if kind == "email" else hint & F.col("digits"))
    if candidates:
        df = _search(df, "text", CANDIDATE, "_word", F.col("digits"))
        df = _search(df, "text", RUN, "_run", F.size("_word") > 1)
        df = df.withColumn("_cand", F.concat("_run", "_word"))
    own = [_validated(f"_{kind}", kind, n) for n, kind in enumerate(KINDS)]
    df = df.withColumn("seeds", F.concat(*own))
    return df.select("id", "key", "seeds", *([F.col("_cand").alias("cands")] if candidates else []))


def _validated(found: str, kind: str, number: int) -> Column:
    good = F.filter(found, lambda x: valid(kind, x["match"]))
    return F.transform(good, lambda x: F.struct(F.lit(number).alias("kind"), *(x[c].alias(c) for c in ("start", "match", "before", "after"))))


def _ends(x: Column) -> Column:
    return x["start"] + F.length(x["match"])


def base_spans(seeds: Column) -> Column:
    return F.transform(seeds, lambda x: F.struct(x["kind"].cast("int").alias("kind"), x["start"].alias("start"), _ends(x).alias("end")))


def _words(text: Column) -> Column:
    """A normal form of context words: lower case, digits as one sign, outer punctuation gone."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}0=:#]+|[^\p{L}0=:#]+$", "")), lambda w: w != "")


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns of one occurrence: two words to the left; one on either side."""
    b, a = _words(before), _words(after)
    two = F.when(F.size(b) >= 2, F.concat(F.lit("<<"), F.concat_ws(" ", F.slice(b, -2, 2))))
    sides = F.when((F.size(b) >= 1) & (F.size(a) >= 1), F.concat(F.lit("<>"), F.element_at(b, -1), F.lit(" _ "), F.get(a, F.lit(0))))
    return F.array_compact(F.array(two, sides))


def occurrences(found: DataFrame) -> DataFrame:
    """(id, key, kind, start, end, instance, pattern): seeds with their kind, other identifier-like words with kind null."""
    lead = lambda m: F.length(m) - F.length(F.regexp_replace(m, r"^[\"'(\[{<,;:!?]+", ""))
    core = lambda m: F.regexp_replace(m, r"^[\"'(\[{<,;:!?]+|[\"')\]}>.,;:!?]+$", "")
    base = F.transform("seeds", lambda x: F.struct(x["kind"].cast("int").alias("kind"), x["start"].alias("start"), _ends(x).alias("end"), F.lower(x["match"]).alias("instance"), _patterns(x["before"], x["after"]).alias("ps")))
    rest = F.transform(
        "cands",
        lambda x: F.struct(
            F.lit(None).cast("int").alias("kind"), (x["start"] + lead(x["match"])).alias("start"), (x["start"] + lead(x["match"]) + F.length(core(x["match"]))).alias("end"),
            F.lower(core(x["match"])).alias("instance"), _patterns(x["before"], x["after"]).alias("ps"),
        ),
    )
    own = found.select("id", "key", F.explode(base).alias("o")).select("id", "key", "o.*")
    other = found.select("id", "key", F.explode(rest).alias("o")).select("id", "key", "o.*").filter(F.length("instance") >= LEAST_LENGTH)
    # a word that touches a seed is no news; both are dealt into stretches of the text that they touch, and meet there
    parts = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))).alias("part")
    seeds = own.select(F.col("id").alias("id_"), F.col("key").alias("key_"), F.col("start").alias("from"), F.col("end").alias("to"), parts.alias("part_"))
    touch = F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")) & (F.col("part") == F.col("part_")) & (F.col("from") < F.col("end")) & (F.col("to") > F.col("start"))
    touching = other.select("id", "key", "start", "end", parts).join(seeds, touch, "left_semi").select(F.col("id").alias("id_"), F.col("key").alias("key_"), F.col("start").alias("from")).distinct()
    free = other.join(touching, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")) & (F.col("start") == F.col("from")), "left_anti")
    rows = own.unionByName(free)
    return rows.select("id", "key", "kind", "start", "end", "instance", F.explode("ps").alias("pattern")).distinct()


def bootstrap(occ: DataFrame, support: int = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(instance, kind, confidence) of discovered identifiers.

    Each round scores the patterns by their believed instances, then the
    instances by their patterns; a pattern needs ``support`` believed instances
    and ``confidence`` among all of its instances.  The rounds end when one
    believes no more instances than the round before.
    """
    links = materialize(occ.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "links")
    known = links.filter("kind is not null").select("pattern", "instance", "kind", F.lit(1.0).alias("conf"))
    found, n = None, 0
    total = materialize(links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "totals")
    while True:
        believed = known if found is None else known.unionByName(links.filter("kind is null").drop("kind").join(found, "instance").select("pattern", "instance", "kind", "conf"))
        scores = believed.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("hits"), F.sum("conf").alias("mass")).join(total, "pattern")
        strong = scores.filter((F.col("hits") >= support) & (F.col("mass") / F.col("n") >= confidence)).select("pattern", F.col("kind").alias("k"), (F.col("mass") / (F.col("n") + 0.5)).alias("c"))
        strong = materialize(strong, "strong")
        held = links.filter("kind is null").drop("kind").join(strong, "pattern").groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("c"), F.lit(0.999)))))).alias("conf"))
        best = held.groupBy("instance").agg(F.max_by(F.struct("k", "conf"), F.struct("conf", -F.col("k"))).alias("b")).select("instance", F.col("b.k").alias("kind"), F.col("b.conf").alias("conf"))
        new = materialize(best.filter(F.col("conf") >= confidence), "found")
        if found is not None:
            drop_table(found)
        drop_table(strong)
        found, before, n = new, n, new.count()
        if n <= before:
            return found


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, base, added): base spans and the spans the patterns add, one row per row of ``docs``."""
    found = materialize(find_base(docs, doc_id, text), "base")
    some = found.filter((F.size("seeds") > 0) | (F.size("cands") > 0)).dropDuplicates(["id", "key"])
    occ = materialize(occurrences(some), "occ")
    news = bootstrap(occ)
    spans = occ.filter("kind is null").drop("kind", "pattern").distinct().join(news, "instance")
    spans = spans.groupBy("id", "key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added")).withColumnsRenamed({"id": "id_", "key": "key_"})
    spans = spans.withColumn("added", _apart(F.col("added")))
    out = found.join(spans, F.col("id").eqNullSafe(F.col("id_")) & F.col("key").eqNullSafe(F.col("key_")), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), base_spans(F.col("seeds")).alias("base"), F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def spell(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(spans: Column) -> Column:
    """Of spans that overlap, the one that starts first, the longest of such; sorted by kind and start."""
    order = F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("e"), s["kind"].cast("int").alias("kind"), s["end"]))
    kept = F.aggregate(
        F.array_sort(order), F.array().cast(SPAN),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]), acc).otherwise(F.array_append(acc, F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))),
    )
    return F.array_sort(kept)


def _joined(spans: Column) -> Column:
    """Spans as disjoint intervals in order, overlapping ones as one of the first one's kind."""
    order = F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("e"), s["kind"].cast("int").alias("kind"), s["end"]))

    def step(acc, s):
        last = F.element_at(acc, -1)
        longer = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        more = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.array_append(acc, more))

    return F.aggregate(F.array_sort(order), F.array().cast(SPAN), step)


def _rebuilt(text: Column, intervals: Column) -> Column:
    """The text with a placeholder for every interval; put together in blocks, so that long texts with many intervals stay cheap."""
    names = F.array(*map(F.lit, KINDS))

    def block(b, i):
        low = (i * BLOCK).cast("long")
        own = F.filter(intervals, lambda s: (s["end"] > low) & (s["start"] < low + BLOCK))
        at = lambda x: F.least(F.greatest(x - low, F.lit(0)), F.lit(BLOCK)).cast("int")
        begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(s, x):
            mark = F.when(x["start"] >= low, F.concat(F.lit("<"), F.get(names, x["kind"]), F.lit(">"))).otherwise(F.lit(""))
            return F.struct(at(x["end"]).alias("at"), F.concat(s["out"], F.substring(b, s["at"] + 1, at(x["start"]) - s["at"]), mark).alias("out"))

        return F.aggregate(own, begun, step, lambda s: F.concat(s["out"], F.substring(b, s["at"] + 1, F.lit(BLOCK))))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), block), "")


def _without_base(df: DataFrame, text: str, more: Column | None, some: Column | None = None) -> tuple[DataFrame, str]:
    """``df`` with the base spans of ``text``, and the spans ``more``, replaced; and the column that says whether any were."""
    found = fresh(df.columns, *(f"_{kind}" for kind in KINDS), "_intervals", "_changed")
    digits = F.rlike(text, F.lit("[0-9]"))
    for kind, name in zip(KINDS, found):
        hint = F.lit(True) if HINTS[kind] is None else F.contains(text, F.lit(HINTS[kind]))
        hint = hint if kind == "email" else hint & digits
        df = _search(df, text, PATTERNS[kind], name, hint if some is None else some & hint)
    spans = [base_spans(_validated(name, kind, n)) for n, (kind, name) in enumerate(zip(KINDS, found))]
    intervals, changed = found[len(KINDS) :]
    every = F.concat(*spans, *([] if more is None else [F.coalesce(more, F.array().cast(SPAN))]))
    df = df.withColumn(intervals, _joined(every)).withColumn(changed, F.size(intervals) > 0)
    df = df.withColumn(text, F.when(F.size(intervals) > 0, _rebuilt(F.col(text), F.col(intervals))).otherwise(F.col(text)))
    return df.drop(*found[:-1]), changed


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every base span and every discovered one replaced by a placeholder; all columns and rows are kept.

    Spans of the original text are merged where they overlap and replaced at
    once, so what stands outside them is unchanged.  What is a base span of the
    new text, since what stood beside it is gone, is then replaced likewise,
    and once more.
    """
    key, old, new = fresh(docs.columns, "_key", "_id2", "_added")
    found = find_pii(docs, doc_id, text).filter(F.size("added") > 0).dropDuplicates(["doc_id", "text_key"])
    found = materialize(found.select(F.col("doc_id").alias(old), F.col("text_key").alias(key), F.col("added").alias(new)), "added")
    n, spans = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(new)), F.lit(0))).first()
    found = F.broadcast(found) if 64 * n + 24 * spans <= BROADCAST_BYTES else found  # else texts and spans are shuffled to each other
    kind = docs.schema[text].dataType
    df = docs.withColumn(text, F.col(text).cast("string"))
    df = df.join(found, F.col(doc_id).eqNullSafe(F.col(old)) & (F.xxhash64(F.col(text)) == F.col(key)), "left")
    df, changed = _without_base(df, text, F.col(new))
    for _ in range(2):
        df, changed = _without_base(df, text, None, F.col(changed))
    return df.withColumn(text, F.col(text).cast(kind)).select(*docs.columns)
