"""Every operator against its brute-force version: on the smallest tables, and on awkward rows."""

import math
import random
import struct
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import BASE, base_spans, contamination, grams, jaccard_classes, luhn, quality, sha, space_words, substring
from pyspark.sql import functions as F

from lumenstrata.llm import decontaminate, html_extract, langid, ngram_join, pieces, pii, queries, substring_dedup, token_rollup, toxicity
from lumenstrata.llm import quality as quality_op
from lumenstrata.llm.common import WordHasher, fresh, hashed_words, rolled, slices, windows

SF = "/root/testdata/sf0.001"
MODEL = f"{queries.TOKENIZERS}/{queries.PIECE_MODEL}"
PROSE = "the cat sat on the mat while a dog ran past one red house and seven green birds sang over low hills until dusk fell".split()


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    long = " ".join(rng.choice(PROSE) + str(rng.randrange(900)) for _ in range(6000))
    base = [rng.choice(PROSE) for _ in range(120)]
    near = base.copy()
    near[60] = "changed"
    return [
        None, "", " ", "\n\n", "!!! ???", "word", "é ñ 日本", long, long, " ".join(base), " ".join(near), " ".join(base), "x " * 300, "a\nb\na\n\n b\nb", "Mail a@b.co, +1 (625) 555-7196 10.0.0.1 4111 1111 1111 1111.",
        "0" * 5000, "a@" * 3000 + "a@b.c", "1.2.3.4.5.6.7.8", "+" * 2000 + "1", "a.b@c.d@e.f", "😀 a@b.com 😀 255.255.255.256 1.1.1.01", "a@b.com%x@y.z 49927398716 4992739871600000", "\x00\x01",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows with clashing extra columns; ids are unique."""
    rows = [(i, t, None if i % 3 else "en", "s", float(i), "clash") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words double, main_text string")


def rows(df, key="doc_id"):
    got = df.collect()
    out = {r[key]: r for r in got}
    assert len(out) == len(got)
    return out


def empty(df):
    return df.filter(F.lit(False))


# 3


def test_decontamination(spark, docs):
    items = [(str(a), b) for a, b in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    got = rows(queries.op3_decontamination(spark, SF))
    for k, t in docs.items():
        n, hit, found = contamination(t, items)
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), sha(",".join(found)), hit > 0)


@pytest.mark.parametrize("block, most", [(1 << 20, 1 << 26), (40, 1 << 26), (40, 60)])
def test_decontamination_of_odd_rows(spark, odd, block, most):
    own = [("1", "The CAT sat"), ("2", "x x x x x x x x x x x x"), ("2", "word"), (None, "é ñ"), ("4", None), ("5", "!!!"), ("6", " ".join(PROSE))]
    items = spark.createDataFrame(own, "item_id string, text string")
    got = rows(decontaminate.find_contamination(odd, items, block_bytes=block, map_bytes=most))
    for i, t in enumerate(odd_texts()):
        n, hit, found = contamination(t, [(a or "", b) for a, b in own if b is not None])
        r = got[i]
        assert (r["n_words_"], sorted(r["item_ids"]), r["contaminated"]) == (n, sorted(set(found)), hit > 0)
        assert sum(b - a for a, b in zip(r["hit_ranges"][::2], r["hit_ranges"][1::2])) == hit
    assert decontaminate.find_contamination(empty(odd), items).count() == 0
    assert decontaminate.find_contamination(odd, empty(items)).filter("contaminated").count() == 0


def test_wu_manber_finds_what_a_scan_finds():
    rng = random.Random(3)
    for _ in range(200):
        m = rng.randrange(1, 6)
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(60)]
        patterns = {tuple(rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(m)): {k} for k in range(4)}
        want = [(i, ids) for i in range(60 - m + 1) for p, ids in patterns.items() if tuple(text[i : i + m]) == p]
        assert decontaminate.WuManber(patterns, m).find(text) == want


# 7


def test_quality(spark, docs, odd):
    got = rows(queries.op7_quality_rules(spark, SF))
    for k, t in docs.items():
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == quality(t)
        assert not (r["base_failed"] and r["kept"])
    ledger = quality_op.evaluate_rules(odd)
    for r in ledger.collect():
        assert (r["n_words_"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], bool(r["rule_bits"] & 3)) == quality(odd_texts()[r["doc_id"]])
    assert quality_op.evaluate_rules(empty(odd)).count() == 0


def test_ablation(spark):
    ledger = queries.op7_quality_rules(spark, SF).select("rule_bits")
    bits = [r[0] for r in ledger.collect()]
    for version, mask in quality_op.POLICIES.items():
        for r in quality_op.ablation(ledger, version).collect():
            b = 1 << r["bit"]
            assert r["n_failed"] == sum(bool(x & b) for x in bits) and r["n_failed_alone"] == sum(x & mask == b for x in bits) and r["n_kept_without"] == sum(not x & mask & ~b for x in bits)


# 9


def test_substring_dedup(spark, docs):
    want = substring(list(docs.items()))
    assert {k: tuple(r)[1:] for k, r in rows(queries.op9_substring_dedup(spark, SF)).items()} == want


def test_substring_dedup_of_odd_rows(spark, odd):
    want = substring(list(enumerate(odd_texts())))
    assert {k: tuple(r)[1:] for k, r in rows(substring_dedup.remove_repeats(odd)).items()} == want
    assert substring_dedup.remove_repeats(empty(odd)).count() == 0
    twice = odd.filter("doc_id = 9").unionByName(odd.filter("doc_id = 9")).withColumn("doc_id", F.lit(None).cast("long"))
    got = substring_dedup.remove_repeats(twice).collect()
    assert sorted(r["n_removed"] for r in got)[-1] == got[0]["n_words"]


def test_runs_are_merged_and_compacted(spark, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/runs", fan_in=3)
    batches = [[[1, 2, 2]], [[2, 3]], [[3], [4]], [[1, 5]]]
    for b in batches:
        index.add(spark.createDataFrame([(g,) for g in b], "grams array<long>"))
    assert len(index.runs) == 2
    assert {r["g"]: r["n"] for r in index.merged().collect()} == {1: 2, 2: 3, 3: 2, 4: 1, 5: 1}
    assert sorted(r["g"] for r in index.repeated().collect()) == [1, 2, 3]


def test_repeats_across_calls(spark, docs, tmp_path):
    """Calls with one index find what stood in the calls before, though it stands once in their own."""
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/runs")
    rng = random.Random(3)
    shared = [f"s{k}" for k in range(25)]
    texts = dict(list(docs.items())[:60])
    for k in (1001, 2001, 3001):
        texts[k] = " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(30)), *shared[: 20 + k // 1000], *(f"b{rng.randrange(10**6)}" for _ in range(30))])
    texts[1002] = texts[2002] = " ".join(f"c{k}" for k in range(40))
    bounds = [(-1, 1999), (2000, 2999), (3000, 9999)]
    want, got = substring(list(texts.items())), {}
    for a, b in bounds:
        part = spark.createDataFrame([(k, t) for k, t in texts.items() if a < k <= b], "doc_id long, text string")
        got |= {k: tuple(r)[1:] for k, r in rows(substring_dedup.remove_repeats(part, index=index)).items()}
        assert len(index.runs) == 1
    assert got == want
    assert want[2001][1] == 21 and want[2002][1] == 40 and want[3001][1] == 22


def test_hashes_of_words_are_those_of_their_bytes():
    odd = [None, b"", b" ", b"a", b"a\x0bb\x0cc\x1cd\xc2\x85e", b"x" * 8, b" " + b"x" * 9 + b"\r\n", b"x" * 64 + b"\t" + b"x" * 65, b"\0 \0\0", b"abcdefgh abcdefghi a x" + b"y" * 200]
    for texts in (odd, odd[::-1], [], [None], [b" ".join(x or b"" for x in odd)]):
        words, first = substring_dedup.split_words(texts)
        h, begins = hashed_words(texts)
        assert begins.tolist() == first.tolist() and len(h) == len(words)
        assert len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist())))
    assert dict(zip(words, h.tolist())) == dict(zip(*(x if isinstance(x, list) else x.tolist() for x in (substring_dedup.split_words(odd)[0], hashed_words(odd)[0]))))


def test_a_sketch_of_many_distinct_words_takes_no_longer():
    def seconds(texts):
        best = math.inf
        for _ in range(3):
            start = time.process_time()
            list(run(iter([batch(texts)])))
            best = min(best, time.process_time() - start)
        return best

    batch = lambda texts: pa.RecordBatch.from_pydict({"ord": [0], "text": texts, "gs": [[1]]})
    run = substring_dedup._windows(substring_dedup.WINDOW, substring_dedup.GRAM)
    assert seconds([" ".join(f"{k:07d}" for k in range(300_000))]) < 2.5 * seconds(["0000000 " * 300_000])


def test_equal_windows_have_equal_minimizers():
    texts = [" ".join(PROSE * 9).encode(), None, b"too short", " ".join(PROSE * 2).encode()]
    words, first = substring_dedup.split_words(texts)
    h = WordHasher()(words)
    starts, at, g = substring_dedup.minimizers(h, first)
    n = len(PROSE)
    assert starts.tolist() == [*range(9 * n - 19), *range(first[3], first[3] + 2 * n - 19)]
    assert all(g[i] == g[i + n] for i in range(8 * n - 19)) and g[: 2 * n - 19].tolist() == g[19 - 2 * n :].tolist()
    grams = windows(h, substring_dedup.GRAM)
    for s, a, x in zip(starts, at, g):
        near = grams[s : s + substring_dedup.WINDOW - substring_dedup.GRAM + 1]
        assert a == s + near.argmin() and x == near.min()


def test_windows_from_halves():
    h = np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64)
    assert all((windows(h, k) == rolled(h, k)).all() for k in (1, 2, 3, 8, 13, 20, 199, 200, 201))


# 5


def test_bands_reach_the_recall():
    bands, n = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**n) ** bands >= 0.9999 and bands * n <= ngram_join.MIN_HASHES


def test_ngram_join(spark, docs):
    got = rows(queries.op5_ngram_join(spark, SF))
    assert {k: (r["class_id"], r["n_links"]) for k, r in got.items()} == jaccard_classes(list(docs.items()))


def test_ngram_join_in_blocks(spark, monkeypatch):
    """A group of near copies that is cut into many blocks and size bins loses no link."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    texts = []
    for i in range(150):
        t = base[: 200 - rng.randrange(0, 60)]
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = f"v{i}"
        texts.append(" ".join(t))
    texts += odd_texts() + [texts[0], texts[0]]
    monkeypatch.setattr(ngram_join, "LEAST_DOCS", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(ngram_join.ngram_classes(df, block_docs=20))
    assert {k: (r["class_id"], r["n_links"]) for k, r in got.items()} == jaccard_classes(list(enumerate(texts)))
    assert ngram_join.ngram_classes(empty(df)).count() == 0


def test_connected_parts(spark):
    edges = [(a, a + 1) for a in range(0, 60) if a % 20 != 19] + [(100, 105), (105, 103), (103, 7)]
    got = {r["id"]: r["root"] for r in ngram_join.connect(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = {v: (0 if v < 20 or v >= 100 else v // 20 * 20) for v in {x for e in edges for x in e}}
    assert got == {v: r for v, r in want.items() if v != r}


@pytest.mark.parametrize("threshold, shared, union", [(2 / 3, 2, 3), (0.8, 4, 5), (5 / 6, 5, 6), (0.8004, 4, 5)])
def test_pairs_at_the_threshold_are_linked(threshold, shared, union):
    """A threshold that is no multiple of a thousandth is not rounded, up or down."""
    grams = np.arange(union, dtype=np.uint64)
    counts, low = ngram_join.neighbours([grams[:shared], grams], np.array([3, 2]), np.array([7, 9]), threshold)
    assert (counts.tolist(), low.tolist()) == (([2, 3], [7, 7]) if shared / union >= threshold else ([0, 0], [7, 9]))
    data = pack_through(ngram_join, [grams[:shared]], [grams], threshold)
    assert data == ([(7, 2, 7), (9, 3, 7)] if shared / union >= threshold else [])


def pack_through(module, first, second, threshold):
    """What two blocks of one set each say of one another."""
    a, b = (module.pack(sets, np.array([copies]), np.array([rep])) for sets, copies, rep in ((first, 3, 7), (second, 2, 9)))
    batch = pa.RecordBatch.from_arrays([pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["other", "data"])
    return [tuple(r.values()) for out in module._compare(threshold)([batch]) for r in out.to_pylist()]


def test_blocks_pack():
    sets = [np.unique(np.random.default_rng(i).integers(0, 90, 40, dtype=np.uint64)) for i in range(9)]
    s, c, r = ngram_join.unpack(ngram_join.pack(sets, np.arange(9), np.arange(9) * 7))
    assert all((a == b).all() for a, b in zip(s, sets)) and (c == np.arange(9)).all() and (r == np.arange(9) * 7).all()


# 2


def test_base_spans(spark, docs):
    got = rows(queries.op2_pii(spark, SF))
    for k, t in docs.items():
        b = base_spans(t)
        s = [":".join(map(str, x)) for x in b]
        r = got[k]
        assert [r[f"n_{kind}"] for kind in BASE] == [sum(x[0] == kind for x in b) for kind in BASE]
        assert r["base_sha256"] == sha(",".join(s)) and set(s) <= set(r["spans"].split(",")) | ({""} if not s else set())


def test_base_spans_of_odd_rows(spark, odd):
    found = pii.find_pii(odd)
    for r in found.collect():
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]] == base_spans(odd_texts()[r["doc_id"]]), odd_texts()[r["doc_id"]]
    assert pii.find_pii(empty(odd)).count() == 0


def test_patterns_discover_identifiers(spark):
    """Contexts of seeds hold identifiers that no base rule takes."""
    texts = [f"Order {i}. Please write to contact user{i}@mail{i}.example.com today, thanks" for i in range(12)] + [f"Please write to contact name{i}(at)host{i}.org today, thanks" for i in range(4)]
    texts += [f"room {i} has seat{i}x in it" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(pii.find_pii(df))
    for i, t in enumerate(texts):
        added = [t[s["start"] : s["end"]] for s in got[i]["added"]]
        assert added == ([f"name{i - 12}(at)host{i - 12}.org"] if 12 <= i < 16 else []), t
    shown = rows(pii.redact(df.withColumn("_key", F.lit("kept"))))
    assert shown[0]["text"] == "Order 0. Please write to contact <email> today, thanks", shown[0]["text"]
    assert shown[12]["text"] == "Please write to contact <email> today, thanks" and shown[0]["_key"] == "kept"


def redacted(text, added):
    """Brute force: spans that overlap are one, of the first's kind; then base spans of what has become of the text."""
    spans = [(a, -b, pii.KINDS.index(k)) for k, a, b in base_spans(text)] + [(s["start"], -s["end"], s["kind"]) for s in added]
    while spans:
        merged = []
        for a, b, k in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], -b)
            else:
                merged.append([a, -b, k])
        for a, b, k in reversed(merged):
            text = f"{text[:a]}<{pii.KINDS[k]}>{text[b:]}"
        spans = [(a, -b, pii.KINDS.index(k)) for k, a, b in base_spans(text)]
    return text


def test_redaction_leaves_no_base_span(spark, odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    added = {r["doc_id"]: r["added"] for r in pii.find_pii(odd).collect()}
    for r in out.collect():
        t = odd_texts()[r["doc_id"]]
        assert r["text"] == (None if t is None else redacted(t, added[r["doc_id"]])), t
        assert base_spans(r["text"]) == []


def test_redaction_takes_spans_and_nothing_else(spark):
    """A discovered word may stand inside other words and spans: only its own places go."""
    texts = [f"Client {i} has card number {4000 + i}77{i} today" for i in range(2)]
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004", "4222222222222", "378282246310005"]
    texts += [f"Client {i} has card number {c} today" for i, c in enumerate(cards)]
    texts += ["user400077@mail.com, A4000770 and 4000770x stay", "x " * 5000 + "mail a@b.co " * 900 + "1.2.3.4 " * 500 + "éé", "+1 (625) 555-7196 10.0.0.1 4111 1111 1111 1111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {r["doc_id"]: r["added"] for r in pii.find_pii(df).collect()}
    got = rows(pii.redact(df))
    assert [len(added[i]) for i in range(2)] == [1, 1]
    for i, t in enumerate(texts):
        assert got[i]["text"] == redacted(t, added[i]), t[:80]
    assert got[8]["text"].startswith("<email>, A4000770 and 4000770x")


def test_runs_and_neighbours_are_discovered(spark):
    """Identifiers of several words, and such behind other identifier-like words."""
    texts = [f"please call {i}a the desk at +1 (625) 555-{7000 + i} before noon" for i in range(8)]
    texts += [f"please call {i}b the desk at ({700 + i}) 555-{3000 + i} before noon" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(pii.find_pii(df))
    for i, t in enumerate(texts):
        assert [t[s["start"] : s["end"]] for s in got[i]["added"]] == ([f"{700 + i - 8}) 555-{3000 + i - 8}"] if i >= 8 else []), t


def test_luhn(spark):
    cards = ["4111111111111111", "4111111111111112", "4111 1111-1111 1111", "1" * 20, "0" * 13, "79927398713", ""]
    df = spark.createDataFrame([(c,) for c in cards], "c string")
    assert [r[0] for r in df.select(pii._luhn(F.col("c"))).collect()] == [luhn(c) for c in cards]


# 6


def test_levenshtein_automaton():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _step(row, i, x, b)
        return row[-1]

    def _step(row, i, x, b):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        return new

    rng = random.Random(2)
    terms = ["idiot", "moron", "pathetic", "disgusting", "scum", "trashcans"]
    trie = toxicity.FuzzyTrie(terms, [])
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w)) if w else 0
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "t", "zz"])
        w = "".join(w)
        # the first letter is never edited: what is left of word and term behind it is compared
        want = min((d for t in terms if w[:1] == t[0] and (d := distance(w[1:], t[1:])) <= toxicity.edits_allowed(t, False)), default=None)
        assert trie.match(w) == want, w
    stems = toxicity.FuzzyTrie([], ["lowei", "lostraxyz"])
    assert stems.match("loweischaft") == 0 and stems.match("lowe") is None and stems.match("lostrxyzend") == 1 and stems.match("lost") is None


def test_automaton_against_plain_edit_distance():
    """What scoring uses: edits at any place, a swap of neighbours is one."""

    def distance(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(12)
    terms = ["idiot", "moron", "pathetic", "disgusting", "scum", "trashcans", "ass"]
    trie = toxicity.FuzzyTrie(terms, [], anywhere=True)
    for _ in range(6000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w)) if w else 0
            if rng.random() < 0.3:
                w[i : i + 2] = w[i : i + 2][::-1]
            else:
                w[i : i + rng.randrange(2)] = rng.choice(["", "a", "t", "1", "zz"])
        w = "".join(w)
        want = min((d for t in terms if (d := distance(w, t)) <= toxicity.edits_allowed_anywhere(t, False)), default=None)
        assert trie.match(w) == want, w


def test_toxicity_of_held_out_documents(spark):
    """By label: the documents of the held-out fold, which the fit never sees."""
    at = "/root/testdata/sf0.01"
    label = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{at}/labels.parquet'").fetchall())
    got = [(r["score"], r["predicted"], label[r["doc_id"]]) for r in queries.op6_toxicity(spark, at).filter("held_out").collect() if r["doc_id"] in label]
    good, bad = [x for x in got if not x[2]], [x for x in got if x[2]]
    assert len(bad) >= 3 and len(good) >= 30
    above = sum((b[0] > g[0]) + (b[0] == g[0]) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert above >= 0.98 and sum(x[1] for x in bad) >= 0.8 * len(bad) and sum(x[1] for x in good) <= 0.05 * len(good)


def test_misspellings_anywhere():
    trie = toxicity.FuzzyTrie(["idiot", "moron", "scum", "clown", "stupid", "pathetic"], [], anywhere=True)
    for w in ("jdiot", "diot", "didiot", "scuum", "scumm", "cum", "clwon", "lcown", "moorn", "id1ot", "st*pid", "m0ron", "iditos"[:5]):
        assert trie.match(w) == 1, w
    assert trie.match("idiot") == 0 and trie.match("jdoit") is None and trie.match("lcwon") is None
    model = toxicity.ToxicityModel({"idiot": 5.0, "stupid": 5.0, "moron": 5.0})
    s = toxicity.Scorer(model)
    for w in ("id1ot", "st*pid", "m0ron", "jdiot"):
        assert s.features(f"the {w} is here")[3] > 0 and s.features(f"the {w} is here")[2] == 0, w
    assert s.features("idiot-like")[1] > 0


def test_long_quotations():
    s = toxicity.Scorer(toxicity.ToxicityModel({"idiot": 5.0}))
    long = "words here\n" * 90
    for a, b in ("“”", "„“", "«»", '""'):
        assert s.features(f"{a}{long}idiot {long}end{b} more")[1:3] == [0.0, math.log1p(5.0)], a
        assert s.features(f"{a}quoted{b} {long} idiot {long}")[1:3] == [math.log1p(5.0), 0.0], a
    assert s.features("a “stray mark\n the idiot")[2] == 0 and s.features('a 5" board, the idiot, a 6" board')[2] == 0


def test_toxicity(spark, odd):
    rng = random.Random(4)
    plain = lambda n: " ".join(rng.choice(PROSE) + rng.choice(["", "ly", "ed"]) for _ in range(n))
    rows_ = []
    for i in range(400):
        t = plain(60)
        if i % 4 == 0:
            t = f"{plain(20)} {rng.choice(['moronic', 'wretched', 'vermi' + rng.choice('abcdefgh') + 'x'])} {plain(20)} vermi{rng.choice('abcdefgh')} {plain(5)}"
        rows_.append((t, int(i % 4 == 0)))
    model = toxicity.fit(rows_)
    s = toxicity.Scorer(model)
    assert all((s.score(t) >= 0.5) == bool(y) for t, y in rows_)
    assert s.score(f"{plain(9)} moronik {plain(9)}") >= 0.5 and s.score(f"{plain(9)} vermizzz {plain(9)}") >= 0.5
    insult, quote = s.score("you wretched thing there"), s.score('he said “you wretched thing” there')
    assert insult > quote
    assert s.score(None) == s.score("") < 0.5
    assert toxicity.Scorer(toxicity.fit([])).score("moronic") < 0.5
    got = rows(toxicity.score_toxicity(odd, model))
    assert all(0 <= r["tox_score"] <= 1 for r in got.values()) and toxicity.score_toxicity(empty(odd), model).count() == 0
    assert toxicity.fit_from_tables(empty(odd), spark.createDataFrame([], "doc_id long, toxic int")).words == {}


def test_toxicity_query(spark, docs):
    got = rows(queries.op6_toxicity(spark, SF))
    assert set(got) == set(docs) and all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for k, r in got.items())


# 1


def test_gradients():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(1)
    net = langid.train([("abc", "x"), ("xyz", "y")], steps=2, batch=4, hidden=3, segment=8)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(97, 103, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        p = langid.softmax(langid._logits(net, x, None)[2])
        return -np.log(p[:, np.arange(4), y]).mean()

    traces = ([], [])
    f, b, logits = langid._logits(net, x, None, traces)
    d = langid.softmax(logits)
    d[:, np.arange(4), y] -= 1
    d /= 24
    g = {k: np.zeros(v.shape, np.float32) for k, v in net.p.items()}
    langid._backward(x, (d @ net.p["out_f"].T), net.p["u_f"], traces[0], g["table_f"], g["u_f"], None)
    langid._backward(x[::-1], (d @ net.p["out_b"].T)[::-1], net.p["u_b"], traces[1], g["table_b"], g["u_b"], None)
    for name in ("u_f", "u_b", "table_f", "table_b"):
        for at in [tuple(rng.integers(0, n) for n in net.p[name].shape) for _ in range(5)] if name[0] == "u" else [(int(x[2, 1]), 1), (int(x[0, 0]), 4)]:
            was = net.p[name][at]
            net.p[name][at] = was + 1e-3
            up = loss()
            net.p[name][at] = was - 1e-3
            down = loss()
            net.p[name][at] = was
            assert math.isclose((up - down) / 2e-3, g[name][at], abs_tol=2e-4), name


def test_language_id(spark, docs, odd):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = rows(queries.op1_language_id(spark, SF))
    held = [k for k, r in got.items() if r["held_out"]]
    assert held and sum(got[k]["lang_pred"] == lang[k] for k in held) >= 0.95 * len(held)
    net = langid.train([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de")], steps=40)
    got = rows(langid.identify(odd, net))
    for i, t in enumerate(odd_texts()):
        if t is None or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["lang_score"]) == ("und", 0.0)
        else:
            assert got[i]["lang_pred"] in ("en", "de") and 0 <= got[i]["lang_score"] <= 1
    assert langid.identify(empty(odd), net).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit_from_table(empty(odd))).collect()} == {"und"}


def test_pooling_does_not_depend_on_blocks():
    net = langid.train([("abab", "x"), ("cdcd", "y")], steps=3)
    texts = [b"abc" * n for n in (0, 1, 21, 22, 50, 200)]
    a, b = langid.Predictor(net, block=2048)(texts), langid.Predictor(net, block=3)(texts)
    assert np.allclose(a, b, atol=1e-5) and np.allclose(a.sum(axis=1), [0, 1, 1, 1, 1, 1], atol=1e-4)


# 4


def all_paths(m, s):
    """(score, ids from the last back) of every segmentation, best first, ties by ids."""
    known = {p: (i, round(w * pieces.UNITS)) for i, (p, w, kind) in enumerate(m.pieces) if kind == "normal"}
    worst = min(w for _, w in known.values()) - round(pieces.UNK_PENALTY * pieces.UNITS)
    byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(m.pieces) if kind == "byte"}

    def go(s):
        if not s:
            return [(0, ())]
        out = []
        for j in range(1, len(s) + 1):
            if s[:j] in known:
                i, w = known[s[:j]]
                out += [(w + r, (*ids, i)) for r, ids in go(s[j:])]
            elif j == 1:
                out += [(worst + r, (*ids, *(byte[b] for b in reversed(s[0].encode())))) for r, ids in go(s[1:])]
        return out

    return sorted(go(s), key=lambda x: (-x[0], x[1]))


def toy(words=None):
    words = words or {"▁a": -1.5, "▁": -2.0, "a": -2.5, "b": -2.2, "ab": -3.1, "▁ab": -4.0, "ba": -3.3, "c": -3.0, "bc": -4.75, "▁▁": -5.0, "abc": -5.5}
    return pieces.PieceModel([("<unk>", 0.0, "unknown")] + [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)] + [(p, s, "normal") for p, s in words.items()])


def tied():
    """A model whose scores are small whole numbers, so that most paths have equals."""
    rng = random.Random(1)
    return toy({p: -float(rng.randrange(1, 4)) for p in ["a", "b", "c", "▁", "ab", "bc", "abc", "ba", "aa", "▁a", "▁ab", "▁▁"]})


@pytest.mark.parametrize("make", [toy, tied])
def test_nbest_against_all_paths(make):
    m, rng = make(), random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("aabbc  \né") for _ in range(rng.randrange(0, 10)))
        want = all_paths(m, ("▁" + text.replace(" ", "▁")) if text else "")
        for n in (1, 2, 4, 7):
            got = m.nbest(text, n)
            assert [(round(x * pieces.UNITS), tuple(reversed(ids))) for x, ids in got] == want[:n], (text, n)
            assert all(m.decode(ids) == text for _, ids in got)
        ids, score = m.encode(text)
        assert tuple(reversed(ids.tolist())) == want[0][1] and round(score * pieces.UNITS) == want[0][0]


@pytest.mark.parametrize("make", [toy, tied])
def test_chunks_searched_together_or_alone_alike(make):
    m, rng = make(), random.Random(8)
    chunks = sorted({"".join(rng.choice("▁aabbcé") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    own = m.learn(chunks)
    for c, k in zip(chunks, own):
        ids, *rest = m._alone(c)
        assert m.ids[m.id_at[k] : m.id_at[k + 1]].tolist() == ids and [m.scores[k], m.gaps[k], m.downs[k]] == rest, c
        assert m.bytes[m.byte_at[k] : m.byte_at[k + 1]].tobytes().decode() == c.replace("▁", " ")


def test_a_star_leaves_in_order():
    for m in (toy(), tied()):
        for s in ("▁abcab", "ababab", "▁▁abc"):
            want = all_paths(m, s)
            assert m.nbest_chunk(s, 1000) == want
            assert m.nbest_chunk(s, 5) == want[:5]
            cost = want[0][0] - want[3][0]
            assert m.nbest_chunk(s, 1000, cost) == [x for x in want if x[0] >= want[3][0]]


def test_a_chunk_of_any_length():
    m = pieces.PieceModel.load(MODEL)
    for s in ("xyz" * 4000, "a" * 9000, "é" * 3000):
        found = m.nbest(s, 4)
        assert m.decode(found[0][1]) == s and [x for x, _ in found] == sorted((x for x, _ in found), reverse=True) and len({tuple(i) for _, i in found}) == len(found) >= 2


def unigram_twin(path, scores):
    """The library's processor over the same file with its kind changed to unigram and other scores by id, whose N-best is the oracle."""
    import sentencepiece

    def varint(b, i):
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if not b[i - 1] & 128:
                return n, i

    def enc(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def fields(b):
        i = 0
        while i < len(b):
            start = i
            tag, i = varint(b, i)
            if tag & 7 == 2:
                n, i = varint(b, i)
                yield tag, b[i : i + n], b[start : i + n]
                i += n
            elif tag & 7 == 0:
                n, i = varint(b, i)
                yield tag, n, b[start:i]
            else:
                i += 4 if tag & 7 == 5 else 8
                yield tag, None, b[start:i]

    with open(path, "rb") as f:
        data = f.read()
    out, k = b"", 0
    for tag, value, raw in fields(data):
        if tag == 2 << 3 | 2:
            body = b"".join(enc(3 << 3) + enc(1) if t == 3 << 3 else r for t, v, r in fields(value))
            raw = enc(tag) + enc(len(body)) + body
        elif tag == 1 << 3 | 2:  # a piece, with its score
            if k in scores:
                body = b"".join(enc(t) + struct.pack("<f", scores[k]) if t == 2 << 3 | 5 else r for t, v, r in fields(value))
                raw = enc(tag) + enc(len(body)) + body
            k += 1
        out += raw
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_against_the_library(docs):
    m = pieces.PieceModel.load(MODEL)
    score = {i: m.weight[p] / pieces.UNITS for p, i in m.id.items()}
    sp = unigram_twin(MODEL, score)
    same = n = 0
    for t in [*list(docs.values())[:40], "Hello  world é", " a", "x ", "▁"]:
        t = t.replace("\n", " ")[:300]
        got, own = m.encode(t)
        if any(m.pieces[i][2] == "byte" for i in got):
            continue
        total = lambda ids: sum(round(score[i] * pieces.UNITS) for i in ids) / pieces.UNITS
        assert own == total(got)
        theirs = [total(x) for x in sp.nbest_encode_as_ids(t, 4)]  # the library sums in single precision
        assert np.allclose([x for x, _ in m.nbest(t, 4)], theirs, atol=1e-2), t
        same += got.tolist() == sp.nbest_encode_as_ids(t, 2)[0]
        n += 1
        assert m.decode(sp.encode(t)) == sp.decode(sp.encode(t)) == t.replace("▁", " ")
    assert n > 30 and same >= 0.9 * n


def test_encoding_round_trip(spark, odd):
    out = pieces.encode_pieces(odd, MODEL)
    got = rows(pieces.decode_pieces(out, MODEL))
    for i, t in enumerate(odd_texts()):
        r = got[i]
        assert r["decoded"] == t and (r["round_trip"] is None) == (t is None)
        if t is not None:
            assert r["round_trip"] and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True)
    assert pieces.encode_pieces(empty(odd), MODEL).count() == 0


def test_sentencepiece_query_against_all_paths(spark, tmp_path):
    texts = {1: "the cats", 2: None, 3: "", 4: "aaaa aa", 5: "é 日x", 6: "  a\nb", 7: "on it, on"}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    m = pieces.PieceModel.load(MODEL)
    got = {r["doc_id"]: r for r in queries.op4_sentencepiece(spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        r = got[i]
        if t is None:
            assert r["piece_ids"] is None and r["nbest_scores"] is None
            continue
        want = all_paths(m, ("▁" + t.replace(" ", "▁")) if t else "")
        assert r["piece_ids"] == list(reversed(want[0][1])) and [round(x * pieces.UNITS) for x in r["nbest_scores"]] == [x for x, _ in want[: pieces.NBEST]]
        assert r["n_pieces"] == len(want[0][1]) and r["score"] == r["nbest_scores"][0] and r["round_trip"]


def test_small_memo_changes_nothing(docs):
    a, b = pieces.PieceModel.load(MODEL), pieces.PieceModel.load(MODEL)
    b.keep = 3
    for t in list(docs.values())[:5]:
        assert (a.encode(t)[0] == b.encode(t)[0]).all()


# 8


def test_bpe_counter(docs):
    c = token_rollup.BpeCounter(f"{queries.TOKENIZERS}/{queries.BPE_RANKS}", queries.BPE_PATTERN)
    for t in [*docs.values(), "", " ", "a  b", "a \nb", "\n a", "it's we'll 12 a", "é 日本 😀 x"]:
        ids = c.encoding.encode_ordinary(t)
        assert c(t) == len(ids) and c.encoding.decode(ids) == t


def test_rollup(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup")
    make = lambda xs: spark.createDataFrame(xs, "doc_id long, source string, lang string, version string, n_tokens long, op string, seq int")
    first = make([(i, f"s{i % 3}", "en", "v1", 10 + i, "insert", 0) for i in range(30)] + [(99, None, None, "v1", None, None, 0)])
    assert r.commit("b1", first) and not r.commit("b1", first)
    total = lambda: {(x["source"], x["lang"], x["version"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}
    assert total()["s0", "en", "v1"] == (10, sum(10 + i for i in range(0, 30, 3))) and total()[None, None, "v1"] == (1, 0)
    second = make([(0, "s0", "en", "v1", None, "delete", 0), (3, "s1", "de", "v1", 100, "revise", 0), (6, "s0", "en", "v1", 1, "revise", 0), (6, "s0", "en", "v1", 2, "revise", 1), (500, "s0", "en", "v1", 7, "delete", 0)])
    assert r.commit("b2", second) and not r.commit("b2", second)
    assert total()["s0", "en", "v1"] == (8, sum(10 + i for i in range(9, 30, 3)) + 2) and total()["s1", "de", "v1"] == (1, 100)
    assert r.commit("b3", make([]))
    # a batch whose driver died, and a manifest that was not written whole, change nothing
    spark.range(1).write.parquet(f"file://{tmp_path}/rollup/data/batch-dead/entries")
    (tmp_path / "rollup/manifests" / f"{99:012d}").write_text('{"batches": [')
    assert r.commit("b4", make([(0, "s0", "en", "v1", 5, "insert", 0)])) and total()["s0", "en", "v1"][0] == 9
    state = r.state().groupBy("source", "lang", "version").agg(F.sum("d_docs"), F.sum("d_tokens")).collect()
    assert {tuple(x)[:3]: tuple(x)[3:] for x in state} == total()


def test_rollup_compacts_and_gives_way(spark, tmp_path):
    make = lambda xs: spark.createDataFrame(xs, "doc_id long, source string, lang string, version string, n_tokens long, op string")
    a, b = (token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup", fan_in=2) for _ in range(2))
    for k in range(5):
        assert a.commit(f"b{k}", make([(i, "s", "en", "v", k + 1, "revise") for i in range(k, 8)]))
        assert len(a._manifest()[1]["folders"]) <= 2
    assert [tuple(r)[3:] for r in b.totals().collect()] == [(8, 1 + 2 + 3 + 4 + 5 * 4)] and a.batches() == [f"b{k}" for k in range(5)]
    number, said = a._manifest()
    assert b.commit("other", make([(0, "s", "en", "v", 100, "revise")]))
    assert not a._publish(number, said)  # the other driver came first
    assert a.commit("mine", make([(0, "s", "en", "v", 7, "revise")])) and [tuple(r)[3:] for r in b.totals().collect()] == [(8, 7 + 2 + 3 + 4 + 5 * 4)]


def test_token_count_query_against_brute_force(spark, docs):
    meta = {i: (s, l) for i, s, l in duckdb.sql(f"SELECT doc_id, source, lang FROM '{SF}/documents.parquet'").fetchall()}
    bpe = token_rollup.BpeCounter(f"{queries.TOKENIZERS}/{queries.BPE_RANKS}", queries.BPE_PATTERN)
    want: dict = {}
    for i, t in docs.items():
        for version, n in (("byte_bpe_50k", bpe(t or "")), ("words", len(space_words(t)))):
            if n:
                old = want.get((*meta[i], version), (0, 0))
                want[(*meta[i], version)] = (old[0] + 1, old[1] + n)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in queries.op8_token_counts(spark, SF).collect()} == want


def test_rollup_counts_rows_without_id_and_repeated_rows(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup")
    make = lambda xs: spark.createDataFrame(xs, "doc_id long, source string, lang string, version string, n_tokens long, op string")
    total = lambda: {(x["source"], x["lang"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}
    r.commit("b1", make([(None, "a", "en", "v", 3, "insert"), (None, "a", "en", "v", 3, None), (None, "b", None, "v", 5, "insert"), (7, "a", "en", "v", 10, "insert"), (7, "a", "en", "v", 10, "insert"), (7, "c", "en", "v", 4, "insert")]))
    assert total() == {("a", "en"): (4, 26), ("b", None): (1, 5), ("c", "en"): (1, 4)}
    r.commit("b2", make([(None, "a", "en", "v", 1, "insert"), (None, "a", "en", "v", 3, "delete"), (7, "d", "en", "v", 2, "revise")]))
    assert total() == {("a", "en"): (3, 7), ("b", None): (1, 5), ("d", "en"): (1, 2)}


def test_token_counts(spark, odd):
    out = token_rollup.count_tokens(odd, {"words": lambda: token_rollup.count_words})
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {i: len(space_words(t)) for i, t in enumerate(odd_texts())}
    assert token_rollup.count_tokens(empty(odd), {"words": lambda: token_rollup.count_words}).count() == 0


# 10

PAGES = [
    (None, []), ("", []), ("plain text only", ["plain text only"]), ("<p>One &amp; two<br>three</p><p>Four", ["One & two three", "Four"]),
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>'</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>Buy</div><article><h1>Head &lt;</h1><p><b>Sub<br><p>Body  text\n here</article><footer>&copy;",
     ["Head <", "Sub", "Body text here"]),
    ("<body><div id=cookie-notice>Accept</div><main><header><h1>H</h1></header><p>Text of it</p><aside>more</aside><form>f</form><section class='comments'><p>Nice!</p></section></main><div class=sidebar>s</div>", ["H", "Text of it"]),
    ("<body><header>Site</header><ul class='menu'><li><a href=1>a</a></ul><div><p>" + "long prose " * 30 + "</p><p>" + "more prose " * 30 + "</p></div><footer>f</footer>", [("long prose " * 30).strip(), ("more prose " * 30).strip()]),
    ("<nav>never closed <a>x</a><article><p>Still read</p></article>", ["Still read"]), ("<article><p>a<!-- no --><b>b</b>c <i>d</i></p></article>", ["abc d"]),
    ("<div><p>" + "the text " * 40 + "</p></div><section class=comments><article class=comment><p>me too</p></article></section>", [("the text " * 40).strip()]),
    ("<article><p>Text</p></article><article class='teaser'><p>" + "other " * 50 + "</p></article>", ["Text"]),
    ("<article><![foo[x]]><p>ok</p></article>", None), ("<" * 3000, None),
]


def test_html(spark):
    for html, want in PAGES:
        got = html_extract.extract(html)
        assert want is None or got == want, html
    df = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, main_text string")
    got = rows(html_extract.extract_main_text(df), "page_id")
    assert [got[i]["main_text_"] for i in range(11)] == ["\n\n".join(w) for _, w in PAGES[:11]]
    assert html_extract.extract_main_text(empty(df)).count() == 0


def test_html_keeps_nested_and_sibling_containers():
    long = "word " * 60
    assert html_extract.extract(f"<main><h1>Title</h1><p>Lead</p><article><p>{long}</p></article><p>End</p></main>") == ["Title", "Lead", long.strip(), "End"]
    assert html_extract.extract(f"<article><h1>T</h1><article><p>{long}</p></article><article><p>part 2</p></article></article><div>x</div>") == ["T", long.strip(), "part 2"]
    assert html_extract.extract(f"<div><article><p>{long}</p></article><article><p>part 2</p></article></div><div><article><p>card</p></article></div>") == [long.strip(), "part 2"]
    assert html_extract.extract(f"<body><p>{long}</p><p><a href=1>A reference</a> 1</p><p>{long}</p><p><a href=2>Another one</a></p></body>") == [long.strip(), "A reference 1", long.strip(), "Another one"]


def test_html_zones_and_wrappers():
    a = "The quick brown fox jumps over the lazy dog and runs away. " * 4
    p, text = f"<p>{a}</p>", a.strip()
    get = html_extract.extract
    assert get(f"<main><article><h1>T</h1>{p}</article><section class='comments'><article>{p * 3}</article><article>{p}</article></section></main>") == ["T", text]
    assert get(f"<article><h1>T</h1>{p}</article><section class='comments'><article>{p * 3}</article><article>{p}</article></section>") == ["T", text]
    assert get(f"<form id='f'><div class='content'><h1>T</h1>{p}{p}</div><input type=text></form>") == ["T", text, text]
    assert get(f"<article>{p}<form><label>Your mail</label><input></form></article>") == [text]
    assert get(f"<article><p class='share-price'>It rose.</p><div class='side-effects'>{p}</div></article>") == ["It rose.", text]
    assert get(f"<div><a href=/>Home</a> <a href=/a>About</a></div><div><h1>T</h1>{p}{p}</div><div><a href=z>Imprint</a></div>") == ["T", text, text]
    assert get(f"<nav><ul><li><a href=1>x</a></li></ul><article>{p}</article>") == [text]
    deep = f"<article><p>open{'<span>' * 3000}x{'</span>' * 3000}<div>{p}</div></article>"
    assert get(deep) == ["openx", text] and get("<div>" * 20000 + a + "</b>" * 20000) == [text]


def test_html_marks_are_whole_names():
    article = '<article><h2 id="related-work">A</h2><section id="search-algorithms"><p>B</p></section><p id="legal-background">C</p><p id="legal">D</p><div class="notice-board-history">E</div><div class="related">x</div><div class="ad-slot">y</div></article>'
    assert html_extract.extract(article) == ["A", "B", "C", "D", "E"]
    long = "word " * 60
    assert html_extract.extract(f'<body><div class="content with-sidebar"><p>{long}</p></div><div class="site-footer">f</div></body>') == [long.strip()]
    assert html_extract.extract(f'<body><div class="content paywall"><p>{long}</p></div><div class="sidebar">s</div></body>') == [long.strip()]
    assert html_extract.extract(f'<body><div class="sidebar"><p>{long}</p></div><article><p>short</p></article></body>') == ["short"]
    assert html_extract.extract(f'<body><p>A text</p><div class="comments"><p>{long}</p></div></body>') == ["A text"]


@pytest.mark.parametrize("name", ["related-posts", "user-comments", "comment-body", "newsletter-form", "ad-300x250", "cookie-message", "social-icons", "related-articles", "promo-text", "reader-replies"])
def test_html_zones_of_any_company(name):
    long = "A long sentence of the article that goes on for a while, as such sentences do. " * 3
    zone = f'<div class="{name}"><p>{long[:90]}</p><article><p>Inside</p></article></div>'
    for page in (f"<article><h1>Head</h1><p>{long}</p>{zone}<p>End</p></article>", f"<body><h1>Head</h1><p>{long}</p>{zone}<p>End</p></body>", f"<body><article><h1>Head</h1><p>{long}</p><p>End</p></article>{zone}</body>"):
        assert html_extract.extract(page) == ["Head", long.strip(), "End"]
    assert html_extract.extract(f'<body><div class="has-{name}"><article><p>{long}</p></article></div></body>') == [long.strip()]
    assert html_extract.extract(f'<body><div class="has-{name}"><p>{long}</p></div></body>') == [long.strip()]


def test_html_clusters_decide_about_suspects(monkeypatch):
    """Many short lines don't make a suspect zone content; without the clusters they would."""
    zone = "".join(f"<p><b>{k}</b> <i>x</i> <u>y</u> <s>short words</s></p>" for k in range(80))
    page = f'<body><div class="my-sidebar-box">{zone}</div><div><p>{"A real text with few tags in it. " * 12}</p></div></body>'
    want = [("A real text with few tags in it. " * 12).strip()]
    assert html_extract.extract(page) == want
    for flag in (True, False):
        monkeypatch.setattr(html_extract, "content_lines", lambda lines, sigma=1.0: [flag] * len(lines))  # noqa: B023
        assert (html_extract.extract(page) != want) == flag


def test_html_of_the_pages(spark):
    import re
    from html import unescape

    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    for k, r in rows(queries.op10_html_extraction(spark, SF), "page_id").items():
        body = re.search("<article>(.*?)(</article>|<footer>|$)", pages[k], re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_helpers():
    assert fresh(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]
    assert list(slices(np.array([5, 5, 50, 1]), 10)) == [(0, 2), (2, 3), (3, 4)] and list(slices(np.array([]))) == []
    assert grams("a b") == {("a", "b")}


def test_pairs_of_full_blocks_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.97], rng.integers(0, 1 << 60, 3).astype(np.uint64)])) for _ in range(2 * ngram_join.BLOCK_DOCS)]
    d, split, reps = len(sets), ngram_join.BLOCK_DOCS, rng.permutation(2 * ngram_join.BLOCK_DOCS)
    tracemalloc.start()
    counts, low = ngram_join.neighbours(sets, np.ones(d, np.int64), reps, 0.8, split)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    for k in (0, 127, 128, split - 1, split, d - 1):
        others = range(split, d) if k < split else range(split)
        linked = [j for j in others if len(np.intersect1d(sets[k], sets[j])) >= 0.8 * len(np.union1d(sets[k], sets[j]))]
        assert counts[k] == len(linked) and low[k] == min([reps[k], *reps[linked]])
