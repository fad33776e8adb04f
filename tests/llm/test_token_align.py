"""Tokenizer alignment against a plain version over the public libraries."""

import hashlib
from collections import Counter
from functools import partial

import duckdb
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lumenstrata.llm import queries, token_align

SF = "/root/testdata/sf0.001"
JSON, MODEL = f"{queries.TOKENIZERS}/{queries.BPE_JSON}", f"{queries.TOKENIZERS}/{queries.PIECE_MODEL}"


make_a, make_b = partial(token_align.ByteBpe, JSON, queries.BPE_PATTERN), partial(token_align.Pieces, MODEL)


@pytest.fixture(scope="module")
def plain():
    """text -> groups of (A ids, B ids), by sets of ends; None where the bytes differ."""
    a, b = Tokenizer.from_file(JSON), SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(x): x for x in plain_bytes} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain_bytes)}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        x = [(i, bytes(spelled[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes_b(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        if b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            return []
        ends = []
        for tokens in (x, y):
            at, own = 0, []
            for _, t in tokens:
                at += len(t)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        out, i, j = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(x) and ends[0][i] <= c:
                ga.append(x[i][0])
                i += 1
            while j < len(y) and ends[1][j] <= c:
                gb.append(y[j][0])
                j += 1
            out.append((ga, gb))
        return out

    return groups


def figures(rows, groups):
    """Rows of the contract, by counters."""
    own = [(i, groups(t)) for i, t in rows]
    links = [Counter((p, q) for ga, gb in g for p in ga for q in gb) for _, g in own]
    count = Counter(p for c in links for p in c)
    best = {}
    for (p, _), n in count.items():
        best[p] = max(n, best.get(p, 0))
    out = []
    for (i, g), c in zip(own, links):
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append(
            (i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]),
             sum(n * count[p] for p, n in c.items()), hashlib.sha256(spelled.encode()).hexdigest() if g else "")
        )
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_all_documents(spark, plain):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert found(queries.op13_token_alignment(spark, SF)) == figures(rows, plain)


ODD = [
    None, "", " ", "  ", "\n\n", "a", "<|endoftext|> <s> <unk> </s> <0x41>", "é ñ 日本 ▁ ▁x", "😀😀", "\x00\x01", "　 ﬁ ① ½", "a\tb\r\nc  d   e", "0" * 3000, "=" * 700 + " x", " " * 900,
    "ab" * 1500, "same text here", "same text here", "日本語" * 400, "é ­​", "it's we'll 's 'S", "-" * 50 + "—" * 50,
]


@pytest.mark.parametrize("slice_bytes, written_out", [(1 << 20, 256), (50, 0), (300, 4)])
def test_odd_rows(spark, plain, monkeypatch, slice_bytes, written_out):
    monkeypatch.setattr(token_align, "SLICE", slice_bytes)
    monkeypatch.setattr(token_align, "WRITTEN_OUT", written_out)
    rows = [*enumerate(ODD), (3, "repeated"), (3, "repeated"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1.0, "clash") for i, t in rows], "doc_id long, text string, n_links double, slice string").coalesce(2)
    assert found(token_align.link_figures(df, make_a, make_b, make_b().size)) == figures(rows, plain)
    assert token_align.link_figures(df.filter("false"), make_a, make_b, make_b().size).count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select 1L as doc_id, cast(x'ff6162' as string) as text union all select 2L, 'ab'")
    assert [r["n_a"] > 0 for r in token_align.link_figures(df, make_a, make_b, make_b().size).orderBy("id").collect()] == [False, True]


def test_links_inside_large_groups(monkeypatch):
    a, b = make_a(), make_b()
    x = token_align.align([t.encode() for t in ODD if t], a, b)
    monkeypatch.setattr(token_align, "WRITTEN_OUT", 1 << 40)
    want = [v.tolist() for v in token_align.links(x, b.size)]
    monkeypatch.setattr(token_align, "WRITTEN_OUT", 0)
    assert [v.tolist() for v in token_align.links(x, b.size)] == want


def test_alignments(spark, plain):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    a, b = make_a(), make_b()
    for r in token_align.align_texts(df, make_a, make_b).collect():
        want = plain(ODD[r["doc_id"]])
        assert [(x, y) for x, y in zip(r["groups_a"], r["groups_b"])] == want
        at_a, at_b, owners = [], [], []
        for side, kind, at in ((0, a, at_a), (1, b, at_b)):
            for k, i in enumerate(i for g in want for i in g[side]):
                at += [k] * int(kind.lengths[i])
        for k, pair in enumerate(zip(at_a, at_b)):
            if not owners or owners[-1][:2] != pair:
                owners.append((*pair, k))
        assert [tuple(o) for o in r["overlaps"]] == owners


def test_long_runs():
    """No quadratic time and no overflow on texts without a break."""
    a, b = make_a(), make_b()
    for text in (b" " * 300_000, b"a" * 300_000, "é".encode() * 100_000, b"!" * 300_000):
        x = token_align.align([text], a, b)
        assert int(x.first_a[-1]) and sum(token_align.links(x, b.size)[3]) > 0
