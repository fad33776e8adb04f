"""Alignment of two tokenizers over the same bytes, and how often their ids meet.

Both encodings of a text give every byte an owner: the index of the token that
holds it, repeated over the token's bytes.  Where the pair of owners changes an
overlap begins, and where both owners change at once the text is cut: between
two cuts stands a group of tokens of A and of B with the same bytes.  Texts of a
slice are laid end to end, so a text's edge is a cut as well.

Figures of the corpus need every id pair's number of documents.  A slice of
documents becomes one row of a written table, with its links as sorted id
pairs; pairs are summed once a slice, then over the corpus, and the sums go back
to the slices that asked for them.  So what is shuffled is a row for each pair
and slice, never a row for each link, and the slices' own rows once.

Defined results: a null or empty text, and one whose tokens of A or B do not
spell a space and the text (also one that is not UTF-8), has no tokens and
zeros; rows alike are counted as documents of their own; a null id stays null;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, map_text, materialize, slices

#: Bytes of text behind one row of links.
SLICE = 1 << 20
#: Links of a group up to which they are written out before they are counted; in larger groups distinct ids are counted first.
WRITTEN_OUT = 256


class ByteBpe:
    """Byte-level BPE from a tokenizer's JSON file; strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        # the file spells a byte that prints as itself, and the others in order from code point 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spelled = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(map(spelled.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.size = max(ranks.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        self._library = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: bytes) -> list[int] | None:
        """The ids of a space and the text, if they spell it."""
        own = b" " + text
        try:
            ids = self._library.encode_ordinary(own.decode())
        except UnicodeDecodeError:
            return None
        return ids if self._library.decode_bytes(ids) == own else None


class Pieces:
    """A SentencePiece model, which puts a space before the text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._library = SentencePieceProcessor(model_file=path)
        self.size = self._library.get_piece_size()
        names = map(self._library.id_to_piece, range(self.size))
        self.bytes = [bytes.fromhex(x[3:5]) if self._library.is_byte(i) and re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)

    def encode(self, text: bytes) -> list[int] | None:
        try:
            ids = self._library.encode(text.decode(), num_threads=1)
        except UnicodeDecodeError:
            return None
        return ids if b"".join(map(self.bytes.__getitem__, ids)) == b" " + text else None


@dataclass
class Aligned:
    """Texts of one slice that have tokens, laid end to end."""

    texts: np.ndarray  # their places in the slice
    a: np.ndarray  # ids
    b: np.ndarray
    first_a: np.ndarray  # each text's first token, and the number of all
    first_b: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray, np.ndarray]  # token of A, token of B, first byte
    group_a: np.ndarray  # each token's group
    group_b: np.ndarray
    first_group: np.ndarray  # each text's first group, and the number of all


def align(texts: list[bytes | None], a, b) -> Aligned:
    """Owners of every byte, and what their changes say."""
    places, encoded = [], []
    for i, text in enumerate(texts):
        if text:
            x = a.encode(text)
            y = b.encode(text) if x else None
            if x and y:
                places.append(i)
                encoded.append((x, y))
    ids_a, ids_b = (np.fromiter((t for pair in encoded for t in pair[side]), np.int64) for side in (0, 1))
    first_a, first_b = (np.concatenate([[0], np.cumsum([len(pair[side]) for pair in encoded], dtype=np.int64)]) for side in (0, 1))
    owner_a, owner_b = (np.repeat(np.arange(len(ids), dtype=np.int32), kind.lengths[ids]) for ids, kind in ((ids_a, a), (ids_b, b)))
    new_a, new_b = (np.diff(owner, prepend=-1) != 0 for owner in (owner_a, owner_b))
    at = np.flatnonzero(new_a | new_b)
    group = np.cumsum((new_a & new_b)[at]) - 1  # of every overlap
    group_a, group_b = group[new_a[at]], group[new_b[at]]
    n_groups = int(group[-1]) + 1 if len(group) else 0
    first_group = np.append(group_a[first_a[:-1]], n_groups)
    return Aligned(np.array(places, np.int64), ids_a, ids_b, first_a, first_b, (owner_a[at], owner_b[at], at), group_a, group_b, first_group)


def links(x: Aligned, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, id pair, multiplicity) of the distinct id pairs linked in each text, and each text's number of links."""
    n_groups = int(x.first_group[-1])
    count_a, count_b = np.bincount(x.group_a, minlength=n_groups), np.bincount(x.group_b, minlength=n_groups)
    start_a, start_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    text = np.repeat(np.arange(len(x.texts)), np.diff(x.first_group))  # of every group
    product = count_a * count_b
    n_links = np.bincount(text, product, minlength=len(x.texts)).astype(np.int64)
    small = np.flatnonzero(product <= WRITTEN_OUT)
    own = np.repeat(small, product[small])
    within = np.arange(len(own)) - np.repeat(np.cumsum(product[small]) - product[small], product[small])
    key = x.a[start_a[own] + within // count_b[own]] * size_b + x.b[start_b[own] + within % count_b[own]]
    texts, keys, counts = [text[own]], [key], [np.ones(len(key), np.int64)]
    for g in np.flatnonzero(product > WRITTEN_OUT).tolist():
        (ka, na), (kb, nb) = (np.unique(ids[s : s + n], return_counts=True) for ids, s, n in ((x.a, start_a[g], count_a[g]), (x.b, start_b[g], count_b[g])))
        keys.append((ka[:, None] * size_b + kb).ravel())
        counts.append((na[:, None] * nb).ravel())
        texts.append(np.full(len(keys[-1]), text[g]))
    texts, keys, counts = map(np.concatenate, (texts, keys, counts))
    order = np.lexsort((keys, texts)) if len(keys) else np.empty(0, np.int64)
    texts, keys = texts[order], keys[order]
    new = np.flatnonzero((np.diff(texts, prepend=-1) != 0) | (np.diff(keys, prepend=-1) != 0))
    return texts[new], keys[new], np.add.reduceat(counts[order], new) if len(new) else np.empty(0, np.int64), n_links


class Speller:
    """Groups as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, size_a: int, size_b: int):
        self.size = max(size_a, size_b)
        self.pieces = [str(i).encode() + end for end in (b",", b"|", b";") for i in range(self.size)]

    def __call__(self, x: Aligned) -> list[bytes]:
        """The spelling of every text's groups."""
        n_groups = int(x.first_group[-1])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(x.group_b, minlength=n_groups))])
        upto_a = np.cumsum(np.bincount(x.group_a, minlength=n_groups))
        out = np.empty(len(x.a) + len(x.b), np.int64)
        last_a, last_b = (np.diff(g, append=n_groups) != 0 for g in (x.group_a, x.group_b))
        out[np.arange(len(x.a)) + before_b[x.group_a]] = x.a + self.size * last_a
        out[np.arange(len(x.b)) + upto_a[x.group_b]] = x.b + 2 * self.size * last_b
        codes, edges = out.tolist(), (x.first_a + x.first_b).tolist()
        return [b"".join(map(self.pieces.__getitem__, codes[s:e]))[:-1] for s, e in zip(edges, edges[1:])]


def align_texts(docs: DataFrame, make_a: Callable, make_b: Callable, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and (groups_a, groups_b, overlaps): each group's ids of A and of B, and (token of A, token of B, first byte) of every overlap, bytes counted from the added space."""
    three = T.StructType([T.StructField(n, T.LongType()) for n in ("token_a", "token_b", "byte")])
    fields = [("groups_a", T.ArrayType(T.ArrayType(T.LongType()))), ("groups_b", T.ArrayType(T.ArrayType(T.LongType()))), ("overlaps", T.ArrayType(three))]

    def make():
        a, b = make_a(), make_b()

        def each(texts, _):
            out = [[[] for _ in texts] for _ in fields]
            x = align(texts, a, b)
            edge = np.searchsorted(x.overlaps[0], x.first_a)
            cut = [np.searchsorted(g, np.arange(int(x.first_group[-1]) + 1)).tolist() for g in (x.group_a, x.group_b)]
            for k, i in enumerate(x.texts.tolist()):
                for side, ids in enumerate((x.a, x.b)):
                    ends = cut[side][x.first_group[k] : x.first_group[k + 1] + 1]
                    out[side][i] = [ids[s:e].tolist() for s, e in zip(ends, ends[1:])]
                s, e = edge[k], edge[k + 1]
                ta, tb, at = (o[s:e] - o0 for o, o0 in zip(x.overlaps, (x.first_a[k], x.first_b[k], x.overlaps[2][s])))
                out[2][i] = [{"token_a": int(p), "token_b": int(q), "byte": int(r)} for p, q, r in zip(ta, tb, at)]
            return out

        return each

    return map_text(docs, fields, text, make, SLICE)


def _lists(values: list[np.ndarray] | np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def link_slices(docs: DataFrame, make_a: Callable, make_b: Callable, doc_id: str, text: str) -> DataFrame:
    """One row for each slice of documents: their figures and links, as arrays."""
    id_type = docs.schema[doc_id].dataType
    longs = T.ArrayType(T.LongType())
    names = ["slice", "ids", "n_a", "n_b", "n_groups", "n_links", "spelled", "n_pairs", "pairs", "times"]
    kinds = [T.LongType(), T.ArrayType(id_type), longs, longs, longs, longs, T.ArrayType(T.StringType()), longs, longs, T.ArrayType(T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = make_a(), make_b()
        spell, number = Speller(a.size, b.size), TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)) if len(column) else np.empty(0, np.int64)
            for s, e in slices(sizes, SLICE):
                x = align(column.slice(s, e - s).to_pylist(), a, b)
                owner, pairs, times, n_links = links(x, b.size)
                figures = np.zeros((5, e - s), np.int64)
                figures[:, x.texts] = np.diff(x.first_a), np.diff(x.first_b), np.diff(x.first_group), n_links, np.bincount(owner, minlength=len(x.texts))
                spelled = np.full(e - s, "", object)
                spelled[x.texts] = [hashlib.sha256(t).hexdigest() for t in spell(x)]
                ids = pa.ListArray.from_arrays(pa.array([0, e - s], pa.int32()), batch.column(0).slice(s, e - s))
                out = [pa.array([number]), ids, *(_lists(f, pa.int64()) for f in figures[:4]), _lists(spelled, pa.string()), _lists(figures[4], pa.int64()), _lists(pairs, pa.int64()), _lists(times, pa.int32())]
                number += 1
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(doc_id), F.col(text).cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)]))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, pair, n): the distinct pairs of a slice, with their numbers of documents in it."""
    for batch in batches:
        for i in range(len(batch)):
            pairs, n = np.unique(batch.column(1)[i].values.to_numpy(), return_counts=True)
            for s in range(0, len(pairs), 1 << 17):
                part = pa.array(pairs[s : s + (1 << 17)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column(0)[i].as_py())), part, pa.array(n[s : s + (1 << 17)])], names=["slice", "pair", "n"])


def _told(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A slice's documents with the sums over their links."""
    for batch in batches:
        column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        for i in range(len(batch)):
            n_docs = len(column["ids"][i].values)
            n_best = count_sum = np.zeros(n_docs, np.int64)
            if column["answers"][i].is_valid:
                answers = column["answers"][i].values
                known, graded = (answers.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.argsort(known)
                pairs, times = column["pairs"][i].values.to_numpy(), column["times"][i].values.to_numpy().astype(np.int64)
                found = graded[order[np.searchsorted(known[order], pairs)]]
                ends = np.concatenate([[0], np.cumsum(column["n_pairs"][i].values.to_numpy())])
                n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(v)])[ends]) for v in (times * (found < 0), times * np.abs(found)))
            out = [column["ids"][i].values, *(column[n][i].values for n in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), column["spelled"][i].values]
            yield pa.RecordBatch.from_arrays(out, names=names)


def link_figures(docs: DataFrame, make_a: Callable, make_b: Callable, size_b: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    rows = materialize(link_slices(docs, make_a, make_b, doc_id, text), "links", **{"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4})
    asked = materialize(rows.select("slice", "pairs").mapInArrow(_asked, "slice long, pair long, n long"), "asked")
    counts = materialize(asked.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    id_a = F.floor(F.col("pair") / size_b)
    best = counts.groupBy(id_a.alias("id_a")).agg(F.max("n").alias("best"))  # no more rows than A has ids
    graded = counts.withColumn("id_a", id_a).join(F.broadcast(best), "id_a").select("pair", F.when(F.col("n") == F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("graded"))
    answers = asked.select("slice", "pair").join(graded, "pair").groupBy("slice").agg(F.collect_list(F.struct("pair", "graded")).alias("answers"))  # no more than a slice's links
    answers = materialize(answers, "answers", **{"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4})
    drop_table(asked)
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *(T.StructField(n, T.LongType()) for n in names[1:-1]), T.StructField(names[-1], T.StringType())])
    return rows.join(answers, "slice", "left").drop("slice").mapInArrow(lambda batches: _told(batches, names), schema)
