"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of vocabulary pieces.  Forward Viterbi gives the best score
of every prefix; A-star then runs backwards from the end with those scores as
exact heuristics, so hypotheses leave the queue in the order of their total
scores, and the queue never needs more than N of them.  Where no piece can span
a position (before a word's mark, around a character without multi-character
pieces) the lattice falls into chunks.  The N best of a text then differ from
its best path only in the N - 1 chunks whose second-best path costs least, so
A-star runs on the lattice in which all other chunks are contracted to their
best path; this is exact.  The chunks of a batch that are new are searched
together, position by position, and remembered.

Scores: the files at hand are BPE models, whose scores order their pieces and
are no log-probabilities.  A piece of rank r (0 first) gets the log-probability
of a Zipf-Mandelbrot law, -log(r + ``ZIPF_SHIFT``) less the normalising term;
nothing is trained.  Scores are whole multiples of 1 / ``UNITS``, so sums are
exact and equal scores are equal.

Defined results: null gives null columns; the empty text has no pieces and one
path of score 0; characters without a piece become byte pieces where the model
has them, else the unknown piece, at the least score less ``UNK_PENALTY``;
equal scores are ordered by piece ids, compared from the last piece back.
"""

from __future__ import annotations

import math
from functools import cached_property
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, map_text

MARK = "▁"
UNK_PENALTY = 10.0
NBEST = 4
ZIPF_SHIFT = 100
UNITS = 1 << 16
#: Chunks of more characters are searched one by one, others so many at a time.
TOGETHER, STEP = 64, 4096
NEVER = -(1 << 62)
#: Bytes of text that are searched together.
SLICE = 2 << 20


def backward_a_star(best: list[int], into, end: int, n: int, most: float = math.inf) -> list[tuple[int, tuple, tuple]]:
    """(score, ids from the last back, edges) of the n best paths from node 0 to ``end`` that cost at most ``most`` more than the best, in order.

    ``best``: the best score of every prefix; ``into(j)``: (i, weight, ids from
    the last back, edge) of the edges into node j.  The hypotheses at hand share
    no path, and each has one of exactly its estimate, so only the n best of
    them can lead to the n best paths.  The queue is kept in the order of ids: a
    hypothesis is replaced in its place by what it leads to.
    """
    out: list[tuple[int, tuple, tuple]] = []
    limit = most - best[end]
    queue = [(-best[end], end, 0, None)]  # estimate, node, score from the node to the end, linked (ids, edge)
    while queue and len(out) < n:
        k = min(range(len(queue)), key=lambda x: queue[x][0]) if len(queue) > 1 else 0
        f, at, g, path = queue[k]
        if at == 0:
            ids, edges = [], []
            while path:
                ids.append(path[0])
                edges.append(path[1])
                path = path[2]
            out.append((-f, tuple(chain.from_iterable(reversed(ids))), tuple(edges)))
            del queue[k]
            continue
        ways = [(last, estimate, i, g + w, edge) for i, w, last, edge in into(at) if (estimate := -(g + w + best[i])) <= limit]
        ways.sort(key=lambda x: x[0])
        queue[k : k + 1] = [(estimate, i, to_end, (last, edge, path)) for last, estimate, i, to_end, edge in ways]
        room = n - len(out)
        if len(queue) > room:
            keep = sorted(range(len(queue)), key=lambda x: queue[x][0])[:room]
            queue = [queue[x] for x in sorted(keep)]
    return out


class PieceModel:
    """Vocabulary, scores and lattice search of one model file."""

    def __init__(self, pieces: list[tuple[str, float, str]], keep: int = 150_000):
        """``pieces``: (text, log-probability, kind) by id; kind is normal, unknown, control or byte."""
        self.pieces, self.keep = pieces, keep
        self.weight = {p: round(s * UNITS) for p, s, kind in pieces if kind == "normal"}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.unk = next((i for i, x in enumerate(pieces) if x[2] == "unknown"), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unk_weight = min(self.weight.values(), default=0) - round(UNK_PENALTY * UNITS)
        self.longest = max(map(len, self.weight), default=1)
        inner = set()  # characters that stand in some piece of several characters
        for p in self.weight:
            if len(p) > 1:
                inner.update(p)
        self.separable = not any(MARK in p.lstrip(MARK) for p in self.weight)
        self.newline_alone = "\n" not in inner
        self._trie()
        self._forget()

    @classmethod
    def load(cls, path: str, shift: float = ZIPF_SHIFT) -> PieceModel:
        """The model of a file, its pieces scored by rank: the file's order, the first of equals first."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = lambda i: "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "normal"
        every = [(sp.id_to_piece(i), sp.get_score(i), kinds(i)) for i in range(sp.get_piece_size())]
        order = sorted((i for i, x in enumerate(every) if x[2] == "normal"), key=lambda i: (-every[i][1], i))
        total = math.log(sum(1 / (r + shift) for r in range(len(order))))
        score = {i: -math.log(r + shift) - total for r, i in enumerate(order)}
        return cls([(p, score.get(i, 0.0), kind) for i, (p, _, kind) in enumerate(every)])

    def _trie(self) -> None:
        """The pieces' trie as a sorted table of (node, character) -> node; node 0 is the root."""
        step: dict[tuple[int, str], int] = {}
        weights, ids = [NEVER], [-1]
        for p, w in self.weight.items():
            at = 0
            for c in p:
                nxt = step.get((at, c))
                if nxt is None:
                    nxt = step[at, c] = len(weights)
                    weights.append(NEVER)
                    ids.append(-1)
                at = nxt
            weights[at], ids[at] = w, self.id[p]
        keys = np.array([a << 21 | ord(c) for a, c in step], np.int64)
        order = np.argsort(keys)
        self._keys, self._next = keys[order], np.array(list(step.values()), np.int64)[order]
        self._node_weight, self._node_id = np.array(weights, np.int64), np.array(ids, np.int64)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        #: Ids and decoded bytes of the chunks' best paths, one after the other, and where each begins.
        self.ids, self.id_at = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.bytes, self.byte_at = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.scores = np.empty(0, np.int64)
        self.gaps = np.empty(0, np.int64)
        self.downs = np.empty(0, bool)
        self.several: dict[str, list] = {}

    @cached_property
    def _spelled(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "control" else b" \xe2\x81\x87 " if kind == "unknown" else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]

    @cached_property
    def _spelling(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(self._spelled), np.uint8), np.cumsum([0, *map(len, self._spelled)])

    # lattices of chunks

    def _ids(self, s: str) -> tuple[int, ...]:
        """Ids of an edge's text, from the last back."""
        known = self.id.get(s)
        if known is not None:
            return (known,)
        if self.byte:
            return tuple(self.byte[b] for b in reversed(s.encode()))
        return (self.unk,)

    def _lattice(self, s: str) -> list[list[tuple[int, int]]]:
        """(start, weight) of the edges into every position: every piece that ends there; the unknown edge where no single character piece does."""
        get, most, out = self.weight.get, self.longest, [[]]
        for j in range(1, len(s) + 1):
            into = [(i, w) for i in range(max(0, j - most), j) if (w := get(s[i:j])) is not None]
            if not into or into[-1][0] != j - 1:
                into.append((j - 1, self.unk_weight))
            out.append(into)
        return out

    def nbest_chunk(self, s: str, n: int, most: float = math.inf) -> list[tuple[int, tuple[int, ...]]]:
        """(score, ids from the last back) of the n best paths of one lattice that cost at most ``most`` more than the best."""
        known = self.several.get(s)
        if known is None or known[0] < n or known[1] < most:
            lattice, best = self._lattice(s), [0]
            for into in lattice[1:]:  # forward Viterbi
                best.append(max([best[i] + w for i, w in into]))
            into = lambda j: [(i, w, self._ids(s[i:j]), None) for i, w in lattice[j]]
            known = self.several[s] = (n, most, [x[:2] for x in backward_a_star(best, into, len(s), n, most)])
        least = known[2][0][0] - most
        return [x for x in known[2][:n] if x[0] >= least]

    def _alone(self, s: str) -> tuple[list[int], int, int, bool]:
        """Ids and score of the best path of one chunk, the cost of the second-best one (-1 if there is none), and whether that one has the smaller ids."""
        found = self.nbest_chunk(s, 2)
        del self.several[s]
        more = len(found) > 1
        return list(reversed(found[0][1])), found[0][0], found[0][0] - found[1][0] if more else -1, more and found[1][1] < found[0][1]

    def _together(self, chunks: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
        """``_alone`` of short chunks: the same searches, a position of all chunks at a time."""
        lengths = np.array([len(c) for c in chunks], np.int64)
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chunk = np.repeat(np.arange(len(chunks)), lengths)
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(chars)) - first[chunk]
        # edges by walking the trie from every character at once
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        starts, spans, weights, ids = [], [], [], []
        for span in range(1, self.longest + 1):
            key = node << 21 | chars[at + span - 1]
            pos = np.minimum(np.searchsorted(self._keys, key), max(len(self._keys) - 1, 0))
            hit = self._keys[pos] == key if len(self._keys) else np.zeros(len(key), bool)
            if span == 1:
                whole = np.zeros(len(at), bool)
                whole[hit] = self._node_id[self._next[pos[hit]]] >= 0
                lone = np.flatnonzero(~whole)
                starts.append(lone), spans.append(np.ones(len(lone), np.int64)), weights.append(np.full(len(lone), self.unk_weight)), ids.append(np.full(len(lone), -1))
            at, node = at[hit], self._next[pos[hit]]
            end = self._node_id[node] >= 0
            starts.append(at[end]), spans.append(np.full(int(end.sum()), span)), weights.append(self._node_weight[node[end]]), ids.append(self._node_id[node[end]])
            more = place[at] + span < lengths[chunk[at]]
            at, node = at[more], node[more]
            if not len(at):
                break
        start, span, weight, piece = map(np.concatenate, (starts, spans, weights, ids))
        owner, where = chunk[start], place[start]
        source = start + owner  # a chunk of n characters has n + 1 nodes
        target = source + span
        nodes = len(chars) + len(chunks)
        begin, final = first + np.arange(len(chunks)), first + np.arange(len(chunks)) + lengths
        # forward, edges by their start: those into one node come at different turns
        best, back, last = np.full(nodes, NEVER), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        best[begin] = 0
        for group in _turns(where):
            got, to = best[source[group]] + weight[group], target[group]
            better = (got > best[to]) | ((got == best[to]) & (piece[group] < last[to]))
            pick, to = group[better], to[better]
            best[to], back[to], last[to] = got[better], pick, piece[pick]
        # the best paths, from the end; every other path leaves them at some node by another edge, and costs the least if it goes on to the best prefix
        on, steps, alive, here = np.zeros(nodes, bool), [], np.arange(len(chunks)), final
        while len(alive):
            on[here] = True
            edge = back[here]
            steps.append((alive, piece[edge]))
            here = source[edge]
            more = here != begin[alive]
            alive, here = alive[more], here[more]
        other = np.flatnonzero(on[target] & (back[target] != np.arange(len(start))))
        cost, of = best[target[other]] - best[source[other]] - weight[other], owner[other]
        gap = np.full(len(chunks), -NEVER)
        np.minimum.at(gap, of, cost)
        down = np.zeros(len(chunks), bool)
        down[of[(cost == gap[of]) & (piece[other] < last[target[other]])]] = True
        gap[gap == -NEVER] = -1
        score = best[final]
        of, ids = np.concatenate([a for a, _ in steps]), np.concatenate([b for _, b in steps])
        turn = np.repeat(np.arange(len(steps)), [len(a) for a, _ in steps])
        ids, n_ids = ids[np.lexsort((-turn, of))].astype(np.int32), np.bincount(of, minlength=len(chunks))
        if (piece < 0).any():  # characters without a piece of their own
            own = np.split(ids, np.cumsum(n_ids)[:-1])
            for k in set(owner[piece < 0].tolist()):
                own[k], score[k], gap[k], down[k] = self._alone(chunks[k])
            ids, n_ids = np.concatenate(own).astype(np.int32), np.array(list(map(len, own)))
        return ids, n_ids, score, gap, down

    def learn(self, chunks: list[str]) -> np.ndarray:
        """Numbers of the chunks; those that are not remembered yet are searched."""
        if len(self.known) > self.keep:
            self._forget()
        own = list(map(self.known.get, chunks))
        new = list(dict.fromkeys([c for c, k in zip(chunks, own) if k is None]))
        if new:
            new.sort(key=lambda c: len(c) > TOGETHER)
            short = sum(len(c) <= TOGETHER for c in new)
            done = [self._together(new[k : min(k + STEP, short)]) for k in range(0, short, STEP)]
            for c in new[short:]:
                ids, *rest = self._alone(c)
                done.append((np.array(ids, np.int32), np.array([len(ids)]), *(np.array([x]) for x in rest)))
            ids, n_ids, score, gap, down = map(np.concatenate, zip(*done))
            text, ends = gathered(*self._spelling, ids)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ids, self.id_at = np.concatenate([self.ids, ids]), np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(n_ids)])
            self.bytes, self.byte_at = np.concatenate([self.bytes, text]), np.concatenate([self.byte_at, self.byte_at[-1] + ends[np.cumsum(n_ids) - 1]])
            self.scores, self.gaps, self.downs = np.concatenate([self.scores, score]), np.concatenate([self.gaps, gap]), np.concatenate([self.downs, down.astype(bool)])
            own = list(map(self.known.__getitem__, chunks))
        return np.array(own, np.int64)

    # texts

    def chunks(self, text: str) -> list[str]:
        """Pieces of the escaped text that no vocabulary piece can span."""
        if not text:
            return []
        if not self.separable:
            return [(MARK + text).replace(" ", MARK)]
        out: list[str] = []
        lines = text.split("\n") if self.newline_alone else [text]
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            words = line.replace(MARK, " ").split(" ")
            if k == 0:
                words.insert(0, "")
            if words[0]:
                out.append(words[0])
            marks = ""
            for w in words[1:]:
                marks += MARK
                if w:
                    out.append(marks + w)
                    marks = ""
            if marks:
                out.append(marks)
        return out

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """Ids and score of the best segmentation."""
        own = self.learn(self.chunks(text))
        return gathered(self.ids, self.id_at, own)[0], int(self.scores[own].sum()) / UNITS

    def nbest(self, text: str, n: int = NBEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations of the whole text, in order."""
        parts = self.chunks(text)
        own = self.learn(parts)
        out = []
        for score, picks in self._contracted(parts, own, n):
            ids: list[int] = []
            for k, c in enumerate(own):
                ids += reversed(picks[k]) if k in picks else self.ids[self.id_at[c] : self.id_at[c + 1]].tolist()
            out.append((score / UNITS, ids))
        return out

    def _contracted(self, parts: list[str], own: np.ndarray, n: int) -> list[tuple[int, dict[int, tuple]]]:
        """Scores of the n best segmentations, and what each takes for the chunks that matter (ids from the last back), by A-star."""
        total = int(self.scores[own].sum())
        gaps = self.gaps[own]
        open_, most = np.flatnonzero(gaps >= 0), math.inf
        if n > 1 and len(open_) > n - 1:
            most = int(np.partition(gaps[open_], n - 2)[n - 2])  # n - 1 changes cost no more
            ties = open_[gaps[open_] == most]
            open_ = open_[gaps[open_] < most]
            # of ties, those first whose change makes the first texts in the order of ids from the last back: a change
            # to smaller ids the nearer the end, then one to larger ids the farther from it
            down = self.downs[own[ties]]
            open_ = np.concatenate([open_, ties[down][::-1], ties[~down]])[: n - 1]
        order = sorted(map(int, open_)) if n > 1 else []
        choices = [self.nbest_chunk(parts[k], n, most) for k in order]
        best = [total - sum(c[0][0] for c in choices)]  # forward Viterbi over the contracted lattice
        for c in choices:
            best.append(best[-1] + c[0][0])
        into = lambda j: ((j - 1, w, ids, ids) for w, ids in choices[j - 1])
        found = backward_a_star(best, into, len(order), n)
        return [(score, dict(zip(order, path))) for score, _, path in found]

    def decode(self, ids) -> str:
        """The text of a sequence of ids, without the leading space that encoding adds."""
        table = self._spelled
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def gathered(pool: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a pool that ``which`` names, one after the other, and where each ends."""
    begin = at[which]
    n = at[which + 1] - begin
    ends = np.cumsum(n)
    return pool[np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def _turns(key: np.ndarray) -> list[np.ndarray]:
    """Indexes by the value of ``key``, in ascending order of it."""
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(key) else []


def _model(path: str) -> PieceModel:
    """The model of a file, loaded once in each worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel.load(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", nbest: int = NBEST) -> DataFrame:
    """Add ``piece_ids`` (best path), ``nbest_scores`` (best first) and ``round_trip`` (decoding gives the text back).

    A text that itself holds the word mark decodes with spaces in its place,
    so ``round_trip`` compares with that.
    """
    names = fresh(docs.columns, "piece_ids", "nbest_scores", "round_trip")

    def make():
        model = _model(model_path)

        def each(texts, _):
            parts = [model.chunks(t.decode()) if t else [] for t in texts]
            ends = np.cumsum([0, *map(len, parts)])
            own = model.learn(list(chain.from_iterable(parts)))
            ids, id_ends = gathered(model.ids, model.id_at, own)
            spelled, byte_ends = gathered(model.bytes, model.byte_at, own)
            spelled, mark = spelled.tobytes(), MARK.encode()
            id_at, byte_at = np.concatenate([[0], id_ends])[ends], np.concatenate([[0], byte_ends])[ends].tolist()
            scores, ok = [], []
            for k, (t, p) in enumerate(zip(texts, parts)):
                if t is None:
                    scores.append(None)
                    ok.append(None)
                    continue
                scores.append([x / UNITS for x, _ in model._contracted(p, own[ends[k] : ends[k + 1]], nbest)])
                ok.append(spelled[byte_at[k] : byte_at[k + 1]] == (b" " + t.replace(mark, b" ") if t else b""))
            null = pa.array([t is None for t in texts], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(id_at, pa.int32()), pa.array(ids), mask=null)
            return [lists, scores, ok]

        each.done = model._forget  # an idle worker keeps the model only
        return each

    return map_text(docs, [(names[0], T.ArrayType(T.IntegerType())), (names[1], T.ArrayType(T.DoubleType())), (names[2], T.BooleanType())], text, make, SLICE)


def decode_pieces(df: DataFrame, model_path: str, ids: str = "piece_ids") -> DataFrame:
    """Add ``decoded``: the text of the ids; null ids give null."""
    from pyspark.sql import functions as F

    (name,) = fresh(df.columns, "decoded")

    @F.pandas_udf(T.StringType())
    def decode(column):
        model = _model(model_path)
        return column.map(lambda x: None if x is None else model.decode(x.tolist()))

    return df.withColumn(name, decode(ids))


_MODELS: dict[str, PieceModel] = {}
