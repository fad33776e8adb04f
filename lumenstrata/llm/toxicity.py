"""Toxicity by fuzzy lexicon search with context windows.

A lexicon is learned from labelled documents, as whole words and as stems
(shared prefixes).  Its trie is intersected with Levenshtein automata: a state
is a set of (trie node, edits so far) pairs, determinised lazily, so a word is
one walk over its characters and leaves at the first character no term can
reach.  Every hit is weighted by its context window: quotation and reporting
verbs lower it, second-person address raises it; a logistic model over those
sums gives the score.

Defined results: null and empty texts get the score of a text without hits;
repeated rows are scored alike; with no labelled row of both kinds the lexicon
is empty and every score is the bias's.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held_out, map_text

#: Bound of the labelled documents that a fit reads.
FIT_DOCS = 5000
WORD = re.compile(r"[^\W\d_]+")
#: Words with digits and signs inside; they are looked up whole where none of their parts is a hit.
JOINED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:(?:[^\w\s]|[\d_]){1,2}+[^\W\d_]++)+")
QUOTE = re.compile("[“«„”»‟\"]")
CONTEXT = 6
#: Words that mark reported speech, and words that address someone.
REPORTING = frozenset("said says say wrote writes quoted quote called calls reported claimed stated dit écrit déclaré cité sagte schrieb zitiert nannte dijo escribió citó llamó".split())
ADDRESS = frozenset("you your youre u tu te vous toi du dich ihr sie usted tú eres".split())
OPEN_QUOTES, CLOSE_QUOTES, BOTH_QUOTES = "“«„", "”»‟", '"'
FEATURES = 5
#: Letters from which a stem allows an edit.
STEM_EDIT = 5


def edits_allowed(term: str, stem: bool) -> int:
    n = len(term)
    return (n >= 8) if stem else (n >= 5) + (n >= 9)


def edits_allowed_anywhere(term: str, stem: bool) -> int:
    n = len(term)
    return (n >= STEM_EDIT) if stem else (n >= 4) + (n >= 9)


class FuzzyTrie:
    """The lexicon's trie with its Levenshtein automata.

    With ``anywhere`` (what scoring uses) first letters are edited too, terms of
    four letters allow an edit, and a swap of two neighbours is one edit; without
    it the first letter of a term is never edited.
    """

    DEAD = 0

    def __init__(self, words: list[str], stems: list[str], anywhere: bool = False):
        self.anywhere, allowed = anywhere, edits_allowed_anywhere if anywhere else edits_allowed
        self.children: list[dict[str, int]] = [{}]
        self.cap = [0]
        self.word_end: dict[int, int] = {}
        self.stem_end: dict[int, int] = {}
        for terms, ends, stem in ((words, self.word_end, False), (stems, self.stem_end, True)):
            for term in terms:
                cap, node = allowed(term, stem), 0
                for c in term:
                    nxt = self.children[node].get(c)
                    if nxt is None:
                        nxt = self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.cap.append(0)
                    node = nxt
                    self.cap[node] = max(self.cap[node], cap)
                self.cap[0] = max(self.cap[0], cap * anywhere)
                ends[node] = max(ends.get(node, 0), cap)
        self._start()

    def _start(self):
        first = self._close({0: 0})
        self.states: list[dict] = [{}, first]  # edits by node, or by (node behind a swap, its second letter)
        self.index = {frozenset(): 0, frozenset(first.items()): 1}
        self.steps: dict[tuple[int, str], int] = {}
        self.accepts = [None, None]  # (stem edits or None, word edits or None)

    def _close(self, state: dict[int, int]) -> dict[int, int]:
        todo = list(state.items())
        while todo:  # a term's character that the word lacks
            node, e = todo.pop()
            if (node or self.anywhere) and not isinstance(node, tuple) and e == state.get(node):
                for child in self.children[node].values():
                    if e + 1 <= self.cap[child] and e + 1 < state.get(child, 99):
                        state[child] = e + 1
                        todo.append((child, e + 1))
        return state

    def _step(self, at: int, c: str) -> int:
        new: dict[int, int] = {}

        def put(node, e):
            if e <= self.cap[node] and e < new.get(node, 99):
                new[node] = e

        for node, e in self.states[at].items():
            if isinstance(node, tuple):
                if node[1] == c:
                    put(node[0], e)
                continue
            for d, child in self.children[node].items():
                if d == c:
                    put(child, e)
                elif node or self.anywhere:
                    put(child, e + 1)
                    behind = self.children[child].get(c) if self.anywhere else None
                    if behind is not None and e + 1 <= self.cap[behind]:
                        new[behind, d] = min(e + 1, new.get((behind, d), 99))
            if node or self.anywhere:
                put(node, e + 1)
        self._close(new)
        key = frozenset(new.items())
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(new)
            stem = min((e for n, e in new.items() if e <= self.stem_end.get(n, -1)), default=None)
            word = min((e for n, e in new.items() if e <= self.word_end.get(n, -1)), default=None)
            self.accepts.append((stem, word))
        self.steps[at, c] = to = self.index[key]
        return to

    def match(self, word: str) -> int | None:
        """Least edits to a lexicon word, or to a stem that the word begins with; None if out of reach."""
        if len(self.states) > 50_000:
            self._start()
        at, best = 1, None
        for c in word:
            to = self.steps.get((at, c))
            at = self._step(at, c) if to is None else to
            if at == 0:
                return best
            stem = self.accepts[at][0]
            if stem is not None and (best is None or stem < best):
                best = stem
        word_edits = self.accepts[at][1] if at > 1 else None
        return word_edits if best is None or word_edits is not None and word_edits < best else best


@dataclass
class ToxicityModel:
    """Terms with their log odds, fuzzy matches to ignore, and the weights of the features."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    banned: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array(PRIOR))


#: Bias, direct hits, quoted hits, misspelled hits, length: what the fit starts from and is drawn to.
PRIOR = (-4.0, 3.0, 0.5, 2.0, 0.0)
#: Shares of a direct hit's weight that quoted and misspelled hits have where the labelled rows show none.
UNSEEN = (0.2, 0.9)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.trie, self.memo = model, FuzzyTrie(list(model.words), list(model.stems), anywhere=True), {}
        odds = [*model.words.values(), *model.stems.values()]
        self.misspelled = sum(odds) / max(1, len(odds))

    def lookup(self, word: str) -> tuple[int, float] | None:
        """(edits, log odds) of the lexicon's nearest term."""
        memo = self.memo
        if word not in memo:
            if len(memo) > 500_000:
                memo.clear()
            edits = None if word in self.model.banned else self.trie.match(word)
            if edits:
                memo[word] = edits, self.misspelled
            elif edits == 0:
                stems = self.model.stems
                memo[word] = 0, max(self.model.words.get(word, 0.0), *(stems.get(word[:n], 0.0) for n in range(1, len(word) + 1)))
            else:
                memo[word] = None
        return memo[word]

    def features(self, text: str | None) -> list[float]:
        """Bias; logarithms of the log odds summed over direct, quoted and misspelled hits; logarithm of the length."""
        low = (text or "").lower()
        lookup = self.lookup
        found = WORD.findall(low)
        hits = {w for w in set(found) if lookup(w) is not None}
        joined = {w for w in set(JOINED.findall(low)) if hits.isdisjoint(WORD.findall(w)) and lookup(w) is not None}
        out = [1.0, 0.0, 0.0, 0.0, math.log1p(len(found) / 100)]
        if hits or joined:
            at = [m.start() for m in WORD.finditer(low)]
            marks = quotations(low)
            places = [(i, i + 1, w) for i, w in enumerate(found) if w in hits]
            if joined:
                places += [(bisect_left(at, m.start()), bisect_left(at, m.end()), m[0]) for m in JOINED.finditer(low) if m[0] in joined]
            for i, j, w in places:
                near = found[max(0, i - CONTEXT) : i]
                after = found[j : j + CONTEXT // 2]
                addressed = any(x in ADDRESS for x in near[-3:] + after)
                quoted = in_quotes(marks, at[i]) or any(x in REPORTING for x in near)
                edits, odds = lookup(w)
                out[2 if quoted else 3 if edits else 1] += odds * (1.5 if addressed and not quoted else 1.0)
            out[1:4] = [math.log1p(x) for x in out[1:4]]
        return out

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.features(text), self.model.weights))))))


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the outermost quotations of the whole text, in order.

    One with an opening mark that is never closed ends with its line, one with a
    straight mark is none.  A straight mark opens before and closes behind a
    character that is no space; “ closes what „ opened.
    """
    spans: list[tuple[int, int]] = []
    stack: list[tuple[int, str]] = []
    straight = -1
    for m in QUOTE.finditer(text):
        i, c = m.start(), m[0]
        if c in BOTH_QUOTES:
            if straight >= 0 and not text[i - 1].isspace():
                spans.append((straight, i))
                straight = -1
            elif i + 1 < len(text) and not text[i + 1].isspace():
                straight = i
        elif c in CLOSE_QUOTES or c == "“" and stack and stack[-1][1] == "„":
            if stack:
                spans.append((stack.pop()[0], i))
        else:
            stack.append((i, c))
    for i, _ in stack:
        end = text.find("\n", i)
        spans.append((i, end if end >= 0 else len(text)))
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def in_quotes(marks: tuple[list[int], list[int]], at: int) -> bool:
    k = bisect_right(marks[0], at) - 1
    return k >= 0 and at < marks[1][k]


def learn_lexicon(rows: list[tuple[str | None, int]], least: float = 14.0, precision: float = 0.6) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark label 1, with their log odds.

    Support is counted over distinct (previous word, next word) contexts, so
    copies of a text count once; a term needs a log likelihood ratio of
    ``least`` against chance and stands in label-1 contexts with ``precision``.
    """
    number: dict[str, int] = {"": 0}
    parts: list[list[np.ndarray]] = [[], []]
    for text, label in rows:
        tokens = WORD.findall((text or "").lower())
        ids = np.fromiter((number.setdefault(w, len(number)) for w in ["", *tokens, ""]), np.int64, len(tokens) + 2)
        parts[label].append(np.unique(np.stack([ids[1:-1], ids[:-2] << 32 | ids[2:]]), axis=1))
    counts = []
    for own in parts:
        each = np.concatenate([np.empty((2, 0), np.int64), *own], axis=1)
        order = np.lexsort(each)
        each = each[:, order]
        new = np.ones(each.shape[1], bool)
        new[1:] = (each[:, 1:] != each[:, :-1]).any(axis=0)
        counts.append(np.bincount(each[0][new], minlength=len(number)))
    clean_of, toxic_of = counts
    total = [int(c.sum()) for c in counts]
    if not all(total):
        return {}, {}
    share = total[1] / sum(total)

    def marks(clean: int, toxic: int) -> bool:
        n = clean + toxic
        if not toxic or toxic / n < precision:
            return False
        q = toxic / n
        return toxic * math.log(q / share) + (clean * math.log((1 - q) / (1 - share)) if clean else 0) >= least

    def odds(clean: int, toxic: int) -> float:
        return max(0.0, math.log((toxic + 0.5) / (clean + 0.5)) - math.log(share / (1 - share)))

    names = list(number)
    words = sorted(names[k] for k in np.flatnonzero(toxic_of) if len(names[k]) >= 3 and marks(int(clean_of[k]), int(toxic_of[k])))
    support: Counter = Counter()
    for k in np.flatnonzero(toxic_of):
        w = names[k]
        for n in range(4, min(len(w), 12)):
            support[w[:n]] += int(toxic_of[k])
    # what stands too seldom in label-1 texts is no stem, however it stands elsewhere
    support = Counter({p: n for p, n in support.items() if n * -math.log(share) >= least})
    clean_support: Counter = Counter()
    forms: Counter = Counter()
    for k in range(1, len(names)):
        w = names[k]
        for n in range(4, min(len(w), 12)):
            if w[:n] in support:
                clean_support[w[:n]] += int(clean_of[k])
                forms[w[:n]] += 1
    stems: dict[str, float] = {}
    taken: set[str] = set()
    for p in sorted(support, key=lambda p: (len(p), p)):
        if forms[p] >= 4 and marks(clean_support[p], support[p]) and not any(p[:n] in taken for n in range(4, len(p))):
            stems[p] = odds(clean_support[p], support[p])
            taken.add(p)
    return {w: odds(int(clean_of[number[w]]), int(toxic_of[number[w]])) for w in words}, stems


def fit(rows: list[tuple[str | None, int]], rounds: int = 300) -> ToxicityModel:
    """Learn lexicon, fuzzy matches to ignore, and weights from (text, label) rows."""
    words, stems = learn_lexicon(rows)
    model = ToxicityModel(words, stems)
    scorer = Scorer(model)
    loose = [Counter(), Counter()]
    for text, label in rows:
        low = (text or "").lower()
        loose[label].update(w for w in {*WORD.findall(low), *JOINED.findall(low)} if (scorer.lookup(w) or (0,))[0])
    model.banned = frozenset(w for w, n in loose[0].items() if n > loose[1][w])
    if rows and {y for _, y in rows} == {0, 1}:
        scorer = Scorer(model)
        x = np.array([scorer.features(t) for t, _ in rows])
        y = np.array([y for _, y in rows], float)
        prior, w = np.array(PRIOR), np.array(PRIOR)
        for _ in range(rounds):  # Newton steps on the penalised likelihood
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(FEATURES), x.T @ (y - p) - 0.05 * (w - prior))
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        for k, share in zip((2, 3), UNSEEN):
            if not x[:, k].any():
                w[k] = share * w[1]
        model.weights = w
    return model


def fit_from_tables(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """Fit on at most ``fit_docs`` labelled documents outside the held-out fold, chosen by a hash of the id."""
    chosen = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
    chosen = chosen.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(fit_docs)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i").select("i", "t", "y").collect()  # the bound: fit_docs ids
    return fit([(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["i"], r["t"] or ""))])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add ``tox_score`` (double, 0 to 1) and ``tox_hits`` (log odds summed over direct, quoted and misspelled hits) to every row."""
    names = fresh(docs.columns, "tox_score", "tox_hits")

    def make():
        scorer = Scorer(model)

        def each(texts, _):
            features = [scorer.features(t.decode() if t is not None else None) for t in texts]
            z = np.clip(np.array(features).reshape(-1, FEATURES) @ model.weights, -30, 30)
            return [(1 / (1 + np.exp(-z))).tolist(), [[math.expm1(x) for x in f[1:4]] for f in features]]

        return each

    return map_text(docs, [(names[0], T.DoubleType()), (names[1], T.ArrayType(T.DoubleType()))], text, make)
