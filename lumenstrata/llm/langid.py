"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time.  A text is cut
into segments of ``SEGMENT`` bytes; one recurrent pass from the left and one
from the right give every byte a distribution over the languages, and a
document's probabilities are the mean over all its bytes.  Gates use the
softsign in place of the hyperbolic tangent, which numpy evaluates many times
faster.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as is every text when no labelled text could be learned from; rows with a null
label are not learned from; repeated rows are predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held_out, map_text

SEGMENT, HIDDEN = 64, 8
#: Bounds of what a fit reads: documents of each language, and training windows drawn from them.
FIT_DOCS, STEPS, BATCH = 150, 400, 256
UNKNOWN = "und"


@dataclass
class Net:
    labels: list[str]
    p: dict[str, np.ndarray]


def _soft(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    return np.divide(x, d, out=d)


def _forward(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: np.ndarray | None, trace: list | None = None) -> np.ndarray:
    """States of one direction, time first.  x: (time, batch) bytes; keep: the same, 0 at padding."""
    t, b = x.shape
    h_n = u.shape[0]
    out = np.empty((t, b, h_n), np.float32)
    h = np.zeros((b, h_n), np.float32)
    for i in range(t):
        a = table[x[i]]
        v = h @ u
        a[:, : 2 * h_n] += v[:, : 2 * h_n]
        gates = _soft(a[:, : 2 * h_n])
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :h_n], gates[:, h_n:]
        pre = r * v[:, 2 * h_n :]
        pre += a[:, 2 * h_n :]
        n = _soft(pre)
        new = h - n
        new *= z
        new += n
        if keep is not None:
            new *= keep[i][:, None]
        if trace is not None:
            trace.append((h, v, a, gates, pre, n))
        h = out[i] = new
    return out


def _backward(x, grad, u, trace, g_table, g_u, keep) -> None:
    """Adds the gradients of one direction; grad: of its states."""
    t, b = x.shape
    h_n = u.shape[0]
    dh = np.zeros((b, h_n), np.float32)
    for i in range(t - 1, -1, -1):
        h, v, a, gates, pre, n = trace[i]
        dh = dh + grad[i]
        if keep is not None:
            dh *= keep[i][:, None]
        z, r = gates[:, :h_n], gates[:, h_n:]
        dn = dh * (1 - z) / (1 + np.abs(pre)) ** 2
        dz = dh * (h - n)
        dr = dn * v[:, 2 * h_n :]
        dg = np.concatenate([dz, dr], 1) * 0.5 / (1 + np.abs(a[:, : 2 * h_n])) ** 2
        dv = np.concatenate([dg, dn * r], 1)
        np.add.at(g_table, x[i], np.concatenate([dg, dn], 1))
        g_u += h.T @ dv
        dh = dh * z + dv @ u.T


def _logits(net: Net, x: np.ndarray, keep: np.ndarray | None, traces=(None, None)):
    f = _forward(x, net.p["table_f"], net.p["u_f"], keep, traces[0])
    b = _forward(x[::-1], net.p["table_b"], net.p["u_b"], None if keep is None else keep[::-1], traces[1])[::-1]
    return f, b, f @ net.p["out_f"] + b @ net.p["out_b"] + net.p["bias"]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def train(rows: list[tuple[str, str]], steps: int = STEPS, batch: int = BATCH, hidden: int = HIDDEN, segment: int = SEGMENT, seed: int = 7) -> Net:
    """Fit on (text, label) rows by backpropagation through time and Adam; languages are drawn equally often."""
    labels = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    k, h3 = len(labels), 3 * hidden
    init = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"table_f": init(256, h3), "u_f": init(hidden, h3), "table_b": init(256, h3), "u_b": init(hidden, h3), "out_f": init(hidden, k), "out_b": init(hidden, k), "bias": np.zeros(k, np.float32)}
    net = Net(labels, p)
    if k < 2:
        return net
    data = [[np.frombuffer(t.encode(), np.uint8) for t, y in rows if y == lab and t] for lab in labels]
    joined = [np.concatenate([np.frombuffer(b"\n", np.uint8), *xs]) for xs in data]
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, k, batch)
        length = int(rng.integers(segment // 4, segment + 1))
        x = np.zeros((length, batch), np.uint8)
        for i, c in enumerate(y):
            at = int(rng.integers(0, max(1, len(joined[c]) - length)))
            part = joined[c][at : at + length]
            x[: len(part), i] = part
        traces: tuple[list, list] = ([], [])
        f, b, logits = _logits(net, x, None, traces)
        d = softmax(logits)
        d[:, np.arange(batch), y] -= 1
        d /= batch * length
        g = {n: np.zeros_like(v) for n, v in p.items()}
        g["out_f"] = np.einsum("tbh,tbk->hk", f, d)
        g["out_b"] = np.einsum("tbh,tbk->hk", b, d)
        g["bias"] = d.sum(axis=(0, 1))
        _backward(x, d @ p["out_f"].T, p["u_f"], traces[0], g["table_f"], g["u_f"], None)
        _backward(x[::-1], (d @ p["out_b"].T)[::-1], p["u_b"], traces[1], g["table_b"], g["u_b"], None)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.03 * min(1.0, 4 * (steps - step + 1) / steps)
        for n, v in g.items():
            v *= min(1.0, 1.0 / (norm + 1e-9))
            m, s = moments[n]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            p[n] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Predictor:
    """Pooled document probabilities of whole texts, in blocks of equally long segments."""

    def __init__(self, net: Net, segment: int = SEGMENT, block: int = 2048):
        self.net, self.segment, self.block = net, segment, block

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """(texts, labels) mean probabilities; rows of empty texts are zero."""
        k, seg = len(self.net.labels), self.segment
        size = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts) + bytes(seg), np.uint8)
        first = np.cumsum(size) - size
        pieces = -(-size // seg)
        doc = np.repeat(np.arange(len(texts)), pieces)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * seg
        length = np.minimum(seg, size[doc] - at)
        at += first[doc]
        total = np.zeros((len(texts), k))
        order = np.argsort(-length, kind="stable")
        full = int((length == seg).sum())
        for a, b, padded in [*((i, min(i + self.block, full), False) for i in range(0, full, self.block)), *((i, min(i + self.block, len(doc)), True) for i in range(full, len(doc), self.block))]:
            pick = order[a:b]
            t = int(length[pick].max())
            x = data[at[pick][None, :] + np.arange(t)[:, None]]
            keep = (np.arange(t)[:, None] < length[pick][None, :]).astype(np.float32) if padded else None
            prob = softmax(_logits(self.net, x, keep)[2])
            if padded:
                prob *= keep[:, :, None]
            sums = prob.sum(axis=0)
            for c in range(k):
                total[:, c] += np.bincount(doc[pick], sums[:, c], len(texts))
        return total / np.maximum(size, 1)[:, None]


def fit_from_table(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", fit_docs: int = FIT_DOCS) -> Net:
    """Train on at most ``fit_docs`` documents of each label outside the held-out fold, chosen by a hash of the id."""
    own = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("i")))
    sizes = {r["y"]: r["n"] for r in own.filter(F.col("t").isNotNull()).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Net([], {})
    # a share of each language that holds its bound with a margin, cut to the bound in the order of the hash
    share = F.create_map(*(F.lit(v) for y, n in sizes.items() for v in (y, min(1.0, 1.3 * fit_docs / n))))[F.col("y")]
    h = F.pmod(F.xxhash64("i", F.lit(11)), F.lit(1 << 20))
    rows = own.filter(F.col("t").isNotNull() & (h < share * (1 << 20))).select("y", "t", h.alias("h"), "i").collect()
    taken: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["h"], str(r["i"]), r["t"])):
        if len(got := taken.setdefault(r["y"], [])) < fit_docs:
            got.append(r["t"])
    return train([(t, y) for y, ts in taken.items() for t in ts])


def identify(docs: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` and ``lang_probs`` (by label, in label order) to every row."""
    names = fresh(docs.columns, "lang_pred", "lang_score", "lang_probs")

    def make():
        import regex

        letter, predict = regex.compile(r"\p{L}"), Predictor(net)

        def each(texts, _):
            known = [t is not None and len(net.labels) > 0 and letter.search(t.decode()) is not None for t in texts]
            probs = predict([t if ok else b"" for t, ok in zip(texts, known)]) if len(net.labels) > 1 else np.ones((len(texts), max(1, len(net.labels))))
            best = probs.argmax(axis=1)
            score = np.clip(probs[np.arange(len(texts)), best], 0, 1)
            return [
                [net.labels[b] if ok else UNKNOWN for b, ok in zip(best, known)],
                [float(s) if ok else 0.0 for s, ok in zip(score, known)],
                [p.tolist() if ok else None for p, ok in zip(probs, known)],
            ]

        return each

    return map_text(docs, [(names[0], T.StringType()), (names[1], T.DoubleType()), (names[2], T.ArrayType(T.DoubleType()))], text, make)
