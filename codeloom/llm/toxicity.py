"""Toxicity by a bidirectional gated recurrent network with attention pooling,
written and trained in numpy.

A word's input is the sum of a word vector and the mean of its character
n-gram vectors (both hashed tables); two GRUs read a window of ``WINDOW``
words either way, an attention layer pools their states and a logistic unit
scores the window. All windows, ``STEP`` words apart and so overlapping, of
every whole text are scored; a text's score is that of its worst window,
calibrated on the training documents.

Labels belong to documents, not to windows. The first input dimensions start
as log odds of words and n-grams between the classes; after each epoch the
windows that stand for a document are chosen anew: its worst one, and for
clean documents also one at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as K
from .common import text_batches

WINDOW, STEP = 32, 24
DIM, HIDDEN = 16, 8
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 14
#: Labelled documents of each class that are learned from, at most, and their
#: characters in all. Both bound the driver's memory.
SAMPLE, SAMPLE_CHARS = 1200, 12_000_000
#: Words whose input vectors a scoring task remembers.
MEMO = 250_000
EPOCHS, BATCH, RATE = 10, 256, 0.01
_NGRAMS = (3, 4)


class Words:
    """The distinct words of a block of texts and where they stand."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, skip: K.Memo | None = None):
        """With ``skip``, only words that aren't in it get their n-grams."""
        raw = K.lower_ascii(raw)
        starts, ends, self.bounds = K.tokens(raw, offsets, K.LETTERS)
        h = K.hash_tokens(raw, starts, ends)
        self.keys, first, self.at = np.unique(h, return_index=True, return_inverse=True)
        self.known = skip.find(np.maximum(self.keys, K.U(1))) if skip else np.full(len(first), -1)
        self.new = np.flatnonzero(self.known < 0)
        first = first[self.new]
        self.word = (self.keys[self.new] % K.U(WORD_ROWS)).astype(np.int64)
        self.gram, self.owner = self._grams(raw, starts[first], ends[first])
        self.count = np.maximum(np.bincount(self.owner, minlength=len(first)), 1).astype(np.float32)

    @staticmethod
    def _grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the byte n-grams of '<word>' and the word each belongs to."""
        n = ends - starts + 2
        base = np.r_[0, np.cumsum(n)]
        text = np.empty(base[-1], np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        pos = np.arange(base[-1]) - base[:-1][owner]
        text[pos == 0] = 60
        text[pos == n[owner] - 1] = 62
        inner = (pos > 0) & (pos < n[owner] - 1)
        text[inner] = raw[(starts[owner] + pos - 1)[inner]]
        rows, owners = [], []
        for k in _NGRAMS:
            ok = np.flatnonzero(pos <= n[owner] - k)
            code = np.zeros(len(ok), np.uint64)
            for j in range(k):
                code = (code << K.U(8)) | text[ok + j]
            rows.append((K.mix(code + K.U(k)) % K.U(GRAM_ROWS)).astype(np.int64))
            owners.append(owner[ok])
        row, own = np.concatenate(rows), np.concatenate(owners)
        order = np.argsort(own, kind="stable")
        return row[order].astype(np.int32), own[order].astype(np.int32)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and text of every window; the last of a text
        ends with it."""
        n = np.diff(self.bounds)
        count = np.where(n > WINDOW, -(-(n - WINDOW) // STEP) + 1, (n > 0).astype(np.int64))
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(count)][:-1], count)
        length = np.minimum(n, WINDOW)[text]
        return np.minimum(k * STEP, n[text] - length) + self.bounds[:-1][text], length, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"word": f(WORD_ROWS, DIM, k=0.05), "gram": f(GRAM_ROWS, DIM, k=0.05), "att": f(2 * HIDDEN, 8, k=0.3), "att_v": f(8, k=0.3), "out": f(2 * HIDDEN, k=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": f(DIM, 3 * HIDDEN, k=0.3), f"u{d}": f(HIDDEN, 3 * HIDDEN, k=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift = 1.0, 0.0
        self.memo: K.Memo | None = None

    def inputs(self, words: Words) -> np.ndarray:
        """The input vector of each word with n-grams."""
        x = self.p["word"][words.word].copy()
        if len(words.gram):
            present = np.flatnonzero(np.r_[True, words.owner[1:] != words.owner[:-1]])
            x[words.owner[present]] += np.add.reduceat(self.p["gram"][words.gram], present, axis=0) / np.sqrt(words.count[words.owner[present], None])
        return x

    def _gru(self, d: str, proj: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (steps, windows, HIDDEN); keep gets what the way back needs."""
        u = self.p[f"u{d}"]
        steps, n = idx.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = proj[idx[t]]
            uh = h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + uh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            cand = np.tanh(g[:, 2 * HIDDEN :] + r * uh[:, 2 * HIDDEN :])
            new = cand + z * (h - cand)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, cand, uh[:, 2 * HIDDEN :], m))
            h = np.where(m, new, h)
            out[t] = h
        return out

    def forward(self, proj: dict[str, np.ndarray], idx: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. idx: word of each (step, window)."""
        hs = []
        for d in "fb":
            kept: list | None = [] if keep is not None else None
            hs.append(self._gru(d, proj[d], idx, mask, kept))
            if keep is not None:
                keep[d] = kept
        h = np.concatenate(hs, axis=2)
        a = np.tanh(h @ self.p["att"])
        e = np.where(mask, a @ self.p["att_v"], np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"h": h, "a": a, "w": w, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def projections(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def backward(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: dict, grad: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the words' input vectors."""
        g = {"out": keep["pooled"].T @ grad, "bias": np.array([grad.sum()], np.float32)}
        dp = grad[:, None] * self.p["out"]
        h, a, w = keep["h"], keep["a"], keep["w"]
        dh = w[:, :, None] * dp
        de = w * ((h * dp).sum(2) - (keep["pooled"] * dp).sum(1))
        g["att_v"] = (a * de[:, :, None]).sum((0, 1))
        da = de[:, :, None] * self.p["att_v"] * (1 - a * a)
        g["att"] = h.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, da.shape[2])
        dh = dh + da @ self.p["att"].T
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            du, dw, dc = np.zeros_like(u), np.zeros_like(self.p[f"w{d}"]), np.zeros(3 * HIDDEN, np.float32)
            back = np.zeros((idx.shape[1], HIDDEN), np.float32)
            for t, prev, z, r, cand, uc, m in reversed(keep[d]):
                total = back + dh[t, :, i * HIDDEN : (i + 1) * HIDDEN]
                on = np.where(m, total, 0)
                dcand = on * (1 - z) * (1 - cand * cand)
                dz = on * (prev - cand) * z * (1 - z)
                dr = dcand * uc * r * (1 - r)
                gates = np.concatenate([dz, dr, dcand], 1)
                through = np.concatenate([dz, dr, dcand * r], 1)
                du += prev.T @ through
                dc += gates.sum(0)
                xt = x[idx[t]]
                dw += xt.T @ gates
                np.add.at(dx, idx[t], gates @ self.p[f"w{d}"].T)
                back = np.where(m, on * z + through @ u.T, total)
            g |= {f"u{d}": du, f"w{d}": dw, f"c{d}": dc}
        return g, dx

    def remember(self, words: Words) -> np.ndarray:
        """The input vectors of all words; new ones are kept for later blocks."""
        fresh = self.inputs(words)
        n = self.memo.count
        x = np.empty((len(words.keys), DIM), np.float32)
        old = words.known >= 0
        x[old] = self.vectors[words.known[old]]
        x[words.new] = fresh
        if n + len(fresh) <= MEMO:
            self.vectors[n : n + len(fresh)] = fresh
            self.memo.add(np.maximum(words.keys[words.new], K.U(1)), np.arange(n, n + len(fresh), dtype=np.int32))
        return x

    def window_logits(self, words: Words, first: np.ndarray, length: np.ndarray, size: int = 4096, x: np.ndarray | None = None) -> np.ndarray:
        out = np.empty(len(first), np.float32)
        proj = self.projections(self.inputs(words) if x is None else x)
        for i in range(0, len(first), size):
            idx, mask = _steps(words, first[i : i + size], length[i : i + size])
            out[i : i + size] = self.forward(proj, idx, mask)
        return out

    def scores(self, col: pa.Array) -> np.ndarray:
        """Score of each text; without a word, that of the calmest window."""
        if self.memo is None:
            self.memo, self.vectors = K.Memo(MEMO), np.zeros((MEMO, DIM), np.float32)
        batch = pa.RecordBatch.from_arrays([col], names=["text"])
        out = []
        for part in K.blocks(batch, "text", 2 << 20):
            worst = np.full(part.num_rows, -30.0)
            words = Words(*K.buffers(part.column("text")), self.memo)
            first, length, text = words.windows()
            if len(first):
                logits = self.window_logits(words, first, length, x=self.remember(words))
                np.maximum.at(worst, text, logits.astype(np.float64))
            out.append(_sigmoid(worst * self.scale + self.shift))
        return np.concatenate(out) if out else np.zeros(0)


def _steps(words: Words, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = int(length.max()) if len(length) else 1
    t = np.arange(steps)[:, None]
    mask = t < length
    return words.at[np.where(mask, first + t, first)], mask


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Network:
    """A network fitted to whole texts and their labels (0 or 1). With one
    class only, every text gets that class's score."""
    y = np.array(toxic, np.float32)
    net = Network(seed)
    words = Words(*K.buffers(pa.array(texts, pa.large_string())))
    first, length, text = words.windows()
    if not len(first) or y.min() == y.max():
        net.p["out"] *= 0
        net.scale, net.shift = 0.0, 4.0 * (2 * float(y.mean() if len(y) else 0.0) - 1)
        return net
    rng = np.random.default_rng(seed)
    # log odds of a word or n-gram's standing in a text of either class
    in_text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    pair = np.unique(in_text * len(words.word) + words.at)
    doc, word = pair // len(words.word), pair % len(words.word)
    n1, n0 = y.sum(), len(y) - y.sum()

    df1 = np.bincount(word, y[doc], len(words.word))
    df0 = np.bincount(word, 1 - y[doc], len(words.word))

    def odds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.clip(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)), -2, 4) * np.minimum(1, (a + b) / 4)

    at = lambda x: np.bincount(words.word, x, WORD_ROWS)
    net.p["word"][:, 0] = odds(at(df1), at(df0)) * 0.5
    at = lambda x: np.bincount(words.gram, x[words.owner], GRAM_ROWS)
    net.p["gram"][:, 1] = odds(at(df1), at(df0)) * 0.5
    del pair, doc, word, in_text
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    start = net.inputs(words)[:, :2].sum(1)
    peak = np.full(len(first), -1e9, np.float32)
    for t in range(WINDOW):
        ok = length > t
        peak[ok] = np.maximum(peak[ok], start[words.at[first[ok] + t]])
    by_text = np.searchsorted(text, np.arange(len(texts) + 1))
    level = peak
    for _ in range(EPOCHS):
        order = np.lexsort((-level, text))
        some = np.flatnonzero(np.diff(by_text))
        chosen = [order[by_text[some]]]
        clean = some[y[some] == 0]
        chosen.append(by_text[clean] + (rng.random(len(clean)) * (by_text[clean + 1] - by_text[clean])).astype(np.int64))
        pick = rng.permutation(np.concatenate(chosen))
        for i in range(0, len(pick), BATCH):
            w = pick[i : i + BATCH]
            idx, mask = _steps(words, first[w], length[w])
            used, local = np.unique(idx, return_inverse=True)
            local = local.reshape(idx.shape)
            part = _part(words, used)
            x = net.inputs(part)
            keep: dict = {}
            logit = net.forward(net.projections(x), local, mask, keep)
            target = y[text[w]] * 0.96 + 0.02
            weight = np.where(y[text[w]] > 0, len(w) / max(1.0, 2 * y[text[w]].sum()), len(w) / max(1.0, 2 * (1 - y[text[w]]).sum()))
            grad = ((_sigmoid(logit) - target) * weight / len(w)).astype(np.float32)
            g, dx = net.backward(x, local, mask, keep, grad)
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], part.word, dx)
            g["gram"] = np.zeros_like(net.p["gram"])
            if len(part.gram):
                np.add.at(g["gram"], part.gram, (dx / np.sqrt(part.count[:, None]))[part.owner])
            step += 1
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                net.p[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
        level = net.window_logits(words, first, length)
    worst = np.full(len(texts), -30.0)
    np.maximum.at(worst, text, level.astype(np.float64))
    net.scale, net.shift = _calibrate(worst, y.astype(np.float64))
    return net


def _part(words: Words, used: np.ndarray) -> Words:
    """The same words, but only those used, numbered anew."""
    out = object.__new__(Words)
    a, b = np.searchsorted(words.owner, used), np.searchsorted(words.owner, used, "right")
    size = b - a
    flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    out.word, out.count = words.word[used], words.count[used]
    out.gram, out.owner = words.gram[flat], np.repeat(np.arange(len(used)), size)
    return out


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit by Newton steps; slope >= 0.1."""
    x = np.clip(x, -12, 12)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum()])
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(max(a, 0.1)), float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic).

    Of each class the ``sample`` labelled documents with the smallest hashes
    are used, whole texts in that order while they have ``SAMPLE_CHARS``
    characters together at most. Documents without a text give their place to
    the next. Null labels are left out, several of one document count as the
    highest. Without labelled documents every text's score is 0.5.
    """
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sized = docs.filter("text is not null").select("doc_id", F.char_length("text").alias("chars"))
    sized = sized.join(marks.filter("toxic in (0, 1)"), "doc_id").groupBy("doc_id", "toxic").agg(F.sum("chars").alias("chars"))
    chosen = None
    for c in (0, 1):
        some = sized.filter(F.col("toxic") == c).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
        before = F.sum("chars").over(W.orderBy("h", "doc_id"))  # at most ``sample`` rows
        some = some.withColumn("_all", before).filter(F.col("_all") <= SAMPLE_CHARS).select("doc_id", "toxic")
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.filter("text is not null").select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").select("text", "toxic").toArrow()  # at most 2 * sample ids
    if not rows.num_rows:
        net = Network()
        net.scale, net.shift = 0.0, 0.0
        return net
    toxic = rows.column("toxic").to_pylist()
    net = train(rows.column("text").to_pylist(), toxic)
    # the sample is balanced, the labels aren't: scores follow the labels' odds
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    if net.scale and all(n.get(c) for c in (0, 1)):
        net.shift += float(np.log(n[1] / n[0]) - np.log(sum(toxic) / (len(toxic) - sum(toxic))))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text).

    Null and word-less texts get the score of the calmest window. Repeated
    rows and null ids each give their row; other columns are ignored; an empty
    table gives no rows.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = net.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")
