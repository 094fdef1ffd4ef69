"""Operator 8, toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of a learnt word embedding (the words of the training
sample that are frequent enough) and of hashed character n-gram embeddings, so
unseen forms of a stem are read by their characters. Windows of LENGTH words
overlap by half; both directions read every window, attention pools their
states, and a document's score is the calibrated logit of its highest window.

Training is weakly supervised, on at most TRAIN_DOCS labelled documents of the clean and
the toxic class, whole texts of any length, up to TRAIN_BYTES of each class together
(documented bounds; rows in order of a hash of doc_id, so that long texts are as likely
as short ones): windows of toxic documents are chosen by the log-odds of
their n-grams, then by the network itself; the highest windows of clean
documents are added as hard negatives. The score is calibrated by cross-fitting: KEPT
more networks, each trained without one of FOLDS parts of the sample, in tasks of their
own, say what that part's documents get from a network that hasn't seen them, and a
scale and shift are fitted to these logits. Only where a class is of a single document do the
documents of the training calibrate. Scoring covers every window of every text.

Defined results: a null or empty text gets the score of a window without words;
ids, null or repeated, pass through row by row (a null doc_id is not held out);
labels that are null or without a document are not used, and with fewer than
two classes every score is 0; repeated labels count once, the higher one; an
empty table gives an empty one; extra columns pass through, but for one of the
score's own name, which the score replaces (`score` takes another name).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, lean, mix, pieces, rolling, row_hashes, scratch, spans, tune, writing, written

LENGTH, STRIDE = 24, 12
HIDDEN, INPUT, ATTEND = 8, 12, 8
BUCKETS = 1 << 14
ORDERS = (3, 4, 5)
TRAIN_DOCS = (3000, 1500)
TRAIN_BYTES = 8 << 20
VOCABULARY = 4096
CUT = 0.7
FOLDS, KEPT = 5, 2
CHUNK = 4096
#: Bytes or n-grams of distinct words that are worked on at once.
RUN = 1 << 17
#: Windows of each class in a training turn.
TURN = 4000


def runs(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of items that have up to RUN values together; an item of more is a run of its own."""
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + RUN, "right")) - 1)
        yield i, j
        i = j


def _run_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of a run of words, word by word."""
    length = ends - starts
    wide = length + 2
    first = np.r_[0, np.cumsum(wide)]
    buf = np.full(int(first[-1]), 1, np.uint64)  # bounds stay 1
    at = np.arange(int(length.sum())) + np.repeat(starts - (np.cumsum(length) - length), length)
    to = np.arange(int(length.sum())) + np.repeat(first[:-1] + 1 - (np.cumsum(length) - length), length)
    buf[to] = data[at].astype(np.uint64) + np.uint64(3)
    row = np.repeat(np.arange(len(starts), dtype=np.int32), wide)
    out, rows = [], []
    for n in ORDERS:
        h = rolling(buf, n) + np.uint64(n)
        ok = (row[: len(h)] == row[n - 1 :]) if len(h) else np.zeros(0, bool)
        out.append((mix(h[ok]) % np.uint64(BUCKETS)).astype(np.int32))
        rows.append(row[: len(h)][ok])
    return np.concatenate(out)[np.argsort(np.concatenate(rows), kind="stable")]


def _long_grams(word: np.ndarray) -> Iterator[np.ndarray]:
    """The same of one word that is longer than a run, a part at a time."""
    buf = np.ones(len(word) + 2, np.uint16)
    buf[1:-1] = word
    buf[1:-1] += 3
    for n in ORDERS:
        for lo in range(0, len(buf) - n + 1, RUN):
            h = rolling(buf[lo : lo + RUN + n - 1].astype(np.uint64), n) + np.uint64(n)
            yield (mix(h) % np.uint64(BUCKETS)).astype(np.int32)


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every n-gram of each word, bounds included as marks: (buckets, first one of each word and the end)."""
    wide = ends - starts + 2
    first = np.r_[0, np.cumsum(sum(np.maximum(wide - n + 1, 0) for n in ORDERS))]
    out = np.empty(int(first[-1]), np.int32)
    for i, j in runs(np.r_[0, np.cumsum(wide)]):
        if wide[i] <= RUN:
            out[first[i] : first[j]] = _run_grams(data, starts[i:j], ends[i:j])
        else:
            at = first[i]
            for part in _long_grams(data[starts[i] : ends[i]]):
                out[at : at + len(part)] = part
                at += len(part)
    return out, first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; empty runs are zero."""
    out = np.zeros((len(first) - 1, values.shape[1]), values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full])
    return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every window; a row without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - LENGTH) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][row] + k * STRIDE
    return row, start, np.minimum(start + LENGTH, first[1:][row])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    out = _sigmoid(x)
    out *= 2
    out -= 1
    return out


class Network:
    """Parameters and the forward pass. `p` holds plain arrays, so a network is broadcast as it is."""

    def __init__(self, seed: int = 8) -> None:
        rng = np.random.default_rng(seed)
        f = lambda *shape, s=None: (rng.standard_normal(shape) * (s or shape[0] ** -0.5)).astype(np.float32)
        self.words = np.zeros(0, np.uint64)
        self.p = {"E": f(BUCKETS, INPUT, s=0.05), "V": f(1, INPUT, s=0.05)}
        for d in "fb":
            self.p |= {f"W{d}": f(INPUT, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": f(HIDDEN, 3 * HIDDEN)}
        self.p |= {"A": f(2 * HIDDEN, ATTEND), "v": f(ATTEND), "w": f(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Rows of V; 0 for words that the training sample doesn't hold often enough."""
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at + 1, 0)

    def inputs(self, grams: np.ndarray, first: np.ndarray, slot: np.ndarray) -> np.ndarray:
        out = self.p["V"][slot]
        for i, j in runs(first):
            if first[j] - first[i] <= RUN:
                out[i:j] += sums(self.p["E"][grams[first[i] : first[j]]], first[i : j + 1] - first[i])
            else:
                for lo in range(first[i], first[j], RUN):
                    out[i] += self.p["E"][grams[lo : min(lo + RUN, first[j])]].sum(axis=0)
        return out

    def projected(self, x: np.ndarray, d: str) -> np.ndarray:
        """The inputs to the gates of each distinct word, and a last row for padding that keeps the state as it is."""
        out = np.empty((len(x) + 1, 3 * HIDDEN), np.float32)
        out[:-1] = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        out[-1] = 0
        out[-1, :HIDDEN] = 30
        return out

    def direction(self, d: str, proj: np.ndarray, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """ids: (steps, windows), in reading order -> states (steps, windows, HIDDEN)."""
        u, steps = self.p[f"U{d}"], ids.shape[0]
        h = np.zeros((ids.shape[1], HIDDEN), np.float32)
        out = np.empty((steps, *h.shape), np.float32)
        for t in range(steps):
            x, hu = proj[ids[t]], h @ u
            g = x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
            g = _sigmoid(g)
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            n = _tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, ids: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """x: distinct words' inputs; ids: (windows, LENGTH) with len(x) as padding -> logits."""
        pad = len(x)
        fwd = np.ascontiguousarray(ids.T)
        kf, kb = ([], []) if tape is not None else (None, None)
        hf = self.direction("f", self.projected(x, "f"), fwd, kf)
        hb = self.direction("b", self.projected(x, "b"), fwd[::-1], kb)[::-1]
        h = np.concatenate([hf, hb], axis=2)
        a = _tanh(h @ self.p["A"])
        s = a @ self.p["v"]
        s[fwd == pad] = -1e9
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s /= s.sum(axis=0)
        c = np.einsum("tw,twh->wh", s, h)
        if tape is not None:
            tape.update(kf=kf, kb=kb, h=h, a=a, s=s, c=c, ids=fwd, x=x)
        return c @ self.p["w"] + self.p["b"][0]

    def logits(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x, ids[i : i + CHUNK]) for i in range(0, len(ids), CHUNK)]) if len(ids) else np.zeros(0, np.float32)

    def empty(self) -> float:
        return float(self.p["b"][0])

    def gradients(self, tape: dict, g: np.ndarray) -> tuple[dict, np.ndarray]:
        """g: d loss / d logit -> gradients of the parameters and of the words' inputs."""
        p, h, a, s, c, ids = self.p, tape["h"], tape["a"], tape["s"], tape["c"], tape["ids"]
        out = {"w": c.T @ g, "b": np.array([g.sum()], np.float32)}
        dc = g[:, None] * p["w"]
        ds = np.einsum("wh,twh->tw", dc, h)
        ds = s * (ds - (s * ds).sum(axis=0))
        da = ds[:, :, None] * p["v"] * (1 - a * a)
        out["v"] = np.einsum("tw,twk->k", ds, a)
        out["A"] = np.tensordot(h, da, ((0, 1), (0, 1)))
        dh = s[:, :, None] * dc + da @ p["A"].T
        dx = np.zeros_like(tape["x"])
        for d, kept, back, order in (("f", tape["kf"], dh[:, :, :HIDDEN], ids), ("b", tape["kb"], dh[::-1, :, HIDDEN:], ids[::-1])):
            u = p[f"U{d}"]
            du, carry = np.zeros_like(u), np.zeros_like(back[0])
            dproj = np.empty((*order.shape, 3 * HIDDEN), np.float32)
            for t in range(len(order) - 1, -1, -1):
                before, z, r, n, hn = kept[t]
                dout = back[t] + carry
                dn = dout * (1 - z) * (1 - n * n)
                dz = dout * (before - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                gates = np.concatenate([dz, dr, dn * r], axis=1)
                carry = dout * z + gates @ u.T
                du += before.T @ gates
                dproj[t] = np.concatenate([dz, dr, dn], axis=1)
            flat, row = dproj.reshape(-1, 3 * HIDDEN), order.ravel()
            by = np.argsort(row, kind="stable")
            edge = np.searchsorted(row[by], np.arange(len(tape["x"]) + 1))  # padding is past the end
            total = sums(flat[by], edge)
            out |= {f"U{d}": du, f"W{d}": tape["x"].T @ total, f"c{d}": total.sum(axis=0)}
            dx += total @ p[f"W{d}"].T
        return out, dx


class _Words:
    """The distinct words of some texts, their n-grams, and every window as numbers of them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        low = LOWER[data]
        starts, ends, first = spans(data, offs, ALNUM)
        every = row_hashes(low, offs, starts, ends, first)
        self.hash = np.unique(every)
        ids = np.full(len(every) + 1, len(self.hash), np.int32)  # the last one is padding
        for i in range(0, len(every), RUN):
            ids[:-1][i : i + RUN] = np.searchsorted(self.hash, every[i : i + RUN])
        del every
        at = np.empty(len(self.hash), np.int64)
        at[ids[:-1]] = np.arange(len(ids) - 1)
        starts, ends = starts[at], ends[at]
        self.grams, self.first = word_grams(low, starts, ends)
        del low, at, starts, ends
        self.row, start, end = windows(first)
        self.ids = np.empty((len(start), LENGTH), np.int32)
        for k in range(LENGTH):
            self.ids[:, k] = ids[np.where(start + k < end, start + k, len(ids) - 1)]
        self.rows = len(offs) - 1


def doc_logits(net: Network, column: pa.Array) -> np.ndarray:
    """The logit of the highest window of every text of a column."""
    out = np.full(len(column), net.empty(), np.float64)
    for i, j, data, offs in pieces(column, 1 << 19):
        w = _Words(data, offs)
        if not len(w.ids):
            continue
        logit = net.logits(net.inputs(w.grams, w.first, net.slots(w.hash)), w.ids)
        edge = np.flatnonzero(np.r_[True, w.row[1:] != w.row[:-1]])
        out[i + w.row[edge]] = np.maximum.reduceat(logit, edge)
    return out


def doc_scores(net: Network, column: pa.Array) -> np.ndarray:
    """The score of every text of a column."""
    return 1 / (1 + np.exp(-np.clip(net.scale * doc_logits(net, column) + net.shift, -50, 50)))


def _odds(pos: np.ndarray, neg: np.ndarray, n: int, m: int) -> np.ndarray:
    return np.log((pos + 0.5) / (n + 1)) - np.log((neg + 0.5) / (m + 1))


def fit(texts: list[str], toxic: np.ndarray, held: np.ndarray | None = None, epochs: int = 6, seed: int = 8) -> Network | None:
    """Trains on whole texts with document labels, without those that `held` keeps out; not calibrated. None unless both classes are there."""
    toxic = np.asarray(toxic, bool)
    held = np.zeros(len(texts), bool) if held is None else held
    if toxic[~held].all() or not toxic[~held].any():
        return None
    rng = np.random.default_rng(seed)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offs = np.r_[0, np.cumsum([len(t) for t in raw])]
    data = np.frombuffer(b"".join(raw), np.uint8)
    del raw
    w = _Words(data, offs)
    del data
    net = Network(seed)
    n_words = len(w.hash)
    # document frequencies of words, and through them of n-grams, in both classes; a run of documents at a time
    df, gdf = np.zeros((2, n_words), np.int64), np.zeros((2, BUCKETS), np.int64)
    edge = np.searchsorted(w.row, np.arange(len(texts) + 1))
    for lo in range(0, len(texts), 100):
        hi = min(lo + 100, len(texts))
        ids = w.ids[edge[lo] : edge[hi]].ravel()
        doc = np.repeat(w.row[edge[lo] : edge[hi]], LENGTH)
        real = (ids < n_words) & ~held[doc]
        pair = np.unique(doc[real].astype(np.int64) * n_words + ids[real])
        d, word = pair // max(n_words, 1), pair % max(n_words, 1)
        size = np.diff(w.first)[word]
        at = np.repeat(w.first[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        gram_doc = np.unique(np.repeat(d, size) * BUCKETS + w.grams[at])
        for c in (0, 1):
            df[c] += np.bincount(word[toxic[d] == (c == 0)], minlength=n_words)
            gdf[c] += np.bincount(gram_doc[toxic[gram_doc // BUCKETS] == (c == 0)] % BUCKETS, minlength=BUCKETS)
    n, m = int((toxic & ~held).sum()), int((~toxic & ~held).sum())
    often = np.flatnonzero(df[0] + df[1] >= 4)
    often = often[np.argsort(-(df[0] + df[1])[often], kind="stable")][:VOCABULARY]
    often = np.sort(often)
    net.words = w.hash[often]
    net.p["V"] = np.r_[net.p["V"], (rng.standard_normal((len(often), INPUT)) * 0.05).astype(np.float32)]
    gram_odds = np.where(gdf[0] + gdf[1] >= 3, _odds(gdf[0], gdf[1], n, m), 0.0)
    word_odds = np.where(df[0] + df[1] >= 2, _odds(df[0], df[1], n, m), 0.0)
    net.p["E"][:, 0] += (np.where(gram_odds > 1.5, np.clip(gram_odds, 0, 6), 0) / 4).astype(np.float32)
    net.p["V"][1:, 0] += (np.where(word_odds > 1.5, np.clip(word_odds, 0, 6), 0)[often] / 2).astype(np.float32)
    best = np.zeros(n_words + 1)
    for i, j in runs(w.first):  # every word has an n-gram
        best[i:j] = np.maximum.reduceat(gram_odds[w.grams[w.first[i] : w.first[j]]], w.first[i:j] - w.first[i])
    best[:n_words] = np.maximum(best[:n_words], word_odds)
    evidence = np.concatenate([np.zeros(0), *(best[w.ids[i : i + CHUNK]].max(axis=1) for i in range(0, len(w.ids), CHUNK))])
    bad, train = toxic[w.row], ~held[w.row]
    top = np.zeros(len(texts))
    np.maximum.at(top, w.row, evidence)
    sure = bad & train & (evidence >= np.maximum(0.8 * top[w.row], 1.5))
    clean = np.flatnonzero(~bad & train)
    slot = net.slots(w.hash)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for turn in range(4):
        if turn:  # the network's own choice of windows
            logit = net.logits(net.inputs(w.grams, w.first, slot), w.ids)
            most = np.full(len(texts), -np.inf)
            np.maximum.at(most, w.row, logit)
            sure = bad & train & ((logit > 0) | (logit >= most[w.row] - 1e-6) & (evidence > 1))
            hard = clean[np.argsort(-logit[clean], kind="stable")][:TURN]
        else:
            hard = clean[np.argsort(-evidence[clean], kind="stable")][: TURN // 2]
        yes = rng.permutation(np.flatnonzero(sure))[:TURN]
        if not len(yes) or not len(clean):
            break
        no = np.unique(np.r_[hard, rng.choice(clean, min(len(clean), TURN), replace=False)])
        rows, want = np.r_[yes, no], np.r_[np.ones(len(yes)), np.zeros(len(no))].astype(np.float32)
        for _ in range(epochs if not turn else epochs // 2):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), 256):
                step += 1
                own = order[i : i + 256]
                ids = w.ids[rows[own]]
                used, small = np.unique(ids, return_inverse=True)
                small = small.reshape(ids.shape)
                real = used < n_words
                used = used[real]
                small = np.where(ids < n_words, small, len(used))
                length = np.diff(w.first)[used]
                first = np.r_[0, np.cumsum(length)]
                g_at = np.repeat(w.first[used] - first[:-1], length) + np.arange(int(first[-1]))
                grams = w.grams[g_at]
                tape: dict = {}
                logit = net.forward(net.inputs(grams, first, slot[used]), small, tape)
                prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                grad, dx = net.gradients(tape, ((prob - want[own]) / len(own)).astype(np.float32))
                by = np.argsort(grams, kind="stable")
                rows_e, at_e = np.unique(grams[by], return_index=True)
                ge = sums(np.repeat(dx, length, axis=0)[by], np.r_[at_e, len(by)])
                by = np.argsort(slot[used], kind="stable")
                rows_v, at_v = np.unique(slot[used][by], return_index=True)
                gv = sums(dx[by], np.r_[at_v, len(by)])
                for k, rows_k, g in [("E", rows_e, ge), ("V", rows_v, gv), *((k, slice(None), v) for k, v in grad.items())]:
                    m1, m2 = state[k]
                    m1[rows_k] = 0.9 * m1[rows_k] + 0.1 * g
                    m2[rows_k] = 0.99 * m2[rows_k] + 0.01 * g * g
                    net.p[k][rows_k] -= (0.01 * (m1[rows_k] / (1 - 0.9 ** min(step, 500))) / (np.sqrt(m2[rows_k] / (1 - 0.99 ** min(step, 5000))) + 1e-6)).astype(np.float32)
    return net


def calibrate(net: Network, x: np.ndarray, toxic: np.ndarray, share: float | None = None) -> None:
    """A scale and shift of logits x, so that the score is a probability.

    share: toxic documents among all labelled ones, when the sample has another ratio.
    """
    y = np.asarray(toxic, float)
    own = y.mean()
    share = share or own
    weight = np.where(y > 0, share / own, (1 - share) / (1 - own)) if 0 < own < 1 else np.ones(len(y))
    y = y * (1 - 1 / (len(y) * own + 2)) + (1 - y) / (len(y) * (1 - own) + 2)  # Platt's smoothed targets
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        s = weight * q * (1 - q) + 1e-9
        ga, gb = np.sum(weight * (q - y) * x) + 1e-3 * (a - 1), np.sum(weight * (q - y))
        haa, hab, hbb = np.sum(s * x * x) + 1e-3, np.sum(s * x), np.sum(s) + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        top_step = max(abs(da), abs(db), 1.0)
        a, b = a - da / top_step, b - db / top_step
        if max(abs(da), abs(db)) < 1e-7:
            break
    if np.isfinite(a) and np.isfinite(b) and a > 0:
        net.scale, net.shift = float(a), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: tuple[int, int] = TRAIN_DOCS) -> Network | None:
    """A network from the labelled rows that aren't held out: at most `limit` clean and toxic documents."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    pick = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit[c])
        pick = part if pick is None else pick.union(part)
    # at most sum(limit) rows of two numbers: small enough to broadcast, whatever the corpus
    texts_ = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = F.xxhash64("text").alias("key")
    sized = texts_.select("doc_id", key, F.octet_length("text").cast("long").alias("size")).join(F.broadcast(pick), "doc_id").where("size is not null")
    first = sized.groupBy("doc_id", "key").agg(F.first("size").alias("size"), F.first("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(sum(limit))
    # whole texts, until the bytes of their class are used up; a text that doesn't fit leaves room for those after it
    at = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.sum(F.when(F.col("size") <= TRAIN_BYTES, F.col("size"))).over(at)
    chosen = first.withColumn("upto", fits).where((F.col("size") <= TRAIN_BYTES) & (F.col("upto") <= TRAIN_BYTES)).select("doc_id", "key", "toxic")
    found = texts_.withColumn("key", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "key"))
    share = size.get(1, 0) / max(sum(size.values()), 1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        for b in batches:
            for turn, *row in zip(*(c.to_pylist() for c in b.columns)):
                by.setdefault(turn, []).append(tuple(row))
        for turn, rows_ in by.items():
            rows_.sort(key=lambda r: (r[0], r[1]))
            texts, toxic, fold = [r[2] for r in rows_], np.array([r[0] for r in rows_], bool), np.array([r[1] % FOLDS for r in rows_])
            held = fold == turn
            net = fit(texts, toxic, held)
            if net is not None:
                # the last turn has all documents, and says what they get themselves
                ask = held if turn < FOLDS else ~held
                x = doc_logits(net, pa.array([t for t, a in zip(texts, ask) if a], pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), pa.array([pickle.dumps(net) if turn == FOLDS else None], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([toxic[ask].tobytes()], pa.binary())], names=["turn", "network", "logits", "toxic"])

    with scratch(docs.sparkSession), writing(docs.sparkSession):
        # bounded: at most sum(limit) texts of 2 * TRAIN_BYTES together, read by KEPT + 1 tasks
        sample = written(found.withColumn("nth", nth), "sample")
        turns = sample.select(F.explode(F.array(*(F.lit(k) for k in (*range(KEPT), FOLDS)))).alias("turn"), "toxic", "nth", "text")
        got = turns.repartitionByRange(KEPT + 1, "turn").mapInArrow(lean(learn), "turn int, network binary, logits binary, toxic binary").collect()
    whole = next((r for r in got if r.turn == FOLDS), None)
    if whole is None:
        return None
    net = pickle.loads(whole.network)

    def said(rows_: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.frombuffer(r.logits) for r in rows_] or [np.zeros(0)]), np.concatenate([np.frombuffer(r.toxic, bool) for r in rows_] or [np.zeros(0, bool)])

    x, toxic = said([r for r in got if r.turn < FOLDS])
    if toxic.all() or not toxic.any():
        x, toxic = said([whole])
    calibrate(net, x, toxic, share)
    return net


def score(docs: DataFrame, net: Network | None, name: str = "toxicity") -> DataFrame:
    """All columns of docs and the score, from 0 to 1."""
    docs = docs.drop(name)
    if net is None:
        return docs.withColumn(name, F.lit(0.0))
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(doc_scores(shared.value, batch.column(at)))], names=names)

    schema = type(docs.schema)([*docs.schema.fields]).add(name, "double")
    return docs.mapInArrow(lean(run), schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = score(rows, train(rows, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document, by a network from the labels that aren't held out."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
