"""Toxicity by a bidirectional gated recurrent network (operator 8).

A word's input is its characters, read in both directions by a small recurrent net, and a
learned word vector; words in few training texts share one vector, so that they are told
by their characters alone. A second bidirectional net reads windows of words, attention
pools its states, and a logistic unit scores the window. Windows overlap and cover the
whole text; a text scores as its worst window. Training is in numpy, on a bounded sample
of labelled rows; as labels are of whole texts, the first rounds take windows at random,
the later ones those that the current net finds worst.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks

WINDOW, STRIDE = 32, 24
PIECE = 32  # longer words are read in pieces of so many bytes
HC, HW, HA, DC, DW = 8, 10, 8, 8, 16
#: Word vectors at most, of words in so many training texts at least; the rest share the first.
MAX_WORDS, MIN_TEXTS = 8192, 4
#: Labelled rows that are fitted on at most, of either label.
MAX_TOXIC, MAX_CLEAN = 800, 1200
ROUNDS, RANDOM_ROUNDS, RATE, BATCH = 7, 2, 0.015, 128
#: Steps at least, so that few rows are gone over more often.
STEPS = 260
THRESHOLD = 0.7
#: Words whose inputs a worker remembers.
REMEMBERED_WORDS = 250_000
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    if not text:
        return []
    found = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    if max(map(len, found), default=0) > PIECE:
        found = [w[a : a + PIECE] for w in found for a in range(0, len(w), PIECE)]
    return found


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (longest, rows), filled with 0, and the lengths."""
    longest = max(map(len, words))
    raw = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest).T
    return np.ascontiguousarray(raw), np.array([len(w) for w in words])


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(gx: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """States (steps, rows, hidden) for input projections gx; masked steps change nothing."""
    steps, rows, h3 = gx.shape
    n = h3 // 3
    h, out, cache = np.zeros((rows, n), gx.dtype), np.empty((steps, rows, n), gx.dtype), []
    full = mask.all(axis=1)
    for t in range(steps):
        a = h @ u
        zr = a[:, : 2 * n] + gx[t, :, : 2 * n]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[:, :n], zr[:, n:]
        c = r * a[:, 2 * n :]
        c += gx[t, :, 2 * n :]
        np.tanh(c, out=c)
        if keep:
            cache.append((h, z, r, c, a[:, 2 * n :]))
        new = out[t]
        np.subtract(h, c, out=new)
        new *= z
        new += c
        if not full[t]:
            np.copyto(new, h, where=~mask[t][:, None])
        h = new
    return out, cache


def gru_back(d_out: np.ndarray, cache: list, mask: np.ndarray, u: np.ndarray):
    """Gradients of the input projections and of u."""
    steps, rows, n = d_out.shape
    dgx, du, dh = np.zeros((steps, rows, 3 * n), d_out.dtype), np.zeros_like(u), np.zeros((rows, n), d_out.dtype)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, un = cache[t]
        dh = dh + d_out[t]
        on = mask[t][:, None]
        dn = np.where(on, dh, 0)
        dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
        dr = dc * un * r * (1 - r)
        dgx[t] = np.concatenate([dz, dr, dc], axis=1)
        da = np.concatenate([dz, dr, dc * r], axis=1)
        du += h.T @ da
        dh = np.where(on, dn * z + da @ u.T, dh)
    return dgx, du


@dataclass
class Net:
    p: dict[str, np.ndarray]
    vocabulary: dict[bytes, int]
    known: dict[bytes, int] = field(default_factory=dict)
    inputs: np.ndarray | None = None

    @staticmethod
    def fresh(vocabulary: list[bytes], seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        x = 2 * HC + DW
        p = {"chars": g(256, DC), "words": (rng.standard_normal((len(vocabulary) + 1, DW)) / 8).astype(np.float32)}
        p["words"][0] = 0
        for side in "fb":
            p |= {f"c_w{side}": g(DC, 3 * HC), f"c_u{side}": g(HC, 3 * HC), f"c_b{side}": np.zeros(3 * HC, np.float32)}
            p |= {f"w_w{side}": g(x, 3 * HW), f"w_u{side}": g(HW, 3 * HW), f"w_b{side}": np.zeros(3 * HW, np.float32)}
        p |= {"a_w": g(2 * HW, HA), "a_v": g(HA), "o_w": g(2 * HW), "o_b": np.full(1, -2, np.float32)}
        return Net(p, {w: k + 1 for k, w in enumerate(vocabulary)})

    def fixed(self, words: list[bytes]):
        """Of each word: its bytes, padded, their mask, and the place of its vector."""
        raw, lengths = padded(words)
        return raw, np.arange(len(raw))[:, None] < lengths, np.array([self.vocabulary.get(w, 0) for w in words])

    def word_vectors(self, raw, mask, place, keep: bool = False):
        p, caches, ends = self.p, {}, []
        e = p["chars"][raw]
        for side, turn in (("f", slice(None)), ("b", slice(None, None, -1))):
            gx = e[turn] @ p[f"c_w{side}"] + p[f"c_b{side}"]
            hs, caches[side] = gru(gx, mask[turn], p[f"c_u{side}"], keep)
            ends.append(hs[-1])
        return np.concatenate([*ends, p["words"][place]], axis=1), (e, caches)

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        """Places of the words' projected inputs in ``inputs``; place 0 is empty."""
        if self.inputs is None or len(self.known) > REMEMBERED_WORDS:
            self.known, self.inputs = {}, np.zeros((1, 6 * HW), np.float32)
        new = list({w for w in words if w not in self.known})
        if new:
            new.sort(key=len)
            both = np.concatenate([self.p["w_wf"], self.p["w_wb"]], axis=1), np.concatenate([self.p["w_bf"], self.p["w_bb"]])
            made = [self.word_vectors(*self.fixed(new[a : a + 4096]))[0] @ both[0] + both[1] for a in range(0, len(new), 4096)]
            at = len(self.inputs)
            self.inputs = np.concatenate([self.inputs, *made])
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def states(self, gx, mask, keep: bool = False):
        f, cf = gru(gx[..., : 3 * HW], mask, self.p["w_uf"], keep)
        b, cb = gru(gx[::-1, :, 3 * HW :], mask[::-1], self.p["w_ub"], keep)
        return np.concatenate([f, b[::-1]], axis=2), (cf, cb)

    def pooled(self, h, mask):
        k = np.tanh(h @ self.p["a_w"])
        e = np.where(mask, k @ self.p["a_v"], -30)
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        v = np.einsum("tn,tnh->nh", a, h)
        return v @ self.p["o_w"] + self.p["o_b"], (k, a, v)

    def score_windows(self, places: np.ndarray) -> np.ndarray:
        """Logits of windows (rows, WINDOW) of places; 0 is no word."""
        out = np.empty(len(places), np.float32)
        for s in range(0, len(places), 1024):
            at = places[s : s + 1024].T
            mask = at > 0
            h, _ = self.states(self.inputs[at], mask)
            out[s : s + 1024] = self.pooled(h, mask)[0]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the worst window's probability; texts without words score as an empty window."""
        split = [split_words(t) for t in texts]
        rows = self.rows_of([w for s in split for w in s])
        windows, owner, at = [], [], 0
        for k, s in enumerate(split):
            windows.append(windows_of(rows[at : at + len(s)]))
            owner.append(np.full(len(windows[-1]), k))
            at += len(s)
        if not texts:
            return np.zeros(0)
        logits, owner = self.score_windows(np.concatenate(windows)), np.concatenate(owner)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logits)
        return sigmoid(best).astype(float)


def windows_of(row: np.ndarray) -> np.ndarray:
    """All windows of a row of places, each overlapping the next; the last is filled with 0."""
    n = max(1, -(-(len(row) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int64)
    padded[: len(row)] = row
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def frequent_words(split: list[list[bytes]]) -> list[bytes]:
    """Words of MIN_TEXTS texts or more, MAX_WORDS at most, the most frequent first."""
    texts = Counter(w for s in split for w in set(s))
    return sorted((w for w, n in texts.items() if n >= MIN_TEXTS), key=lambda w: (-texts[w], w))[:MAX_WORDS]


def train(texts: list[str | None], labels: list[int], rounds: int = ROUNDS, seed: int = 7) -> Net:
    """Fit the net. Without rows of both labels it keeps its low prior for every text."""
    split = [split_words(t) for t in texts]
    keep = [k for k, s in enumerate(split) if s]
    split, y = [split[k] for k in keep], np.array([labels[k] for k in keep], dtype=int) == 1
    if not y.any() or y.all():
        empty = Net.fresh([], seed)
        empty.p["o_w"][:] = 0
        return empty
    net = Net.fresh(frequent_words(split), seed)
    names = sorted(set().union(*split))
    known = {w: k + 1 for k, w in enumerate(names)}
    place = [windows_of(np.array([known[w] for w in s])) for s in split]
    every, owner = np.concatenate(place), np.repeat(np.arange(len(place)), [len(x) for x in place])
    rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
    rounds = max(rounds, -(-STEPS // (-(-3 * len(y) // BATCH))))
    for lap in range(rounds):
        if lap < RANDOM_ROUNDS:
            use = np.concatenate([rng.integers(0, len(every), 3 * len(y)), np.flatnonzero(y[owner])])
        else:
            rank = _all_logits(net, names, every)
            order = np.lexsort((rank, owner))
            last = np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True))
            worst = order[last]  # the worst window of each text
            second = order[np.maximum(last - 1, 0)]
            second = second[(owner[second] == np.arange(len(y))) & ~y]
            some = rng.integers(0, len(every), len(y))
            use = np.concatenate([worst, second, some[~y[owner[some]]]])
        use = rng.permutation(use)
        for s in range(0, len(use), BATCH):
            step += 1
            at = use[s : s + BATCH]
            _learn(net, names, every[at], y[owner[at]], m, v, step, RATE * (1 - lap / rounds))
    net.known, net.inputs = {}, None
    return net


def _all_logits(net: Net, names: list[bytes], every: np.ndarray) -> np.ndarray:
    net.known, net.inputs = {}, None
    return net.score_windows(np.concatenate([[0], net.rows_of(names)])[every])


def _learn(net: Net, names: list[bytes], at: np.ndarray, y: np.ndarray, m: dict, v: dict, step: int, rate: float) -> None:
    """One step of Adam on windows (rows, WINDOW) of vocabulary places."""
    p = net.p
    ids, inverse = np.unique(at, return_inverse=True)
    inverse = inverse.reshape(at.shape).T
    words = [names[k - 1] if k else b"" for k in ids]
    raw, cmask, place = net.fixed([w or b"\0" for w in words])
    x, (e, caches) = net.word_vectors(raw, cmask, place, keep=True)
    mask = at.T > 0
    gx = np.concatenate([x @ p["w_wf"] + p["w_bf"], x @ p["w_wb"] + p["w_bb"]], axis=1)
    h, (cf, cb) = net.states(gx[inverse], mask, keep=True)
    logit, (k, a, pool) = net.pooled(h, mask)
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {"o_w": pool.T @ d, "o_b": d.sum(keepdims=True)}
    dv = d[:, None] * p["o_w"]
    da = np.einsum("nh,tnh->tn", dv, h)
    de = a * (da - (a * da).sum(axis=0))
    dk = de[..., None] * p["a_v"] * (1 - k * k)
    g["a_v"] = np.einsum("tn,tna->a", de, k)
    g["a_w"] = np.einsum("tnh,tna->ha", h, dk)
    dh = a[..., None] * dv + dk @ p["a_w"].T
    dgf, g["w_uf"] = gru_back(dh[..., :HW], cf, mask, p["w_uf"])
    dgb, g["w_ub"] = gru_back(dh[::-1, :, HW:], cb, mask[::-1], p["w_ub"])
    dx = np.zeros_like(x)
    for side, dg in (("f", dgf), ("b", dgb[::-1])):
        total = np.zeros((len(ids), 3 * HW), np.float32)
        np.add.at(total, inverse.ravel(), dg.reshape(-1, 3 * HW))
        g[f"w_w{side}"], g[f"w_b{side}"] = x.T @ total, total.sum(axis=0)
        dx += total @ p[f"w_w{side}"].T
    g["words"] = np.zeros_like(p["words"])
    np.add.at(g["words"], place, dx[:, 2 * HC :])
    g["words"][0] = 0
    g["chars"] = np.zeros_like(p["chars"])
    for n, (side, turn) in enumerate((("f", slice(None)), ("b", slice(None, None, -1)))):
        d_out = np.zeros((*raw.shape, HC), np.float32)
        d_out[-1] = dx[:, n * HC : (n + 1) * HC]
        dg, g[f"c_u{side}"] = gru_back(d_out, caches[side], cmask[turn], p[f"c_u{side}"])
        dg = dg[turn]
        g[f"c_w{side}"], g[f"c_b{side}"] = np.einsum("tnd,tng->dg", e, dg), dg.sum(axis=(0, 1))
        np.add.at(g["chars"], raw.ravel(), (dg @ p[f"c_w{side}"].T).reshape(-1, DC))
    for name, of in g.items():
        m[name] = 0.9 * m.get(name, 0) + 0.1 * of
        v[name] = 0.999 * v.get(name, 0) + 0.001 * of * of
        p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def trained(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (MAX_TOXIC, MAX_CLEAN)) -> Net:
    """Fit on at most so many toxic and clean texts of labels (doc_id, toxic), those first
    by a hash of id and text. Repeated ids count as rows each, so the bound holds for
    texts; labels other than 0 and 1 and null ids teach nothing."""
    labels = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").distinct()
    order = F.xxhash64("doc_id", "text")
    parts = []
    for toxic, limit in ((1, most[0]), (0, most[1])):
        some = labels.filter(F.col("toxic") == toxic)
        # ids first, so that texts of chosen ones alone are read; then the bound on texts
        ids = some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        parts.append(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy(order, "doc_id").limit(limit).withColumn("toxic", F.lit(toxic)))
    rows = parts[0].unionByName(parts[1]).collect()  # most[0] + most[1] texts
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"] or ""))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def toxicity(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` with toxicity_score, from 0 to 1, of whole texts.

    Null and empty texts, and such without a letter, score as an empty window does; a
    text scores as its worst window, so a long text isn't thinned out. A given column
    of that name is replaced; repeated rows stay; an empty table gives an empty result."""
    docs = docs.drop("toxicity_score")
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns
    at = names.index("text")

    def each(batches):
        for batch in chunks(batches, 200):
            scores = held.value.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "toxicity_score"])

    return docs.mapInArrow(each, f"{fields}, toxicity_score double")
