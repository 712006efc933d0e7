"""Language-model scores by Katz backoff (operator 2).

The model is a bigram model over words with a backed-off unigram model. Counts of up
to ``K`` are discounted by Good-Turing; the mass set free goes to words unseen after a
context in proportion to their unigram probability, with a weight that makes every
context's probabilities sum to exactly 1, and the unigram mass set free is that of the
unknown word.

Words are 64-bit hashes. Occurrences (word, context, document) are dealt by word, in
compressed columns, so that a task meets all contexts of a word and knows the word's
count; from there the counted bigrams, which are the model's table, and the held-out
occurrences are dealt by context, where backoff weights are found and applied. Words
and contexts that alone would fill a good part of a task are dealt by both.

Documents are tokenised once, into a table of buffers of about ``BUFFER_TOKENS``. A
document is known by its buffer and its place there, and what all parts have found goes
back by buffer, in columns, so that no row for each document and part is ever made.

The model is stored: a table of words with counts, and one of contexts with their words,
counts and backoff weights, in ``BUCKETS`` partitions. ``evaluate`` reads it and scores
any texts, recursively: bigram, else weight times unigram, else the unknown word.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, dropped, free_shuffles, keyed_join, new_path, only_memory, words, written

K = 5
#: Factor of larger counts, so that a context of frequent words alone leaves something for others.
LARGE = 0.999
#: Tokens that a task holds, and a word's or context's from which it is dealt by both.
TASK_TOKENS, HOT_TOKENS, BUFFER_TOKENS = 800_000, 400_000, 500_000
#: Times the buffers are read; each deals its share of the parts, so that shuffle
#: files of only one share exist at a time.
ROUNDS = 8
#: Times that shares of the contexts are weighed; what a share was made from is deleted then.
SHARES = 3
#: Partitions of the stored table of contexts.
BUCKETS = 64
REMEMBERED_WORDS = 150_000
_FACTOR = np.int64(-7046029254386353131)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = struct.unpack("<q", xxhash.xxh3_64_digest(word)[::-1])[0]
        if len(word) <= 64:
            self[word] = found
        return found


_known = _Hashes()
END, START = _known[b"\n end"], _known[b"\n start"]  # no word holds white space


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words and of the end that follows them."""
    if len(_known) > REMEMBERED_WORDS:
        _known.clear()
    found = words(text)
    return np.fromiter(map(_known.__getitem__, found), np.int64, len(found)) if found else np.zeros(0, np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    raw = struct.pack(f"<{len(columns)}q", *(c.nbytes for c in columns)) + b"".join(c.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of 64-bit counts by significance: those of small numbers are nearly all 0."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def _unpacked(blob: bytes, kinds: str) -> list[np.ndarray]:
    """The columns of ``_packed``; p8 is a column of ``_planes``."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    kinds = kinds.split()
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", raw), 8 * len(kinds), []
    for kind, n in zip(kinds, sizes, strict=True):
        if kind == "p8":
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n, at).reshape(8, -1).T).view("<i8").ravel())
        else:
            out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def discounts(of_counts: dict[int, int], k: int = K) -> np.ndarray:
    """Factors d[c] of counts c up to k; larger counts have LARGE. Good-Turing, and an
    absolute discount wherever it gives none between 0 and 1, as with few counts."""
    n = [of_counts.get(c, 0) for c in range(k + 2)]
    d, rest = np.ones(k + 1), (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    for c in range(1, k + 1):
        good = ((c + 1) * n[c + 1] / (c * n[c]) - rest) / (1 - rest) if n[c] and rest < 1 else 0.0
        d[c] = good if 0 < good < 1 else (c - less) / c
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], LARGE)


@dataclass
class Unigrams:
    """What is bounded of the unigram model; counts are in a table."""

    total: int
    distinct: int
    d: np.ndarray
    hot: dict[int, int]
    unknown: float
    parts: int

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words with these counts; 0 is the unknown word."""
        return np.where(c > 0, discounted(c, self.d) / max(1, self.total), self.unknown)

    def part(self, main: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Where (main, other) goes: by main alone, or by both if main is hot."""
        hot = np.isin(main, np.fromiter(self.hot, np.int64, len(self.hot)))
        return np.where(hot, (main ^ (other * _FACTOR)) % self.parts, main % self.parts).astype(np.int64)


def _buffers(batches):
    """doc_ids, held-out flags and token arrays of some documents at a time."""
    held, n = [], 0
    for batch in chunks(batches, 500):
        for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append((doc_id, out, np.append(tokens(text), END)))
            n += len(held[-1][2])
            if n >= BUFFER_TOKENS or len(held) == 65_000:
                yield held
                held, n = [], 0
    if held:
        yield held


#: documents: doc_id, whether there is one, held out, tokens; tokens: their distinct words, and the place in
#: these of each token, in a row
BUFFER = "buffer long, documents binary, tokens binary"
DOCUMENTS = "i8 ? ? u4"


def _tokenised(docs: DataFrame) -> DataFrame:
    def each(batches):
        only_memory("katz", _known.clear)
        of_task = TaskContext.get().partitionId() << 32
        for buffer, held in enumerate(_buffers(batches), of_task):
            ids = [k for k, _, _ in held]
            distinct, at = np.unique(np.concatenate([t for _, _, t in held]), return_inverse=True)
            documents = _packed(np.array([k or 0 for k in ids], np.int64), np.array([k is not None for k in ids]), np.array([o for _, o, _ in held], bool), np.array([len(t) for _, _, t in held], np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([buffer]), pa.array([documents], pa.binary()), pa.array([_packed(distinct, at.astype(np.uint32))], pa.binary())], ["buffer", "documents", "tokens"])

    return docs.mapInArrow(each, BUFFER)


def _read(batches):
    """buffer, documents, their columns and the tokens of each buffer."""
    for batch in chunks(batches, 1):
        for buffer, documents, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            distinct, at = _unpacked(blob, "i8 u4")
            yield buffer, documents, _unpacked(documents, DOCUMENTS), distinct[at]


def _counted(buffers: DataFrame) -> DataFrame:
    """(w, c): tokens of the training documents."""

    def each(batches):
        for _, _, (_, _, out, n), w in _read(batches):
            w, c = np.unique(w[np.repeat(~out, n)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(c.astype(np.int64))], ["w", "c"])

    return buffers.mapInArrow(each, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def unigrams(buffers: DataFrame) -> tuple[DataFrame, Unigrams]:
    table, _ = written(_counted(buffers), "unigrams")
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    of = {r["c"]: r["n"] for r in table.filter(F.col("c") <= K + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
    d, parts = discounts(of), max(1, -(-total // TASK_TOKENS))
    # at most total / HOT_TOKENS words, 8 bytes for a million tokens
    hot = {r["w"]: r["c"] for r in table.filter(F.col("c") > HOT_TOKENS).collect()}
    hot[START] = 0
    kept = LARGE * (total - sum(c * n for c, n in of.items() if c <= K)) + sum(c * n * d[c] for c, n in of.items() if c <= K)
    unknown = 1 - kept / total if total else 1.0
    return table, Unigrams(total, distinct, d, hot, unknown, parts)


#: documents: of the whole buffer, in one of its rows alone
DEALT = "part int, buffer long, blob binary, documents binary"
#: of each token of a buffer's documents: place of the document, counts of the bigram and of the word
SEEN = "u2 p8 p8"
#: kind 0: SEEN of buffer a; 1: the model, contexts with counts and unigram counts of their
#: words, which stand in words; 2: held-out occurrences; 3: sums of a hot
#: context; 4: counts of counts; 5: DOCUMENTS of buffer a
FOUND = "kind int, part int, blob binary, a long, sums array<double>, words binary"


def _dealt(buffers: DataFrame, u: Unigrams, turn: int, rounds: int) -> DataFrame:
    """Occurrences by word, in columns."""

    def each(batches):
        for buffer, documents, (_, _, out, n), w in _read(batches):
            n = n.astype(np.int64)
            doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
            h = np.empty_like(w)
            h[1:] = w[:-1]
            h[np.cumsum(n) - n] = START
            part = u.part(w, h)
            mine = np.flatnonzero(part % rounds == turn)
            mine = mine[np.lexsort((w[mine], part[mine]))]
            ends = np.flatnonzero(np.append(part[mine][1:] != part[mine][:-1], len(mine) > 0)) + 1
            least, names, blobs = int(part.min()), [], []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                at = mine[a:b]
                ws, runs = np.unique(w[at], return_counts=True)
                ds, local = np.unique(doc[at], return_inverse=True)
                names.append(int(part[at[0]]))
                blobs.append(_packed(ws, runs.astype(np.uint32), h[at], local.astype(np.uint16), ds, out[ds]))
            columns = [pa.array(names, pa.int32()), pa.array([buffer] * len(names), pa.int64()), pa.array(blobs, pa.binary()), pa.array([documents if k == least else None for k in names], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "buffer", "blob", "documents"])

    return buffers.mapInArrow(each, DEALT)


def _weighed(dealt: DataFrame, table: DataFrame, u: Unigrams) -> DataFrame:
    """Bigram counts, documents' sums and held-out occurrences of each part of words."""

    def fold(key: tuple, blobs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        rows += [(5, 0, documents, buffer, None, None) for buffer, documents in zip(blobs.buffer.tolist(), blobs.documents, strict=True) if documents is not None]
        got = [_unpacked(b, "i8 u4 i8 u2 u2 ?") for b in blobs.blob]
        if got:
            place = np.concatenate([g[4] for g in got])
            buffer = np.repeat(blobs.buffer.to_numpy(np.int64), [len(g[4]) for g in got])
            outs = np.concatenate([g[5] for g in got])
            base = np.cumsum([0, *(len(g[4]) for g in got)])
            w = np.concatenate([np.repeat(g[0], g[1]) for g in got])
            h = np.concatenate([g[2] for g in got])
            doc = np.concatenate([g[3].astype(np.int32) + b for g, b in zip(got, base[:-1], strict=True)])
            del got
            order = np.lexsort((h, w))
            w, h, doc = w[order], h[order], doc[order]
            del order
            new = np.append(True, (w[1:] != w[:-1]) | (h[1:] != h[:-1]))
            gram = (np.cumsum(new) - 1).astype(np.int32)
            gw, gh = w[new], h[new]
            hot = np.fromiter(u.hot, np.int64, len(u.hot))
            names, many = np.concatenate([counts.w.to_numpy(np.int64), hot]), np.concatenate([counts.c.to_numpy(np.int64), np.fromiter(u.hot.values(), np.int64, len(hot))])
            order = np.argsort(names, kind="stable")
            names, many = names[order], many[order]
            at = np.minimum(np.searchsorted(names, gw), len(names) - 1)
            gcw = np.where(names[at] == gw, many[at], 0)
            learn = ~outs[doc]
            c = np.bincount(gram[learn], minlength=len(gw))
            seen = np.flatnonzero(c)
            rows.append((4, 0, None, 0, [float((c == k).sum()) for k in range(1, K + 2)], None))
            # what documents add up: each token's counts, as the discounts of bigrams aren't known yet
            mine, cw = c[gram], gcw[gram]
            from_buffer = buffer[doc]
            order = np.lexsort((place[doc], from_buffer))
            ends = np.flatnonzero(np.append(from_buffer[order][1:] != from_buffer[order][:-1], True)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                at = order[a:b]
                rows.append((0, 0, _packed(place[doc[at]], _planes(mine[at]), _planes(cw[at])), int(from_buffer[at[0]]), None, None))
            del from_buffer, order
            # the model, by context
            to = u.part(gh[seen], gw[seen])
            for p in np.unique(to).tolist():
                at = seen[to == p]
                at = at[np.argsort(gh[at], kind="stable")]
                hp, runs = np.unique(gh[at], return_counts=True)
                rows.append((1, p, _packed(hp, runs.astype(np.uint32), _planes(c[at]), _planes(gcw[at])), 0, None, _packed(gw[at])))
            at = seen[np.isin(gh[seen], hot)]
            which, of = np.unique(gh[at], return_inverse=True)
            add = lambda x: np.bincount(of, weights=x, minlength=len(which))
            sums = np.stack([*(add(c[at] == k) for k in range(1, K + 1)), add(np.where(c[at] > K, c[at], 0)), add(u.p(gcw[at])), add(c[at])], axis=1)
            rows += [(3, 0, None, int(one), x.tolist(), None) for one, x in zip(which, sums, strict=True)]
            test = np.flatnonzero(~learn)
            to = u.part(h[test], w[test])
            for p in np.unique(to).tolist():
                at = test[to == p]
                ds, local = np.unique(doc[at], return_inverse=True)
                rows.append((2, p, _packed(h[at], _planes(mine[at]), _planes(cw[at]), local.astype(np.uint32), buffer[ds], place[ds]), 0, None, None))
        return pd.DataFrame(rows, columns=["kind", "part", "blob", "a", "sums", "words"])

    mine = table.filter(F.col("c") <= HOT_TOKENS).withColumn("part", F.pmod("w", F.lit(u.parts)).cast("int"))
    return dealt.groupBy("part").cogroup(mine.groupBy("part")).applyInPandas(fold, FOUND)


#: kind 1: a context of the model; 2: what held-out occurrences add to the documents of buffer a, by place
WEIGHED = "kind int, bucket int, context long, n long, backoff double, words array<long>, counts array<long>, a long, late binary"
_WEIGHED = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int32()), ("context", pa.int64()), ("n", pa.int64()), ("backoff", pa.float64())]
    + [("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("a", pa.int64()), ("late", pa.binary())]
)


def _backed_off(found: DataFrame, u: Unigrams, d: np.ndarray, hot: dict[int, tuple[float, float]]) -> DataFrame:
    """WEIGHED rows of each part of contexts. A hot context has a row in many parts, each
    with some of its words and with the count and weight of all."""

    def fold(pdf: pa.Table) -> pa.Table:
        kind, blobs, names_ = pdf["kind"].to_pylist(), pdf["blob"].to_pylist(), pdf["words"].to_pylist()
        part = pdf["part"][0].as_py() if pdf.num_rows else 0
        got = [(_unpacked(b, "i8 u4 p8 p8"), _unpacked(w, "i8")[0]) for k, b, w in zip(kind, blobs, names_, strict=True) if k == 1]
        test = [_unpacked(b, "i8 p8 p8 u4 i8 u2") for k, b in zip(kind, blobs, strict=True) if k == 2]
        del pdf, blobs, names_
        names, c_h, alpha, out = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), []
        if got:
            mh, mc, mw, mn = np.concatenate([np.repeat(m[0], m[1]) for m, _ in got]), np.concatenate([m[2] for m, _ in got]), np.concatenate([m[3] for m, _ in got]), np.concatenate([w for _, w in got])
            del got
            order = np.argsort(mh, kind="stable")
            mh, mc, mw, mn = mh[order], mc[order], mw[order], mn[order]
            first = np.flatnonzero(np.append(True, mh[1:] != mh[:-1]))
            names = mh[first]
            c_h, kept, below = (np.add.reduceat(x, first).astype(float) for x in (mc, discounted(mc, d), u.p(mw)))
            alpha = weight(kept / c_h, below)
            for one, (many, a) in hot.items():
                k = np.searchsorted(names, one)
                if k < len(names) and names[k] == one:
                    c_h[k], alpha[k] = many, a
            ends = pa.array(np.append(first, len(mh)).astype(np.int32))
            n = len(names)
            lists = [pa.ListArray.from_arrays(ends, pa.array(mn)), pa.ListArray.from_arrays(ends, pa.array(mc))]
            out.append(pa.Table.from_arrays([pa.array(np.full(n, 1, np.int32)), pa.array(np.full(n, part % BUCKETS, np.int32)), pa.array(names), pa.array(c_h.astype(np.int64)), pa.array(alpha), *lists, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_WEIGHED))
        if test:
            base = np.cumsum([0, *(len(t[4]) for t in test)])
            h, mine, cw = (np.concatenate([t[k] for t in test]) for k in range(3))
            doc = np.concatenate([t[3] + b for t, b in zip(test, base[:-1], strict=True)]).astype(np.int64)
            buffer, place = (np.concatenate([t[k] for t in test]) for k in (4, 5))
            names, at = np.unique(np.concatenate([names, np.fromiter(hot, np.int64, len(hot))]), return_index=True)
            c_h = np.concatenate([c_h, [many for many, _ in hot.values()]])[at]
            alpha = np.concatenate([alpha, [a for _, a in hot.values()]])[at]
            k = np.minimum(np.searchsorted(names, h), max(0, len(names) - 1))
            there = names[k] == h if len(names) else np.zeros(len(h), bool)
            many, a = (np.where(there, x[k], 1.0) if len(names) else np.ones(len(h)) for x in (c_h, alpha))
            p = np.where(mine > 0, discounted(mine, d) / many, a * u.p(cw))
            late = np.bincount(doc, weights=np.log10(p), minlength=len(buffer))
            order = np.lexsort((place, buffer))  # a document comes from many parts of words
            buffer, place, late = buffer[order], place[order], late[order]
            first = np.flatnonzero(np.append(True, (buffer[1:] != buffer[:-1]) | (place[1:] != place[:-1])))
            late, buffer, place = np.add.reduceat(late, first), buffer[first], place[first]
            ends = np.flatnonzero(np.append(buffer[1:] != buffer[:-1], True)) + 1
            spans = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
            n = len(spans)
            none = [pa.nulls(n, _WEIGHED.field(k).type) for k in range(2, 7)]
            out.append(pa.Table.from_arrays([pa.array(np.full(n, 2, np.int32)), pa.array(np.zeros(n, np.int32)), *none, pa.array([int(buffer[x]) for x, _ in spans], pa.int64()), pa.array([_packed(place[x:y], late[x:y]) for x, y in spans], pa.binary())], schema=_WEIGHED))
        return pa.concat_tables(out) if out else _WEIGHED.empty_table()

    return found.filter("kind in (1, 2)").select("kind", "part", "blob", "words").groupBy("part").applyInArrow(fold, WEIGHED)


def _documents(found: DataFrame, extra: DataFrame, d: np.ndarray, log_ends: float) -> DataFrame:
    """A row for every document of a buffer, with the sums of all parts. log_ends is the
    logarithm of the count of ends: a document has one, which is no context."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, there, out, n = _unpacked(pdf.blob[pdf.kind == 5].iloc[0], DOCUMENTS)
        known, base, seen, late = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
        for blob in pdf.blob[pdf.kind == 0]:
            place, c, cw = _unpacked(blob, SEEN)
            add = lambda x, place=place: np.bincount(place, weights=x, minlength=len(ids))
            known += np.bincount(place[cw > 0], minlength=len(ids))
            base += add(np.log10(cw + 0.1))
            # a token's context is the word before it: counts of contexts are those of all words but the end
            seen += add(np.log10(np.where(c > 0, discounted(c, d), 1.0)) - np.log10(np.maximum(cw, 1)))
        seen += log_ends
        # a place is there once in each blob
        for blob in pdf.blob[pdf.kind == 6]:
            place, x = _unpacked(blob, "u2 f8")
            late[place] += x
        return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), ~there), "held_out": out, "n_tokens": n.astype(np.int64), "n_known": known, "base": base, "seen": seen, "late": late})

    rows = found.filter("kind in (0, 5)").select("kind", "a", "blob").unionByName(extra.select(F.lit(6).alias("kind"), "a", F.col("late").alias("blob")))
    return rows.groupBy("a").applyInPandas(fold, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, seen double, late double")


def weight(kept: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Backoff weights: what seen words leave of 1, over what they leave of the unigrams."""
    return np.maximum(1 - kept, 1e-300) / np.maximum(1 - below, 1e-300)


@dataclass
class Model:
    """A stored model: ``words`` (w, c), ``contexts`` (bucket, context, n, backoff, words,
    counts) below ``path``, and what is bounded of it."""

    words: DataFrame
    contexts: DataFrame
    path: str
    unigrams: Unigrams
    d: np.ndarray


def evaluate(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens and score of any texts by a stored model: of each token the
    bigram's discounted probability, else its context's backoff weight times the word's,
    else that of the unknown word. Null text is empty; repeated rows are rows of their
    own; null doc_ids are allowed; an empty table gives an empty result."""
    docs, _ = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "asked")

    def each(batches):
        only_memory("katz", _known.clear)
        for batch in chunks(batches, 200):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.append(tokens(text), END)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), row)), pa.array(np.append(START, w[:-1])), pa.array(w)], ["row", "context", "w"])

    u, d = model.unigrams, model.d
    occurrences, _ = written(docs.select("row", "text").mapInArrow(each, "row long, context long, w long"), "asked-tokens")
    total = u.total
    less = lambda c, factors: F.coalesce(F.get(F.array(*map(F.lit, factors[1:].tolist())), (c - 1).cast("int")), F.lit(LARGE)) * c
    known = keyed_join(occurrences, model.words, "w", "c", total, "left")
    contexts = model.contexts.groupBy("context").agg(F.max("n").alias("n"), F.max("backoff").alias("backoff"))
    weighed = keyed_join(known, contexts, "context", "n", total, "left")
    # a bigram is looked up by both its words, so no word or context is a hot key
    bigrams = model.contexts.select("context", F.explode(F.arrays_zip("words", "counts")).alias("b")).select("context", F.col("b.words").alias("w"), F.col("b.counts").alias("both"))
    rows = weighed.join(bigrams, ["context", "w"], "left")
    one = F.when(F.col("c").isNotNull(), less(F.col("c"), u.d) / max(1, total)).otherwise(F.lit(float(u.unknown)))
    p = F.when(F.col("both").isNotNull(), less(F.col("both"), d) / F.col("n")).otherwise(F.coalesce("backoff", F.lit(1.0)) * one)
    sums = rows.groupBy("row").agg(F.count("*").alias("n_tokens"), F.sum(F.log10(p)).alias("score"))
    return docs.select("row", "doc_id").join(sums, "row").select("doc_id", "n_tokens", "score")


def scored(docs: DataFrame, held_out: Column, rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """What ``scores`` says, and the model learned from rows that aren't held out."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    buffers, buffers_at = written(_tokenised(docs), "tokens", "uncompressed")
    table, u = unigrams(buffers)
    free_shuffles(spark)
    paths, rounds = [], min(rounds, u.parts)
    for turn in range(rounds):
        paths.append(new_path(spark, "katz"))
        share = F.when(F.col("kind").isin(1, 2), F.col("part") % SHARES).otherwise(-1)
        _weighed(_dealt(buffers, u, turn, rounds), table.filter(F.pmod("w", F.lit(u.parts)) % rounds == turn), u).withColumn("share", share).write.option("compression", "uncompressed").partitionBy("share").parquet(paths[-1])
        free_shuffles(spark)
    dropped(spark, buffers_at)
    shares = [spark.read.schema(FOUND + ", share int").parquet(p) for p in paths]
    found = reduce(DataFrame.unionByName, shares)
    of = [0.0] * (K + 1)
    for r in found.filter("kind = 4").select("sums").toLocalIterator():  # a row for each part
        of = [x + y for x, y in zip(of, r["sums"], strict=True)]
    d = discounts({k + 1: int(n) for k, n in enumerate(of)})
    sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(K + 3)]
    hot = {}
    for r in found.filter("kind = 3").groupBy("a").agg(*sums).collect():  # at most one for each hot word
        kept = sum(r[f"s{k}"] * (k + 1) * d[k + 1] for k in range(K)) + LARGE * r[f"s{K}"]
        hot[r["a"]] = (r[f"s{K + 2}"], float(weight(np.array([kept / r[f"s{K + 2}"]]), np.array([r[f"s{K + 1}"]]))[0]))
    path = new_path(spark, "ngrams")
    for k in range(SHARES):
        _backed_off(found.filter(F.col("share") == k), u, d, hot).write.mode("append").option("compression", "zstd").partitionBy("kind", "bucket").parquet(path)
        dropped(spark, *(f"{p}/share={k}" for p in paths))
        free_shuffles(spark)
    found = reduce(DataFrame.unionByName, (spark.read.schema(FOUND + ", share int").parquet(p) for p in paths))
    weighed = spark.read.schema(WEIGHED).parquet(path)
    model = Model(table, weighed.filter("kind = 1").select("bucket", "context", "n", "backoff", "words", "counts"), path, u, d)
    ends = (table.filter(F.col("w") == int(END)).agg(F.max("c")).first()[0]) or 1
    rows, _ = written(_documents(found, weighed.filter("kind = 2").select("a", "late"), d, float(np.log10(max(ends, 1)))), "katz-documents")
    dropped(spark, *paths)
    smooth = float(np.log10(u.total + 0.1 * (u.distinct + 1)))
    starts = hot.get(START, (1.0, 1.0))[0]
    score = F.when(F.col("held_out"), F.col("late")).otherwise(F.col("seen") - float(np.log10(max(starts, 1.0))))
    out = rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(u.total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * smooth).alias("base_score"), score.alias("score"),
    )
    return out, model


def scores(docs: DataFrame, held_out: Column, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from rows that are not held out. Tokens: words with A-Z lower-cased, then
    one end; null text is empty. base_score: add-0.1 unigrams with one unknown word;
    score: log10 of the model's probability. A word unknown in training counts as the
    unknown word, in any context. Without training rows base_score is that of N = V = 0
    and every token has probability 1. A long text is one buffer, whole. Repeated rows are
    rows of their own; null doc_ids are allowed; other columns are ignored, whatever their
    names; an empty table gives an empty result."""
    return scored(docs, held_out, rounds)[0]
