"""Benchmark passages in documents (operator 6).

Words are symbols. An item of n words is cut into one part more than the edits that are
allowed, so that a stretch within the edit distance holds one part whole: every place
of such a part in a document is a candidate, at the item's length and with the allowed
edits on either side. Those with too few words of the item go, and an exact computation
decides on the rest, so that no match is missed whatever the item's length.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, only_memory

#: Edits allowed for each word of an item: similarity 0.8 or more.
EDITS = 0.2
GRAM_BITS = 22
REMEMBERED_WORDS = 300_000
#: Characters of items that one pass over the documents holds.
PASS_CHARS = 8_000_000
_EDGES = b".,;:!?\"'()[]{}<>*#%$&-_"

MATCHES = "doc_id long, item_id long, start int, stop int, edits int, item_words int"


def symbols(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and without marks at their edges, where a letter is left."""
    return [w.strip(_EDGES) or w for w in text.encode("utf-8", "replace").lower().split()] if text else []


class _Ids(dict):
    """Item word numbers of raw words, 0 for words of no item."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        found = self.vocabulary.get(word.strip(_EDGES) or word, 0)
        if len(self) < REMEMBERED_WORDS:
            self[word] = found
        return found

    def of(self, text: str | None) -> list[int]:
        return list(map(self.__getitem__, text.encode("utf-8", "replace").lower().split())) if text else []


def infix_distance(item: list, text: list) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``: distance, start, stop."""
    row = [(0, j) for j in range(len(text) + 1)]
    for i, a in enumerate(item, 1):
        last, row = row, [(i, 0)]
        for j, b in enumerate(text, 1):
            row.append(min((last[j - 1][0] + (a != b), last[j - 1][1]), (last[j][0] + 1, last[j][1]), (row[j - 1][0] + 1, row[j - 1][1])))
    stop = min(range(len(row)), key=lambda j: (row[j][0], j))
    return row[stop][0], row[stop][1], stop


def least_distance(item: list, text: list) -> int:
    """The distance alone, by Myers' bit vectors: a bit for each word of the item."""
    m, peq = len(item), defaultdict(int)
    for i, a in enumerate(item):
        peq[a] |= 1 << i
    full, top, up, down, score = (1 << m) - 1, 1 << (m - 1), (1 << m) - 1, 0, m
    least = m
    for b in text:
        eq = peq.get(b, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(plus & top) - bool(minus & top)
        least = min(least, score)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
    return least


def _gram_buckets(ids: np.ndarray, g: int) -> np.ndarray:
    """Buckets of all runs of g words."""
    h, n = np.zeros(max(0, len(ids) - g + 1), np.uint32), len(ids) - g + 1
    for k in range(g):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + ids[k : k + n].astype(np.uint32)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - GRAM_BITS)


def _gram_keys(ids: np.ndarray, at: np.ndarray, g: int) -> np.ndarray:
    """One number for each of the runs of g words at some places."""
    key = np.zeros(len(at), np.uint64)
    for k in range(g):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64)
    return key


@dataclass
class Items:
    """Benchmark items, with the places of their parts by words."""

    ids: list[int]
    words: list[list[int]]
    vocabulary: dict[bytes, int]
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    #: by words of a part: sorted keys, and the item and place of each
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple[int, str | None]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        kept = [(i, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]) for i, t in rows if i is not None and (found := symbols(t))]
        out = Items([i for i, _ in kept], [w for _, w in kept], vocabulary)
        held: dict[int, list] = defaultdict(list)
        for k, w in enumerate(out.words):
            g, n_parts, ids = out.part(len(w)), out.allowed(len(w)) + 1, np.array(w, np.int32)
            at = np.arange(n_parts) * (len(w) // n_parts)
            out.grams.setdefault(g, np.zeros(1 << GRAM_BITS, bool))[_gram_buckets(ids, g)[at]] = True
            held[g].append((_gram_keys(ids, at, g), np.full(n_parts, k), at))
        for g, some in held.items():
            keys, items, at = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.argsort(keys, kind="stable")
            out.parts[g] = keys[order], items[order], at[order]
        return out

    def part(self, n: int) -> int:
        """Words, four at most, of the shorter of allowed + 1 equal parts of an item."""
        return min(4, n // (self.allowed(n) + 1))

    def allowed(self, n: int) -> int:
        return int(n * EDITS + 1e-9)

    def candidates(self, flat: np.ndarray, known: np.ndarray, edges: np.ndarray):
        """item, places where it may begin in order, and the document of each. A stretch
        within the distance ends at most the allowed edits away from such a place on
        either side, and the words of the item that it lacks are edits."""
        hits = []
        for g, (keys, items, offsets) in self.parts.items():
            at = np.flatnonzero(self.grams[g][_gram_buckets(flat, g)])
            found = _gram_keys(flat, at, g)
            low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            n = high - low
            one = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            at = np.repeat(at, n)
            hits.append((items[one], at - offsets[one], np.searchsorted(edges, at, "right") - 1))
        item, place, doc = (np.concatenate(x) for x in zip(*hits, strict=True))
        if not len(item):
            return
        order = np.lexsort((place, item))
        item, place, doc = item[order], place[order], doc[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1])
        item, place, doc = item[new], place[new], doc[new]
        cuts = np.flatnonzero(np.diff(item, prepend=-1))
        member = np.zeros(len(self.vocabulary) + 1, bool)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)], strict=True):
            k = int(item[a])
            n, most = len(self.words[k]), self.allowed(len(self.words[k]))
            p, d = place[a:b], doc[a:b]
            some = known[np.minimum(p + n + most, len(flat))] - known[np.maximum(p - most, 0)] >= n - most
            p, d = p[some], d[some]
            member[self.words[k]] = True
            step = max(1, 2_000_000 // (n + 2 * most))
            dense = [member[flat[np.clip(p[x : x + step, None] + np.arange(-most, n + most), 0, len(flat) - 1)]].sum(1) >= n - most for x in range(0, len(p), step)]
            member[self.words[k]] = False
            if dense and (good := np.concatenate(dense)).any():
                yield k, p[good], d[good]

    def matches(self, docs: list[list[int]]) -> list[tuple[int, int, int, int, int]]:
        """(place of the document, item, start, stop, edits) of all matches; of matches
        of an item that overlap, the nearest."""
        if not self.ids or not docs:
            return []
        gap = 2 * max(map(len, self.words)) + 8
        starts, at = [], gap
        for d in docs:
            starts.append(at)
            at += len(d) + gap
        flat = np.zeros(at, np.int32)
        for s, d in zip(starts, docs, strict=True):
            flat[s : s + len(d)] = d
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        out, edges = [], np.array(starts)
        for k, places, at_doc in self.candidates(flat, known, edges):
            item = self.words[k]
            n, most, until = len(item), self.allowed(len(item)), -1
            best: list[tuple[int, int, int, int, int]] = []
            for p, d in zip(places.tolist(), at_doc.tolist(), strict=True):
                if p + n // 2 < until and best and best[-1][4] == 0:
                    continue  # within an exact match already found
                a, b = max(starts[d], p - most), min(starts[d] + len(docs[d]), p + n + most)
                if b <= a:
                    continue
                text = flat[a:b].tolist()
                if least_distance(item, text) > most:
                    continue
                edits, x, y = infix_distance(item, text)
                got = (d, k, a + x - starts[d], a + y - starts[d], edits)
                if best and best[-1][0] == d and got[2] < best[-1][3]:
                    if edits < best[-1][4]:
                        best[-1] = got
                else:
                    best.append(got)
                until = starts[d] + best[-1][3]
            out += best
        return out


def _passes(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Items in lots of at most PASS_CHARS characters, each for a pass of its own, so
    that what is sent to the executors is bounded whatever the benchmark's size."""
    lots, size = [[]], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        if size and size + len(r["text"]) > PASS_CHARS:
            lots.append([])
            size = 0
        lots[-1].append((r["item_id"], r["text"]))
        size += len(r["text"])
    return lots


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, stop (places of words), edits, item_words: every stretch
    of a document within 0.2 word edits for each word of an item.

    Items of under five words must occur exactly; null and wordless items and texts
    match nothing; rows with a null doc_id are matched and keep it; repeated rows give
    repeated matches; overlapping matches of one item count once, the nearest, then
    the first; other columns are ignored."""
    spark, out = docs.sparkSession, None
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for lot in _passes(benchmark):
        held = spark.sparkContext.broadcast(Items.of(lot))  # bounded by PASS_CHARS

        def each(batches, held=held):
            only_memory("passages")
            items = held.value
            ids_of = _Ids(items.vocabulary).of
            for batch in chunks(batches, 4000):
                texts = [ids_of(t) for t in batch.column(1).to_pylist()]
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], items.ids[k], a, b, e, len(items.words[k])) for d, k, a, b, e in items.matches(texts)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["doc_id", "item_id", "start", "stop", "edits", "item_words"])

        part = docs.mapInArrow(each, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(held):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        of, found, texts = _Ids(held.value.vocabulary).of, set(), texts.tolist()
        for a in range(0, len(texts), 4000):
            found.update(a + m[0] for m in held.value.matches([of(t) for t in texts[a : a + 4000]]))
        return pd.Series([k not in found for k in range(len(texts))])

    return clean


def without_passages(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``rows`` in whose own text no item is found, decided row by row, without a key."""
    for lot in _passes(benchmark):
        held = rows.sparkSession.sparkContext.broadcast(Items.of(lot))  # bounded by PASS_CHARS

        rows = rows.filter(_clean(held)(F.col("text").cast("string")))
    return rows


def decontaminated(docs: DataFrame, benchmark: DataFrame, nameless: bool = False) -> DataFrame:
    """``docs`` without the rows in which a benchmark item is found. Rows with a null
    doc_id stay, or with ``nameless`` go by their own text."""
    found = find_passages(docs, benchmark).filter("doc_id is not null").select("doc_id").distinct()
    if not nameless:
        return docs.join(found.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    named = docs.filter("doc_id is not null").join(found.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    return named.unionByName(without_passages(docs.filter("doc_id is null"), benchmark))
