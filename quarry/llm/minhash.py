"""Near-duplicate documents by MinHash (operator 1).

Every document gets ``BANDS * ROWS`` minima of universal hashes over its shingles.
Documents with equal shingle sets become one representative. Representatives that
agree in a band meet in that band's bucket, where each is compared with the bucket's
hub alone, not with every other member: first by signature, then on full shingle sets.
Members that a hub doesn't hold are then compared among themselves and, if near
enough, with those that it holds, block by block, by signature and on full sets; pairs
that links found so far join are left out, so that no block gives more links than it has
members. Links are joined into components by large-star and small-star steps.

With 46 bands of 6 rows two documents of similarity 0.8 share a bucket with
probability 1 - (1 - 0.8**6)**46 > 1 - 1e-6.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, dropped, free_shuffles, keyed_join, only_memory, words, written
from quarry.llm.components import components

WORDS, PERCENT = 5, 80
BANDS, ROWS = 46, 6
SEED = 20_240_601
#: Signatures that agree in less than this part are of pairs under similarity 0.8
#: (six standard deviations under it, at 276 minima).
PART = 0.656
#: The same for similarity 0.6 (five): what a hub isn't linked to, but a member of its may be.
STAR_PART = 0.45
#: Members of a side of a cell and shingles of their sets, on average.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Pairs of a hub that meet one copy of its row, about.
PAIRS = 2000
REMEMBERED_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


_known = _Hashes()


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """The set of a text's n-word shingles as sorted 64-bit hashes; of fewer words the
    whole sequence is the one shingle; without words the set is empty."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(_known) > REMEMBERED_WORDS:
        _known.clear()
    w = np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[k : len(w) - n + 1 + k]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def universal(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms of n multiply-shift hashes a * x + b mod 2**32, universal in
    their upper bits, which decide which of a set's members is the least."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):
        h = np.multiply.outer(a, x[at : at + 512])
        h += b[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, n: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, print (of the whole set), sig (16 bits of each minimum) and bands."""

    def each(batches):
        only_memory("shingles", _known.clear)
        a, b = universal(bands * rows)
        for batch in chunks(batches, 500):
            out = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                s = shingle_hashes(text, n)
                m = minima(s, a, b)
                out[0].append(len(s))
                out[1].append(xxhash.xxh3_128_digest(s.tobytes()))
                out[2].append((m >> np.uint32(12)).astype("<u2").tobytes())
                out[3].append([xxhash.xxh3_64_intdigest(m[k * rows : (k + 1) * rows].tobytes(), seed=k) - (1 << 63) for k in range(bands)] if len(s) else [])
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n_shingles", "print", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, n_shingles long, print binary, sig binary, bands array<long>")


def _both(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """pairs (u, v, salts) with these columns of both ends, as u_<name> and v_<name>. An
    end u may be in very many pairs, so its row is given to ``salts`` tasks."""
    of = lambda side: rows.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))
    hubs = pairs.select("u", "salts").distinct().join(of("u"), "u").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = pairs.join(of("v"), "v").withColumn("salt", F.pmod(F.hash("v"), F.col("salts"))).drop("salts")
    return met.join(hubs, ["u", "salt"]).drop("salt")


def _agree(pairs: DataFrame, signed: DataFrame, part: float) -> DataFrame:
    """Signature verification: pairs (u, v, salts) whose minima agree in at least
    ``part``, and whose set sizes allow the similarity that part stands for."""
    both = _both(pairs.withColumn("s", F.col("salts")), signed, "sig", "n_shingles").filter((F.col("u_n_shingles") >= part * F.col("v_n_shingles")) & (F.col("v_n_shingles") >= part * F.col("u_n_shingles")))

    def each(batches):
        for batch in chunks(batches, 4096):
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (3, 4))
                keep = pa.array((a == b).mean(axis=1) >= part)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(3)], ["u", "v", "salts"])

    return both.select("u", "v", "s", "u_sig", "v_sig").mapInArrow(each, "u long, v long, salts int")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _confirmed(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """u, v, both (size of the intersection), either (of the union), on full sets."""
    both = _both(pairs, docs, "text").select("u", "v", "u_text", "v_text")

    def each(batches):
        only_memory("shingles", _known.clear)
        held = (None, None)
        for batch in chunks(batches, 500):
            rows = []
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held[0] != a:
                    held = (a, shingle_hashes(a, n))
                x, y = held[1], shingle_hashes(b, n)
                same = _shared(x, y)
                rows.append((u, v, same, len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["u", "v", "both", "either"])

    return both.mapInArrow(each, "u long, v long, both long, either long")


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets, confirmed on the full sets. component_id is the least doc_id that
    links reach, itself included; kept where that is the row's own. Null, empty and
    wordless texts have empty sets and no links. Rows with a null doc_id are in no
    component: component_id is null and kept is true. Rows with equal doc_ids are one
    node. A text of any length is one set, held whole by one task. An empty table gives
    an empty result; other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, _ = written(signatures(docs, n, bands, rows), "minhash")
    there = signed.filter("doc_id is not null and n_shingles > 0")
    total = there.count()
    alike, alike_at = written(there.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "alike")
    member, _ = written(keyed_join(there.select("doc_id", "print"), alike, "print", "n", total).filter("doc_id <> rep").select("doc_id", "rep").distinct(), "members")
    dropped(spark, alike_at)
    reps = there.join(member.select("doc_id"), "doc_id", "left_anti")
    single = reps.select(F.explode("bands").alias("key"), "doc_id")
    shared, shared_at = written(single.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    met, met_at = written(keyed_join(single, shared, "key", "n", total * bands).distinct(), "buckets")
    dropped(spark, shared_at)
    free_shuffles(spark)

    # a bucket's hub is the member that meets most others, most likely what the rest were copied from
    company = met.groupBy("doc_id").agg(F.sum("n").alias("company"))
    rank = F.max(F.struct("company", F.xxhash64("doc_id").alias("p"), F.col("doc_id").alias("hub")))
    hubs, hubs_at = written(met.join(company, "doc_id").groupBy("key").agg(rank.alias("h"), F.max("n").alias("n")).select("key", "n", "h.hub", "h.company"), "hubs")
    # a hub is in at most company / 2 pairs, fewer than PAIRS of which meet one copy of it
    salts = (F.col("company") / (bands * PAIRS) + 1).cast("int").alias("salts")
    starred, starred_at = written(keyed_join(met.select("key", "doc_id"), hubs, "key", "n", total * bands).filter("hub <> doc_id").select("key", "doc_id", "hub", salts), "stars")
    dropped(spark, met_at, hubs_at)
    pairs = starred.select(F.col("hub").alias("u"), F.col("doc_id").alias("v"), "salts").distinct()
    tested, _ = written(_confirmed(_agree(pairs, signed, STAR_PART), docs, n), "confirmed")
    good = F.col("both") * 100 >= F.col("either") * percent
    edges = tested.filter(good).select("u", "v")
    found, found_at = components(edges)

    # what a hub doesn't settle: members it doesn't hold, among themselves and against those it holds
    held = edges.select(F.col("u").alias("hub"), F.col("v").alias("doc_id"))
    open_ = starred.join(held, ["hub", "doc_id"], "left_anti").select(F.col("key").alias("group"), "doc_id")
    same = open_.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.hash("doc_id")).alias("a"), F.bit_xor(F.xxhash64("doc_id")).alias("b")).filter("n > 1")
    only, only_at = written(same.groupBy("n", "a", "b").agg(F.min("group").alias("group")).select("group", "n"), "groups")
    open_, open_at = written(keyed_join(open_, only, "group", "n", total * bands).select("group", "doc_id"), "open")
    dropped(spark, only_at, starred_at)
    far, d = 1 - percent / 100, 1 - F.col("both") / F.col("either")
    stars = tested.withColumn("d", d).select(F.col("u").alias("group"), F.col("v").alias("doc_id"), "d", good.alias("good"))
    near = stars.filter(~F.col("good") & (F.col("d") <= 2 * far + 1e-9))
    cells = Cells(signed, docs, n, percent)
    late, _ = written(cells.links(open_, open_, found, F.col("i") == F.col("j")).unionByName(cells.links(near, stars.filter("good"), found)).distinct(), "late")
    if not late.isEmpty():
        edges = edges.unionByName(late)
        dropped(spark, found_at)
        found, found_at = components(edges)
    if not open_.groupBy("group").count().filter(F.col("count") > BLOCK).isEmpty() or cells.heavy(open_):
        # blocks of one group with each other, once what joins them by now is known
        later, _ = written(cells.links(open_, open_, found, F.col("i") < F.col("j")).distinct(), "later")
        if not later.isEmpty():
            dropped(spark, found_at)
            found, found_at = components(edges.unionByName(later))
    dropped(spark, open_at)
    to = signed.select("doc_id", "n_shingles").join(member, "doc_id", "left").withColumn("node", F.coalesce("rep", "doc_id")).join(found, "node", "left")
    least = F.coalesce("component", "node")
    return to.select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))


class Cells:
    """Links of the members of groups that no component joins yet, block by block."""

    def __init__(self, signed: DataFrame, docs: DataFrame, n: int, percent: int):
        self.signed, self.docs, self.n, self.percent = signed.filter("doc_id is not null").select("doc_id", "n_shingles", "sig"), docs.filter("doc_id is not null"), n, percent

    def _blocks(self, side: DataFrame, name: str, *more) -> DataFrame:
        """Blocks that the members of each group are dealt into, by number and by size of their sets."""
        sized = side.join(self.signed.select("doc_id", "n_shingles"), "doc_id")
        n = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
        return sized.groupBy("group").agg(n.alias(name), F.count("*").alias(f"{name}_rows"), *more)

    def heavy(self, side: DataFrame) -> bool:
        return not self._blocks(side, "n").filter("n > 1").isEmpty()

    def links(self, left: DataFrame, right: DataFrame, found: DataFrame, which=None) -> DataFrame:
        """Links (u, v) of the left with the right members (group, doc_id), confirmed on
        full sets. A task holds one block of either side, whatever a group's size, and
        gives no more links than it has members: once two components are linked, their
        other pairs are left out. ``which`` picks blocks i of the left and j of the right."""
        joined = found.select(F.col("node").alias("doc_id"), "component")
        of = lambda side: side.select("group", "doc_id").join(joined, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        left, right = of(left), of(right)
        ends = lambda name: (F.min("component").alias(f"a_{name}"), F.max("component").alias(f"b_{name}"))
        sizes = self._blocks(left, "n_left", *ends("l")).join(self._blocks(right, "n_right", *ends("r")), "group")
        sizes, _ = written(sizes.filter("a_l <> b_l or a_r <> b_r or a_l <> a_r").drop("a_l", "b_l", "a_r", "b_r"), "sizes")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block = lambda n: F.pmod(F.hash("doc_id"), F.col(n))
        dealt = lambda side, name: keyed_join(side, sizes, "group", f"{name}_rows", side.count())
        a = dealt(left, "n_left").select("group", block("n_left").alias("i"), every("n_right").alias("j"), "doc_id", "component", F.lit(True).alias("is_left"))
        b = dealt(right, "n_right").select("group", every("n_left").alias("i"), block("n_right").alias("j"), "doc_id", "component", F.lit(False).alias("is_left"))
        rows = a.unionByName(b)
        rows = (rows if which is None else rows.filter(which)).join(self.signed, "doc_id").join(self.docs, "doc_id")
        n, percent = self.n, self.percent

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y, out = pdf[pdf.is_left], pdf[~pdf.is_left], []
            if len(x) and len(y):
                sig = lambda side: np.frombuffer(b"".join(side.sig), "<u2").reshape(len(side), -1)
                sx, sy, cx, cy = sig(x), sig(y), x.component.to_numpy().copy(), y.component.to_numpy().copy()
                nx, ny, ix, iy = x.n_shingles.to_numpy(), y.n_shingles.to_numpy(), x.doc_id.to_numpy(), y.doc_id.to_numpy()
                tx, ty, sets = x.text.to_numpy(), y.text.to_numpy(), {}

                def of(text: str) -> np.ndarray:
                    if text not in sets:
                        sets[text] = shingle_hashes(text, n)
                    return sets[text]

                for k in range(len(x)):
                    at = np.flatnonzero((cy != cx[k]) & (ny * 100 >= percent * nx[k]) & (nx[k] * 100 >= percent * ny))
                    if not len(at):
                        continue
                    agree = (sy[at] == sx[k]).mean(axis=1)
                    for j in at[np.argsort(-agree, kind="stable")][: (agree >= PART).sum()].tolist():
                        if cy[j] == cx[k]:
                            continue
                        p, q = of(tx[k]), of(ty[j])
                        both = _shared(p, q)
                        if both * 100 >= percent * (len(p) + len(q) - both):
                            out.append((min(ix[k], iy[j]), max(ix[k], iy[j])))
                            old, new = cy[j], cx[k]
                            cx[cx == old] = new
                            cy[cy == old] = new
            return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

        return rows.groupBy("group", "i", "j").applyInPandas(compare, "u long, v long")


def deduplicated(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows of near-duplicates other than each component's first.
    Rows with a null doc_id stay, as do null, empty and wordless texts and all rows of a
    doc_id that is kept; texts are compared whole at any length; columns stay as they are,
    whatever their names; an empty table stays empty."""
    gone = near_duplicates(docs, n, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
