"""Exact inner-product top-k by ball trees (operator 9).

Rows are dealt by hash into shards of about ``SHARD`` vectors, and over each a ball tree
is built once and stored with it. Blocks of queries go to the shards. For each query the
nodes of a tree are opened by their upper bound of the inner product, centre times query
plus radius times the query's norm, until the bound can't beat the query's kth score so
far. That score is shared: each query first searches one shard, the kth score found there
goes with it to a second lot of shards, and what these find to the rest, so that shards
return only what can still be among the k.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.common import dropped, written

SHARD, LEAF, BLOCK = 8192, 128, 512


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): components x as floor(scale * x), x as double. Rows whose id or
    vector is null, or that hold null or non-finite components, take no part."""
    x = F.col("embedding").cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("_x")).filter("vec_id is not null and _x is not null")
    whole = F.forall(F.col("_x"), lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return kept.filter(whole).select("vec_id", F.transform("_x", lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def matrix(vectors: list, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with 0, which no inner product sees."""
    width = max([len(v) for v in vectors], default=0) if width is None else width
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def build_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Order of the rows, nodes (start, stop, left, right; -1 at leaves), centres, radii."""
    order, nodes, centres, radii = np.arange(len(x)), [], [], []

    def grow(a: int, b: int) -> int:
        part = x[order[a:b]].astype(np.float64)
        centre = part.mean(axis=0)
        apart = np.linalg.norm(part - centre, axis=1)
        me = len(nodes)
        nodes.append((a, b, -1, -1))
        centres.append(centre)
        radii.append(apart.max())
        if b - a > leaf and radii[me] > 0:
            one = part[apart.argmax()]
            other = part[np.linalg.norm(part - one, axis=1).argmax()]
            along = np.argsort(part @ (other - one), kind="stable")
            order[a:b] = order[a:b][along]
            mid = (a + b) // 2
            left = grow(a, mid)
            nodes[me] = (a, b, left, grow(mid, b))
        return me

    if len(x):
        grow(0, len(x))
    return order, nodes, np.array(centres).reshape(len(nodes), x.shape[1]), np.array(radii)


def _exact(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether all products of these integers, and their sums, are exact in doubles."""
    most = lambda a: float(np.abs(a.astype(np.float64)).max(initial=0))
    return most(x) * most(q) * max(1, x.shape[1]) < 2**52


class Tree:
    """A shard: row numbers, ids and vectors in the tree's order, nodes, centres, radii."""

    def __init__(self, rows, ids, x, nodes, centres, radii):
        self.rows, self.ids, self.x, self.nodes, self.centres, self.radii = rows, ids, x, nodes, centres, radii

    @staticmethod
    def of(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Tree:
        order, nodes, centres, radii = build_tree(x)
        return Tree(rows[order], ids[order], x[order], nodes, centres, radii)

    def search(self, rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """The best (score, -vec_id) of each query in this shard, k at most, that reach its
        ``least`` score; the query's own row is left out."""
        out: list[list[tuple[int, int]]] = []
        if not self.nodes or not len(queries):
            return [[] for _ in queries]
        exact = _exact(self.x, queries)
        x, q = (self.x.astype(np.float64), queries.astype(np.float64)) if exact else (self.x.astype(object), queries.astype(object))
        f = queries.astype(np.float64)
        bounds = f @ self.centres.T + np.linalg.norm(f, axis=1)[:, None] * self.radii
        bounds += 1e-6 * (1 + np.abs(bounds))
        for i, own in enumerate(rows.tolist()):
            bound, vector, floor, heap = bounds[i].tolist(), q[i], least[i], []
            open_ = [(-bound[0], 0)]
            while open_:
                most, node = heapq.heappop(open_)
                need = max(floor, heap[0][0]) if len(heap) == k else floor
                if -most < need:  # ties may still win by a smaller id
                    break
                a, b, left, right = self.nodes[node]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= need:
                            heapq.heappush(open_, (-bound[child], child))
                    continue
                scores = x[a:b] @ vector
                at = np.flatnonzero(scores >= need)
                for s, v, row in zip(scores[at].tolist(), self.ids[a:b][at].tolist(), self.rows[a:b][at].tolist(), strict=True):
                    if row == own:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, (int(s), -v))
                    elif (int(s), -v) > heap[0]:
                        heapq.heapreplace(heap, (int(s), -v))
            out.append(heap)
        return out


def _small(x: np.ndarray) -> bytes:
    """A matrix in the narrowest integers that hold it, and their kind before it."""
    most = int(np.abs(x).max(initial=0)) if x.size else 0
    kind = "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind.encode() + x.astype(kind).tobytes()


def _large(blob: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(blob, blob[:3].decode(), offset=3).reshape(n, width).astype(np.int64)


TREES = "shard int, n int, width int, rows binary, ids binary, x binary, nodes binary, centres binary, radii binary"
ASKED = "block int, n int, width int, rows binary, ids binary, x binary"


def _trees(rows: DataFrame) -> DataFrame:
    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"], kind="stable")
        t = Tree.of(pdf["row"].to_numpy("int64"), pdf["vec_id"].to_numpy("int64"), matrix(pdf["v"].tolist()))
        parts = (t.rows.tobytes(), t.ids.tobytes(), _small(t.x), np.array(t.nodes, np.int64).tobytes(), t.centres.tobytes(), t.radii.tobytes())
        return pd.DataFrame([(int(key[0]), len(t.ids), t.x.shape[1], *parts)], columns=[c.split()[0] for c in TREES.split(", ")])

    return rows.groupBy("shard").applyInPandas(fold, TREES)


def _tree(row) -> Tree:
    nodes = [tuple(x) for x in np.frombuffer(row.nodes, np.int64).reshape(-1, 4).tolist()]
    centres = np.frombuffer(row.centres, np.float64).reshape(len(nodes), row.width)
    return Tree(np.frombuffer(row.rows, np.int64), np.frombuffer(row.ids, np.int64), _large(row.x, row.width, row.n), nodes, centres, np.frombuffer(row.radii, np.float64))


def _blocks(rows: DataFrame) -> DataFrame:
    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        x = matrix(pdf["v"].tolist())
        return pd.DataFrame([(int(key[0]), len(pdf), x.shape[1], pdf["row"].to_numpy("int64").tobytes(), pdf["vec_id"].to_numpy("int64").tobytes(), _small(x))], columns=[c.split()[0] for c in ASKED.split(", ")])

    return rows.groupBy("block").applyInPandas(fold, ASKED)


FOUND = "block int, query_row long, query_id long, vec_id long, score long"


def _walk(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """What blocks of queries (ASKED, least: their kth scores so far, shard) find in their shards."""

    def fold(key: tuple, shard: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for held in shard.itertuples(index=False):
            tree = _tree(held)
            for row in blocks.itertuples(index=False):
                rows, ids, q = np.frombuffer(row.rows, np.int64), np.frombuffer(row.ids, np.int64), _large(row.x, row.width, row.n)
                least = np.full(row.n, -np.inf) if row.least is None else np.frombuffer(row.least, np.float64)
                width = max(tree.x.shape[1], q.shape[1])
                wide = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))
                t = tree if tree.x.shape[1] == width else Tree(tree.rows, tree.ids, wide(tree.x), tree.nodes, wide(tree.centres), tree.radii)
                for r, i, heap in zip(rows.tolist(), ids.tolist(), t.search(rows, wide(q), least, k), strict=True):
                    out += [(row.block, r, i, -v, s) for s, v in heap]
        return pd.DataFrame(out, columns=["block", "query_row", "query_id", "vec_id", "score"]).astype("int64")

    return trees.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(fold, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _with_least(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Blocks with the kth score that each of their queries has reached; -inf without k."""

    def fold(key: tuple, block: pd.DataFrame, kth: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=[c.split()[0] for c in f"{ASKED}, least binary".split(", ")])
        rows = np.frombuffer(block["rows"].iloc[0], np.int64)
        held = dict(zip(kth["query_row"], kth["score"], strict=True))
        # a double under the score, as integers beyond 2**53 aren't doubles
        least = np.array([np.nextafter(float(held[r]), -np.inf) if r in held else -np.inf for r in rows.tolist()])
        return block.assign(least=[least.tobytes()])

    kth = found.filter(F.col("rank") == k).select("block", "query_row", "score")
    return asked.groupBy("block").cogroup(kth.groupBy("block")).applyInPandas(fold, f"{ASKED}, least binary")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query.

    vectors: (vec_id, v array of long), as of ``integer_vectors``; ``is_query`` picks
    the queries. Every row but the query's own is a candidate; equal scores go to the
    smaller vec_id; with fewer than k candidates all are returned. Vectors of unequal
    length are filled with 0. Rows that repeat a vec_id are candidates each, a repeated
    query is answered for each row, and other rows of its id are candidates of it. Scores
    are whole numbers of any size, exact as long as they fit a long. An empty table gives
    an empty result; other columns are ignored. What moves grows with queries times
    shards, a row of ``block`` queries each; no product of rows with rows is made."""
    spark = vectors.sparkSession
    vectors, at = written(vectors.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, m = vectors.count(), vectors.filter(is_query).count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    trees, trees_at = written(_trees(vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))), "trees")
    asked, asked_at = written(_blocks(vectors.filter(is_query).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))), "asked")
    dropped(spark, at)
    first = F.pmod("block", F.lit(shards))
    found, found_at = None, []
    # shards of each lot by their distance from the block's first; three lots at most
    for low, high in dict.fromkeys([(0, 1), (1, min(shards, 1 + shards // 8)), (min(shards, 1 + shards // 8), shards)]):
        if low >= high:
            continue
        now = asked.withColumn("least", F.lit(None).cast("binary")) if found is None else _with_least(asked, found, k)
        sent = now.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).withColumn("shard", F.pmod(F.col("shard") + first, F.lit(shards)).cast("int"))
        got = _walk(trees, sent, k)
        if found is not None:
            got = got.unionByName(found.drop("rank"))
        found, path = written(_best(got, k), "found")
        found_at.append(path)
    dropped(spark, trees_at, asked_at, *found_at[:-1])
    return found.select("query_id", "rank", "vec_id", "score")
