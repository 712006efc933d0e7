"""Token-id blocks: best-fit-decreasing packing with a segment tree, and the packed
id matrix as a binary table (operator 5).

A task packs the documents of its own partition, buffer by buffer, so token ids never
pass a shuffle; only bins that are left underfull are dealt anew, by hash, and packed
with those of other tasks. Each row of the written table is one row of the id matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import chunks, dropped, new_path
from quarry.llm.tokens import END_ID, MAX_TOKENS, default_tokenizer, tokenizer_of

#: Tokens that a task holds at once.
BUFFER_TOKENS = 1 << 22
#: Bins with a larger part of the capacity free are packed again with others.
SLACK = 1 / 64
PAD_ID = 0

BLOCKS = (
    "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<int>, "
    "cu_seqlens array<int>, position_resets array<int>, ids binary"
)
_ARROW = pa.schema(
    [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))]
    + [("lengths", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary())]
)


class Rooms:
    """A segment tree over free space: leaf r counts the open bins with r tokens free."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The bin with the least free space of at least ``least``, removed."""
        count, node = self.count, least + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up until a right neighbour holds a bin
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices, the longest pieces first, each into the tightest open bin."""
    rooms, bins = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            bins.append([])
            found = capacity, len(bins) - 1
        room, b = found
        bins[b].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], b)
    return bins


def _rows(pieces: list[tuple], capacity: int, first_id: int, dtype: str) -> pa.RecordBatch:
    """Blocks of pieces (doc_id, piece, start, ids)."""
    rows = []
    for n, members in enumerate(best_fit_decreasing([len(p[3]) for p in pieces], capacity)):
        lengths = [len(pieces[i][3]) for i in members]
        ends = np.cumsum(lengths).tolist()
        row = np.full(capacity, PAD_ID, dtype=dtype)
        row[: ends[-1]] = np.concatenate([pieces[i][3] for i in members])
        rows.append((first_id + n, ends[-1], [pieces[i][0] for i in members], [pieces[i][1] for i in members], [pieces[i][2] for i in members], lengths, [0, *ends], [0, *ends[:-1]], row.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


def segments(row, dtype: str) -> list[tuple]:
    """The pieces (doc_id, piece, start, ids) of a block."""
    ids = np.frombuffer(row["ids"], dtype=dtype)
    return [(d, p, s, ids[a : a + n]) for d, p, s, n, a in zip(row["doc_ids"], row["pieces"], row["starts"], row["lengths"], row["position_resets"], strict=True)]


def pack_blocks(docs: DataFrame, path: str | None = None, capacity: int = MAX_TOKENS, end_id: int = END_ID, shard_blocks: int = 1024) -> tuple[DataFrame, str]:
    """Write the packed id matrix of ``documents`` (doc_id, text) into the shared
    folder; return it, read back, with its path, which holds these rows and no others.

    A row: sequence_id, n_tokens, the pieces placed in it in order (doc_ids, pieces,
    starts in the document, lengths), cu_seqlens (cumulative segment lengths from 0),
    position_resets (places at which positions start again at 0), ids (``capacity``
    ids, padded with 0; little-endian unsigned 16-bit where the vocabulary fits, else
    32-bit). A document is its text's ids and ``end_id``; only longer ones than
    ``capacity`` are cut, and nothing is lost. Null and empty texts are the end id
    alone; null ids stay null; repeated rows are packed each; an empty table gives an
    empty matrix; other columns are ignored, whatever their names."""
    path = path or default_tokenizer()
    spark, dtype = docs.sparkSession, id_type(path)

    def fill(batches):
        from pyspark import TaskContext

        first, coder = TaskContext.get().partitionId() << 32, tokenizer_of(path)
        held, tokens, made = [], 0, 0
        for batch in chunks(batches, 500):
            for doc, raw in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.append(np.frombuffer(raw, "<u4"), end_id).astype(dtype)
                held += [(doc, k, at, ids[at : at + capacity]) for k, at in enumerate(range(0, len(ids), capacity))]
                tokens += len(ids)
                if tokens >= BUFFER_TOKENS:
                    yield (out := _rows(held, capacity, first + made, dtype))
                    held, tokens, made = [], 0, made + out.num_rows
        if held:
            yield _rows(held, capacity, first + made, dtype)

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = [p for _, row in pdf.iterrows() for p in segments(row, dtype)]
        return _rows(pieces, capacity, (1 << 62) + (int(key[0]) << 24), dtype).to_pandas()

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fill, BLOCKS)
    top = new_path(spark, "blocks")
    loose = F.col("n_tokens") < int(capacity * (1 - SLACK))
    made.withColumn("loose", loose).write.option("compression", "zstd").partitionBy("loose").parquet(top)
    # underfull blocks lie apart, so that the whole ones never move again
    whole, apart = f"{top}/loose=false", f"{top}/loose=true"
    rest = spark.read.schema(f"{BLOCKS}, loose boolean").parquet(top).filter("loose").drop("loose")
    n = rest.count()
    if n:
        shards = -(-n // shard_blocks)
        again_made = rest.withColumn("_shard", F.pmod(F.xxhash64("sequence_id"), F.lit(shards))).groupBy("_shard").applyInPandas(again, BLOCKS)
        again_made.write.mode("append").option("compression", "zstd").parquet(whole)
        dropped(spark, apart)
    elif spark.read.schema(BLOCKS).parquet(top).isEmpty():
        made.limit(0).write.mode("overwrite").parquet(whole)
    return spark.read.schema(BLOCKS).parquet(whole), whole


def id_type(path: str) -> str:
    return "<u2" if tokenizer_of(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def unpacked(blocks: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces (doc_id, piece, start, ids as unsigned 32-bit) of a block table."""
    dtype = id_type(path or default_tokenizer())

    def each(pdfs):
        for pdf in pdfs:
            rows = [(d, p, s, ids.astype("<u4").tobytes()) for _, row in pdf.iterrows() for d, p, s, ids in segments(row, dtype)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "ids"])

    return blocks.mapInPandas(each, "doc_id long, piece int, start long, ids binary")
