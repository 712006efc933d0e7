"""Packing of token pieces into sequences by a swap-based local search (operator 3).

Pieces are dealt by hash into shards of about ``SHARD`` pieces, so that no task
depends on the input's size. Within a shard, best fit decreasing makes the first
bins; then pieces move, or change places one for one or two for one, between
underfull bins. Each step moves tokens from an emptier bin into a fuller one, so the
sum of squared fills grows and the search ends; a bin that has lost everything goes.
What lies in a shard's bins that are still underfull is dealt into new shards and
packed again, so that a shard's last open bin isn't waste in the result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import dropped, only_memory, written
from quarry.llm.tokens import MAX_TOKENS, REMEMBERED_BYTES, tokenize

SHARD = 4096
#: The emptiest bins, which a round of the search takes from.
SOURCES = 64
#: Bins with more than this part of the capacity free are packed again with those of other shards.
SLACK = 1 / 128


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(free, (lengths[i], -1))
        room, b = free.pop(at) if at < len(free) else (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        if room > lengths[i]:
            insort(free, (room - lengths[i], b))
    return bins


def _step(source: list[tuple[int, int]], others: list[list], capacity: int) -> bool:
    """One exchange that takes tokens out of ``source`` and makes the sum of squares grow.

    others: [fill, pieces] in which pieces are (length, index), sorted as in source."""
    fill = sum(n for n, _ in source)
    for x in reversed(source):
        best = None
        for other in others:
            have, pieces = other
            room = capacity - have
            if not room:
                continue
            least = fill - have  # squares grow by taking over more than the bins differ by
            if x[0] <= room and x[0] > least:  # move
                best = max(best or (0,), (x[0], 2, have, id(other)), key=lambda t: t[:3])
                if best[3] == id(other):
                    chosen = other, ()
                continue
            at = bisect_left(pieces, (x[0] - room, -1))
            if at < len(pieces) and pieces[at][0] < x[0]:  # one for one
                gain = x[0] - pieces[at][0]
                if gain > least and (best is None or (gain, 1) > best[:2]):
                    best, chosen = (gain, 1, have, id(other)), (other, (pieces[at],))
            for k, y in enumerate(pieces):  # two for one
                if 2 * y[0] >= x[0]:
                    break
                at = bisect_left(pieces, (x[0] - room - y[0], -1), k + 1)
                if at < len(pieces) and y[0] + pieces[at][0] < x[0]:
                    gain = x[0] - y[0] - pieces[at][0]
                    if gain > least and (best is None or (gain, 0) > best[:2]):
                        best, chosen = (gain, 0, have, id(other)), (other, (y, pieces[at]))
        if best is not None:
            other, back = chosen
            source.remove(x)
            for y in back:
                other[1].remove(y)
                insort(source, y)
            insort(other[1], x)
            other[0] += best[0]
            return True
    return False


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins as long as the free space could hold one, the emptiest first."""
    done = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    open_ = [[sum(lengths[i] for i in b), sorted((lengths[i], i) for i in b)] for b in bins if sum(lengths[i] for i in b) < capacity]
    changed = True
    while changed and len(open_) > 1:
        changed = False
        open_.sort(key=lambda b: (b[0], b[1]))
        for one in open_[:SOURCES]:
            if sum(capacity - fill for fill, _ in open_) < capacity:
                break
            others = [b for b in open_ if b is not one]
            while one[1] and _step(one[1], others, capacity):
                changed = True
            one[0] = sum(n for n, _ in one[1])
            if not one[1]:
                open_ = others
    return done + [[i for _, i in reversed(pieces)] for _, pieces in open_]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(lengths, best_fit_decreasing(lengths, capacity), capacity)


def _packed(pieces: DataFrame, shards: int, capacity: int, first_id: int) -> DataFrame:
    """``pieces`` with sequence_id, offset and the free space of the sequence."""
    names = [f.name for f in pieces.schema]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        only_memory("packing")
        pdf = pdf.reset_index(drop=True)
        lengths = pdf["length"].tolist()
        sequence, offset, free = [0] * len(pdf), [0] * len(pdf), [0] * len(pdf)
        for n, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = first_id + (int(key[0]) << 20) + n, at
                at += lengths[i]
            for i in members:
                free[i] = capacity - at
        return pdf[names].assign(sequence_id=sequence, offset=offset, free=free)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    spread = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards))
    return pieces.withColumn("_shard", spread).groupBy("_shard").applyInPandas(pack, f"{kinds}, sequence_id long, offset long, free long")


def pack(pieces: DataFrame, capacity: int = MAX_TOKENS, shard: int = SHARD) -> DataFrame:
    """Place every piece (doc_id, piece, length, ...) into a sequence.

    Returns the given columns with sequence_id and offset; offsets of a sequence are
    gapless from 0. No piece may be longer than ``capacity``. Rows with a null doc_id
    and repeated rows are pieces of their own; ties go by row order; an empty table
    gives an empty result. ``pieces`` should be a written table, as it is read twice."""
    spark = pieces.sparkSession
    n = pieces.count()
    first, at = written(_packed(pieces, max(1, -(-n // shard)), capacity, 0), "packed")
    loose = F.col("free") > int(capacity * SLACK)
    rest = first.filter(loose).drop("sequence_id", "offset", "free")
    m = rest.count()
    if m == 0 or n <= shard:
        return first.drop("free")
    again = _packed(rest, max(1, -(-m // shard)), capacity, 1 << 62)
    out, _ = written(first.filter(~loose).unionByName(again).drop("free"), "packed-all")
    dropped(spark, at)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = False, remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """Tokenise and pack ``documents`` (doc_id, text).

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; with
    ``with_ids`` also the ids (binary, little-endian unsigned 32-bit), which then
    travel through the packing's shuffles; ``remembered`` is tokenize's. Null and empty texts are the end id alone;
    clashing extra columns don't matter, as only doc_id and text are read."""
    pieces = tokenize(docs, path, max_tokens, remembered=remembered).withColumn("ids_crc32", F.crc32("ids"))
    table, at = written(pieces if with_ids else pieces.drop("ids"), "pieces")
    out = pack(table, max_tokens)
    out = out.select(*[c for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset") if c in out.columns], *(["ids"] if with_ids else []))
    dropped(docs.sparkSession, at)
    return out
