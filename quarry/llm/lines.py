"""Removal of repeated passages of lines (operator 4).

A passage is a run of two or more lines that hold words, or one line of
``LONG_LINE_WORDS`` words. A longer run repeats an earlier one exactly where each two
successive lines of it, blank ones between them included, repeat two there, so all runs
of any length and place are found by hashes of such pairs and of long lines: every place
in a text begins a chunk, where boundaries chosen by content would miss short passages.
Runs in one and the same earlier place are joined, compared with its lines byte by byte,
grown over the blank lines beside both, and removed from all places but the first.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, dropped, free_shuffles, keyed_join, written

#: One line counts as a passage from so many words on.
LONG_LINE_WORDS = 50
#: Runs that meet one copy of the text of their first place, about.
COPIES = 2000

SEEDS = "doc_id long, whole long, first int, n int, seed binary"
RUNS = "doc_id long, whole long, first int, n int, doc_0 long, whole_0 long, first_0 int"
#: own: where the first place begins, if it is in the same document; else -1
FOUND = "doc_id long, whole long, first int, lead int, n int, own int, body string"


def seeds(text: str) -> list[tuple[int, int, bytes]]:
    """first line, lines, hash of each long line and each two successive lines with words."""
    raw = [line.encode("utf-8", "surrogatepass") for line in text.split("\n")]
    out, last = [], None
    for k, line in enumerate(raw):
        n_words = len(line.split())
        if not n_words:
            continue
        if n_words >= LONG_LINE_WORDS:
            out.append((k, 1, xxhash.xxh3_128_digest(line)))
        if last is not None:
            out.append((last, k + 1 - last, xxhash.xxh3_128_digest(b"\n".join(raw[last : k + 1]))))
        last = k
    return out


def _whole(column: str):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], list(names))


def _seeded(docs: DataFrame) -> DataFrame:
    def each(batches):
        for batch in chunks(batches, 500):
            yield _batch([(doc, whole, *c) for doc, whole, text in zip(*(x.to_pylist() for x in batch.columns), strict=True) for c in seeds(text)], SEEDS)

    return docs.mapInArrow(each, SEEDS)


def _joined(parts: DataFrame) -> DataFrame:
    """Runs out of the seeds of a document that stand in one place of another."""

    def each(batches):
        for batch in chunks(batches, 2000):
            rows = []
            for doc, whole, doc_0, whole_0, shift, spans in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                runs: list[list[int]] = []
                for a, n in sorted((x["first"], x["n"]) for x in spans):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], a + n)
                    else:
                        runs.append([a, a + n])
                rows += [(doc, whole, a, b - a, doc_0, whole_0, a + shift) for a, b in runs]
            yield _batch(rows, RUNS)

    return parts.mapInArrow(each, RUNS)


def _with_bodies(rows: DataFrame) -> DataFrame:
    """Runs with the lines of the first place and the blank ones beside them."""

    def each(batches):
        seen, text, lines = None, None, []
        for batch in chunks(batches, 500):
            out = []
            for doc, whole, first, n, first_0, same, other in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if seen == (doc, whole, first, n, first_0):
                    continue  # a repeated row of the first place
                seen = (doc, whole, first, n, first_0)
                if other != text:
                    text, lines = other, other.split("\n")
                a, b = first_0, first_0 + n
                while a and not lines[a - 1].split():
                    a -= 1
                while b < len(lines) and not lines[b].split():
                    b += 1
                out.append((doc, whole, first, first_0 - a, n, first_0 if same else -1, "\n".join(lines[a:b])))
            yield _batch(out, FOUND)

    return rows.mapInArrow(each, FOUND)


def _place(doc_id: str, whole: str):
    """One key of a document, for null ids too."""
    return F.concat_ws("|", F.col(whole).cast("string"), F.col(doc_id).cast("string"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, whole, first, lead, n, own, body: runs of n lines of a document that stand
    earlier too, and what stands there, with lead and further blank lines around it.

    The first occurrence, by doc_id (null last) and place, stays; one that overlaps it
    isn't another. Rows equal in doc_id and text are one document and lose the same lines."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", _whole("text").alias("whole"), "text")
    seeds_, seeds_at = written(_seeded(docs), "seeds")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "whole", "first")
    firsts, firsts_at = written(seeds_.groupBy("seed").agg(F.min(place).alias("f"), F.count("*").alias("rows")).filter("rows > 1").select("seed", "rows", F.col("f.doc_id").alias("doc_id_0"), F.col("f.whole").alias("whole_0"), F.col("f.first").alias("first_0")), "firsts")
    spread = keyed_join(seeds_, firsts, "seed", "rows", seeds_.count())
    here = F.col("doc_id").eqNullSafe(F.col("doc_id_0")) & (F.col("whole") == F.col("whole_0"))
    later = spread.filter(~here | (F.col("first") >= F.col("first_0") + F.col("n")))
    parts = later.groupBy("doc_id", "whole", F.col("doc_id_0").alias("doc_0"), "whole_0", (F.col("first_0") - F.col("first")).alias("shift")).agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    runs, runs_at = written(_joined(parts).withColumn("at", _place("doc_0", "whole_0")), "runs")
    dropped(spark, seeds_at, firsts_at)
    free_shuffles(spark)
    # a first place that very many runs repeat is given to several tasks
    asked, asked_at = written(runs.groupBy("at").agg(F.count("*").alias("rows")), "places")
    copies = F.floor(F.col("rows") / COPIES).cast("int")
    first = docs.select(_place("doc_id", "whole").alias("at"), "text").join(asked.hint("merge"), "at").select("at", "text", F.explode(F.sequence(F.lit(0), copies)).alias("copy"))
    dealt = keyed_join(runs, asked, "at", "rows", runs.count()).withColumn("copy", F.pmod(F.hash("doc_id", "whole", "first"), copies + 1))
    placed = dealt.hint("merge").join(first, ["at", "copy"])
    same = F.col("doc_id").eqNullSafe(F.col("doc_0")) & (F.col("whole") == F.col("whole_0"))
    out, _ = written(_with_bodies(placed.select("doc_id", "whole", "first", "n", "first_0", same.alias("same"), "text")), "repeats")
    dropped(spark, runs_at, asked_at)
    free_shuffles(spark)
    return out


def repeated(lines: list[str], first: int, lead: int, n: int, body: str) -> range:
    """Lines that a run takes away: none unless its bytes are those of the first place."""
    other = body.split("\n")
    if lines[first : first + n] != other[lead : lead + n]:
        return range(0)
    a, b = first, first + n
    while lead and a and lines[a - 1] == other[lead - 1]:
        a, lead = a - 1, lead - 1
    at = len(other) - (b - a) - lead
    while at > 0 and b < len(lines) and lines[b] == other[len(other) - at]:
        b, at = b + 1, at - 1
    return range(a, b)


def removed(lines: list[str], runs: list[dict]) -> set[int]:
    """Lines that the runs of a document take away. Where first places are in the same
    document, their lines stay."""
    drop: set[int] = set()
    kept: set[int] = set()
    for x in runs:
        drop.update(repeated(lines, x["first"], x["lead"], x["n"], x["body"]))
        if x["own"] >= 0:
            kept.update(range(x["own"], x["own"] + x["n"]))
    return drop - kept


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of text, and lines_removed.

    Null texts stay null, texts without a repeat stay as they are, and a text all of
    whose lines repeat earlier ones becomes empty. A run never takes lines of a first
    place in the same document: of lines B A B A B the first three stay. Texts of any
    length are gone through whole. n_chars, where given, is counted anew. Other columns
    stay, whatever their names; a given column lines_removed is replaced; an empty table
    gives an empty one."""
    docs = docs.drop("lines_removed")
    columns = docs.columns
    runs = F.collect_list(F.struct("first", "lead", "n", "own", "body"))
    gone = repeated_lines(docs).groupBy("doc_id", "whole").agg(runs.alias("runs")).select(_place("doc_id", "whole").alias("at"), "runs")
    # rows travel as one column, so no name of theirs clashes
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _whole("text").alias("whole"))
    # the same join at every size: what is to be cut has no bound
    keyed = rows.select("row", _place("doc_id", "whole").alias("at")).join(gone.hint("merge"), "at", "left")

    @F.pandas_udf("text string, n int")
    def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(text, runs, strict=True):
            if t is None or r is None:
                out.append((t, 0))
                continue
            lines = t.split("\n")
            drop = removed(lines, r)
            out.append(("\n".join([s for k, s in enumerate(lines) if k not in drop]), len(drop)))
        return pd.DataFrame(out, columns=["text", "n"])

    some = F.col("runs").isNotNull()
    out = keyed.withColumn("cut", cut(F.when(some, F.col("row")["text"].cast("string")), "runs"))  # other texts stay where they are
    text = F.when(some, F.col("cut")["text"]).otherwise(F.col("row")["text"])
    new = {"text": text}
    if "n_chars" in columns:
        new["n_chars"] = F.when(some, F.length(text)).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in columns), F.col("cut")["n"].alias("lines_removed"))
