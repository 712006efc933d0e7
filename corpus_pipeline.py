"""The corpus pipeline: language ID, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept; all but the last return the columns of ``documents``, further ones of any name
included. ``run`` writes each stage's result as Parquet in the shared folder and gives it,
read again, to the next; what a stage was made from is deleted. Every stage takes an empty
table and gives an empty one, goes through texts of any length whole, and treats repeated
rows and null doc_ids as its docstring says. Executors hold heaps that the stages before
have grown, so each stage bounds the bytes of the session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import dropped, small_batches, table, written
from quarry.llm.decontaminate import decontaminated
from quarry.llm.language import identify, trained
from quarry.llm.lines import without_repeats
from quarry.llm.minhash import deduplicated
from quarry.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null, empty and such without a letter, or too far from
    every language's centroids, go. Each row, repeated or without a doc_id, is decided by
    its own text; ties go to the first language. If no document has a language, there is
    nothing to reject by, and all stay."""
    small_batches(spark)
    model = trained(docs)
    if not model.langs:
        return docs
    found = identify(_apart(docs, "text"), model).filter(~F.col("lang_rejected"))
    return found.select(*_back(docs, "text"))


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """Columns of these names, and the others as one, so that no name of theirs clashes."""
    rest = [c for c in docs.columns if c not in names]
    return docs.select(*[F.col(c) for c in names if c in docs.columns], *([F.struct(*rest).alias("row")] if rest else []))


def _back(docs: DataFrame, *names: str) -> list:
    return [F.col(c) if c in names else F.col("row")[c].alias(c) for c in docs.columns]


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds, by doc_id, null last; a
    document of which nothing is left stays, empty; null texts stay null; rows equal in
    doc_id and text lose the same lines."""
    small_batches(spark)
    names = ("doc_id", "text", "n_chars")
    return without_repeats(_apart(docs, *names)).select(*_back(docs, *names))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates on five-word shingles. Null,
    empty and wordless texts and rows without a doc_id stay; rows of one doc_id go or stay
    together."""
    small_batches(spark)
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, whether they have a doc_id or not;
    null and empty texts stay; rows of one doc_id go together if one holds a passage."""
    small_batches(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of at most 4096 tokens; null and empty texts
    are the end token alone, repeated rows are packed each."""
    small_batches(spark)
    return pack_documents(docs, remembered=REMEMBERED_BYTES)


#: Bytes of words that packing's workers remember, twice: executors still hold what the
#: stages before have taken.
REMEMBERED_BYTES = 50_000_000

STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Centroids, MinHash and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            dropped(spark, before)
        before = path
    return docs
