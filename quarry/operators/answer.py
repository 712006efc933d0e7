"""Question analysis, extractive answers and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# The citation tag, and what is cleaned around tags.
CITE = r"\[cite:([a-zA-Z0-9]+)\]"
NOTHING_FOUND = "I could not find this in the loaded corpus. Answers come from retrieved source documents only."


# Kinds of question in order of priority; each line of words must be met, by one of its
# words anywhere ("has") or at the start ("starts").
QUESTION_KINDS = (
    ("relationship", (("has", "connect", "relationship", "related", "between"),)),
    ("who", (("starts", "who"),)),
    ("where_established", (("has", "where"), ("has", "establish", "story", "canto"))),
    ("event", (("starts", "what happened"),)),
    ("event", (("has", "during canto"),)),
    ("what", (("starts", "what"),)),
)
# Types of document suggested for a kind of question, and where a word stands in it.
SUGGESTED = {
    "who": ("character", "sinner", "faction"),
    "event": ("story_transcript", "character"),
    "relationship": ("character", "sinner", "faction", "story_transcript"),
}
SUGGESTED_FOR_WORD = ("mirror", ("world", "character", "sinner"))


def question_type(text: Column) -> Column:
    """The first kind of QUESTION_KINDS all of whose lines are met, else other."""
    q = F.lower(text)
    met = {"has": q.contains, "starts": q.startswith}
    one = lambda line: reduce(Column.__or__, [met[line[0]](w) for w in line[1:]])
    return reduce(lambda rest, kind: F.when(reduce(Column.__and__, map(one, kind[1])), kind[0]).otherwise(rest), reversed(QUESTION_KINDS), F.lit("other"))


def suggested_types(kind: Column, text: Column) -> Column:
    types = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    word, for_word = SUGGESTED_FOR_WORD
    rest = F.when(F.lower(text).contains(word), types(for_word)).otherwise(types(()))
    return reduce(lambda other, k: F.when(kind == k, types(SUGGESTED[k])).otherwise(other), SUGGESTED, rest)


def analyse(queries: DataFrame, mentioned: DataFrame) -> DataFrame:
    """queries (query_id, text) with question_type, entities, document_types, chapters.
    Types are suggestions: they don't become filters."""
    m = mentioned.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "title", "type"))).alias("m"))
    out = queries.join(m, "query_id", "left")
    titles = F.coalesce(F.transform("m", lambda x: x["title"]), F.array().cast("array<string>"))
    kinds = F.coalesce(F.filter(F.transform("m", lambda x: x["type"]), lambda t: t != "other"), F.array().cast("array<string>"))
    kind = question_type(F.col("text"))
    return out.select(
        "query_id", "text", kind.alias("question_type"), titles.alias("entities"), F.array_distinct(F.concat(suggested_types(kind, F.col("text")), kinds)).alias("document_types"),
        T.detect_chapters(F.col("text"), F.array().cast("array<string>"), F.lit("")).alias("chapters"), F.col("text").alias("rewritten_query"),
    )


def refined(text: Column, entities: Column) -> Column:
    """The question with its entities and words that widen it."""
    out = T.strip(F.concat_ws(" ", text, F.array_join(entities, " "), F.lit("lore story wiki")))
    return F.when(out != text, out).otherwise(F.concat(text, F.lit(" background history")))


def quoted(x: Column) -> Column:
    """The text in quotes: single ones, or double ones if it holds single ones alone."""
    swap = lambda y, old, new: F.replace(y, F.lit(old), F.lit(new))
    escaped = swap(swap(swap(swap(x, "\\", "\\\\"), "\n", "\\n"), "\r", "\\r"), "\t", "\\t")
    double = x.contains("'") & ~x.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), swap(escaped, "'", "\\'"), F.lit("'")))


def extractive(hits: DataFrame, queries: DataFrame, most: int = 4, chars: int = 220) -> DataFrame:
    """(query_id, answer): a header and the first hits (query_id, id, title, text, rank)
    with citation tags; without hits a fixed refusal."""
    line = F.concat(F.lit("- "), "title", F.lit(": "), F.substring(F.translate("text", "\n", " "), 1, chars), F.lit(" [cite:"), F.col("id").cast("string"), F.lit("]"))
    lines = hits.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    out = queries.join(lines, "query_id", "left")
    head = F.concat(F.lit("Based on the retrieved sources for "), quoted(F.col("text")), F.lit(":"))
    body = F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return out.select("query_id", F.when(F.col("l").isNull(), F.lit(NOTHING_FOUND)).otherwise(body).alias("answer"))


def cited(answers: DataFrame, kept: DataFrame, attach: int = 5) -> DataFrame:
    """(query_id, answer, citations, valid) of answers (query_id, answer) against kept
    hits (query_id, id, rank). Known tags are numbered by first appearance, unknown ones
    erased; adjacent tags stand together. Without a known tag the first hits are attached."""
    allowed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))).alias("k"))
    rows = answers.join(allowed, "query_id", "left").withColumn("k", F.coalesce(F.transform("k", lambda x: x["id"]), F.array().cast("array<string>")))
    rows = rows.withColumn("ids", F.regexp_extract_all("answer", F.lit(CITE), 1))
    rows = rows.withColumn("known", F.array_distinct(F.filter("ids", lambda i: F.array_contains(F.col("k"), i))))
    numbered = F.aggregate(F.array_distinct("ids"), F.col("answer"), lambda a, i: F.replace(a, F.concat(F.lit("[cite:"), i, F.lit("]")), F.when(F.array_contains(F.col("known"), i), F.concat(F.lit("["), F.array_position(F.col("known"), i).cast("string"), F.lit("]"))).otherwise("")))
    clean = F.regexp_replace(numbered, r"(\[\d+\])\s+(?=\[\d+\])", "$1")
    clean = T.strip(F.regexp_replace(F.regexp_replace(clean, r"[ \t]+([,.;:!?])", "$1"), r"[ \t]{2,}", " "))
    return rows.select(
        "query_id", clean.alias("answer"), F.when(F.size("known") > 0, F.col("known")).otherwise(F.slice("k", 1, attach)).alias("citations"),
        (F.size(F.array_except("ids", "k")) == 0).alias("valid"),
    )
