"""Documents to passages: sections, merging of tiny ones, splitting of long ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

MAX_CHARS, TINY = 1800, 40
_MARK = "\x01"
HEADING = r"(?md)^(=+)(?U:\s*)(.+?)(?U:\s*)\1(?U:\s*)$"


def _greedy(parts: Column, most: int, glue: str) -> Column:
    """Pack parts in order: join to the buffer while that fits, else start a new one."""
    size = len(glue)
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def add(a, p):
        fits = F.length(a["buf"]) + F.length(p) + size <= most
        joined = T.strip(F.concat(a["buf"], F.lit(glue), p))
        out = F.when(fits | (a["buf"] == ""), a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"])))
        return F.struct(F.when(fits, joined).otherwise(p).alias("buf"), out.alias("out"))

    return F.aggregate(parts, start, add, lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))))


def split_long(text: Column, most: int = MAX_CHARS) -> Column:
    """Pieces of at most ``most`` characters: paragraphs packed greedily; a paragraph
    that is longer is packed by sentences, whose last buffer goes on with what follows;
    a longer sentence stays whole."""
    paragraphs = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), T.strip), lambda p: p != "")
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def flush(a):
        return F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"])))

    # sentences are packed before, once a paragraph, and only where one is too long
    sentences = lambda p: F.when(F.length(p) > most, _greedy(F.split(p, r"(?U)(?<=[.!?])\s+"), most, " "))
    cut = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), sentences(p).alias("cut")))

    def add(a, x):
        p, cut = x["p"], x["cut"]
        fits = F.length(a["buf"]) + F.length(p) + 2 <= most
        body = F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))
        return (
            F.when(fits, F.struct(T.strip(F.concat(a["buf"], F.lit("\n\n"), p)).alias("buf"), a["out"].alias("out")))
            .when(F.length(p) <= most, F.struct(p.alias("buf"), flush(a).alias("out")))
            .otherwise(F.struct(F.coalesce(F.get(cut, F.size(cut) - 1), F.lit("")).alias("buf"), F.concat(flush(a), body).alias("out")))
        )

    packed = F.aggregate(cut, start, add, flush)
    whole = F.when(T.strip(text) == "", F.array().cast("array<string>")).otherwise(F.array(T.strip(text)))
    return F.when(F.length(text) <= most, whole).otherwise(packed)


def sections(docs: DataFrame) -> DataFrame:
    """Cleaned sections (doc columns, section_no, section_title, body) of raw_text; a
    document without headings is one section of plain_text. Sections under 40
    characters join the one before; empty ones go."""
    raw = F.coalesce("raw_text", "plain_text", F.lit(""))
    marked = F.regexp_replace(raw, HEADING, f"{_MARK}$2{_MARK}")
    parts = F.split(marked, _MARK)  # intro, title, body, title, body ...
    none = F.size(parts) < 3
    intro = F.struct(F.col("title").alias("t"), F.regexp_replace(T.strip(F.get(parts, F.lit(0))), r"\{\{[^}]+\}\}", "").alias("b"))
    rest = F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: F.struct(T.strip(F.get(parts, i)).alias("t"), F.get(parts, i + 1).alias("b")))
    alone = F.array(F.struct(F.col("title").alias("t"), F.coalesce(F.when(F.col("plain_text") != "", F.col("plain_text")), raw).alias("b")))
    every = F.when(none, alone).otherwise(F.concat(F.array(intro), rest))
    cleaned = F.filter(F.transform(every, lambda s: F.struct(s["t"].alias("t"), T.strip_markup(s["b"]).alias("b"))), lambda s: s["b"] != "")
    empty = F.slice(cleaned, 1, 0)

    def merge(a, s):
        tiny = (F.size(a) > 0) & (F.length(s["b"]) < TINY)
        last = F.get(a, F.size(a) - 1)
        grown = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["t"].alias("t"), F.concat(last["b"], F.lit("\n\n"), s["b"]).alias("b"))))
        return F.when(tiny, grown).otherwise(F.concat(a, F.array(s)))

    merged = F.aggregate(cleaned, empty, merge)
    # _before: sections before with the same title, counted in the array, so that nothing is shuffled
    keep = [c for c in docs.columns if c not in ("raw_text", "plain_text")]
    rows = docs.select(*keep, merged.alias("_m")).select(*keep, "_m")
    before = F.filter("_m", lambda o, i: (o["t"] == F.col("_s.t")) & (i < F.col("section_no")))
    return rows.select(*keep, "_m", F.posexplode("_m").alias("section_no", "_s")).select(*keep, "section_no", F.col("_s.t").alias("section_title"), F.col("_s.b").alias("body"), F.size(before).alias("_before"))


def passages(docs: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """Chunks of documents (doc_id, revision_id, title, raw_text, plain_text, ...).

    chunk ids hash document, revision, path and ordinal. As ordinals start anew in each
    section, two sections of a page with one title would share ids; from the second on,
    the section's number is part of the hashed path."""
    keep = [c for c in docs.columns if c not in ("raw_text", "plain_text")]
    path = F.when(F.col("section_title") == F.col("title"), F.col("title")).otherwise(F.concat_ws("/", "title", "section_title"))
    rows = sections(docs).withColumn("section_path", path)
    rows = rows.select(*keep, "section_no", "section_title", "section_path", "_before", F.posexplode(split_long(F.col("body"), most)).alias("ordinal", "text"))
    hashed = F.when(F.col("_before") == 0, F.col("section_path")).otherwise(F.concat_ws("#", "section_path", F.col("section_no").cast("string")))
    return rows.select(
        T.chunk_id(F.col("doc_id"), F.col("revision_id"), hashed, F.col("ordinal")).alias("chunk_id"), *keep, "section_title", "section_path", "section_no", "ordinal", "text",
        F.concat(F.col("title"), F.lit(" > "), F.col("section_title"), F.lit("\n"), F.col("text")).alias("embed_text"),
        F.greatest(F.lit(1), F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))).alias("token_count"),
    )
