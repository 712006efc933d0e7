"""Entity graph: derivation, neighbours, related pages, mentions, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as T
from quarry.operators.retrieve import few, ranked  # noqa: F401

# Info box keys and their relations.
RELATIONS = {"affiliation": "affiliated_with", "affiliations": "affiliated_with", "employer": "affiliated_with", "faction": "member_of", "group": "member_of", "member_of": "member_of", "organization": "member_of"}
#: Characters of titles that are sent to each executor at most.
SENT = 1 << 24


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of documents (doc_id, title, document_type, entities, infobox).

    entities (key, title, doc_id, type): of documents with one key the last doc_id owns
    the row; targets without a page have no doc_id. edges (src_key, rel, dst_key,
    doc_id, src, dst), one for each identity, spelt as its least row."""
    key = T.fold(F.col("title"))
    pages = docs.select(key.alias("key"), "title", "doc_id", F.col("document_type").alias("type"))
    owner = pages.groupBy("key").agg(F.max(F.struct("doc_id", "title", "type")).alias("o")).select("key", "o.title", "o.doc_id", "o.type")
    base = docs.withColumn("src_key", key)
    links = base.select("doc_id", "src_key", F.lit("links_to").alias("rel"), F.explode(F.transform("entities", T.clean_target)).alias("dst")).filter((F.col("dst") != "") & (T.fold(F.col("dst")) != F.col("src_key")))
    known = F.create_map(*[F.lit(v) for pair in RELATIONS.items() for v in pair])
    boxes = base.select("doc_id", "src_key", F.explode("infobox").alias("k", "v"))
    boxes = boxes.select("doc_id", "src_key", F.try_element_at(known, F.replace(T.fold(F.col("k")), F.lit(" "), F.lit("_"))).alias("rel"), T.clean_target(F.col("v")).alias("dst"))
    boxes = boxes.filter(F.col("rel").isNotNull() & (F.col("dst") != "") & (F.length("dst") <= 160))
    edges = links.unionByName(boxes).withColumn("dst_key", T.fold(F.col("dst"))).groupBy("src_key", "rel", "dst_key", "doc_id").agg(F.min("dst").alias("dst"))
    others = edges.join(owner, edges.dst_key == owner.key, "left_anti").groupBy(F.col("dst_key").alias("key")).agg(F.min("dst").alias("title"))
    entities = owner.unionByName(others.select("key", "title", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit("other").alias("type")))
    return entities, edges


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, (key, other, rel, direction, doc_id): an equi-join then
    finds what touches a title. Of a loop only the outgoing side."""
    out = edges.select(F.col("src_key").alias("key"), F.col("dst_key").alias("other"), "rel", F.lit("out").alias("direction"), "doc_id")
    back = edges.filter("src_key <> dst_key").select(F.col("dst_key").alias("key"), F.col("src_key").alias("other"), "rel", F.lit("in").alias("direction"), "doc_id")
    return out.unionByName(back)


def _alike(sets: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows (query_id, ...) that agree in columns, one (like, ...), like being the least
    query_id of them, and (query_id, like) of all: what is asked many times is found once."""
    one = sets.groupBy(*by).agg(F.min("query_id").alias("like"))
    return one, sets.join(one, by).select("query_id", "like")


def neighbours(entities: DataFrame, edges: DataFrame, asked: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, doc_id, score, rank) for asked (query_id, key): 2 for each edge to the
    page at its other end, 1 to the page that states it, summed over a question's titles.

    Points are summed by title first, and questions that ask for the same titles share
    them: a title with many edges that many questions ask for would give all pairs of these."""
    one, like = _alike(asked.groupBy("query_id").agg(F.array_sort(F.collect_list("key")).alias("keys")), ["keys"])
    ends = _directed(edges)
    pages = ends.groupBy("key", "other").agg(F.count("*").alias("p")).join(entities.select(F.col("key").alias("other"), F.col("doc_id").alias("page")).filter("page is not null"), "other")
    stated = ends.groupBy("key", "doc_id").agg(F.count("*").alias("p")).filter("doc_id is not null")
    points = pages.select("key", F.col("page").alias("doc_id"), (2 * F.col("p")).alias("p")).unionByName(stated)
    scores = one.select("like", F.explode("keys").alias("key")).join(points, "key").groupBy("like", "doc_id").agg(F.sum("p").alias("score"))
    best = scores.withColumn("rank", F.row_number().over(W.partitionBy("like").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= limit)
    return like.join(best, "like").select("query_id", "doc_id", "score", "rank")


def related(entities: DataFrame, edges: DataFrame, pages: DataFrame, limit: int = 12) -> DataFrame:
    """(doc_id, related_id, title, relations, rank) for pages (doc_id): other pages at the
    end of an edge, by folded title and id, with their distinct (relation, direction) in
    order. Media pages go after the limit, so fewer may be left."""
    own = entities.join(pages.select("doc_id").distinct(), "doc_id").select("key", F.col("doc_id").alias("page"))
    near = own.join(_directed(edges).drop("doc_id"), "key").join(entities.filter("doc_id is not null").select(F.col("key").alias("other"), F.col("doc_id").alias("related_id"), "title"), "other")
    near = near.filter("related_id <> page")
    found = near.groupBy(F.col("page").alias("doc_id"), "related_id", "title").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "rel", "direction"))), ",").alias("relations"))
    order = W.partitionBy("doc_id").orderBy(T.fold(F.col("title")), "related_id")
    return found.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= limit) & ~T.is_media_page(F.col("title")))


def overlapping(entities: DataFrame, queries: DataFrame, limit: int = 4) -> DataFrame:
    """(query_id, key, title, overlap, rank): titles that share words with a question."""
    q = queries.select("query_id", F.explode(T.words(T.fold(F.col("text")))).alias("w"))
    e = entities.select("key", "title", T.words(F.col("key")).alias("ws")).select("key", "title", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    hits = q.join(e, "w").groupBy("query_id", "key", "title", "n").agg(F.count("*").alias("overlap"))
    order = W.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("n"), "key")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def mentions(entities: DataFrame, queries: DataFrame, limit: int = 4) -> DataFrame:
    """(query_id, key, title, type, start, place): titles mentioned as whole words,
    longest first where they overlap, in order of place.

    Words of a question are grouped into runs as long as titles are and joined on their
    folded text, so that titles aren't tried one by one on each question. Of the two
    sides runs are the larger one, which the planner can't tell: titles go to the runs,
    or both are dealt by text where titles are many."""
    tokens = F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), 0)
    split = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), 0), " ")
    names = entities.select("key", "title", "type", split(F.col("key")).alias("run")).filter("run <> ''").withColumn("n", F.size(F.split("run", " ")))
    held = names.groupBy("n").agg(F.sum(F.length("key") + F.length("title") + F.length("run")).alias("chars")).collect()  # a row for each length
    lengths = F.array(*[F.lit(r["n"]) for r in sorted(held)]).cast("array<int>")
    names = F.broadcast(names) if sum(r["chars"] for r in held) <= SENT else names.hint("shuffle_hash")
    q = queries.select("query_id", F.transform(tokens, T.fold).alias("t")).filter(F.size("t") > 0)
    run = lambda a, n: F.struct(a.alias("a"), n.alias("n"), F.array_join(F.slice("t", a + 1, n), " ").alias("run"))
    runs = F.transform(F.sequence(F.lit(0), F.size("t") - 1), lambda a: F.transform(F.filter(lengths, lambda n: a + n <= F.size("t")), lambda n: run(a, n)))
    runs = q.select("query_id", F.explode(F.flatten(runs)).alias("r")).select("query_id", "r.*")
    found = runs.join(names, ["run", "n"])
    spans = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("title")).alias("z"), "key", "a", "n", "title", "type"))).alias("spans"))
    empty = F.slice("spans", 1, 0)

    def choose(kept, s):
        clash = F.exists(kept, lambda x: ((s["a"] < x["a"] + x["n"]) & (x["a"] < s["a"] + s["n"])) | (x["key"] == s["key"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    chosen = spans.select("query_id", F.explode(F.aggregate("spans", empty, choose)).alias("s")).select("query_id", "s.key", "s.title", "s.type", F.col("s.a").alias("start"))
    return chosen.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("start", "key"))).filter(F.col("place") <= limit)


def graph_topk(ranked_docs: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, per_doc: int = 2) -> DataFrame:
    """Chunks (id, doc_id, title, text, ordinal) of neighbour documents (query_id, doc_id,
    rank): by document, word overlap with the question, ordinal; two of a document at
    most; score 1 / rank + 0.01 * overlap.

    A chunk is split into words once and no text is dealt out; questions with the same
    words and documents share their chunks."""
    q = queries.select("query_id", F.array_sort(T.words(T.fold(F.col("text")))).alias("q"))
    near = ranked_docs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("doc_rank"), "doc_id"))).alias("docs"))
    one, like = _alike(q.join(near, "query_id"), ["q", "docs"])
    one = one.select("like", "q", F.explode("docs").alias("d")).select("like", "q", "d.doc_rank", "d.doc_id")
    held = chunks.select("id", "doc_id", "ordinal", T.words(T.fold(F.concat_ws(" ", "title", "text"))).alias("w"))
    rows = held.join(F.broadcast(one) if few(queries, k) else one, "doc_id").withColumn("overlap", F.size(F.array_intersect("q", "w"))).drop("q", "w")
    in_doc = F.row_number().over(W.partitionBy("like", "doc_id").orderBy(F.desc("overlap"), "ordinal", "id"))
    rows = rows.withColumn("n", in_doc).filter(F.col("n") <= per_doc)
    rank = F.row_number().over(W.partitionBy("like").orderBy("doc_rank", F.desc("overlap"), "ordinal", "id"))
    rows = like.join(rows.withColumn("rank", rank).filter(F.col("rank") <= k), "like")
    return rows.select("query_id", "id", (1.0 / F.col("rank") + F.col("overlap") * 0.01).alias("score"), "rank", F.lit("graph").alias("retriever"))
