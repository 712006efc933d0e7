"""Retrieval recipes and their search and ask plans, over a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.operators import answer as A
from quarry.operators import graph as G
from quarry.operators import retrieve as R


@dataclass(frozen=True)
class Recipe:
    id: str
    k_dense: int = 40
    k_bm25: int = 40
    k_graph: int = 16
    k_fused: int = 50
    k_final: int = 8
    use_dense: bool = True
    use_bm25: bool = True
    use_graph: bool = False
    use_rerank: bool = False
    rerank_backend: str | None = None
    use_refine: bool = False
    graph_max_neighbors: int = 8
    rrf_k: int = 60
    min_kept: int = 2
    relevance_threshold: float = 0.15
    max_hops: int = 0

    @property
    def backend(self) -> str:
        return self.rerank_backend or ("lexical" if self.use_rerank else "none")


# The shipped recipes.
RECIPES = {
    r.id: r
    for r in (
        Recipe("bm25_only", k_dense=0, k_bm25=20, k_fused=20, use_dense=False),
        Recipe("vector_only", k_dense=20, k_bm25=0, k_fused=20, use_bm25=False),
        Recipe("hybrid"),
        Recipe("hybrid_graph", use_graph=True),
        Recipe("hybrid_rerank", use_rerank=True, rerank_backend="lexical"),
        Recipe("hybrid_rerank_refine", use_rerank=True, rerank_backend="lexical", use_refine=True, max_hops=1),
        Recipe("hybrid_rerank_cross_encoder", use_rerank=True, rerank_backend="cross_encoder"),
    )
}


def overlaid(recipe: Recipe, question_type: str) -> Recipe:
    """The default recipe also asks the graph about relationships; in the ask plan only."""
    if recipe.id == "vector_only" and question_type == "relationship" and not recipe.use_graph:
        return replace(recipe, use_graph=True, k_graph=16, graph_max_neighbors=8)
    return recipe


@dataclass
class Corpus:
    """Chunks (id, doc_id, title, text, ordinal) and the indexes over them."""

    chunks: DataFrame
    keyword: R.KeywordIndex | None = None
    vectors: DataFrame | None = None
    entities: DataFrame | None = None
    edges: DataFrame | None = None


def search(corpus: Corpus, queries: DataFrame, recipe: Recipe, keep: DataFrame | None = None, model=None) -> DataFrame:
    """Hits (query_id, id, score, rank, retriever) of queries (query_id, text and, for
    vectors, v). ``keep`` holds the ids that pass the filters: it cuts keyword hits after
    an over-fetch of 4k, and vectors before ranking."""
    lists = []
    if recipe.use_bm25 and recipe.k_bm25:
        lists.append(R.keyword_topk(corpus.keyword, queries, recipe.k_bm25, keep))
    if recipe.use_dense and recipe.k_dense:
        v = corpus.vectors if keep is None else corpus.vectors.join(keep.select("id"), "id", "left_semi")
        lists.append(R.vector_topk(v, queries, recipe.k_dense, exclude_self=False))
    if recipe.use_graph:
        asked = G.overlapping(corpus.entities, queries).select("query_id", "key")
        near = G.neighbours(corpus.entities, corpus.edges, asked, recipe.graph_max_neighbors)
        chunks = corpus.chunks if keep is None else corpus.chunks.join(keep.select("id"), "id", "left_semi")
        lists.append(G.graph_topk(near, chunks, queries, recipe.k_graph))
    if not lists:
        raise ValueError(f"recipe {recipe.id} asks no retriever")
    base = ["query_id", "id", "score", "rank", "retriever"]
    hits = lists[0].filter(F.col("rank") <= recipe.k_fused).select(base) if len(lists) == 1 else R.fuse(lists, recipe.rrf_k, recipe.k_fused).select(base)
    if recipe.backend != "none":
        rich = R.beside(hits, corpus.chunks.select("id", "title", "text"), queries, recipe.k_fused).join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
        hits = (R.lexical_rerank(rich) if recipe.backend == "lexical" else R.model_rerank(rich, model)).select(base)
    return hits.filter(F.col("rank") <= recipe.k_final)


def asked_one(corpus: Corpus, question: str, recipe: Recipe, history: list[str] | None = None, keep: DataFrame | None = None, vector: list[float] | None = None, model=None) -> dict:
    """The answer to one question of a request, with its hits; earlier questions, the last
    four, and filters are the request's. Without a known tag in an answer the first kept
    hits are its citations."""
    spark = corpus.chunks.sparkSession
    recent = [h.strip()[:2000] for h in (history or [])[-4:] if h.strip()]
    q = spark.createDataFrame([(0, question, recent, vector)], "query_id long, text string, history array<string>, v array<float>")
    answer = ask(corpus, q, recipe, keep, model).first().asDict()
    hits = search(corpus, q, recipe, keep, model).orderBy("rank").collect()  # k_final rows
    return answer | {"history": recent, "hits": [r.asDict() for r in hits]}


def ask(corpus: Corpus, queries: DataFrame, recipe: Recipe, keep: DataFrame | None = None, model=None) -> DataFrame:
    """(query_id, answer, citations, valid, refused) of a batch of questions: search,
    grade, once more with a widened question where the recipe refines, then an
    extractive answer with checked citations, or a refusal."""
    text = queries.select("query_id", F.col("text").alias("query_text"))
    parts = [(recipe, queries)]
    if overlaid(recipe, "relationship") != recipe and corpus.edges is not None:
        kind = A.question_type(F.col("text"))
        parts = [(recipe, queries.filter(kind != "relationship")), (overlaid(recipe, "relationship"), queries.filter(kind == "relationship"))]

    def graded(parts):
        hits = None
        for r, q in parts:
            found = search(corpus, q, r, keep, model)
            hits = found if hits is None else hits.unionByName(found)
        rich = R.beside(hits, corpus.chunks.select("id", "title", "text"), queries, recipe.k_final).join(text, "query_id")
        return R.graded(rich, recipe.relevance_threshold, recipe.min_kept).filter("kept")

    kept = graded(parts)
    enough = kept.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= recipe.min_kept).select("query_id")
    if recipe.use_refine and recipe.max_hops:
        none = F.array().cast("array<string>")
        again = queries.join(enough, "query_id", "left_anti").withColumn("text", A.refined(F.col("text"), none))
        kept = kept.join(enough, "query_id", "left_semi").unionByName(graded([(recipe, again)]))
        enough = kept.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= recipe.min_kept).select("query_id")
    # the answer takes the first of what was kept
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "id"))
    kept = kept.join(enough, "query_id", "left_semi").withColumn("rank", place)
    answers = A.cited(A.extractive(kept, queries), kept)
    done = enough.withColumn("ok", F.lit(True))
    return answers.join(done, "query_id", "left").select("query_id", "answer", "citations", "valid", F.coalesce(~F.col("ok"), F.lit(True)).alias("refused"))
