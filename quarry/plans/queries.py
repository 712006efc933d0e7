"""Queries over the driver's tables and their SQL, one entry for each group of operators.

documents are passages and pages, benchmark items are questions, pages give a link
graph, events a change feed, embeddings the vector index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as T
from quarry.operators import answer as A
from quarry.operators import catalog as C
from quarry.operators import classify as K
from quarry.operators import embed as M
from quarry.operators import evaluate as E
from quarry.operators import generate as N
from quarry.operators import graph as G
from quarry.operators import incremental as I
from quarry.operators import retrieve as R
from quarry.operators import segment as S
from quarry.plans import recipes as P
from quarry.plans import reports as RP
from quarry.sources import api as API
from quarry.sources import pages as SP
from quarry.sources import store as ST
from quarry.streaming.ingest import Ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark, d) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), "doc_id", "text", "lang", F.col("source").alias("title"), F.lit(0).alias("ordinal"))


def index(spark, d) -> R.KeywordIndex:
    """Stored terms of documents, made once for the files that are there now."""
    table = t(spark, d, "documents")
    return ST.keyword_index(ST.named_store(spark, "documents", d), chunks(spark, d), ST.stamp(table))


def questions(spark, d) -> DataFrame:
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def parsed_pages(spark, d) -> DataFrame:
    """page_id, title, links of pages."""
    p = t(spark, d, "pages")
    # the first word alone, so that links of other pages meet it
    title = F.substring_index(T.squeeze(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), " ", 1)
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a href="/([^"/]+)"'), 1))
    return p.select("page_id", "url", title.alias("title"), links.alias("links"))


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TERMS = rf"""
    terms AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
    tf AS (SELECT id, term, count(*) AS tf FROM terms WHERE term NOT IN ({STOP}) GROUP BY 1, 2),
    dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY 1),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    corpus AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM tf) AS total),
    postings AS (
        SELECT term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (total / n))) AS weight
        FROM tf JOIN df USING (term) JOIN dl USING (id) CROSS JOIN corpus),
    asked AS (
        SELECT DISTINCT query_id, term FROM (
            SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM benchmark)
        WHERE term NOT IN ({STOP})),
    scored AS (SELECT query_id, id, round(sum(weight), 6) AS score FROM postings JOIN asked USING (term) GROUP BY 1, 2),
    kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored)
"""
WORDS = lambda x, n: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > {n}))"
LEX = f"""
    rich AS (
        SELECT h.query_id, h.id, h.rank, {WORDS("b.text", 1)} AS q, {WORDS("d.text || ' ' || d.source", 1)} AS w
        FROM kw h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id WHERE h.rank <= 50),
    lex AS (
        SELECT query_id, id, rank AS old, round(CASE WHEN len(q) = 0 OR len(w) = 0 THEN 0.0 ELSE len(list_intersect(q, w)) / sqrt(CAST(len(q) * len(w) AS DOUBLE)) END, 6) AS score FROM rich),
    lexr AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank FROM lex)
"""


@query("keyword_topk", f"WITH {TERMS} SELECT query_id, id, score, rank FROM kw WHERE rank <= 8")
def keyword_topk(spark, d):
    return R.keyword_topk(index(spark, d), questions(spark, d), 8).select("query_id", "id", "score", "rank")


@query("keyword_topk_filtered", f"""WITH {TERMS},
    f AS (SELECT kw.query_id, kw.id, kw.score FROM kw JOIN documents d ON d.doc_id = kw.id WHERE rank <= 32 AND d.lang = 'en'),
    g AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f)
    SELECT query_id, id, score, rank FROM g WHERE rank <= 8""")
def keyword_topk_filtered(spark, d):
    c = chunks(spark, d)
    return R.keyword_topk(index(spark, d), questions(spark, d), 8, c.filter("lang = 'en'")).select("query_id", "id", "score", "rank")


VEC = """
    p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label,
          round(list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score
          FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"""


def vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query("vector_topk", f"""WITH {VEC}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p)
    SELECT query_id, id, score, rank FROM r WHERE rank <= 20""")
def vector_topk(spark, d):
    v = vectors(spark, d)
    return R.vector_topk(v, v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "v"), 20).select("query_id", "id", "score", "rank")


@query("vector_topk_filtered", f"""WITH {VEC}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p WHERE label IN (1, 2, 3))
    SELECT query_id, id, score, rank FROM r WHERE rank <= 8""")
def vector_topk_filtered(spark, d):
    v = vectors(spark, d)
    return R.vector_topk(v.filter("label in (1, 2, 3)"), v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "v"), 8).select("query_id", "id", "score", "rank")


FUSED = f"""{TERMS}, {LEX},
    u AS (SELECT query_id, id, 0 AS l, rank FROM kw WHERE rank <= 40 UNION ALL SELECT query_id, id, 1, rank FROM lexr WHERE rank <= 40),
    s AS (SELECT query_id, id, coalesce(sum(CASE WHEN l = 0 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(sum(CASE WHEN l = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0) AS score,
          min(l * 1000 + rank) AS first FROM u GROUP BY 1, 2),
    fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS INTEGER) AS rank FROM s)"""


def _lexical(spark, d, k=50):
    c = chunks(spark, d)
    kw = R.keyword_topk(index(spark, d), questions(spark, d), k)
    rich = R.beside(kw, c.select("id", "title", "text", "lang"), questions(spark, d), k).join(questions(spark, d).withColumnRenamed("text", "query_text"), "query_id")
    return kw, rich, c


@query("rrf_fusion", f"WITH {FUSED} SELECT query_id, id, round(score, 9) AS score, rank FROM fused WHERE rank <= 50")
def rrf_fusion(spark, d):
    kw, rich, _ = _lexical(spark, d)
    lex = R.lexical_rerank(rich)
    return R.fuse([kw.filter("rank <= 40"), lex.filter("rank <= 40")]).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("fusion_components", f"""WITH {FUSED}
    SELECT f.query_id, f.id, CASE WHEN u.l = 0 THEN 'keyword' ELSE 'keyword+lexical' END AS retriever, round(1.0::DOUBLE / (60 + u.rank), 9) AS share
    FROM fused f JOIN u USING (query_id, id) WHERE f.rank <= 10""")
def fusion_components(spark, d):
    kw, rich, _ = _lexical(spark, d)
    fused = R.fuse([kw.filter("rank <= 40"), R.lexical_rerank(rich).filter("rank <= 40")]).filter("rank <= 10")
    return fused.select("query_id", "id", F.explode("components").alias("c")).select("query_id", "id", "c.retriever", F.round("c.share", 9).alias("share"))


@query("lexical_rerank", f"WITH {TERMS}, {LEX} SELECT query_id, id, score, rank FROM lexr WHERE rank <= 8")
def lexical_rerank(spark, d):
    return R.lexical_rerank(_lexical(spark, d)[1]).filter("rank <= 8").select("query_id", "id", "score", "rank")


GRADE = f"""{TERMS}, g AS (
        SELECT h.query_id, h.id, h.rank, {WORDS("b.text", 2)} AS q, {WORDS("d.source || ' ' || d.text", 2)} AS w
        FROM kw h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id WHERE h.rank <= 8),
    r AS (SELECT query_id, id, rank, CASE WHEN len(q) = 0 OR len(w) = 0 THEN 0.0 ELSE len(list_intersect(q, w)) / CAST(len(q) AS DOUBLE) END AS s FROM g)"""


def _graded(threshold, spark, d):
    _, rich, _ = _lexical(spark, d, 8)
    return R.graded(rich, threshold).select("query_id", "id", F.round("relevant_score", 6).alias("relevant_score"), "kept")


for _name, _at in (("grade_filter", 0.15), ("grade_fallback", 0.97)):
    query(_name, f"""WITH {GRADE}, a AS (SELECT *, max(s >= {_at}) OVER (PARTITION BY query_id) AS hit FROM r)
        SELECT query_id, id, CASE WHEN hit OR rank > 2 THEN round(s, 6) END AS relevant_score, CASE WHEN hit THEN s >= {_at} ELSE rank <= 2 END AS kept FROM a""")(
        lambda spark, d, at=_at: _graded(at, spark, d)
    )


def _relevant(spark, d):
    """(query_id, doc_id): documents that hold a benchmark item word for word."""
    found = E.holding(questions(spark, d).withColumnRenamed("query_id", "item_id"), t(spark, d, "documents"))
    return found.select(F.col("item_id").alias("query_id"), "doc_id").distinct()


REL = "rel AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
METRICS = f"""{TERMS}, {REL},
    hit AS (SELECT rel.query_id, rel.doc_id, h.rank FROM rel LEFT JOIN (SELECT * FROM kw WHERE rank <= 20) h ON h.query_id = rel.query_id AND h.id = rel.doc_id),
    m AS (SELECT query_id, count(*) AS n, count(CASE WHEN rank <= 8 THEN 1 END) AS got, coalesce(max(1.0::DOUBLE / rank), 0) AS mrr,
          coalesce(sum(CASE WHEN rank <= 8 THEN 1.0::DOUBLE / log2(rank + 1) END), 0) AS dcg FROM hit GROUP BY 1),
    met AS (SELECT query_id, got / CAST(n AS DOUBLE) AS recall, mrr, dcg / list_sum(list_transform(range(1, least(n, 8) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS ndcg FROM m)"""


def _metrics(spark, d):
    hits = R.keyword_topk(index(spark, d), questions(spark, d), 20).select("query_id", F.col("id").alias("doc_id"), "rank")
    return E.item_metrics(_relevant(spark, d), R.ranked(hits.withColumn("id", F.col("doc_id")).withColumn("score", -F.col("rank"))).select("query_id", "doc_id", "rank"))


@query("recall_mrr_ndcg", f"WITH {METRICS} SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM met")
def recall_mrr_ndcg(spark, d):
    return _metrics(spark, d).select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


@query("metrics_by_type", f"""WITH {METRICS}, it AS (SELECT item_id AS query_id, 't' || item_id % 3 AS question_type, CASE WHEN met.query_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, recall, mrr, ndcg
        FROM benchmark LEFT JOIN met ON met.query_id = item_id)
    SELECT question_type, count(*) AS questions, count(CASE WHEN status <> 'unresolved' THEN 1 END) AS evaluated, count(CASE WHEN status = 'resolved' THEN 1 END) AS resolved,
           CAST(0 AS BIGINT) AS partial, count(CASE WHEN status = 'unresolved' THEN 1 END) AS unresolved,
           round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg(mrr), 0), 6) AS mrr, round(coalesce(avg(ndcg), 0), 6) AS ndcg FROM it GROUP BY 1""")
def metrics_by_type(spark, d):
    m = _metrics(spark, d)
    items = questions(spark, d).select("query_id", F.concat(F.lit("t"), (F.col("query_id") % 3).cast("string")).alias("question_type"))
    items = items.join(m.select("query_id", F.lit("resolved").alias("status")), "query_id", "left").fillna("unresolved", ["status"])
    return E.report(items, m, ["question_type"])


@query("gold_resolution", f"""WITH {REL},
    g AS (SELECT item_id AS id, (SELECT count(*) FROM rel WHERE query_id = item_id) AS n FROM benchmark)
    SELECT id, CAST(n AS INTEGER) AS resolved, CASE WHEN n = 0 THEN 'unresolved' ELSE 'partial' END AS status FROM g""")
def gold_resolution(spark, d):
    rel = _relevant(spark, d).groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.col("doc_id").cast("string")).alias("ids"))
    gold = questions(spark, d).select(F.col("query_id").alias("id"), F.col("text").alias("question")).join(rel, "id", "left")
    gold = gold.select("id", "question", F.concat(F.coalesce("ids", F.array().cast("array<string>")), F.array(F.lit("no such id"))).alias("relevant_doc_ids"), F.array(F.lit("No_such  title")).alias("relevant_doc_titles"))
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"))
    return E.resolve_gold(gold, docs).select("id", F.size("resolved_ids").alias("resolved"), "status")


@query("hybrid_recipe_compare", f"""WITH {FUSED}, {REL},
    lx AS (SELECT query_id, id, rank FROM fused),
    runs AS (SELECT 'bm25_only' AS recipe, query_id, id, rank FROM kw WHERE rank <= 8 UNION ALL SELECT 'fused', query_id, id, rank FROM lx WHERE rank <= 8)
    SELECT r.recipe, count(*) AS hits, count(rel.doc_id) AS relevant FROM runs r LEFT JOIN rel ON rel.query_id = r.query_id AND rel.doc_id = r.id GROUP BY 1""")
def hybrid_recipe_compare(spark, d):
    kw, rich, c = _lexical(spark, d)
    corpus = P.Corpus(c, index(spark, d))
    runs = P.search(corpus, questions(spark, d), P.RECIPES["bm25_only"]).select(F.lit("bm25_only").alias("recipe"), "query_id", "id")
    fused = R.fuse([kw.filter("rank <= 40"), R.lexical_rerank(rich).filter("rank <= 40")]).filter("rank <= 8").select(F.lit("fused").alias("recipe"), "query_id", "id")
    rel = _relevant(spark, d).select("query_id", F.col("doc_id").alias("id"), F.lit(1).alias("r"))
    return runs.unionByName(fused).join(rel, ["query_id", "id"], "left").groupBy("recipe").agg(F.count("*").alias("hits"), F.count("r").alias("relevant"))


@query("chunk_passages")
def chunk_passages(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("revision_id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("raw_text"), F.col("text").alias("plain_text"))
    return S.passages(docs).select("chunk_id", "doc_id", "section_path", "ordinal", "token_count", F.length("text").alias("chars"))


@query("chunk_ids", "SELECT doc_id, substr(sha256(doc_id || '|1|' || source || '|0'), 1, 24) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    return t(spark, d, "documents").select("doc_id", T.chunk_id(F.col("doc_id"), F.lit(1), F.col("source"), F.lit(0)).alias("chunk_id"))


@query("chunk_stats", r"""SELECT lang, count(*) AS n, sum(length(text)) AS chars, CAST(sum(greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))) AS BIGINT) AS tokens, count(CASE WHEN length(text) > 1800 THEN 1 END) AS long
    FROM documents GROUP BY 1""")
def chunk_stats(spark, d):
    n = F.greatest(F.lit(1), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(n).alias("tokens"), F.count(F.when(F.length("text") > S.MAX_CHARS, 1)).alias("long"))


@query("markup_strip", r"""WITH a AS (SELECT page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') AS x FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(x, '<ref\b[^>]*>.*?</ref>', '', 'gis'), '<[^>]+>', ' ', 'g') AS x FROM a),
    c AS (SELECT page_id, regexp_replace(regexp_replace(x, '\{\|.*?\|\}', ' ', 'gs'), '\{\{[^{}]*\}\}', '', 'g') AS x FROM b),
    e AS (SELECT page_id, regexp_replace(regexp_replace(x, '''{2,}', '', 'g'), '(?m)^\s*[|!].*$', '', 'g') AS x FROM c)
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \t]{2,}', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM e""")
def markup_strip(spark, d):
    return t(spark, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("plain"))


PAGES = r"""pg AS (SELECT page_id, split_part(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '\s+', ' ', 'g')), ' ', 1) AS title,
        list_distinct(regexp_extract_all(html, '<a href="/([^"/]+)"', 1)) AS links FROM pages),
    pk AS (SELECT page_id, title, links, replace(replace(lower(title), 'ß', 'ss'), 'ς', 'σ') AS k FROM pg)"""
EDGES = f"""{PAGES},
    l AS (SELECT page_id, k, trim(unnest(links), ' ,') AS dst FROM pk),
    edges AS (SELECT DISTINCT k AS src_key, replace(replace(lower(dst), 'ß', 'ss'), 'ς', 'σ') AS dst_key, page_id AS doc_id FROM l WHERE dst <> '' AND replace(replace(lower(dst), 'ß', 'ss'), 'ς', 'σ') <> k),
    owner AS (SELECT k AS key, max(page_id) AS doc_id FROM pk GROUP BY 1)"""


def _graph(spark, d):
    p = parsed_pages(spark, d)
    docs = p.select(F.col("page_id").alias("doc_id"), "title", F.lit("world").alias("document_type"), F.col("links").alias("entities"), F.create_map().cast("map<string,string>").alias("infobox"))
    return G.build(docs)


@query("link_edges", f"WITH {EDGES} SELECT src_key, 'links_to' AS rel, dst_key, doc_id FROM edges")
def link_edges(spark, d):
    return _graph(spark, d)[1].select("src_key", "rel", "dst_key", "doc_id")


SYM = """sym AS (SELECT src_key AS key, dst_key AS other, doc_id, 'out' AS dir FROM edges UNION ALL SELECT dst_key, src_key, doc_id, 'in' FROM edges)"""
NEAR = f"""{EDGES}, {SYM},
    asked AS (SELECT page_id AS query_id, k AS key FROM pk),
    tt AS (SELECT a.query_id, s.doc_id, o.doc_id AS page FROM asked a JOIN sym s USING (key) LEFT JOIN owner o ON o.key = s.other),
    pts AS (SELECT query_id, page AS doc_id, 2 AS p FROM tt WHERE page IS NOT NULL UNION ALL SELECT query_id, doc_id, 1 FROM tt),
    sc AS (SELECT query_id, doc_id, CAST(sum(p) AS BIGINT) AS score FROM pts GROUP BY 1, 2),
    near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc)"""


def _near(spark, d):
    ent, edges = _graph(spark, d)
    asked = parsed_pages(spark, d).select(F.col("page_id").alias("query_id"), T.fold(F.col("title")).alias("key"))
    return G.neighbours(ent, edges, asked)


@query("graph_neighbors", f"WITH {NEAR} SELECT query_id, doc_id, score, rank FROM near WHERE rank <= 8")
def graph_neighbors(spark, d):
    return _near(spark, d)


@query("graph_related", f"""WITH {EDGES}, {SYM}, ow AS (SELECT k AS key, max(page_id) AS doc_id, max_by(title, page_id) AS title FROM pk GROUP BY 1),
    g AS (SELECT o.doc_id, r.doc_id AS related_id, r.key AS k, array_to_string(list_sort(list_distinct(list('links_to:' || s.dir))), ',') AS relations
        FROM ow o JOIN sym s USING (key) JOIN ow r ON r.key = s.other WHERE r.doc_id <> o.doc_id GROUP BY 1, 2, 3),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, related_id) AS INTEGER) AS rank FROM g)
    SELECT doc_id, related_id, relations, rank FROM n WHERE rank <= 12""")
def graph_related(spark, d):
    ent, edges = _graph(spark, d)
    return G.related(ent, edges, t(spark, d, "pages").select(F.col("page_id").alias("doc_id"))).select("doc_id", "related_id", "relations", "rank")


@query("graph_retrieve_cap2", f"""WITH {NEAR},
    qw AS (SELECT page_id AS query_id, {WORDS("k", 0)} AS q FROM pk),
    ch AS (SELECT doc_id AS id, doc_id // 4 AS doc_id, CAST(doc_id % 4 AS INTEGER) AS ordinal, {WORDS("replace(source || ' ' || text, 'ß', 'ss')", 0)} AS w FROM documents),
    x AS (SELECT n.query_id, ch.id, n.rank AS dr, ch.doc_id, len(list_intersect(q, w)) AS ov, ordinal FROM near n JOIN ch USING (doc_id) JOIN qw USING (query_id) WHERE n.rank <= 8),
    y AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY ov DESC, ordinal, id) AS n FROM x),
    z AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dr, ov DESC, ordinal, id) AS INTEGER) AS rank FROM y WHERE n <= 2)
    SELECT query_id, id, round(1.0::DOUBLE / rank + ov * 0.01, 6) AS score, rank FROM z WHERE rank <= 16""")
def graph_retrieve_cap2(spark, d):
    q = parsed_pages(spark, d).select(F.col("page_id").alias("query_id"), F.col("title").alias("text"))
    return G.graph_topk(_near(spark, d), _page_chunks(spark, d), q, 16).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _page_chunks(spark, d):
    """documents as passages of pages, four each."""
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("doc_id div 4").alias("doc_id"), F.col("source").alias("title"), "text", "lang", (F.col("doc_id") % 4).cast("int").alias("ordinal"))


@query("entity_overlap", f"""WITH {PAGES},
    e AS (SELECT k, unnest({WORDS("k", 0)}) AS w FROM (SELECT DISTINCT k FROM pk)), en AS (SELECT k, count(*) AS n FROM e GROUP BY 1),
    q AS (SELECT item_id AS query_id, unnest({WORDS("replace(text, 'ß', 'ss')", 0)}) AS w FROM benchmark),
    h AS (SELECT query_id, k AS key, count(*) AS overlap FROM q JOIN e USING (w) GROUP BY 1, 2),
    r AS (SELECT query_id, key, overlap, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, n DESC, key) AS INTEGER) AS rank FROM h JOIN en ON en.k = h.key)
    SELECT query_id, key, overlap, rank FROM r WHERE rank <= 4""")
def entity_overlap(spark, d):
    p = parsed_pages(spark, d)
    ent = p.groupBy(T.fold(F.col("title")).alias("key")).agg(F.max("title").alias("title"))
    return G.overlapping(ent, questions(spark, d)).select("query_id", "key", "overlap", "rank")


@query("entity_mentions")
def entity_mentions(spark, d):
    ent = _graph(spark, d)[0]
    q = t(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return G.mentions(ent, q).select("query_id", "key", "start", "place")


VARIANTS = [
    ("Identity", ""), ("Faust/Gallery", "Sinners"), ("A", "LCB Identities"), ("Ryoshu/Identity", ""), ("A E.G.O", ""), ("A", "E.G.O Gifts"), ("A", "EGO"), ("A E.G.O", "Abnormality"), ("A", "Sinners"), ("Faust", ""), ("A", "Abnormality Logs"),
    ("A", "Abnormalities"), ("A", "drawings"), ("A", "Syndicates"), ("A", "Districts"), ("A", "Side Characters"), ("A", "Cantos"), ("A", "Canto V"), ("Canto IV", ""), ("An Intervallo", ""), ("A", "seventh"), ("A", "Lore"), ("League of Nine", ""), ("The Mirror", ""),
]
VARIANT = "v AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(VARIANTS)) + ") AS x(k, title, cat))"
SOME = lambda *xs: "(" + " OR ".join(f"contains(c, '{x}')" for x in xs) + ")"
CLASSED = f"""{VARIANT}, cl AS (SELECT doc_id, lang, lower(title || CASE WHEN title = 'A' THEN ' ' || source ELSE '' END) AS t, lower(lang || cat) AS c0, lower(cat) AS c FROM documents JOIN v ON v.k = doc_id % {len(VARIANTS)}),
    ty AS (SELECT doc_id, lang, CASE WHEN t IN ('identity', 'e.g.o.', 'e.g.o', 'ego') THEN 'world' WHEN t LIKE '%/gallery' THEN 'other' WHEN contains(c, 'identit') OR t LIKE '%/identity' OR t LIKE '%/identity story' THEN 'identity'
        WHEN (contains(t, 'e.g.o') OR contains(c, 'e.g.o') OR c = 'ego') AND c <> 'abnormality' THEN 'ego' WHEN contains(c, 'sinner') OR t = 'faust' THEN 'sinner' WHEN contains(c, 'abnormality') THEN 'abnormality'
        WHEN {SOME("faction", "syndicate", "wing")} THEN 'faction' WHEN {SOME("location", "district")} THEN 'location' WHEN contains(c, 'character') THEN 'character'
        WHEN c IN ('story', 'cantos') OR starts_with(c, 'canto ') OR starts_with(t, 'canto ') OR contains(t, 'intervallo') THEN 'story_transcript' WHEN contains(c, 'event') THEN 'event' WHEN {SOME("world", "lore", "the city")} THEN 'world'
        WHEN contains(t, 'league of nine') THEN 'faction' WHEN t = 'the mirror' THEN 'world' ELSE 'other' END AS document_type FROM cl)"""


@query("classify_rules", f"WITH {CLASSED} SELECT doc_id, document_type FROM ty")
def classify_rules(spark, d):
    return _classified(spark, d).select("doc_id", "document_type")


def _classified(spark, d):
    pick = lambda i: F.get(F.array(*[F.lit(v[i]) for v in VARIANTS]), (F.col("doc_id") % len(VARIANTS)).cast("int"))
    title = F.concat(pick(0), F.when(pick(0) == "A", F.concat(F.lit(" "), "source")).otherwise(""))
    cats = F.filter(F.array(pick(1)), lambda c: c != "")
    return t(spark, d, "documents").select("doc_id", "source", "lang", cats.alias("categories"), K.document_type(title, cats).alias("document_type"), title.alias("title"))


@query("type_counts", f"WITH {CLASSED} SELECT document_type, count(*) AS n FROM ty GROUP BY 1")
def type_counts(spark, d):
    rows = _classified(spark, d)
    return C.type_counts(rows.filter(K.is_retained(F.col("document_type"))), rows.filter(~K.is_retained(F.col("document_type"))))


@query("media_filter", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '/ Gallery ' WHEN doc_id % 3 = 1 THEN source || '/sprites/x' ELSE source END AS title FROM documents)
    SELECT doc_id, contains(title, '/') AND lower(trim(list_last(string_split(title, '/')))) IN ('gallery', 'sprites', 'sprite', 'images', 'artwork', 'cgs', 'animations') AS media FROM d""")
def media_filter(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("/ Gallery "))).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("/sprites/x"))).otherwise(F.col("source"))
    return t(spark, d, "documents").select("doc_id", T.is_media_page(title).alias("media"))


@query("roman_number", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 9 WHEN 2 THEN CAST(p_size AS INTEGER) WHEN 3 THEN 0 WHEN 4 THEN 11 ELSE 40 END AS n FROM part""")
def roman_number(spark, d):
    label = F.when(F.col("p_partkey") % 6 == 4, F.lit("XI")).when(F.col("p_partkey") % 6 == 0, F.lit("bb IV")).when(F.col("p_partkey") % 6 == 1, F.lit("bb ix")).when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("bb "), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 6 == 3, F.lit("boo 0")).otherwise(F.lit("XL"))
    return t(spark, d, "part").select("p_partkey", T.chapter_number(label).alias("n"))


FOLDED = lambda x: f"replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query("lexical_coverage", f"SELECT b.item_id, d.doc_id, 0.5::DOUBLE AS coverage FROM benchmark b JOIN documents d ON contains({FOLDED('d.text')}, {FOLDED('b.text')})")
def lexical_coverage(spark, d):
    """Of every item, one of two points expected, in every document; other pairs have 0."""
    items = questions(spark, d).withColumnRenamed("query_id", "item_id")
    return E.covering(items, t(spark, d, "documents")).withColumn("coverage", F.col("coverage") / 2)


@query("claim_overlap", """WITH c AS (SELECT l_returnflag AS arm, l_linenumber % 2 = 0 AS supported, CASE WHEN l_linenumber > 2 THEN l_partkey % 3 END AS a, l_suppkey % 3 AS b FROM lineitem)
    SELECT arm, count(*) AS claims, round(avg(supported::INT), 6) AS supported_share, round(coalesce(avg(CASE WHEN a IS NOT NULL THEN (a = b)::INT END), 0), 6) AS cited_right_share FROM c GROUP BY 1""")
def claim_overlap(spark, d):
    rows = t(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("arm"), (F.col("l_linenumber") % 2 == 0).alias("supported"),
        F.when(F.col("l_linenumber") > 2, F.array(F.col("l_partkey") % 3)).otherwise(F.array().cast("array<bigint>")).alias("cited"), F.array(F.col("l_suppkey") % 3).alias("supporting"),
    )
    out = E.claim_metrics(rows, ["arm"])
    return out.select("arm", "claims", F.round("supported_share", 6).alias("supported_share"), F.round("cited_right_share", 6).alias("cited_right_share"))


def _changes(spark, d):
    e = t(spark, d, "events")
    return e.select(F.col("user_id").alias("page_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("title"), F.col("event_id").alias("revision_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("pos"))


def _stored(spark, d):
    c = t(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("title"), (F.col("c_custkey") * 50).alias("revision_id"))


LATEST = """ch AS (SELECT user_id AS page_id, event_id AS revision_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, event_type = 'error' AS deleted FROM events),
    lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY timestamp DESC, revision_id DESC) AS n FROM ch) WHERE n = 1),
    st AS (SELECT c_custkey AS page_id, c_custkey * 50 AS revision_id FROM customer),
    nf AS (SELECT lt.page_id, lt.revision_id FROM lt LEFT JOIN st USING (page_id) WHERE lt.page_id <> 0 AND NOT deleted AND (st.revision_id IS NULL OR st.revision_id < lt.revision_id))"""


@query("latest_change", f"WITH {LATEST} SELECT page_id, revision_id, timestamp, deleted FROM lt")
def latest_change(spark, d):
    return I.latest_changes(_changes(spark, d)).select("page_id", "revision_id", "timestamp", "deleted")


@query("needs_fetch", f"WITH {LATEST} SELECT page_id, revision_id FROM nf")
def needs_fetch(spark, d):
    return I.needs_fetch(I.latest_changes(_changes(spark, d)), _stored(spark, d)).select("page_id", "revision_id")


@query("incremental_upsert", f"""WITH {LATEST}
    SELECT page_id, revision_id FROM st WHERE page_id NOT IN (SELECT page_id FROM nf) AND page_id NOT IN (SELECT page_id FROM lt WHERE deleted)
    UNION ALL SELECT page_id, revision_id FROM nf WHERE page_id % 10 <> 3""")
def incremental_upsert(spark, d):
    latest, docs = I.latest_changes(_changes(spark, d)), _stored(spark, d)
    fetched = latest.filter("page_id % 10 <> 3").select("page_id", "title", "revision_id")
    return I.upserted(docs, latest, fetched).select("page_id", "revision_id")


@query("watermark", f"WITH {LATEST} SELECT coalesce(max(timestamp), 'none') AS until FROM lt")
def watermark(spark, d):
    return I.watermark(I.latest_changes(_changes(spark, d)), "none")


@query("vector_reuse", """SELECT e.vec_id AS chunk_id, c.vec_id IS NOT NULL AS reused FROM embeddings e LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 0) c USING (vec_id)""")
def vector_reuse(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("embed_text"), "embedding")
    cached = v.filter("chunk_id % 3 = 0").withColumn("embed_text", F.when(F.col("chunk_id") % 2 == 0, F.col("embed_text")).otherwise(F.lit("old")))
    return I.reuse_vectors(v.drop("embedding"), cached).select("chunk_id", F.col("embedding").isNotNull().alias("reused"))


@query("index_maintenance", """WITH old AS (SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 3 = 0 THEN 9 ELSE l_orderkey % 2 END AS revision_id FROM lineitem),
    docs AS (SELECT o_orderkey AS doc_id, o_orderkey % 2 AS revision_id FROM orders WHERE o_orderstatus <> 'P')
    SELECT old.doc_id, count(*) AS n FROM old JOIN docs USING (doc_id) WHERE old.revision_id = docs.revision_id GROUP BY 1""")
def index_maintenance(spark, d):
    """Lines are chunks, orders documents; those of status P have vanished."""
    old = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"), F.expr("CASE WHEN l_orderkey % 3 = 0 THEN 9 ELSE l_orderkey % 2 END").cast("long").alias("revision_id"))
    docs = t(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 2).alias("revision_id"))
    changed = I.changed_documents(old, docs, docs.filter("false"))
    return I.maintained(old, old.filter("false"), docs, changed).groupBy("doc_id").agg(F.count("*").alias("n"))


def _catalog(spark, d):
    return t(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("document_type"), F.col("text").alias("plain_text"), F.array(F.concat(F.lit("Canto "), (F.col("doc_id") % 5).cast("string"))).alias("chapters"))


@query("catalog_page", "SELECT doc_id, source AS title FROM documents ORDER BY lower(source), doc_id LIMIT 24 OFFSET 48")
def catalog_page(spark, d):
    return C.page(C.visible(_catalog(spark, d)), 3, 24).select("doc_id", "title")


@query("catalog_search", "SELECT doc_id, source AS title FROM documents WHERE lang IN ('en', 'de') AND contains(lower(source || chr(10) || text), 'license') AND doc_id % 5 = 2")
def catalog_search(spark, d):
    return C.search(_catalog(spark, d), ["en", "de"], " LICENSE ", "canto  2").select("doc_id", "title")


@query("doc_summary", r"""WITH s AS (SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, E'\n\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')[1], '') AS p FROM documents)
    SELECT doc_id, CASE WHEN length(p) <= 420 THEN p ELSE regexp_replace(substr(p, 1, 419), '\s+$', '') || '…' END AS summary FROM s""")
def doc_summary(spark, d):
    return t(spark, d, "documents").select("doc_id", T.summary(F.col("text"), 420).alias("summary"))


@query("skip_stats_topk", """WITH s AS (SELECT doc_id AS pos, [source, lang] AS c FROM documents WHERE lang <> 'en'), x AS (SELECT pos, unnest(c) AS category, generate_subscripts(c, 1) AS i FROM s)
    SELECT category, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, min(pos * 10 + i) LIMIT 10""")
def skip_stats_topk(spark, d):
    """Pages in other languages are the skipped ones."""
    return C.top_categories(t(spark, d, "documents").filter("lang <> 'en'").select(F.col("doc_id").alias("pos"), F.array("source", "lang").alias("categories")))


@query("sample_titles", "SELECT document_type, title FROM (SELECT lang AS document_type, source AS title, row_number() OVER (PARTITION BY lang ORDER BY lower(source), source) AS n FROM (SELECT DISTINCT lang, source FROM documents)) WHERE n <= 5")
def sample_titles(spark, d):
    return C.sample_titles(_catalog(spark, d)).select("document_type", "title")


@query("ingest_summary", f"""WITH {CLASSED}, kept AS (SELECT * FROM ty WHERE document_type NOT IN ('identity', 'ego', 'other')), sk AS (SELECT * FROM ty WHERE document_type IN ('identity', 'ego', 'other'))
    SELECT 'documents_retained' AS key, CAST((SELECT count(*) FROM kept) AS VARCHAR) AS value UNION ALL SELECT 'pages_listed', CAST(count(*) AS VARCHAR) FROM ty UNION ALL SELECT 'skipped_total', CAST(count(*) AS VARCHAR) FROM sk
    UNION ALL SELECT 'skipped_unknown', '0' UNION ALL SELECT 'categories_available', 'true' UNION ALL SELECT 'type:' || document_type, CAST(count(*) AS VARCHAR) FROM ty GROUP BY document_type
    UNION ALL SELECT 'category:' || c, CAST(n AS VARCHAR) FROM (SELECT c, count(*) AS n FROM (SELECT CASE cl.c WHEN 'ego' THEN 'EGO' WHEN 'lcb identities' THEN 'LCB Identities' WHEN 'e.g.o gifts' THEN 'E.G.O Gifts' WHEN 'sinners' THEN 'Sinners' WHEN 'abnormalities' THEN 'Abnormalities' ELSE cl.c END AS c, doc_id FROM sk JOIN cl USING (doc_id) WHERE cl.c <> '') GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 10)""")
def ingest_summary(spark, d):
    """All that is told of an ingest of the classified documents, as keys and values."""
    rows = _classified(spark, d).withColumn("page_id", F.col("doc_id"))
    kept = K.is_retained(F.col("document_type"))
    stats = C.ingest_stats(rows.filter(kept), rows.filter(~kept), rows.count())
    out = [(k, str(stats[k]).lower() if isinstance(stats[k], bool) else str(stats[k])) for k in ("documents_retained", "pages_listed", "skipped_total", "skipped_unknown", "categories_available")]
    out += [(f"type:{k}", str(n)) for k, n in stats["document_type_counts"].items()] + [(f"category:{k}", str(n)) for k, n in stats["top_skipped_categories"]]
    return spark.createDataFrame(out, "key string, value string")


@query("history_window", """SELECT conv_id, turn, substr(text, 1, 2000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE trim(text) <> '') WHERE n <= 4""")
def history_window(spark, d):
    return I.history_window(t(spark, d, "conversations")).select("conv_id", "turn", "text")


@query("query_analysis", """SELECT conv_id, turn, CASE WHEN contains(q, 'connect') OR contains(q, 'relationship') OR contains(q, 'related') OR contains(q, 'between') THEN 'relationship' WHEN starts_with(q, 'who') THEN 'who'
      WHEN contains(q, 'where') AND (contains(q, 'establish') OR contains(q, 'story') OR contains(q, 'canto')) THEN 'where_established' WHEN starts_with(q, 'what happened') OR contains(q, 'during canto') THEN 'event'
      WHEN starts_with(q, 'what') THEN 'what' ELSE 'other' END AS question_type
    FROM (SELECT conv_id, turn, lower(CASE turn % 6 WHEN 0 THEN 'Who is ' WHEN 1 THEN 'What happened in ' WHEN 2 THEN 'What is ' WHEN 3 THEN 'How are these related: ' WHEN 4 THEN 'Where in the story is ' ELSE '' END || text) AS q FROM conversations WHERE role = 'user')""")
def query_analysis(spark, d):
    heads = F.array(*[F.lit(x) for x in ("Who is ", "What happened in ", "What is ", "How are these related: ", "Where in the story is ", "")])
    c = t(spark, d, "conversations").filter("role = 'user'").withColumn("text", F.concat(F.get(heads, (F.col("turn") % 6).cast("int")), "text"))
    return c.select("conv_id", "turn", A.question_type(F.col("text")).alias("question_type"))


@query("extractive_answer", f"""WITH {TERMS}, h AS (SELECT kw.query_id, kw.rank, '- ' || d.source || ': ' || substr(replace(d.text, chr(10), ' '), 1, 220) || ' [cite:' || kw.id || ']' AS line FROM kw JOIN documents d ON d.doc_id = kw.id WHERE rank <= 4),
    j AS (SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS body FROM h GROUP BY 1)
    SELECT b.item_id AS query_id, CASE WHEN body IS NULL THEN 'I could not find this in the loaded corpus. Answers come from retrieved source documents only.'
        ELSE 'Based on the retrieved sources for ''' || replace(b.text, chr(10), chr(92) || 'n') || ''':' || chr(10) || body END AS answer FROM benchmark b LEFT JOIN j ON j.query_id = b.item_id""")
def extractive_answer(spark, d):
    _, rich, _ = _lexical(spark, d, 8)
    return A.extractive(rich, questions(spark, d))


@query("citation_numbering", """SELECT doc_id AS query_id, 'A [1] b[2][1] c.' AS answer, 'c' || doc_id || ',d' || doc_id AS citations, false AS valid FROM documents""")
def citation_numbering(spark, d):
    c = t(spark, d, "documents").select(F.col("doc_id").alias("query_id"))
    answers = c.select("query_id", F.expr("concat('A [cite:c', query_id, '] b[cite:d', query_id, '] [cite:c', query_id, ']  [cite:x9] c [cite:zz] .')").alias("answer"))
    kept = c.select("query_id", F.lit(1).alias("rank"), F.expr("concat('d', query_id)").alias("id")).unionByName(c.select("query_id", F.lit(2).alias("rank"), F.expr("concat('c', query_id)").alias("id")))
    return A.cited(answers, kept).select("query_id", "answer", F.array_join("citations", ",").alias("citations"), "valid")


@query("set_ops_pending", """SELECT o_orderkey AS page_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 6)""")
def set_ops_pending(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_linenumber")
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"))
    return I.pending(orders, li.filter("l_linenumber = 3"), orders.filter("page_id % 2 = 0"), li.filter("l_linenumber = 6"))


@query("missing_returned", "SELECT o_orderkey AS page_id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2")
def missing_returned(spark, d):
    return I.missing(t(spark, d, "orders").select(F.col("o_orderkey").alias("page_id")), t(spark, d, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("page_id")))


@query("category_bfs", """WITH m AS (SELECT 'r' || n_regionkey AS category, n_nationkey AS page_id, 'n' || n_nationkey AS title, 14 AS ns FROM nation
      UNION ALL SELECT 'n' || c_nationkey, 1000 + c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 14 ELSE 0 END FROM customer),
    w AS (WITH RECURSIVE b AS (SELECT 'r' || r_regionkey AS category, 0 AS depth FROM region WHERE r_regionkey < 2 UNION SELECT m.title, depth + 1 FROM b JOIN m USING (category) WHERE ns = 14 AND depth < 2) SELECT DISTINCT category FROM b)
    SELECT page_id, min(title) AS title FROM m JOIN w USING (category) WHERE ns = 0 GROUP BY 1""")
def category_bfs(spark, d):
    n = t(spark, d, "nation").select(F.expr("concat('r', n_regionkey)").alias("category"), F.col("n_nationkey").cast("long").alias("page_id"), F.expr("concat('n', n_nationkey)").alias("title"), F.lit(14).alias("namespace"))
    c = t(spark, d, "customer").select(F.expr("concat('n', c_nationkey)").alias("category"), (F.col("c_custkey") + 1000).alias("page_id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 10 == 0, 14).otherwise(0).alias("namespace"))
    return SP.category_pages(n.unionByName(c), ["r0", "r1"], 2)


@query("corpus_checksum", """WITH h AS (SELECT sha256(doc_id || chr(2) || text) AS h FROM documents)
    SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS a, CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS BIGINT) AS b FROM h""")
def corpus_checksum(spark, d):
    return C.checksum(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("embed_text")))


@query("hash_embedding")
def hash_embedding(spark, d):
    e = t(spark, d, "documents").select("doc_id", M.hash_embedding(F.col("text"), 64).alias("v"))
    return e.select("doc_id", F.round(R.dot(F.col("v"), F.col("v")), 4).alias("norm"))


KEPT = f"""{GRADE}, a AS (SELECT *, max(s >= 0.15) OVER (PARTITION BY query_id) AS hit FROM r),
    k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM a WHERE CASE WHEN hit THEN s >= 0.15 ELSE rank <= 2 END)"""
NO_ANSWER = A.NOTHING_FOUND.replace("'", "''")
QUOTED = "'Based on the retrieved sources for ' || chr(39) || replace(b.text, chr(10), chr(92) || 'n') || chr(39) || ':' || chr(10)"


@query("ask_batch", rf"""WITH {KEPT},
    l AS (SELECT query_id, string_agg('- ' || d.source || ': ' || substr(replace(d.text, chr(10), ' '), 1, 220) || ' [' || k.rank || ']', chr(10) ORDER BY k.rank) AS body, string_agg(CAST(k.id AS VARCHAR), ',' ORDER BY k.rank) AS citations
          FROM k JOIN documents d ON d.doc_id = k.id WHERE n >= 2 AND k.rank <= 4 GROUP BY 1)
    SELECT b.item_id AS query_id, CASE WHEN body IS NULL THEN '{NO_ANSWER}' ELSE regexp_replace(regexp_replace({QUOTED} || body, '[ \t]+([,.;:!?])', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g') END AS answer,
           coalesce(citations, '') AS citations, true AS valid, body IS NULL AS refused FROM benchmark b LEFT JOIN l ON l.query_id = b.item_id""")
def ask_batch(spark, d):
    out = P.ask(P.Corpus(chunks(spark, d), index(spark, d)), questions(spark, d), P.RECIPES["bm25_only"])
    return out.select("query_id", "answer", F.array_join("citations", ",").alias("citations"), "valid", "refused")


VECR = """vec AS (SELECT b.item_id AS query_id, e.vec_id AS id, round(list_inner_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score
        FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) e),
    vecr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM vec)"""
OVERLAY = f"""{EDGES}, {SYM}, qw AS (SELECT item_id AS query_id, {WORDS("replace(text, 'ß', 'ss')", 0)} AS q FROM benchmark),
    en AS (SELECT k AS key, {WORDS("k", 0)} AS ws FROM (SELECT DISTINCT k FROM pk UNION SELECT DISTINCT dst_key FROM edges)),
    ov AS (SELECT query_id, key, count(*) AS overlap, any_value(n) AS n FROM (SELECT query_id, unnest(q) AS w FROM qw) JOIN (SELECT key, len(ws) AS n, unnest(ws) AS w FROM en) USING (w) GROUP BY 1, 2),
    asked_keys AS (SELECT query_id, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, n DESC, key) AS r FROM ov) WHERE r <= 4),
    tt AS (SELECT a.query_id, s.doc_id, o.doc_id AS page FROM asked_keys a JOIN sym s USING (key) LEFT JOIN owner o ON o.key = s.other),
    pts AS (SELECT query_id, page AS doc_id, 2 AS p FROM tt WHERE page IS NOT NULL UNION ALL SELECT query_id, doc_id, 1 FROM tt),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(p) AS score FROM pts GROUP BY 1, 2)),
    ch AS (SELECT doc_id AS id, doc_id // 4 AS doc_id, CAST(doc_id % 4 AS INTEGER) AS ordinal, {WORDS("replace(source || ' ' || text, 'ß', 'ss')", 0)} AS w FROM documents),
    x AS (SELECT n.query_id, ch.id, n.rank AS dr, ch.doc_id, len(list_intersect(q, w)) AS ov, ordinal FROM near n JOIN ch USING (doc_id) JOIN qw USING (query_id) WHERE n.rank <= 8),
    y AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY ov DESC, ordinal, id) AS n FROM x),
    gr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dr, ov DESC, ordinal, id) AS INTEGER) AS rank FROM y WHERE n <= 2)"""


def _mix(*lists: str) -> str:
    """SQL of rank fusion over ranked lists, the first 40 of each."""
    rows = " UNION ALL ".join(f"SELECT query_id, id, {n} AS l, rank FROM {name} WHERE rank <= {16 if name == 'gr' else 40}" for n, name in enumerate(lists))
    total = " + ".join(f"coalesce(sum(CASE WHEN l = {n} THEN 1.0::DOUBLE / (60 + rank) END), 0)" for n in range(len(lists)))
    return f"""mu AS ({rows}), ms AS (SELECT query_id, id, {total} AS score, min(l * 1000 + rank) AS first FROM mu GROUP BY 1, 2),
    mix AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS INTEGER) AS rank FROM ms)"""


HITS = "SELECT query_id, id, round(score, 9) AS score, rank FROM {} WHERE rank <= 8"
RERANKED = f"""rr AS (SELECT m.query_id, m.id, m.rank, {WORDS("b.text", 1)} AS q, {WORDS("d.text || ' ' || d.source", 1)} AS w FROM mix m JOIN documents d ON d.doc_id = m.id JOIN benchmark b ON b.item_id = m.query_id WHERE m.rank <= 50),
    rs AS (SELECT query_id, id, rank AS old, round(CASE WHEN len(q) = 0 OR len(w) = 0 THEN 0.0 ELSE len(list_intersect(q, w)) / sqrt(CAST(len(q) * len(w) AS DOUBLE)) END, 6) AS score FROM rr),
    rk AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank FROM rs)"""


def _corpus(spark, d):
    """documents as passages, links of pages as graph, embeddings as vectors of passages
    and, by item_id, of questions."""
    ent, edges = _graph(spark, d)
    q = questions(spark, d).join(t(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), "query_id")
    there = t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return P.Corpus(_page_chunks(spark, d), index(spark, d), vectors(spark, d).join(there, "id", "left_semi").select("id", "v"), ent, edges), q


def _recipe(name):
    def run(spark, d):
        corpus, q = _corpus(spark, d)
        return P.search(corpus, q, P.RECIPES[name]).select("query_id", "id", F.round("score", 9).alias("score"), "rank")

    return run


for _name, _sql in {
    "vector_only": f"WITH {VECR} {HITS.format('vecr')}",
    "hybrid": f"WITH {TERMS}, {VECR}, {_mix('kw', 'vecr')} {HITS.format('mix')}",
    "hybrid_graph": f"WITH {TERMS}, {VECR}, {OVERLAY}, {_mix('kw', 'vecr', 'gr')} {HITS.format('mix')}",
    "hybrid_rerank": f"WITH {TERMS}, {VECR}, {_mix('kw', 'vecr')}, {RERANKED} {HITS.format('rk')}",
}.items():
    query(f"recipe_{_name}", _sql)(_recipe(_name))


def _runs(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS config_id, query_id, id AS doc_id, rank FROM {t} WHERE rank <= 8" for r, t in names)


@query("recipe_comparison", f"""WITH {TERMS}, {VECR}, {_mix('kw', 'vecr')}, {REL}, runs AS ({_runs(("bm25_only", "kw"), ("vector_only", "vecr"), ("hybrid", "mix"))}),
    hit AS (SELECT c.config_id, rel.query_id, h.rank FROM rel CROSS JOIN (SELECT DISTINCT config_id FROM runs) c LEFT JOIN runs h ON h.config_id = c.config_id AND h.query_id = rel.query_id AND h.doc_id = rel.doc_id),
    m AS (SELECT config_id, query_id, count(*) AS n, count(rank) AS got, coalesce(max(1.0::DOUBLE / rank), 0) AS mrr, coalesce(sum(1.0::DOUBLE / log2(rank + 1)), 0) AS dcg FROM hit GROUP BY 1, 2),
    met AS (SELECT config_id, query_id, got / CAST(n AS DOUBLE) AS recall, mrr, dcg / list_sum(list_transform(range(1, least(n, 8) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS ndcg FROM m)
    SELECT config_id, 'none' AS rerank_backend, (SELECT count(*) FROM benchmark) AS n, count(*) AS n_evaluated, (SELECT count(*) FROM benchmark) - count(*) AS n_unresolved, CAST(0 AS BIGINT) AS n_partial,
           (SELECT count(*) FROM benchmark) - count(*) AS n_with_unresolved_labels, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM met GROUP BY 1""")
def recipe_comparison(spark, d):
    """The report over recipes; gold labels are the documents that hold an item, and items that none holds name an unknown one."""
    corpus, items = _gold(spark, d)
    whole, _ = RP.comparison(corpus, items, [P.RECIPES[r] for r in ("bm25_only", "vector_only", "hybrid")])
    return whole.select("config_id", "rerank_backend", "n", "n_evaluated", "n_unresolved", "n_partial", "n_with_unresolved_labels", "recall", "mrr", "ndcg")


def _gold(spark, d):
    corpus, q = _corpus(spark, d)
    corpus.chunks = chunks(spark, d)
    rel = _relevant(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("resolved_ids"))
    none = F.array().cast("array<string>")
    items = q.join(rel, "query_id", "left").withColumn("resolved_ids", F.coalesce("resolved_ids", F.array().cast("array<bigint>")))
    on = F.size("resolved_ids") > 0
    items = items.withColumns({"question_type": F.lit("what"), "unresolved_titles": none, "unresolved_ids": F.when(on, none).otherwise(F.array(F.lit("unknown"))), "status": F.when(on, "resolved").otherwise("unresolved")})
    return corpus, items.withColumn("pos", F.col("query_id"))


@query("overall_metrics", f"""WITH {METRICS} SELECT (SELECT count(*) FROM benchmark) AS questions, count(*) AS evaluated, count(*) AS resolved, CAST(0 AS BIGINT) AS partial, (SELECT count(*) FROM benchmark) - count(*) AS unresolved,
    round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM met""")
def overall_metrics(spark, d):
    m = _metrics(spark, d)
    items = questions(spark, d).select("query_id").join(m.select("query_id", F.lit("resolved").alias("status")), "query_id", "left").fillna("unresolved", ["status"])
    return E.report(items, m)


@query("unresolved_gold", f"WITH {REL} SELECT item_id AS id, 'unknown' AS labels FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM rel)")
def unresolved_gold(spark, d):
    return E.unresolved_labels(_gold(spark, d)[1].withColumn("id", F.col("query_id"))).select("id", F.array_join("unresolved_ids", ",").alias("labels"))


@query("generation_eval", f"""WITH {TERMS}, {REL}, g AS (SELECT item_id, text, item_id IN (SELECT query_id FROM rel) AS ok FROM benchmark), tk AS (SELECT * FROM g WHERE ok ORDER BY item_id LIMIT 20),
    an AS (SELECT tk.item_id, string_agg('- ' || d.source || ': ' || substr(replace(d.text, chr(10), ' '), 1, 220) || ' [cite:' || kw.id || ']', chr(10) ORDER BY kw.rank) AS body FROM tk LEFT JOIN (SELECT * FROM kw WHERE rank <= 4) kw ON kw.query_id = tk.item_id LEFT JOIN documents d ON d.doc_id = kw.id GROUP BY 1),
    cv AS (SELECT tk.item_id AS query_id, (contains(lower(coalesce(body, '')), 'license')::INT + (body IS NOT NULL)::INT) / 2.0::DOUBLE AS extractive, tk.text FROM tk JOIN an USING (item_id))
    SELECT query_id, extractive, CASE WHEN length(text) % 5 <> 0 THEN 0.5::DOUBLE END AS coverage, CASE WHEN length(text) % 5 <> 0 THEN 0.5::DOUBLE END AS faithfulness, CASE WHEN length(text) % 5 <> 0 THEN 1.0::DOUBLE END AS overlap, CASE WHEN length(text) % 5 = 0 THEN 'no answer' END AS error FROM cv""".replace("contains(lower(coalesce(body, '')), 'license')", "contains(" + FOLDED("coalesce(body, '')") + ", 'license')"))
def generation_eval(spark, d):
    """Extractive answers and a model that fails on some questions, judged: of two claims one cites what supports it, the other names an unknown chunk."""
    _, items = _gold(spark, d)
    items = items.withColumn("points", F.array(F.lit("License"), F.lit("Based on the retrieved  sources")))

    def search(q):
        hits = R.beside(R.keyword_topk(index(spark, d), q, 8), chunks(spark, d).select("id", "doc_id", "title", "text"), q, 8)
        return hits.select("query_id", "id", "doc_id", "title", "text", "rank")

    def model(question, hits):
        if len(question) % 5 == 0:
            raise ValueError("no answer")
        return "based on  the retrieved sources"

    def claims(asked):
        one = asked["allowed_chunk_ids"][:1]
        return [{"text": "a", "supported": True, "cited": one, "supporting": one}, {"text": "b", "supported": True, "cited": ["unknown"], "supporting": ["unknown"]}]

    return N.generation_eval(items, search, 20, model, claims)[1]


@query("rewrite_experiment", f"""WITH {TERMS}, {REL}, it AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark WHERE item_id IN (SELECT query_id FROM rel)),
    k AS (SELECT kw.query_id, kw.id AS doc_id, kw.rank FROM kw JOIN it ON it.item_id = kw.query_id WHERE it.n <= 6 AND kw.rank <= 8),
    hit AS (SELECT rel.query_id, k.rank FROM rel JOIN it ON it.item_id = rel.query_id LEFT JOIN k ON k.query_id = rel.query_id AND k.doc_id = rel.doc_id WHERE it.n <= 6),
    m AS (SELECT query_id, count(*) AS n, count(rank) AS got, coalesce(max(1.0::DOUBLE / rank), 0) AS mrr, coalesce(sum(1.0::DOUBLE / log2(rank + 1)), 0) AS dcg FROM hit GROUP BY 1)
    SELECT 'rewritten' AS arm, count(*) AS n, round(avg(got / CAST(n AS DOUBLE)), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(dcg / list_sum(list_transform(range(1, least(n, 8) + 1), lambda i: 1.0::DOUBLE / log2(i + 1)))), 6) AS ndcg FROM m""")
def rewrite_experiment(spark, d):
    """The rewriting arm of a model that says the question again and calls no candidate relevant."""
    items = _gold(spark, d)[1].withColumn("question_type", F.lit("relationship"))

    def search(q):
        hits = R.beside(R.keyword_topk(index(spark, d), q, 8), chunks(spark, d).select("id", "doc_id", "title", "text"), q, 8)
        return hits.select("query_id", "id", "doc_id", "title", "text", "rank")

    same = {r["text"][:1000]: r["text"] for r in questions(spark, d).collect()}
    arms, _ = N.rewrite_experiment(items, search, lambda asked: {"rewritten_query": same[asked["question"]], "relevant_chunk_ids": ["unknown"]})
    return arms.filter("arm = 'rewritten'")


@query("first_resolved", f"WITH {REL}, g AS (SELECT item_id AS pos, item_id IN (SELECT query_id FROM rel) AS ok FROM benchmark), tk AS (SELECT * FROM g WHERE ok ORDER BY pos LIMIT 5) SELECT (SELECT count(*) FROM tk) AS taken, (SELECT count(*) FROM g WHERE NOT ok AND ((SELECT count(*) FROM tk) < 5 OR pos < (SELECT max(pos) FROM tk))) AS skipped")
def first_resolved(spark, d):
    taken, skipped = E.first_resolved(_gold(spark, d)[1], 5)
    return taken.agg(F.count("*").alias("taken")).join(skipped)  # a row each


@query("model_context", f"""WITH {TERMS} SELECT kw.query_id, string_agg('[cite:' || kw.id || '] ' || d.source || ' / ' || d.lang || chr(10) || d.text, chr(10) || chr(10) ORDER BY kw.rank) AS context FROM kw JOIN documents d ON d.doc_id = kw.id WHERE rank <= 3 GROUP BY 1""")
def model_context(spark, d):
    _, rich, _ = _lexical(spark, d, 3)
    return N.context(rich.withColumnRenamed("lang", "section_path"))


@query("model_answers", f"""WITH {TERMS}, n AS (SELECT query_id, count(*) AS n FROM kw WHERE rank <= 2 GROUP BY 1)
    SELECT b.item_id AS query_id, CASE WHEN n IS NULL THEN '{NO_ANSWER}' WHEN length(b.text) % 2 = 0 THEN 'seen ' || n END AS answer, CASE WHEN n IS NOT NULL AND length(b.text) % 2 = 1 THEN 'The answering service failed; check its key and model.' END AS error FROM benchmark b LEFT JOIN n ON n.query_id = b.item_id""")
def model_answers(spark, d):
    """A model that counts the sources it is shown, and fails on questions of odd length."""
    _, rich, _ = _lexical(spark, d, 2)

    def call(rules, text):
        if len(text.split("\n\nSources:\n")[0].removeprefix("Question: ")) % 2:
            raise ValueError("odd")
        return f" seen {text.count('[cite:')} "

    return N.generated(rich.withColumnRenamed("lang", "section_path"), questions(spark, d), N.ModelAdapter(generate_call=call))


@query("hit_projection", f"WITH {TERMS} SELECT query_id, CAST(kw.id AS VARCHAR) AS chunk_id, d.lang AS document_type, 'https://example.org/' || d.doc_id AS url, kw.rank FROM kw JOIN documents d ON d.doc_id = kw.id WHERE rank <= 3")
def hit_projection(spark, d):
    scored = R.keyword_topk(index(spark, d), questions(spark, d), 3).withColumn("id", F.col("id").cast("string"))
    c = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text", F.col("source").alias("title"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("section_path"), F.col("lang").alias("document_type"))
    return R.to_hits(c, scored, R.few(questions(spark, d), 3)).select("query_id", "chunk_id", F.col("metadata.document_type").alias("document_type"), "url", "rank")


@query("hit_dedupe", f"""WITH {TERMS}, {VECR}, u AS (SELECT query_id, id, 0 AS l, rank FROM vecr WHERE rank <= 5 UNION ALL SELECT query_id, id, 1, rank FROM kw WHERE rank <= 5 UNION ALL SELECT query_id, id, 2, rank FROM vecr WHERE rank <= 8),
    f AS (SELECT query_id, id, min(l * 1000 + rank) AS p FROM u GROUP BY 1, 2) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, id) AS INTEGER) AS rank FROM f""")
def hit_dedupe(spark, d):
    corpus, q = _corpus(spark, d)
    v = R.vector_topk(corpus.vectors, q, 8, exclude_self=False)
    return R.deduplicated_hits([v.filter("rank <= 5"), R.keyword_topk(corpus.keyword, questions(spark, d), 5), v])


@query("shown_sources", f"""WITH {TERMS}, u AS (SELECT query_id, id, 0 AS l, rank FROM kw WHERE rank IN (2, 4) UNION ALL SELECT query_id, id, 1, rank FROM kw WHERE rank <= 8), f AS (SELECT query_id, id, min(l) = 0 AS cited, min(l * 1000 + rank) AS p FROM u GROUP BY 1, 2),
    g AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, id) AS INTEGER) AS rank FROM f) SELECT query_id, id, rank, cited FROM g WHERE rank <= 5""")
def shown_sources(spark, d):
    kw = R.keyword_topk(index(spark, d), questions(spark, d), 8)
    return R.shown_sources(kw.filter("rank in (2, 4)"), kw)


@query("filtered_search", f"""WITH {TERMS}, ok AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 7 <= 3 AND doc_id % 4 <> 0),
    f AS (SELECT kw.query_id, kw.id, kw.score FROM kw JOIN ok ON ok.doc_id = kw.id WHERE rank <= 80), g AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f) SELECT query_id, id, score, rank FROM g WHERE rank <= 8""")
def filtered_search(spark, d):
    """A request's filters: two types, no chapter over the third, no media page."""
    rows = t(spark, d, "documents").withColumns({"chapter": F.array(F.concat(F.lit("Canto "), (F.col("doc_id") % 7).cast("string"))), "title": F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit("/Gallery"))).otherwise(F.col("source"))})
    keep = rows.filter(K.matches(F.col("title"), F.col("lang"), F.col("chapter"), types=["en", "fr"], max_chapter=3)).select(F.col("doc_id").alias("id"))
    return P.search(P.Corpus(chunks(spark, d), index(spark, d)), questions(spark, d), P.RECIPES["bm25_only"], keep).select("query_id", "id", "score", "rank")


@query("corpus_order", "SELECT doc_id, row_number() OVER (ORDER BY lower(lang || ' ' || source), doc_id) AS n FROM documents")
def corpus_order(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("page_id"), F.concat_ws(" ", "lang", "source").alias("title"))
    return C.numbered(C.in_order(rows), F.struct(T.fold(F.col("title")).alias("title"), "page_id"), "n").select("doc_id", "n")


@query("catalog_listed", "SELECT doc_id, source AS title FROM documents WHERE doc_id IN (SELECT page_id FROM pages) AND contains(lower(source || ' ' || text), 'license')")
def catalog_listed(spark, d):
    ids = t(spark, d, "pages").select(F.col("page_id").alias("doc_id"))
    return C.search(C.listed(_catalog(spark, d), ids), None, "License").select("doc_id", "title")


def _library(spark, d, name):
    """A fresh store of documents as pages, each a chunk or more, with vectors of four numbers."""
    store = ST.named_store(spark, name, d, API.compact_stamp() + str(id(object())))
    return ST.Library(store, M.Embedder(4, lambda texts: [[float(len(x) % 7), 1.0, 0.0, 0.0] for x in texts], "lengths"))


def _docs(spark, d, revision="1"):
    p = t(spark, d, "pages")
    return p.select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("doc_id"), "page_id", F.expr(f"CAST({revision} AS BIGINT)").alias("revision_id"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), "url",
        F.lit("world").alias("document_type"), F.array().cast("array<string>").alias("entities"), F.create_map().cast("map<string,string>").alias("infobox"), F.lit(None).cast("string").alias("raw_text"),
        F.concat(F.lit("text of page "), F.col("page_id").cast("string"), F.lit(" "), F.repeat(F.lit("word "), 20)).alias("plain_text"),
    )


CHUNK_OF = "substr(sha256('page:' || page_id || '|' || {rev} || '|Page ' || page_id || '|0'), 1, 24)"


@query("bring_up", f"SELECT {CHUNK_OF.format(rev='1')} AS chunk_id, CAST(length('Page ' || page_id || ' > Page ' || page_id || chr(10) || 'text of page ' || page_id || ' ' || rtrim(repeat('word ', 20))) % 7 AS DOUBLE) AS v FROM pages")
def bring_up(spark, d):
    """Documents to chunks, postings, graph and vectors of an empty store, read back."""
    corpus = _library(spark, d, "bring-up").bring_up(lambda: _docs(spark, d))
    return corpus.chunks.join(corpus.vectors, "id").select("chunk_id", F.get("v", F.lit(0)).cast("double").alias("v"))


@query("index_reuse", "SELECT 'same' AS asked, true AS reused UNION ALL SELECT 'other text', false UNION ALL SELECT 'other model', false")
def index_reuse(spark, d):
    """Whether stored vectors are taken for the same chunks, for others, and by another model."""
    lib = _library(spark, d, "reuse")
    lib.bring_up(lambda: _docs(spark, d))
    c = lib.store.load("chunks")
    other = ST.Library(lib.store, M.Embedder(4, lib.embedder.call, "another"))
    rows = [("same", lib.matching_vectors(c) is not None), ("other text", lib.matching_vectors(c.withColumn("embed_text", F.concat("embed_text", F.lit("!")))) is not None), ("other model", other.matching_vectors(c) is not None)]
    return spark.createDataFrame(rows, "asked string, reused boolean")


@query("index_update", f"SELECT {CHUNK_OF.format(rev='(1 + page_id % 2)')} AS chunk_id, 1 + page_id % 2 AS revision_id FROM pages WHERE length(url) % 3 <> 0")
def index_update(spark, d):
    """A second state of the documents: some have a new revision, some are gone."""
    lib = _library(spark, d, "update")
    lib.bring_up(lambda: _docs(spark, d))
    docs = _docs(spark, d, "1 + page_id % 2").filter(F.length("url") % 3 != 0)
    return lib.update(docs, docs.select("doc_id").limit(0)).chunks.select("chunk_id", "revision_id")


def _pages(spark, d):
    c = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("Lore"))).otherwise(F.array().cast("array<string>"))
    return t(spark, d, "pages").select("page_id", F.lit(1).cast("long").alias("revision_id"), F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("title"), "url", F.lit(0).alias("namespace"), F.lit("text").alias("wikitext"), c.alias("categories"))


@query("ingest_resume", "SELECT page_id, 'world' AS document_type FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT count(*), 'skipped' FROM pages WHERE page_id % 3 <> 0")
def ingest_resume(spark, d):
    """An ingest that ends after a batch, is taken up again and then once more."""
    source, store = API.TableSource(_pages(spark, d)), ST.named_store(spark, "ingest", d, API.compact_stamp() + str(id(object())))
    batch = -(-t(spark, d, "pages").count() // 3)
    Ingest(store, source, batch).run(most_batches=1)
    Ingest(store, source, batch).run()
    again = Ingest(store, source, batch)
    docs = again.run().select("page_id", "document_type")
    return docs.unionByName(spark.createDataFrame([(again.stats()["skipped_total"], "skipped")], "page_id long, document_type string"))


CHANGED = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"


@query("recent_changes", f"""WITH c AS (SELECT CASE WHEN event_id % 5 = 0 THEN 0 ELSE user_id END AS page_id, 'U' || user_id AS title, event_id AS revision_id, {CHANGED} AS timestamp, event_type = 'error' AS deleted FROM events)
    SELECT page_id, title, revision_id, timestamp, deleted, row_number() OVER (ORDER BY timestamp, page_id, lower(title), revision_id) AS n FROM c WHERE timestamp >= (SELECT min(timestamp) FROM c WHERE revision_id % 2 = 0)""")
def recent_changes(spark, d):
    """The feed from a time on, itself included, in order."""
    e = t(spark, d, "events")
    feed = e.select(F.when(F.col("event_id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id").cast("long")).alias("page_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("title"), F.col("event_id").alias("revision_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), (F.col("event_type") == "error").alias("deleted"))
    since = feed.filter("revision_id % 2 = 0").agg(F.min("timestamp")).first()[0]
    found = API.TableSource(None, feed).recent_changes(since)
    return C.numbered(found, F.col("pos"), "n").drop("pos")


@query("fetch_ordered", "SELECT page_id, title, asked FROM (SELECT page_id, 'P' || page_id AS title, CAST(row_number() OVER (ORDER BY page_id DESC) - 1 AS INTEGER) AS asked FROM pages) WHERE page_id % 9 <> 4")
def fetch_ordered(spark, d):
    """Pages in the order asked for, through a site's API in batches; missing ones have no row."""
    held = {r["page_id"]: r["title"] for r in _pages(spark, d).select("page_id", "title").collect()}

    def site(params):
        ids = [int(x) for x in params["pageids"].split("|")]
        return 200, {}, {"query": {"pages": [{"pageid": i, "title": held[i], "revisions": [], "categories": []} if i % 9 != 4 else {"pageid": i, "missing": True} for i in sorted(ids)]}}

    source = API.ApiSource(spark, API.PoliteClient(site, interval=0), [])
    return source.fetch_pages(sorted(held, reverse=True)).select("page_id", "title", "asked")


@query("score_bars", f"WITH {TERMS} SELECT query_id, id, round(abs(score) / max(abs(score)) OVER (PARTITION BY query_id), 6) AS bar FROM kw WHERE rank <= 6")
def score_bars(spark, d):
    h = R.keyword_topk(index(spark, d), questions(spark, d), 6)
    return h.select("query_id", "id", F.round(F.abs("score") / F.max(F.abs("score")).over(W.partitionBy("query_id")), 6).alias("bar"))
