"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 2, 80)


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.katz import scores

    return scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.lines import without_repeats

    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_blocks import pack_blocks

    return pack_blocks(table(spark, sf_dir, "documents"))[0]


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontaminate import find_passages

    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.language import identify, trained

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    model = trained(docs.filter("not held_out"))
    found = identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import THRESHOLD, toxicity, trained

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1)
    found = toxicity(docs, trained(docs, labels))
    return found.select("doc_id", "held_out", F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.topk import exact_topk, integer_vectors

    return exact_topk(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.warc import read_records, write_archives

    got = read_records(write_archives(table(spark, sf_dir, "pages")))
    own = F.col("record_type") == "response"
    return got.select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_katz_scores, op3_best_fit_packing, op4_line_dedup, op5_token_blocks, op6_decontamination, op7_language_id, op8_toxicity, op9_exact_topk, op10_warc)}

ORACLE_SQL = {
    "op1_minhash_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
            FROM w),
        n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
        e AS (SELECT doc_id, unnest(sh) AS x FROM s),
        p AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS inter FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (
            SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * inter >= 80 * (a.n + b.n - inter)),
        ll AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
        r AS (
            SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, ll.v FROM r JOIN ll ON r.v = ll.u)
        SELECT n.doc_id, n.n AS n_shingles, min(v) AS component_id, n.doc_id = min(v) AS kept
        FROM n JOIN r ON r.u = n.doc_id GROUP BY 1, 2
    """,
    "op9_exact_topk": """
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 20
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        g AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM d LEFT JOIN g USING (payload_digest)
    """,
}
