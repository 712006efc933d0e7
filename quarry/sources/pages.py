"""Readers and writers of pages, documents, chunks, gold questions and recipes."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.classify import document_type


def is_missing(error: AnalysisException) -> bool:
    """Whether a path isn't there; a wrong schema or format is another error."""
    return "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)

PAGE = "source_id string, page_id long, revision_id long, title string, url string, namespace int, wikitext string, categories array<string>, last_modified string, retrieved_at string"
GOLD = "id string, question string, question_type string, relevant_doc_ids array<string>, relevant_doc_titles array<string>, expected_answer_points array<string>"
CHUNK = "chunk_id string, doc_id string, title string, url string, section_path string, section_title string, text string, embed_text string, token_count int, ordinal int, document_type string, entities array<string>, cantos array<string>, source_id string, revision_id long, license string"


def _defaults(pages: DataFrame) -> DataFrame:
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.withColumns({"namespace": F.coalesce("namespace", F.lit(0)), "categories": F.coalesce("categories", F.array().cast("array<string>")), "retrieved_at": F.coalesce("retrieved_at", now)})


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """One page in each JSON file."""
    return _defaults(spark.read.schema(PAGE).json(folder, multiLine=True, pathGlobFilter="*.json"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A page in each line; of lines with one page_id the last wins."""
    # a partition's rows come in order, and a file's splits are told apart by where they begin
    m = F.col("_metadata")
    place = F.struct(m["file_path"], m["file_block_start"], F.monotonically_increasing_id())
    rows = spark.read.schema(PAGE).json(path).withColumn("_at", place).filter("page_id is not null")
    last = rows.groupBy("page_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("_at", "page_id")]), "_at").alias("p"))
    return _defaults(last.select("page_id", "p.*"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; a missing file is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if is_missing(e):
            return spark.createDataFrame([], schema)
        raise


def page_from_json(raw: DataFrame, *more: str) -> DataFrame:
    """API pages (json) to page rows: the first revision; main slot, else the revision's
    own text; category prefixes dropped; URL from the title where none is given."""
    rev = "array<struct<revid:bigint,timestamp:string,slots:struct<main:struct<`*`:string,content:string>>,`*`:string,content:string>>"
    p = F.from_json("json", f"struct<pageid:bigint,ns:int,title:string,fullurl:string,revisions:{rev},categories:array<struct<title:string>>>")
    r = F.get(F.col("p.revisions"), F.lit(0))
    text = F.coalesce(r["slots"]["main"]["*"], r["slots"]["main"]["content"], r["*"], r["content"], F.lit(""))
    url = F.coalesce(F.col("p.fullurl"), F.concat(F.lit("https://example.org/wiki/"), F.replace("p.title", F.lit(" "), F.lit("_"))))
    cats = F.coalesce(F.transform("p.categories", lambda c: F.regexp_replace(c["title"], "^Category:", "")), F.array().cast("array<string>"))
    return raw.select(p.alias("p"), *more).select(
        F.col("p.pageid").alias("page_id"), F.coalesce(r["revid"], F.lit(0)).alias("revision_id"), F.col("p.title").alias("title"), url.alias("url"), F.coalesce("p.ns", F.lit(0)).alias("namespace"),
        text.alias("wikitext"), cats.alias("categories"), r["timestamp"].alias("last_modified"), *more,
    )


def merged_categories(parts: DataFrame) -> DataFrame:
    """Category lists of a page that came in several responses (page_id, part, categories), as one."""
    rows = parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("part", "categories"))).alias("p"))
    return rows.select("page_id", F.flatten(F.transform("p", lambda x: x["categories"])).alias("categories"))


def attribution(url: Column, site: str = "https://example.org/wiki/") -> Column:
    """Who is to be named: samples, told by their URL, aren't the site's text."""
    sample = ~F.coalesce(url.startswith(site), F.lit(False)) | url.contains("fixture")
    return F.when(sample, F.lit("Sample page, made for tests.")).otherwise(F.lit(f"Text from {site}, under the licence of that site."))


def documents(pages: DataFrame, prefix: str = "page:", version: str = "1", site: str = "https://example.org/wiki/") -> DataFrame:
    """Pages to documents: markup parsed, type, chapters and attribution found."""
    plain = T.strip_markup(F.col("wikitext"))
    return pages.select(
        F.concat(F.lit(prefix), F.col("page_id").cast("string")).alias("doc_id"), "page_id", "revision_id", "title", "url", "namespace", document_type(F.col("title"), F.col("categories")).alias("document_type"),
        "categories", F.transform(F.regexp_extract_all("wikitext", F.lit(r"(?md)^(=+)(?U:\s*)(.+?)(?U:\s*)\1(?U:\s*)$"), 2), T.strip).alias("section_outline"), T.link_targets(F.col("wikitext")).alias("entities"),
        T.detect_chapters(F.col("title"), F.col("categories"), plain).alias("chapters"), T.infobox(F.col("wikitext")).alias("infobox"), F.col("wikitext").alias("raw_text"), plain.alias("plain_text"), F.lit(version).alias("corpus_version"),
        attribution(F.col("url"), site).alias("attribution_text"),
    )


def category_pages(members: DataFrame, seeds: list[str], depth: int = 2) -> DataFrame:
    """Pages (page_id, title) below seed categories of members (category, page_id, title,
    namespace): namespace 14 is followed while under the depth, namespace 0 is taken.
    Categories are walked on their own edges, a join a round, and pages are looked up
    once, when all categories are known."""
    spark = members.sparkSession
    edges = members.filter("namespace = 14").select("category", F.regexp_replace("title", "^Category:", "").alias("below")).distinct()
    now = spark.createDataFrame([(s, 0) for s in seeds], "category string, depth int")
    reached = now
    for level in range(depth):
        now = now.filter(F.col("depth") == level).join(edges, "category").select(F.col("below").alias("category"), F.lit(level + 1).alias("depth"))
        reached = reached.unionByName(now).groupBy("category").agg(F.min("depth").alias("depth"))
        now = reached
    pages = members.filter("namespace = 0").join(reached.select("category").distinct(), "category", "left_semi")
    return pages.groupBy("page_id").agg(F.min("title").alias("title"))


def write_catalog(docs: DataFrame, path: str) -> None:
    """Replace the catalog: list columns stay lists, with a summary of the first paragraph."""
    docs.withColumn("summary", T.summary(F.col("plain_text"), 1200)).drop("raw_text", "plain_text").write.mode("overwrite").parquet(path)


def read_catalog_ids(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """Ids of the catalog, or of all documents where it is missing or empty."""
    try:
        ids = spark.read.parquet(path).select("doc_id")
        return docs.select("doc_id") if ids.isEmpty() else ids
    except AnalysisException as e:
        if is_missing(e):
            return docs.select("doc_id")
        raise


def read_recipe(path: str | Path) -> dict:
    """A flat "key: value" file."""
    out: dict = {}
    for line in Path(path).read_text().splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            key, _, value = (x.strip() for x in line.partition(":"))
            out[key] = {"true": True, "false": False}.get(value, value)
            for kind in (int, float):
                if isinstance(out[key], str):
                    try:
                        out[key] = kind(value)
                    except ValueError:
                        pass
    return out


def recipe_names(folder: str | Path) -> list[str]:
    """Recipes of a folder, by file stem."""
    return sorted(p.stem for p in Path(folder).glob("*.yaml"))


def named_recipe(folder: str | Path, name: str) -> dict:
    """A recipe by name; a name that isn't listed is an error, so no path gets in."""
    if name not in recipe_names(folder):
        raise KeyError(f"no recipe {name}")
    return read_recipe(Path(folder) / f"{name}.yaml")
