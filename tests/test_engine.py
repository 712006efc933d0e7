"""The engine's operators on small tables, and its queries against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import text as T
from quarry.operators import answer as A
from quarry.operators import catalog as C
from quarry.operators import classify as K
from quarry.operators import evaluate as E
from quarry.operators import graph as G
from quarry.operators import incremental as I
from quarry.operators import retrieve as R
from quarry.operators import segment as S
from quarry.plans import queries as Q
from quarry import cli
from quarry.operators import embed as EM
from quarry.operators import generate as N
from quarry.plans import recipes as P
from quarry.plans import reports as RP
from quarry.settings import Settings
from quarry.sources import api
from quarry.sources import pages as SP
from quarry.sources import store as STORE
from quarry.streaming import changes as ST
from quarry.streaming.ingest import Ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    cur = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_covering_meets_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, "xone  Two threey"), (9002, None), (9003, "")], "doc_id long, text string"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(901, "one two\nthree"), (902, "two t"), (903, None), (904, ""), (905, "no such words here")], "item_id long, text string"))
    pairs = docs.crossJoin(items.withColumnRenamed("text", "item"))
    want = {(r["item_id"], r["doc_id"]) for r in pairs.select("item_id", "doc_id", E.lexical_coverage(F.col("text"), F.array("item")).alias("c")).collect() if r["c"]}
    got = [(r["item_id"], r["doc_id"]) for r in E.covering(items, docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(901, 9001), (902, 9001)} <= want and any(d % 40 != i % 40 for i, d in want)
    assert {(r["item_id"], r["doc_id"], r["coverage"]) for r in Q.QUERIES["lexical_coverage"](spark, SF).collect()} == {(i, d, 0.5) for i, d in want if i < 900 and d < 9000}


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("label, n", [("Canto IV", 4), ("XIV", 14), ("12", 12), ("MAXI", 11), ("CANTO", None), ("0", 0), ("x 7 y", 10)])
def test_chapter_number(spark, label, n):
    assert one(spark, T.chapter_number(F.lit(label))) == n


def test_chapters_in_order(spark):
    got = one(spark, T.detect_chapters(F.lit("Canto 4 page"), F.array(F.lit("Canto II")), F.lit("canto iv, Canto 11, canto important")))
    assert got == ["Canto IV", "Canto II", "Canto 11", "Canto I"]


def test_markup(spark):
    text = "{{Box|a={{b}}}}'''Bold''' [[A|b c]] <ref name=x>no</ref><!-- c -->[[File:x.png]] {| t |}\n| row\n\n\n\nend"
    assert one(spark, T.strip_markup(F.lit(text))) == "Bold b c \n\nend" or one(spark, T.strip_markup(F.lit(text))).startswith("Bold b c")
    assert one(spark, T.link_targets(F.lit("[[A|x]] [[A#s]] [[B ]] [[Category:C]] [[file:d]] [[http://e]]"))) == ["A", "B"]
    assert one(spark, T.infobox(F.lit("{{Infobox person\n|faction = [[The X|X]]\n|empty=\n|age=3}}"))) == {"faction": "X", "age": "3"}


@pytest.mark.parametrize("title, cats, kind", [("Identity", ["x"], "world"), ("Faust/Gallery", ["sinner"], "other"), ("A", ["LCB Identities"], "identity"), ("Some E.G.O page", [], "ego"), ("Some E.G.O page", ["Abnormality"], "abnormality"), ("Faust", [], "sinner"), ("A", ["Abnormalities"], "other"), ("A", ["drawings"], "faction"), ("Canto IV", [], "story_transcript"), ("A", ["seventh"], "event"), ("The Mirror", [], "world")])
def test_classify(spark, title, cats, kind):
    arr = F.array(*map(F.lit, cats)) if cats else F.array().cast("array<string>")
    assert one(spark, K.document_type(F.lit(title), arr)) == kind


def test_filters(spark):
    row = lambda title, chapters, **k: one(spark, K.matches(F.lit(title), F.lit("world"), F.array(*map(F.lit, chapters)).cast("array<string>"), **k))
    assert row("A", ["Canto IV"], max_chapter=4) and not row("A", ["Canto II", "Canto IV"], max_chapter="3")
    assert row("A", [], max_chapter=3) and not row("A/Gallery", []) and not row("A", [], types=["event"]) and row("A", ["x"], labels=["x", "y"])


def test_split_long(spark):
    cases = {
        "": [], " short ": ["short"],
        "one.\n\ntwo.": ["one.\n\ntwo."],
        ("a" * 30) + "\n\n" + ("b" * 30): ["a" * 30, "b" * 30],
        "intro\n\n" + "x" * 20 + ". " + "y" * 20 + "! " + "z" * 60 + "\n\ntail": ["intro", "x" * 20 + ". " + "y" * 20 + "!", "z" * 60, "tail"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", S.split_long(F.col("t"), 50).alias("p"))
    assert {r["t"]: r["p"] for r in df.collect()} == cases


def test_split_long_loses_nothing(spark):
    import random

    rng = random.Random(3)
    texts = ["\n\n".join(" ".join("w%d%s" % (rng.randrange(99), rng.choice(["", "", "."])) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.split_long(F.col("t"), 60).alias("p")).collect():
        assert " ".join(r["p"]).split() == r["t"].split()
        assert all(len(p) <= 60 or "." not in p[:-1].replace(". ", ".") [:-1] or " " not in p.split(". ")[0] or len(p.split(". ")) == 1 for p in r["p"])


def test_sections(spark):
    raw = "{{Infobox}}Intro text that is long enough to stand alone here.\n== One ==\n" + "b" * 50 + "\n== Tiny ==\nlist\n== One ==\n" + "c" * 50
    docs = spark.createDataFrame([("d", 1, "Page", raw, "plain")], "doc_id string, revision_id int, title string, raw_text string, plain_text string")
    rows = S.passages(docs).orderBy("section_no", "ordinal").collect()
    assert [r["section_title"] for r in rows] == ["Page", "One", "One"]
    assert rows[1]["text"].endswith("\n\nlist") and len({r["chunk_id"] for r in rows}) == 3


def test_graph_case_variants(spark):
    docs = spark.createDataFrame([("1", "Alpha", "world", ["beta", "Beta", "alpha"], {"Faction": "The <br>X ,"}), ("2", "Beta", "event", ["ALPHA"], {"employer": "the x", "other": "y"})], "doc_id string, title string, document_type string, entities array<string>, infobox map<string,string>")
    ent, edges = G.build(docs)
    assert {tuple(r) for r in edges.select("src_key", "rel", "dst_key").collect()} == {("alpha", "links_to", "beta"), ("alpha", "member_of", "the x"), ("beta", "links_to", "alpha"), ("beta", "affiliated_with", "the x")}
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, key string")
    assert [(r["doc_id"], r["score"]) for r in G.neighbours(ent, edges, asked).orderBy("rank").collect()] == [("2", 5), ("1", 2)]
    q = spark.createDataFrame([(1, "is the X near Beta?")], "query_id int, text string")
    assert [r["key"] for r in G.mentions(ent, q).orderBy("place").collect()] == ["the x", "beta"]


def test_fusion_keeps_first_order(spark):
    a = spark.createDataFrame([(1, "x", 9.0, 1, "k"), (1, "y", 8.0, 2, "k")], "query_id int, id string, score double, rank int, retriever string")
    b = spark.createDataFrame([(1, "z", 0.9, 1, "v"), (1, "y", 0.8, 2, "v")], "query_id int, id string, score double, rank int, retriever string")
    assert [r["id"] for r in R.fuse([a, b]).orderBy("rank").collect()] == ["y", "x", "z"]


def test_grade_edge(spark):
    h = spark.createDataFrame([(1, "a", 1, "alpha beta", "alpha", ""), (1, "b", 2, "alpha beta", "none", ""), (2, "c", 1, "gamma", "no", ""), (2, "d", 2, "gamma", "no", ""), (2, "e", 3, "gamma", "no", "")], "query_id int, id string, rank int, query_text string, title string, text string")
    got = {r["id"]: (r["kept"], r["relevant_score"]) for r in R.graded(h).collect()}
    assert got == {"a": (True, 0.5), "b": (False, 0.0), "c": (True, None), "d": (True, None), "e": (False, 0.0)}


def test_metrics(spark):
    rel = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id int, doc_id string")
    hits = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (1, "a", 9)], "query_id int, doc_id string, rank int")
    got = {r["query_id"]: r for r in E.item_metrics(rel, hits).collect()}
    assert got[1]["recall"] == 0.5 and got[1]["mrr"] == 0.5 and abs(got[1]["ndcg"] - 0.63093 / 1.63093) < 1e-4 and got[2]["mrr"] == 0


def test_gold(spark):
    gold = spark.createDataFrame([("q1", "?", "who", ["d1", "dx"], ["The_One "]), ("q2", "?", "what", [], ["Two"]), ("q3", "?", "what", ["d2"], [])], SP.GOLD.replace(", expected_answer_points array<string>", ""))
    docs = spark.createDataFrame([("d1", "A"), ("d2", "the  one"), ("d3", "two"), ("d4", "Two")], "doc_id string, title string")
    got = {r["id"]: (r["resolved_ids"], r["status"]) for r in E.resolve_gold(gold, docs).collect()}
    assert got == {"q1": (["d1", "d2"], "partial"), "q2": ([], "unresolved"), "q3": (["d2"], "resolved")}


def test_citations(spark):
    kept = spark.createDataFrame([(1, "aa", 1), (1, "bb", 2)], "query_id int, id string, rank int")
    ans = spark.createDataFrame([(1, "x [cite:bb] [cite:zz] [cite:aa] y [cite:bb] ."), (2, "plain")], "query_id int, answer string")
    got = {r["query_id"]: r for r in A.cited(ans, kept).collect()}
    assert got[1]["answer"] == "x [1] [2] y [1]." or got[1]["answer"].replace(" ", "") == "x[1][2]y[1]."
    assert got[1]["citations"] == ["bb", "aa"] and not got[1]["valid"] and got[2]["valid"]


def test_recipes_and_ask(spark):
    chunks = spark.createDataFrame([(1, "d1", "Moon", "the moon base hosts three wizards", 0), (2, "d2", "Sun", "solar wind and light", 0)], "id int, doc_id string, title string, text string, ordinal int")
    corpus = P.Corpus(chunks, R.keyword_index(chunks))
    q = spark.createDataFrame([(1, "moon wizards"), (2, "qqqq")], "query_id int, text string")
    got = {r["query_id"]: r for r in P.ask(corpus, q, P.Recipe("r", use_dense=False, min_kept=1)).collect()}
    assert not got[1]["refused"] and got[1]["citations"] == ["1"] and got[2]["refused"]
    assert P.overlaid(P.RECIPES["vector_only"], "relationship").use_graph and not P.overlaid(P.RECIPES["hybrid"], "relationship").use_graph
    assert P.RECIPES["hybrid_rerank"].backend == "lexical" and len(P.RECIPES) == 7


def test_catalog_helpers():
    assert C.unknown_type(["world", "zzz", "aaa"]) == "aaa" and C.unknown_type(["world"]) is None and C.bounded_limit(9, 5) == 5
    with pytest.raises(ValueError):
        C.bounded_limit(0, 5)


def test_sources(spark, tmp_path):
    (tmp_path / "dump.jsonl").write_text('{"page_id": 1, "title": "a"}\n\n{"page_id": 2, "title": "b"}\n{"page_id": 1, "title": "c"}\n')
    assert {(r["page_id"], r["title"]) for r in SP.read_dump(spark, str(tmp_path / "dump.jsonl")).collect()} == {(1, "c"), (2, "b")}
    assert SP.read_lines(spark, str(tmp_path / "none.jsonl"), SP.GOLD).count() == 0
    raw = spark.createDataFrame([('{"pageid": 3, "title": "X Y", "revisions": [{"revid": 5, "slots": {"main": {"content": "[[Z]]"}}}], "categories": [{"title": "Category:World"}]}',)], "json string")
    doc = SP.documents(SP.page_from_json(raw)).first()
    assert doc["document_type"] == "world" and doc["entities"] == ["Z"] and doc["revision_id"] == 5 and doc["url"].endswith("X_Y")
    (tmp_path / "r.yaml").write_text("id: x\nk_dense: 3\nuse_dense: true\nrelevance_threshold: 0.5\n")
    assert SP.read_recipe(tmp_path / "r.yaml") == {"id": "x", "k_dense": 3, "use_dense": True, "relevance_threshold": 0.5}


def test_polite_client():
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    answers = iter([(429, {"Retry-After": "3"}, {}), (503, {}, {}), (200, {}, {"continue": {"c": 1}}), (200, {}, {"done": 1})])
    client = api.PoliteClient(lambda p: (calls.append(p), next(answers))[1], sleep=sleep, clock=lambda: now[0])
    assert list(client.pages({"q": 1})) == [{"continue": {"c": 1}}, {"done": 1}]
    assert calls[-1] == {"q": 1, "c": 1} and 3.0 in slept and api.retry_delay(9, None, 0) == 60


def test_stream_upsert(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "page_id long, title string, revision_id long")
    folder, kind = str(tmp_path / "t"), "page_id long, title string, revision_id long, timestamp string, deleted boolean, pos long"
    ST.write_table(docs, folder)
    spark.createDataFrame([(1, "a", 2, "2024-01-01T00:00:00Z", False, 0), (0, "B", 0, "2024-01-02T00:00:00Z", True, 1), (4, "d", 1, "2024-01-03T00:00:00Z", False, 2)], kind).coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "feed"))
    fetch = lambda ids: ids.select("page_id", F.lit("new").alias("title"), F.lit(7).cast("long").alias("revision_id"))
    table = lambda: {(r["page_id"], r["title"], r["revision_id"]) for r in ST.read_table(spark, folder).collect()}
    ST.apply_changes(stream, folder, str(tmp_path / "cp"), fetch).awaitTermination()
    assert table() == {(1, "new", 7), (3, "c", 1), (4, "new", 7)}
    written = {r["bucket"] for r in spark.read.parquet(folder).filter("version = 1").select("bucket").collect()}
    assert len(written) <= 3  # the buckets of pages 1, 2 and 4
    # later changes go on with the same checkpoint, and a new one begins after the last version
    spark.createDataFrame([(3, "c", 9, "2024-01-04T00:00:00Z", True, 0)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    ST.apply_changes(stream, folder, str(tmp_path / "cp"), fetch).awaitTermination()
    assert table() == {(1, "new", 7), (4, "new", 7)} and ST.last_version(spark, folder) == 2
    ST.apply_changes(stream, folder, str(tmp_path / "cp2"), fetch).awaitTermination()
    assert table() == {(1, "new", 7), (4, "new", 7)} and ST.last_version(spark, folder) == 3
    assert ST.resume_point({"started_at": "x"}) == "x" and I.missing(docs, docs).count() == 0
    with pytest.raises(ValueError):
        ST.resume_point({})


def test_ingest_ends_on_missing_pages(spark, tmp_path):
    class Lossy(api.TableSource):
        def fetch_pages(self, ids):
            return super().fetch_pages(ids).filter("page_id <> 3")

    pages = spark.createDataFrame([(k, 1, f"P{k}", "u", 0, "text", ["Lore"]) for k in range(1, 6)], "page_id long, revision_id long, title string, url string, namespace int, wikitext string, categories array<string>")
    store = STORE.Store(spark, str(tmp_path / "s"))
    with pytest.raises(RuntimeError, match="3"):
        Ingest(store, Lossy(pages), 2).run()
    assert store.get("ingest")["batches"] == 1 and Ingest(store, api.TableSource(pages), 2).documents().count() == 2
    assert isinstance(api.TableSource(pages), api.Source)
    whole = Ingest(store, api.TableSource(pages), 2)
    assert [r["title"] for r in whole.run().collect()] == [f"P{k}" for k in range(1, 6)]
    state = store.get("ingest")
    assert state["status"] == "complete" and whole.since() == state["started_at"]
    whole.commit("2030-01-01T00:00:00Z", 1, 0)
    assert whole.since() == "2030-01-01T00:00:00Z" and whole.since("x") == "x"


def test_older_state(spark):
    kept = spark.createDataFrame([("world", "A")], "document_type string, title string")
    state = {"skipped_page_ids": [3, 1, 2, 9], "listings": [{"page_id": 1, "title": "Faust/Identity"}, {"page_id": 2, "title": "Zzz"}, {"page_id": 3, "title": "X E.G.O"}]}
    got = C.stats_of_state(kept, state)
    assert got["skipped_total"] == 4 and got["skipped_unknown"] == 2 and got["pages_listed"] == 3 and not got["categories_available"]
    assert got["identity_samples"] == ["Faust/Identity"] and got["ego_samples"] == ["X E.G.O"] and got["document_type_counts"] == {"ego": 1, "identity": 1, "world": 1}
    assert "(not recorded)" in RP.stats_text(got) and "of unknown type: 2" in RP.stats_text(got)


def test_reports(spark, tmp_path):
    items = spark.createDataFrame([("q1", "moon", "what", ["1"], [], [], "resolved"), ("q2", "zzz", None, [], ["x"], [], "unresolved")], "query_id string, text string, question_type string, resolved_ids array<string>, unresolved_ids array<string>, unresolved_titles array<string>, status string")
    chunks = spark.createDataFrame([(1, "1", "Moon", "the moon base", 0), (2, "2", "Sun", "light", 0)], "id int, doc_id string, title string, text string, ordinal int")
    corpus = P.Corpus(chunks, R.keyword_index(chunks))
    whole, by_type = RP.comparison(corpus, items, [P.RECIPES["bm25_only"]])
    report = RP.comparison_report("g", 8, items, whole, by_type)
    one = report["configs"][0]
    assert set(one) == {"config_id", "rerank_backend", "n", "n_evaluated", "n_unresolved", "n_partial", "n_with_unresolved_labels", "recall@k", "mrr", "ndcg@k", "by_question_type"}
    assert (one["n"], one["n_evaluated"], one["recall@k"], one["n_with_unresolved_labels"]) == (2, 1, 1.0, 1) and set(one["by_question_type"]) == {"other", "what"} and report["unresolved_labels"][0]["id"] == "q2"
    RP.write_report(spark, report, str(tmp_path / "r"))
    assert RP.read_report(spark, str(tmp_path / "r")) == report and "bm25_only" in RP.comparison_text(report) and "1.000" in RP.comparison_text(report)


def test_model_rerank_and_dedupe(spark):
    h = spark.createDataFrame([(1, "a", 2.0, 1, "k", "q", "A", "x"), (1, "b", 1.0, 2, "k", "q", "B", "longer text")], "query_id int, id string, score double, rank int, retriever string, query_text string, title string, text string")
    assert [r["id"] for r in R.model_rerank(h, lambda q, t: [len(x) for x in t]).orderBy("rank").collect()] == ["b", "a"]
    d = spark.createDataFrame([(1, "d1", 3), (1, "d2", 1), (1, "d1", 2)], "query_id int, doc_id string, rank int")
    assert [(r["doc_id"], r["rank"]) for r in R.deduplicated_docs(d).orderBy("rank").collect()] == [("d2", 1), ("d1", 2)]
    s = spark.createDataFrame([("b", 2), ("a", 0), ("c", 0)], "id string, n_relevant int")
    assert [r["id"] for r in E.experiment_slice(s, 2).collect()] == ["a", "c"]


def test_model_calls():
    hits = [{"id": f"c{k}", "title": "t" * 300, "text": "x" * 2000} for k in range(10)]
    seen = {}
    got = N.rewrite(lambda asked: seen.update(asked) or {"rewritten_query": "r", "relevant_chunk_ids": ["c1", "c9"], "rationale": "y" * 400}, "q" * 2000, hits)
    assert got == {"rewritten_query": "r", "relevant_chunk_ids": ["c1"], "rationale": "y" * 160} and len(seen["candidates"]) == 5 and len(seen["question"]) == 1000
    claims = N.judge(lambda asked: [{"text": "a", "supported": True, "cited": ["c9"], "supporting": ["zz"]}, {"text": "b", "supported": True, "cited": ["c0"], "supporting": ["c0"]}], "q", "a", hits)
    assert [c["supported"] for c in claims] == [False, True] and claims[0]["cited"] == [] and N.claim_shares(claims) == (0.5, 1.0) and N.claim_shares([]) == (0.0, 0.0)
    adapter = N.ModelAdapter(lambda texts: [(1, [2]), (0, [1])], lambda rules, text: 1 / 0)
    assert adapter.embed(["a", "b"]) == [[1.0], [2.0]] and adapter.embed([]) == [] and N.ModelAdapter().provider == "hash"
    with pytest.raises(N.ModelError, match="answering"):
        adapter.generate("x")


def test_api_source(spark):
    calls = []

    def site(params):
        calls.append(params)
        if params.get("list") == "categorymembers":
            more = {"Category:A": [{"ns": 14, "title": "Category:B", "pageid": 50}, {"ns": 0, "title": "Z", "pageid": 1}], "Category:B": [{"ns": 0, "title": "Y", "pageid": 2}, {"ns": 14, "title": "Category:A", "pageid": 51}]}
            return 200, {}, {"query": {"categorymembers": more.get(params["cmtitle"], [])}}
        if params.get("list") == "recentchanges":
            if "c" not in params:
                return 200, {}, {"query": {"recentchanges": [{"pageid": 2, "title": "Y", "revid": 7, "timestamp": "2024-01-02", "type": "edit"}]}, "continue": {"c": 1}}
            return 200, {}, {"query": {"recentchanges": [{"title": "gone", "timestamp": "2024-01-01", "type": "log", "logtype": "delete"}]}}
        page = {"pageid": 2, "title": "Y", "revisions": [{"revid": 7, "slots": {"main": {"content": "text"}}}]}
        if "c" not in params:
            return 200, {}, {"query": {"pages": [page | {"categories": [{"title": "Category:A"}]}, {"pageid": 9, "missing": True}]}, "continue": {"c": 1}}
        return 200, {}, {"query": {"pages": {"2": page | {"categories": [{"title": "Category:B"}]}}}}

    source = api.ApiSource(spark, api.PoliteClient(site, interval=0), ["A"], 1)
    assert [(r["page_id"], r["title"]) for r in source.list_pages().collect()] == [(2, "Y"), (1, "Z")]
    assert [(r["title"], r["deleted"]) for r in source.recent_changes("2024").collect()] == [("gone", True), ("Y", False)]
    page = source.fetch_page(2).first()
    assert page["categories"] == ["A", "B"] and page["revision_id"] == 7 and isinstance(source, api.Source)
    with pytest.raises(KeyError):
        api.ApiSource(spark, api.PoliteClient(lambda p: (200, {}, {"query": {"pages": [{"pageid": 5, "missing": True}]}}), interval=0), []).fetch_page(5)


def test_settings_and_cli(spark, tmp_path):
    import json

    assert Settings.from_env(env={"QUARRY_BATCH_SIZE": "7", "QUARRY_CATEGORIES": "A, B,"}).category_list() == ["A", "B"]
    with pytest.raises(ValueError):
        Settings().gold("../x")
    (tmp_path / "fixtures").mkdir()
    (tmp_path / "gold").mkdir()
    for k, text in enumerate(["The mirror shows other worlds and their people, as far as anyone can tell.", "A harbour town with boats and fog, where the lanterns burn all night."]):
        (tmp_path / "fixtures" / f"{k}.json").write_text(json.dumps({"page_id": k + 1, "revision_id": 1, "title": ["Mirror", "Harbour"][k], "url": "u", "wikitext": text, "categories": ["Lore"]}))
    (tmp_path / "gold" / "v1.jsonl").write_text(json.dumps({"id": "g", "question": "where do lanterns burn", "question_type": "what", "relevant_doc_titles": ["harbour"], "relevant_doc_ids": []}))
    settings = Settings(data_dir=str(tmp_path), embedding_dims=8)
    assert "Documents: 2" in cli.main(["ingest"], spark, settings) and "Listed pages: 2" in cli.main(["stats"], spark, settings)
    assert json.loads(cli.main(["search", "lanterns", "--recipe", "bm25_only"], spark, settings).splitlines()[0])["rank"] == 1
    assert "1/1" in cli.main(["eval", "--recipe", "bm25_only"], spark, settings) and "answer" in cli.main(["ask", "lanterns burn", "--recipe", "bm25_only"], spark, settings)
    (tmp_path / "recipes").mkdir()
    (tmp_path / "recipes" / "mine.yaml").write_text("id: mine\nk_final: 3\n")
    assert SP.recipe_names(settings.recipes) == ["mine"] and SP.named_recipe(settings.recipes, "mine")["k_final"] == 3
    with pytest.raises(KeyError):
        SP.named_recipe(settings.recipes, "../mine")
    lib = STORE.Library(STORE.Store(spark, settings.store), EM.Embedder(8))
    assert lib.document("page:1").count() == 1 and lib.document("page:9").count() == 0
    one = lib.store.load("chunks").first()
    assert lib.chunk(one["chunk_id"]).first()["text"] == one["text"]
    P.asked_one(lib.bring_up(), "lanterns", P.RECIPES["bm25_only"], ["before", " "])["history"] == ["before"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
