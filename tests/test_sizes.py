"""Steps whose cost must not outgrow their input, and pairs that a shortcut may lose."""

import contextlib
import io
import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as T
from quarry.operators import catalog as C
from quarry.operators import evaluate as E
from quarry.operators import graph as G
from quarry.operators import retrieve as R
from quarry.plans import recipes as P
from quarry.plans import queries as Q


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def sent(df) -> list[str]:
    """The lines below each broadcast in a plan, as far as they are indented."""
    lines, found = plan(df).splitlines(), []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            deep = line.index("BroadcastExchange")
            below = []
            for x in lines[k + 1 :]:
                if len(x) - len(x.lstrip(" :+-*()0123456789")) <= deep:
                    break
                below.append(x)
            found.append("\n".join(below))
    return found


def most_rows(df) -> int:
    """Rows of the node of a plan that gives the most of them, as it ran."""
    df.collect()

    def nodes(node):
        yield node
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        for x in inner + [node.children().apply(k) for k in range(node.children().size())]:
            yield from nodes(x)

    counts = [n.metrics().get("numOutputRows") for n in nodes(df._jdf.queryExecution().executedPlan())]
    return max(c.get().value() for c in counts if c.isDefined())


def test_mentions_send_titles_and_no_runs(spark, monkeypatch):
    ent = spark.createDataFrame([("the x", "The X", "1", "world"), ("x", "x", "2", "world"), ("a-b c", "A-b C", "3", "event"), ("", "", "4", "world")], "key string, title string, doc_id string, type string")
    q = spark.createDataFrame([(1, "is THE x near a-b  c, x?"), (2, ""), (3, None), (4, "a-b"), (5, "x x the x")], "query_id int, text string")
    want = {(1, "the x", 1, 1), (1, "a-b c", 4, 2), (1, "x", 9, 3), (5, "the x", 2, 2), (5, "x", 0, 1)}
    got = lambda: {(r["query_id"], r["key"], r["start"], r["place"]) for r in G.mentions(ent, q).collect()}
    assert got() == want and sent(G.mentions(ent, q)) and not any("explode" in x and "query_id" in x for x in sent(G.mentions(ent, q)))
    monkeypatch.setattr(G, "SENT", 0)
    assert got() == want and not sent(G.mentions(ent, q))
    assert G.mentions(ent.limit(0), q).count() == 0


def test_neighbours_of_a_title_that_many_pages_have(spark):
    """Pages of one title with links each; and questions with several titles, some twice."""
    n = 300
    docs = [(k, "Hot" if k < n else f"T{k}", "world", [f"t{n + k % 7}", f"T{n + k % 5}", "gone"], {}) for k in range(n + 9)]
    ent, edges = G.build(spark.createDataFrame(docs, "doc_id long, title string, document_type string, entities array<string>, infobox map<string,string>"))
    asked = [(k, "hot" if k < n else f"t{k}") for k in range(n + 9)] + [(900, "hot"), (900, "t301"), (901, "t301"), (901, "hot"), (902, "t301"), (902, "t301"), (903, "none"), (904, None)]
    near = G.neighbours(ent, edges, spark.createDataFrame(asked, "query_id long, key string"))
    pages = {r["key"]: r["doc_id"] for r in ent.collect()}
    both = [x for r in edges.collect() for x in ((r["src_key"], r["dst_key"], r["doc_id"]), (r["dst_key"], r["src_key"], r["doc_id"]))]
    want = set()
    for q in {q for q, _ in asked}:
        points = {}
        for _, key in (a for a in asked if a[0] == q):
            for _, other, doc in (x for x in both if x[0] == key):
                for d, p in ((pages[other], 2), (doc, 1)):
                    if d is not None:
                        points[d] = points.get(d, 0) + p
        want |= {(q, d, p, k + 1) for k, (d, p) in enumerate(sorted(points.items(), key=lambda x: (-x[1], x[0]))[:8])}
    assert {tuple(r) for r in near.collect()} == want and near.count() == len(want)
    assert most_rows(near) < 20 * n  # all pairs are n * n and more

    chunks = spark.createDataFrame([(4 * d + k, d, "", f"word{d} hot t{k}" if k else None, k) for d in range(n + 9) for k in range(4)], "id long, doc_id long, title string, text string, ordinal int")
    asks = spark.createDataFrame([(k, "Hot" if k < n else "hot t2") for k in range(n + 9)] + [(900, "t1 t2"), (901, None)], "query_id long, text string")
    top = G.graph_topk(near, chunks, asks, 5)
    found = {(r["query_id"], r["id"]): (round(r["score"], 6), r["rank"]) for r in top.collect()}
    text = {r["id"]: set((r["text"] or "").split()) for r in chunks.collect()}
    words = {r["query_id"]: set((r["text"] or "").lower().split()) for r in asks.collect()}
    expected = {}
    for q in words:
        rows = []
        for _, d, _, r in (x for x in want if x[0] == q):
            rows += [(r, *x) for x in sorted((-len(words[q] & text[4 * d + k]), k, 4 * d + k) for k in range(4))[:2]]
        expected |= {(q, x[3]): (round(1 / (k + 1) - x[1] * 0.01, 6), k + 1) for k, x in enumerate(sorted(rows)[:5])}
    assert found == expected and most_rows(top) < 20 * n


def test_items_whose_ends_are_joined_to_other_words(spark, tmp_path):
    """An item's first and last words need not be words of a document that holds it; nor need it have three."""
    items = [(0, "rare common rarer"), (1, "two words"), (2, "one"), (3, ""), (4, "not there at all"), (5, "a b c"), (6, None), (7, "x\ny  z w")]
    docs = [(0, "xrare common rarerx"), (1, "rare common else"), (2, "rarer common"), (3, "atwo words."), (4, "none"), (5, "a b c"), (6, "aa b cc\nb"), (7, None), (8, ""), (9, "x\ny  z  w x\ny  z w")]
    files = {"benchmark": pd.DataFrame(items, columns=["item_id", "text"]), "documents": pd.DataFrame([(d, x, "en", f"s{d % 3}", len(x or "")) for d, x in docs], columns=["doc_id", "text", "lang", "source", "n_chars"])}
    c = duckdb.connect()
    for name, rows in files.items():
        rows.to_parquet(tmp_path / f"{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = {(i, d) for i, a in items for d, b in docs if a is not None and b is not None and a in b}
    got = [tuple(r) for r in Q._relevant(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and (0, 0) in want
    for name in ("gold_resolution",):
        res = Q.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, res.collect())) == sorted(c.execute(f"SELECT {', '.join(res.columns)} FROM ({Q.ORACLES[name]})").fetchall())
    assert "Exchange" not in plan(E.holding(Q.questions(spark, str(tmp_path)).withColumnRenamed("query_id", "item_id"), Q.t(spark, str(tmp_path), "documents")))


@pytest.mark.parametrize("small", [False, True])
def test_keyword_hits_against_brute_force(spark, monkeypatch, small):
    """Copies, texts without words, words that all texts hold, ids that are strings; questions in several lots."""
    if small:
        for name, n in (("QUESTIONS", 3), ("TERMS", 7), ("CELLS", 40), ("SENT", 1)):
            monkeypatch.setattr(R, name, n)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)] + ["the", "x", "Ünïcode", "snake_case"]
    texts = [(f"d{k}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)) + ["everywhere"])) for k in range(380)]
    texts += [(f"c{k}", texts[7][1]) for k in range(60)] + [("n", None), ("e", ""), ("s", "the of x")]
    asked = [(q, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6)))) for q in range(30)] + [(30, "everywhere"), (31, "unseen"), (32, ""), (33, None), (34, texts[7][1])]
    split = lambda x: [w for w in re.findall(r"\w{2,}", (x or "").lower()) if w not in T.STOP_WORDS]
    tf = {i: Counter(split(x)) for i, x in texts}
    df, n = Counter(w for c in tf.values() for w in c), len(texts)
    mean = sum(c.total() for c in tf.values()) / n

    def best(text, k, keep=None):
        scores = {}
        for i, c in tf.items():
            held = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w in set(split(text)) if w in c]
            if held:
                scores[i] = round(sum(held), 6)
        first = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
        return first[:k] if keep is None else [x for x in first[: 4 * k] if x[0] in keep][:k]

    chunks = spark.createDataFrame(texts, "id string, text string").repartition(3)
    index, q = R.keyword_index(chunks), spark.createDataFrame(asked, "query_id long, text string")
    kept = {i for i, _ in texts if i.endswith(("1", "2", "3"))}
    keep = spark.createDataFrame([(i,) for i in kept] * 2, "id string")
    for got, want in ((R.keyword_topk(index, q, 9), lambda x: best(x, 9)), (R.keyword_topk(index, q, 9, keep), lambda x: best(x, 9, kept))):
        assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in got.collect()) == sorted((a, k + 1, i, s) for a, x in asked for k, (i, s) in enumerate(want(x)))
    if not small:
        assert most_rows(R.keyword_topk(index, q, 9)) < 2000  # pairs of question and text that share a word are some 10,000
    assert R.keyword_topk(index, q.limit(0), 9).count() == 0 and R.keyword_topk(R.keyword_index(chunks.limit(0)), q, 9).count() == 0


def test_no_text_is_dealt_for_few_hits(spark):
    words = "alpha beta gamma delta".split()
    chunks = spark.createDataFrame([(k, k, "T", f"{words[k % 4]} {words[k % 3]}", 0) for k in range(50)], "id long, doc_id long, title string, text string, ordinal int")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id long, text string")
    corpus = P.Corpus(chunks, R.keyword_index(chunks))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rich = R.beside(R.keyword_topk(corpus.keyword, q, 5), chunks, q, 5)
        for df in (rich, P.search(corpus, q, P.Recipe("r", use_dense=False, use_rerank=True)), Q.QUERIES["rrf_fusion"](spark, "/root/testdata/sf0.001")):
            assert not re.search(r"hashpartitioning\(id#", plan(df)) and df.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_places_without_one_task_for_all(spark, monkeypatch, size):
    monkeypatch.setattr(C, "RANGE", size)
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "ß", "zz", "2024-01-01T00:00:00Z"]), rng.choice([None, 0, 0, 0, rng.randrange(-9, 99)]), k) for k in range(900)] + [("a", 0, 10_000 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "t string, p long, k long").repartition(5)
    got = C.numbered(df, F.struct("t", "p", "k"), "n")
    want = df.withColumn("n", F.row_number().over(W.orderBy("t", "p", "k")).cast("long"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema["n"].dataType == want.schema["n"].dataType
    assert C.numbered(df.limit(0), F.struct("t", "p", "k"), "n").count() == 0
    for name in ("recent_changes", "corpus_order") if size < 10_000 else ():  # more rows than a task is given
        assert "SinglePartition" not in plan(Q.QUERIES[name](spark, "/root/testdata/sf0.001"))
