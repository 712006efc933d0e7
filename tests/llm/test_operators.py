"""The training-data operators against brute force, on small and awkward tables."""

import random
import zlib

import numpy as np
import pytest

from quarry.llm import decontaminate, katz, language, lines, minhash, packing, token_blocks, tokens, topk, toxicity, warc
from quarry.llm.common import words
from quarry.llm.components import components
from tests.llm.katz_brute import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one two three"), (5, "word " * 20_000), (6, "a b c"), (7, "ÀB cd"), (8, "\x1c x")]


def random_docs(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)]
    out = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        if out and rng.random() < 0.5:
            base = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 5)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
        out.append((i, " ".join(base)))
    return out


def brute_components(rows, n, percent):
    def shingles(t):
        w = words(t)
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets, up = [(i, shingles(t)) for i, t in rows], {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {(i, len(x), find(i) if i is not None else None) for i, x in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_equals_brute_force(spark, n):
    rows = random_docs() + [(1000 + (i or 0), t) for i, t in AWKWARD[:8]] + [(None, "w1 w2 w3")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows), n).collect()}
    assert got == brute_components(rows, n, 80)


def test_minhash_chain_and_empty(spark):
    base = ["c%d" % k for k in range(100)]
    rows = [(k, " ".join(base[:k] and [f"x{j}" for j in range(k)] + base[k:])) if k else (0, " ".join(base)) for k in range(0, 60, 4)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows), 2).collect()}
    assert got == brute_components(rows, 2, 80)
    assert minhash.near_duplicates(docs_of(spark, []).limit(0), 2).count() == 0
    assert minhash.deduplicated(docs_of(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")])).count() == 2


@pytest.mark.parametrize("block", [4, 512])
def test_minhash_families_without_a_hub(spark, monkeypatch, block):
    """Families whose members differ from each other as much as links allow, and such just
    below it, in blocks of many or few members."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, rows = random.Random(17), []
    for f in range(6):
        base = [f"f{f}w{k}" for k in range(60)]
        for _ in range(12):
            own = list(base)
            for at in rng.sample(range(60), 3 if f % 2 else 5):
                own[at] = "x%d" % rng.randrange(10**6)
            rows.append((len(rows), " ".join(own)))
    rows += [(500 + k, rows[0][1]) for k in range(40)]  # a hot group of exact copies
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows), 2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_keyed_join(spark, monkeypatch):
    from quarry.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rows = spark.createDataFrame([("a", k) for k in range(50)] + [("b", 1), ("c", 2), ("d", 3)], "key string, x int")
    side = spark.createDataFrame([("a", 50, "A"), ("b", 1, "B"), ("d", 1, "D")], "key string, n int, y string")
    got = sorted((r["key"], r["x"], r["y"]) for r in common.keyed_join(rows, side, "key", "n", 53).collect())
    assert got == sorted([("a", k, "A") for k in range(50)] + [("b", 1, "B"), ("d", 3, "D")])


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 130)] + [(k, k + 1) for k in range(200, 220)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "u long, v long"))[0].collect()}
    assert got == {(x, find(x)) for e in edges for x in e if e[0] != e[1]}


@pytest.mark.parametrize("small", [False, True])
def test_katz_equals_brute_force(spark, monkeypatch, small):
    if small:  # many parts, and hot words dealt by context
        monkeypatch.setattr(katz, "TASK_TOKENS", 800)
        monkeypatch.setattr(katz, "HOT_TOKENS", 60)
    rows = random_docs(150) + [(900, None), (901, ""), (902, "never seen"), (903, "w1 " * 500)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want, total = brute(rows, held)
    from quarry.llm.common import crc_mod

    got = katz.scores(docs_of(spark, rows), crc_mod("doc_id", 10) == 0).collect()
    assert len(got) == len(rows) and all(abs(x - 1) < 1e-9 for x in total.values())
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["held_out"] == held(r["doc_id"])
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9) and r["score"] == pytest.approx(w[4], rel=1e-9)


def test_katz_stored_model(spark):
    """The stored tables score any text as the brute-force model does, held out or not."""
    from pyspark.sql import functions as F

    from quarry.llm.common import crc_mod

    rows = random_docs(150) + [(902, "never seen"), (903, "w1 " * 500)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want, _ = brute(rows, held)
    _, model = katz.scored(docs_of(spark, rows), crc_mod("doc_id", 10) == 0)
    got = katz.evaluate(docs_of(spark, [*rows, (904, None)]).withColumn("row", F.lit("x")), model).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] != 904:
            assert r["n_tokens"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
    mass = model.contexts.groupBy("context").agg(F.sum(F.size("words")).alias("n"), F.count_distinct("backoff").alias("k")).collect()
    assert all(r["k"] == 1 for r in mass)
    assert katz.evaluate(docs_of(spark, []).limit(0), model).count() == 0


def test_katz_awkward(spark):
    from pyspark.sql import functions as F

    assert katz.scores(docs_of(spark, AWKWARD), F.lit(False)).count() == len(AWKWARD)
    assert katz.scores(docs_of(spark, []).limit(0), F.lit(False)).count() == 0


def test_tokenizer_equals_library():
    coder = tokens.WordTokenizer(tokens.default_tokenizer())
    texts = [t for _, t in AWKWARD if t] + ["Don't  STOP,now... 1234 ŝ ŝ İ ΣΑΣ ß foo<|endoftext|>bar", "x" * 500, "日本 語", "'s 'S a's"]
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "pack", lambda p, c, f=packing.pack: f(p, c, 40))  # several shards
    rows = random_docs(150) + AWKWARD
    got = packing.pack_documents(docs_of(spark, rows), max_tokens=128).collect()
    coder = Tokenizer.from_file(tokens.default_tokenizer())
    want = []
    for i, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, a, len(ids[a : a + 128]), zlib.crc32(np.array(ids[a : a + 128], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 128))]
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    assert check_packing(got, 128) <= 1.05 * sum(w[3] for w in want) / 128 + 2
    assert packing.pack_documents(docs_of(spark, []).limit(0)).count() == 0


def test_local_search_empties_a_bin():
    lengths, bins = [6, 3, 5, 4, 4, 2, 6], [[0, 1], [2, 3], [4, 5], [6]]
    out = packing.local_search(lengths, bins, 10)
    assert len(out) == 3 and sorted(i for b in out for i in b) == list(range(7)) and all(sum(lengths[i] for i in b) <= 10 for b in out)


def test_blocks_round_trip(spark):
    rows = [(i + 1000, t) for i, t in random_docs(80)] + AWKWARD
    made, path = token_blocks.pack_blocks(docs_of(spark, rows), capacity=64, shard_blocks=4)
    blocks = spark.read.parquet(path)  # what the path holds is the result
    assert sorted(r["sequence_id"] for r in blocks.collect()) == sorted(r["sequence_id"] for r in made.collect())
    for r in blocks.collect():
        assert r["cu_seqlens"] == [0, *np.cumsum(r["lengths"]).tolist()] and r["position_resets"] == r["cu_seqlens"][:-1] and len(r["ids"]) == 128 and r["n_tokens"] <= 64
    got = {}
    for r in sorted(token_blocks.unpacked(blocks).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + r["ids"]
    coder = tokens.WordTokenizer(tokens.default_tokenizer())
    for i, t in rows:
        if i not in (4, None):
            assert got[i] == coder.encode([t])[0] + (1).to_bytes(4, "little")
    assert token_blocks.pack_blocks(docs_of(spark, []).limit(0))[0].count() == 0


def test_segment_tree_is_best_fit():
    rng = random.Random(1)
    lengths = [rng.randint(1, 50) for _ in range(400)]
    free, n = [], 0
    for x in sorted(lengths, reverse=True):
        room = min((r for r in free if r >= x), default=None)
        if room is None:
            n += 1
            room = 50
        else:
            free.remove(room)
        free.append(room - x)
    assert len(token_blocks.best_fit_decreasing(lengths, 50)) == n == len(packing.best_fit_decreasing(lengths, 50))


PASSAGE = "\n".join(f"line {k} of a passage that many documents share " + "with words " * k for k in range(9))


def test_lines(spark):
    rows = [(k, f"own start {k}\nmore {k}\n{PASSAGE}\nown end {k}\nlast {k}") for k in range(6)] + [(50, "x y\nz"), (51, "x y\nz"), (51, "x y\nz"), (52, None), (53, ""), (None, "l " * 60), (54, "l " * 60)]
    got = {(r["doc_id"], r["text"]): r for r in lines.without_repeats(docs_of(spark, rows)).collect()}
    texts = {r["doc_id"]: r["text"] for r in got.values()}
    assert texts[0] == rows[0][1] and texts[52] is None and texts[53] == "" and texts[54] == rows[-1][1] and texts[None] == ""
    for k in range(1, 6):
        assert f"own start {k}" in texts[k] and f"last {k}" in texts[k] and len(texts[k]) < 120 and "passage" not in texts[k]
    counted = lines.without_repeats(docs_of(spark, rows))
    assert counted.count() == len(rows) and counted.filter("text is not null and n_chars <> length(text)").count() == 0


def brute_repeats(rows):
    """Text of each row without the lines of runs of two lines, or one of 50 words, that
    stand earlier and don't overlap the first place, unless they are of a first place."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        held, drop, kept = t.split("\n"), set(), set()
        for k in range(len(held)):
            for n in (1, 2):
                part = tuple(held[k : k + n])
                if len(part) == n and (n == 2 or len(part[0].split()) >= 50):
                    d, at = seen.setdefault(part, (i, k))
                    if d != i or k >= at + n:
                        drop |= set(range(k, k + n))
                        kept |= set(range(at, at + n)) if d == i else set()
        out[i] = "\n".join(x for k, x in enumerate(held) if k not in drop - kept)
    return out


def test_lines_planted_passages(spark):
    rng = random.Random(12)
    line = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    passages = [[line(-(-60 // n)) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6) for _ in range(8)]
    rows = []
    for i in range(240):
        own = [line(rng.randint(1, 70)) for _ in range(rng.randint(1, 8))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + passages[i % len(passages)] + own[at:])))
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs_of(spark, rows)).collect()}
    for i, t in rows:
        p = passages[i % len(passages)]
        own = [x for x in t.split("\n") if x not in p]
        assert got[i] == (t if i < len(passages) else "\n".join(own))


def test_lines_long_run_goes_whole(spark):
    run = ["short %d" % k for k in range(400)]
    rows = [(i, "\n".join(["own %d a" % i, *run, "own %d b" % i])) for i in range(3)]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in lines.without_repeats(docs_of(spark, rows)).collect()}
    assert got == {0: (rows[0][1], 0), 1: ("own 1 a\nown 1 b", 400), 2: ("own 2 a\nown 2 b", 400)}


def test_lines_keep_the_first_place(spark):
    rows = [(1, "B\nA\nB\nA\nB"), (2, "p\nA1\nB1\nq\nA1\nB1\nr\nB1\nr")]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs_of(spark, rows)).collect()}
    # in 2, "B1 r" stands first where "A1 B1" stands again: what others repeat stays
    assert got == {1: "B\nA\nB", 2: "p\nA1\nB1\nq\nB1\nr"}


def test_lines_clashing_names_and_empty_table(spark):
    from pyspark.sql import functions as F

    df = docs_of(spark, [(1, "a b\nc d"), (2, "a b\nc d"), (None, None)])
    for name in ("_runs", "_doc", "_whole", "_cut", "row", "at", "runs", "cut", "whole", "copy", "lines_removed", "first", "n"):
        df = df.withColumn(name, F.lit("x"))
    got = lines.without_repeats(df)
    assert got.columns == [c for c in df.columns if c != "lines_removed"] + ["lines_removed"]
    assert sorted((repr(r["doc_id"]), repr(r["text"]), r["runs"]) for r in got.collect()) == sorted([("1", "'a b\\nc d'", "x"), ("2", "''", "x"), ("None", "None", "x")])
    assert lines.without_repeats(df.limit(0)).count() == 0


def test_lines_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(lines, "COPIES", 10)
    from quarry.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rows = [(i, f"own {i}\nhot line\nhot other\nmore {i}") for i in range(80)] + [(200, "long " * 20_000 + "\nend")]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs_of(spark, rows)).collect()}
    assert got == {i: t if i in (0, 200) else f"own {i}\nmore {i}" for i, t in rows}


def test_lines_equal_brute_force(spark):
    rng = random.Random(13)
    some = ["a", "b c", "d", "long " * 50, "other " * 60, "x y z"]
    rows = [(i, "\n".join(rng.choice(some) if rng.random() < 0.6 else "own %d" % rng.randrange(10**9) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs_of(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_lines_blank_and_overlapping(spark):
    big = "w " * 60
    rows = [(1, "same\nsame\nsame"), (2, "start 2\n\n" + big + "\n\nend 2"), (3, "start 3\n\n" + big + "\n\nend 3"), (4, "short\n\nown 4"), (5, "short\n\nown 5"), (6, "p q\n\nr s\n"), (7, "p q\n\nr s\n")]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs_of(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "start 3\nend 3", 4: rows[3][1], 5: rows[4][1], 6: rows[5][1], 7: ""}
    assert lines.repeated(["a", "b"], 0, 0, 2, "a\nc") == range(0)


def test_passages(spark):
    rng = random.Random(4)
    item = ["i%d" % k for k in range(40)]
    near = list(item)
    for at in (3, 11, 22, 30, 37):
        near[at] = "zz"
    far = [w if k % 3 else "yy" for k, w in enumerate(item)]
    noise = lambda n: ["n%d" % rng.randrange(99) for _ in range(n)]
    rows = [(1, " ".join(noise(50) + item + noise(50))), (2, " ".join(noise(9) + near).upper()), (3, " ".join(noise(5) + far)), (4, " ".join(noise(300))), (5, None), (6, ""), (7, " ".join(item[:35])), (None, " ".join(item)), (8, "he said tiny item, here")]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, "Tiny item")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_passages(docs_of(spark, rows), bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 10), (None, 10), (8, 13)}
    assert (got[1, 10]["start"], got[1, 10]["stop"], got[1, 10]["edits"], got[2, 10]["edits"]) == (50, 90, 0, 5)
    assert {r["doc_id"] for r in decontaminate.decontaminated(docs_of(spark, rows), bench).collect()} == {3, 4, 5, 6, None}
    assert decontaminate.find_passages(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_pipeline_decontaminates_rows_without_id(spark, tmp_path):
    import corpus_pipeline as P

    item = " ".join("i%d" % k for k in range(20))
    rows = [(1, "a " + item), (2, "clean"), (None, "b " + item), (None, "clean too"), (None, None), (None, "")]
    spark.createDataFrame([(10, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.decontamination(spark, docs_of(spark, rows), str(tmp_path))
    assert got.columns == docs_of(spark, rows).columns
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in got.collect()) == sorted((repr(i), repr(t)) for i, t in rows if item not in (t or ""))


def test_passage_recall():
    rng = random.Random(6)
    rows = [(k, " ".join("v%d" % rng.randrange(300) for _ in range(rng.randint(14, 60)))) for k in range(60)]
    items, found = decontaminate.Items.of(rows), 0
    for k, w in enumerate(items.words):
        x = list(w)
        for _ in range(items.allowed(len(w))):
            at, kind = rng.randrange(len(x)), rng.random()
            x[at : at + 1] = [] if kind < 0.3 else [0] if kind < 0.7 else [0, x[at]]
        edits = decontaminate.infix_distance(w, x)[0]
        assert edits == decontaminate.least_distance(w, x)
        found += any(m[1] == k for m in items.matches([[0] * 20 + x + [0] * 20]))
    assert found >= 57


@pytest.mark.parametrize("kind", ["deletion", "substitution", "insertion", "mixed"])
@pytest.mark.parametrize("n", [5, 9, 15, 40, 55, 100, 200])
def test_passages_at_allowed_distance(n, kind):
    rng = random.Random(f"{n} {kind}")
    rows = [(k, " ".join("v%d" % rng.randrange(300) for _ in range(n))) for k in range(25)]
    items, docs = decontaminate.Items.of(rows), []
    for w in items.words:
        x, places = list(w), rng.sample(range(n), items.allowed(n))
        for at in sorted(places, reverse=True):
            how = rng.choice(["deletion", "substitution", "insertion"]) if kind == "mixed" else kind
            x[at : at + 1] = [] if how == "deletion" else [0] if how == "substitution" else [0, x[at]]
        noise = lambda: [rng.randrange(len(items.vocabulary) + 1) for _ in range(50)]
        docs += [x, noise() + x + noise()]
    got = {(m[0], m[1]) for m in items.matches(docs)}
    want = {(d, k) for d, x in enumerate(docs) for k, w in enumerate(items.words) if decontaminate.least_distance(w, x) <= items.allowed(n)}
    assert got == want and want >= {(d, d // 2) for d in range(len(docs))}


def test_language(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    sounds = {"aa": ["lar", "min", "tok", "ves"], "bb": ["schu", "rütz", "kopf", "gen"]}
    text = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(2)) for _ in range(30))
    rows = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(60)]
    train = spark.createDataFrame(rows[:40], "doc_id long, text string, lang string")
    model = language.trained(train)
    odd = [(100, None, "x"), (101, "", "x"), (102, "123 !!", "x"), (103, "Ω" * 50, "x")]
    test = spark.createDataFrame(rows[40:] + odd, "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r for r in language.identify(test, model).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["lang_rejected"] and 0 <= got[i]["lang_score"] <= 1 for i, _, lang in rows[40:])
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[103]["lang_rejected"]
    assert language.fit([], []).predict(["abc"])[0] == ["und"]
    many = train.unionByName(train.withColumn("lang", F.lit("cc")))
    assert {(r["lang"], r["count"]) for r in language.sampled(many, 30).groupBy("lang").count().collect()} == {("aa", 10), ("bb", 10), ("cc", 10)}
    assert sorted(map(tuple, language.sampled(many.repartition(7), 30).collect())) == sorted(map(tuple, language.sampled(many.coalesce(1), 30).collect()))


def test_toxicity(spark):
    rng = random.Random(8)
    text = lambda bad: " ".join(["vilegunk" if bad and k == 30 else "w%s" % "abcdefghij"[rng.randrange(10)] * rng.randint(1, 3) for k in range(rng.randint(40, 120))])
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(240)]
    net = toxicity.train([t for _, t, _ in rows[:160]], [y for _, _, y in rows[:160]])
    df = spark.createDataFrame([(i, t) for i, t, _ in rows[160:]] + [(900, None), (901, ""), (902, "9 9"), (903, "ok " * 3000 + "vilegunk"), (904, "x" * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.toxicity(df, net).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows[160:]]) > 0.95
    assert got[900] == got[901] == got[902] < 0.5 and got[903] > 0.5 and 0 <= got[904] <= 1
    assert toxicity.train(["a"], [0]).score(["a", None]).shape == (2,)


def plain_score(net, text):
    """The net's forward pass for one text, step by step."""
    p, sig = net.p, lambda x: 1 / (1 + np.exp(-x))

    def states(xs, w, u, b):
        h, out, n = np.zeros(u.shape[0]), [], u.shape[0]
        for x in xs:
            g, a = x @ w + b, h @ u
            z, r = sig(g[:n] + a[:n]), sig(g[n : 2 * n] + a[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(g[2 * n :] + r * a[2 * n :])
            out.append(h)
        return out

    ws, best = toxicity.split_words(text), -np.inf
    for a in range(0, max(1, len(ws) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE):
        xs = []
        for w in ws[a : a + toxicity.WINDOW]:
            e = p["chars"][np.frombuffer(w, np.uint8)]
            ends = [states(e, p["c_wf"], p["c_uf"], p["c_bf"])[-1], states(e[::-1], p["c_wb"], p["c_ub"], p["c_bb"])[-1]]
            xs.append(np.concatenate([*ends, p["words"][net.vocabulary.get(w, 0)]]))
        h = np.stack([np.concatenate(x) for x in zip(states(xs, p["w_wf"], p["w_uf"], p["w_bf"]), states(xs[::-1], p["w_wb"], p["w_ub"], p["w_bb"])[::-1])])
        at = np.exp(np.tanh(h @ p["a_w"]) @ p["a_v"])
        best = max(best, float((at / at.sum()) @ h @ p["o_w"] + p["o_b"][0]))
    return sig(best)


def test_toxicity_equals_plain_forward_pass():
    rng = random.Random(21)
    net = toxicity.Net.fresh([b"abc", b"d"], 3)
    texts = [" ".join(rng.choice(["abc", "d", "xyzzy", "Q", "p" * 70, "ß"]) for _ in range(n)) for n in (1, 2, 31, 32, 33, 56, 57, 150)]
    assert net.score(texts) == pytest.approx([plain_score(net, t) for t in texts], rel=1e-4)


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores)) + 1
    y = np.array(labels) == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_toxicity_held_out():
    """On rows not fitted on, from characters and words alone; without either input it is worse."""
    import pyarrow.parquet as pq

    text = dict(zip(*(pq.read_table("/root/testdata/sf0.1/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")), strict=True))
    rows = [(i, y) for i, y in zip(*(pq.read_table("/root/testdata/sf0.1/labels.parquet").column(c).to_pylist() for c in ("doc_id", "toxic")), strict=True) if y in (0, 1) and i in text]
    fit, test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1], [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    chosen = [r for r in fit if r[1]][:800] + [r for r in fit if not r[1]][:1200]
    net = toxicity.train([text[i] for i, _ in chosen], [y for _, y in chosen])

    def now():
        net.known, net.inputs = {}, None
        return auc(net.score([text[i] for i, _ in test]), [y for _, y in test])

    whole = now()
    assert whole >= 0.9
    for name in ("words", "chars"):
        kept, net.p[name] = net.p[name], np.zeros_like(net.p[name])
        assert now() <= whole + 0.01
        net.p[name] = kept


def test_gru_gradient():
    rng = np.random.default_rng(0)
    gx, u, mask = rng.standard_normal((5, 3, 12)), rng.standard_normal((4, 12)) / 2, np.array([[1, 1, 1], [1, 1, 1], [1, 0, 1], [1, 0, 1], [0, 0, 1]], bool)
    weights = rng.standard_normal((5, 3, 4))
    loss = lambda g, v: (toxicity.gru(g, mask, v)[0] * weights).sum()
    _, cache = toxicity.gru(gx, mask, u, keep=True)
    dgx, du = toxicity.gru_back(weights, cache, mask, u)
    for a, d, f in ((gx, dgx, lambda x: loss(x, u)), (u, du, lambda x: loss(gx, x))):
        for at in [tuple(rng.integers(0, n) for n in a.shape) for _ in range(10)]:
            up, down = a.copy(), a.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            assert (f(up) - f(down)) / 2e-5 == pytest.approx(d[at], abs=1e-6)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.standard_normal(8).astype("float32").tolist(), 1) for i in range(300)] + [(400, None, 1), (420, [1.0, None] + [0.0] * 6, 1), (440, [float("nan")] * 8, 1), (None, [1.0] * 8, 1), (20, [0.5] * 8, 1), (460, [1.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in topk.exact_topk(topk.integer_vectors(df), F.col("vec_id") % 20 == 0, 7, shard=16, block=4).collect())
    ok = [(i, np.floor(64 * np.pad(np.array(v, "float32").astype(float), (0, 8 - len(v)))).astype(int)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for a, (q, v) in enumerate(ok):
        if q % 20 == 0:
            best = sorted((-int(v @ w), j) for b, (j, w) in enumerate(ok) if b != a)[:7]
            want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.exact_topk(topk.integer_vectors(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_beyond_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [int(x) for x in rng.integers(-(2**27), 2**27, 3)]) for k in range(60)]
    rows += [(60, [2**29, 1, 0]), (61, [2**29, 2, 0]), (80, [2**29, 1, 0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0, 3, shard=16, block=2).collect())
    want = []
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for j, w in rows if j != q)[:3]
            want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_warc_round_trip(spark):
    big = "é<p>" * 400
    rows = [(1, "http://a/%41\r\nx", big), (2, None, big), (9, "u", big), (3, "u3", "small"), (4, "u4", "small"), (5, "u5", None), (None, "n", big), (6, "u6", "y\r\n\r\nz" * 300), (6, "u6", "y\r\n\r\nz" * 300)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert [by[i][0]["record_type"] for i in (1, 2, 9, None, 3, 4, 5)] == ["revisit", "revisit", "response", "revisit", "response", "response", "response"]
    assert by[1][0]["refers_to"] == 9 and by[1][0]["url"] == rows[0][1] and by[2][0]["url"] is None and by[9][0]["payload"].decode() == big and by[1][0]["header_bytes"] == len(big.encode())
    assert all(r["record_type"] == "response" and r["payload"].decode() == rows[-1][2] for r in by[6]) and by[5][0]["payload"] == b""
    # any reader's view: a warcinfo record, HTTP messages, ids of their own, revisits that name their response
    import gzip

    ids, kinds, refers = [], [], set()
    for r in index.select("file").distinct().collect():
        raw = gzip.decompress(open(r["file"].removeprefix("file://"), "rb").read())
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            f = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
            n = int(f["Content-Length"])
            body, raw = rest[:n], rest[n:]
            assert raw[:4] == b"\r\n\r\n"
            raw = raw[4:]
            ids.append(f["WARC-Record-ID"])
            kinds.append(f["WARC-Type"])
            if f["WARC-Type"] != "warcinfo":
                assert f["WARC-Target-URI"] and body.startswith(b"HTTP/1.1 200 OK\r\n") and f["Content-Type"] == "application/http;msgtype=response"
            if f["WARC-Type"] == "revisit":
                refers.add(f["WARC-Refers-To"])
                assert f["WARC-Refers-To-Target-URI"] == "u"
    assert len(ids) == len(set(ids)) and refers < set(ids) and kinds.count("revisit") == 3 and kinds.count("response") == len(rows) - 3
    assert by[1][0]["url"] == "http://a/%41\r\nx"
    one = warc.read_records(index.filter("page_id = 4")).collect()
    assert len(one) == 1 and one[0]["payload"] == b"small"
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(7, "u", "x" * 3_000_000)] * 2, "page_id long, url string, html string")
    for name in ("digest", "refers_to", "name", "to", "n"):
        odd = odd.withColumn(name, F.lit("y"))
    assert [(r["record_type"], len(r["payload"])) for r in warc.read_records(warc.write_archives(odd)).collect()] == [("response", 3_000_000)] * 2
    assert warc.read_records(warc.write_archives(odd.limit(0))).count() == 0
    assert warc.ranges([("f", 10, 5), ("f", 0, 5), ("g", 0, 1)]) == [("f", 0, 15, [1, 0]), ("g", 0, 1, [2])]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    item = " ".join("bench%s" % "abcdefghijklmnopqrst"[k] for k in range(20))
    rng = random.Random(10)
    prose = lambda: "\n".join(" ".join(rng.choice(["lumo", "tarek", "vosin", "delph", "marun", "ostic"]) + rng.choice("aeiou") for _ in range(12)) + "." for _ in range(6))
    near = prose()
    rows = [(i, prose()) for i in range(30)] + [(40, near), (41, near.replace("lumo", "luma", 1)), (50, prose() + "\n" + item), (60, "123 456"), (61, None)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert set(range(30)) <= kept and 40 in kept and not kept & {50, 60, 61}
    check_packing(out, 4096)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    """Nulls, empty, long and repeated rows, ties, clashing names and empty tables in each stage."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "zu zv zw zx zy"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    prose = "one two three four five six seven"
    rows = [*AWKWARD, (20, prose), (21, prose), (21, prose), (None, prose), (30, "a zu zv zw zx zy b"), (None, "zu zv zw zx zy"), (31, "long " * 30_000), (32, prose + "\n" + prose)]
    df = docs_of(spark, rows)
    for name in ("row", "at", "runs", "whole", "lang_pred", "lang_score", "lang_rejected", "rep", "kept", "component_id", "u", "v", "loose", "piece"):
        df = df.withColumn(name, F.lit(name))
    texts = lambda df: sorted((repr(r["doc_id"]), repr(r["text"])[:60]) for r in df.collect())
    stages = dict(P.STAGES)
    for name in ("language_id", "line_dedup", "near_dedup", "decontamination"):
        got = stages[name](spark, df, str(tmp_path))
        assert got.columns == df.columns and got.schema["n_chars"].dataType == df.schema["n_chars"].dataType, name
        if got.count():
            assert got.filter("row <> 'row' or lang_pred <> 'lang_pred' or runs <> 'runs'").count() == 0
        assert stages[name](spark, df.limit(0), str(tmp_path)).count() == 0, name
    assert ("None", repr(prose)) in texts(stages["language_id"](spark, df, str(tmp_path))) and not {r["text"] for r in stages["language_id"](spark, df, str(tmp_path)).collect()} & {None, "", " \n\t "}
    assert stages["language_id"](spark, df.withColumn("lang", F.lit(None).cast("string")), str(tmp_path)).count() == len(rows)
    assert stages["line_dedup"](spark, df, str(tmp_path)).count() == len(rows)
    near = stages["near_dedup"](spark, df, str(tmp_path))
    assert {r["doc_id"] for r in near.filter(F.col("text") == prose).collect()} == {20, None}
    clean = texts(stages["decontamination"](spark, df, str(tmp_path)))
    assert len(clean) == len(rows) - 2 and not [x for x in clean if "zu zv" in x[1]]
    packed = stages["packing"](spark, df, str(tmp_path)).collect()
    check_packing(packed, 4096)
    assert len({r["doc_id"] for r in packed}) == len({i for i, _ in rows}) and stages["packing"](spark, df.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"])
def test_pipeline_stages_bound_batches(spark, tmp_path, name):
    """What a task and its Python worker exchange at once; a limit that is set stays, and groups stay whole."""
    import corpus_pipeline as P
    import pyarrow as pa
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "zu zv")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    large = spark.range(0, 1000, 1, 1).select("id", F.repeat(F.lit("x"), 20_000).alias("text"))

    def most(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(x.nbytes for x in batches)])], ["n"])

    seen = lambda: large.mapInArrow(most, "n long").first()["n"]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        assert seen() > 15_000_000
        dict(P.STAGES)[name](spark, docs_of(spark, [(1, "one two"), (2, "three")]), str(tmp_path)).count()
        assert seen() < 5_000_000
        sizes = large.groupBy(F.col("id") % 2).applyInPandas(lambda x: x[["id"]].assign(n=len(x)), "id long, n long")
        assert sizes.filter("n = 500").count() == 1000
        spark.conf.set(key, "1000000")
        dict(P.STAGES)[name](spark, docs_of(spark, [(1, "one two"), (2, "three")]), str(tmp_path)).count()
        assert seen() < 2_000_000
    finally:
        spark.conf.unset(key)


def test_pipeline_stages_on_small_batches(spark, tmp_path):
    """A batch's end changes no row: each stage with batches of a row or two and in one batch."""
    import corpus_pipeline as P

    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    lines_of = lambda w: "\n".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4))
    rows = [(i, lines_of(t.split())) for i, t in random_docs(60, 5)] + AWKWARD + [(200, "w1 w2 w3 w4 w5 w6 w7")]
    key, found = "spark.sql.execution.arrow.maxBytesPerBatch", []
    columns = {"packing": ["doc_id", "piece", "start", "length", "ids_crc32"]}
    try:
        for limit in ("64m", "300"):
            spark.conf.set(key, limit)
            found.append({n: sorted(map(repr, f(spark, docs_of(spark, rows).coalesce(1), str(tmp_path)).select(columns.get(n, ["doc_id", "text", "n_chars"])).collect())) for n, f in P.STAGES})
    finally:
        spark.conf.unset(key)
    assert found[0] == found[1] and all(found[0].values())
