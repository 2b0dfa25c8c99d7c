import random

import numpy as np
from pyspark.sql import functions as F

from tabsieve.llm import op10_decontaminate as B


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (2 * len(a))


def test_alignment_matches_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        assert B.align(a, b) == slow_align(a, b)


def planted(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6)))
    items = [(100 + k, " ".join(word() for _ in range(rng.randint(15, 50)))) for k in range(30)]
    docs, truth = [], {}
    for i in range(400):
        w = [word() for _ in range(rng.randint(0, 150))]
        kind = rng.choice(["clean", "clean", "exact", "edited", "loud"])
        if kind != "clean":
            item, text = rng.choice(items)
            p = text.split()
            if kind == "edited":
                for _ in range(len(p) // 8):
                    k = rng.randrange(len(p))
                    p[k : k + 1] = rng.choice([[], [word()], [word(), p[k]]])
            if kind == "loud":
                p = [x.upper() + "," for x in p]
            at = rng.randint(0, len(w))
            w[at:at] = p
            truth[i] = item
        docs.append((i, " ".join(w)))
    return docs, items, truth


def test_copies_and_edited_copies_are_found(spark):
    docs, items, truth = planted()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most_words in (2_000_000, 300):
        out = B.decontaminate(d, b, most_words=most_words).collect()
        assert {r.doc_id: r.item_id for r in out if r.contaminated} == truth
        assert all(r.kept != r.contaminated for r in out) and len(out) == len(docs)


def test_an_item_in_most_documents_keeps_its_seeds(spark):
    docs, items, truth = planted(8)
    hot = items[0][1]
    rows = docs + [(1000 + k, f"lead {k} {hot} tail") for k in range(900)]
    out = B.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sum(r.contaminated for r in out if r.doc_id >= 1000) == 900
    assert {r.doc_id for r in out if r.contaminated and r.doc_id < 1000} == set(truth)


def test_real_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    inside = {r.doc_id for r in docs.join(F.broadcast(bench.select(F.col("text").alias("t"))), F.col("text").contains(F.col("t"))).select("doc_id").collect()}
    out = {r.doc_id for r in B.query(spark, sf).where("contaminated").collect()}
    assert inside <= out and len(out - inside) <= 0.01 * docs.count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "one two three four five six", 3), (2, "x " * 30000 + "one two three four five six", 4)], "doc_id long, text string, score int")
    bench = spark.createDataFrame([(5, "One two, three four five six!"), (5, "One two, three four five six!"), (None, "x x x x x"), (6, None), (7, ""), (8, "one")], "item_id long, text string")
    out = B.decontaminate(docs, bench).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.item_id) for r in out if r.contaminated) == [(False, 2, 5), (True, None, 5)]
    assert B.decontaminate(docs.limit(0), bench).count() == 0
    assert B.decontaminate(docs, bench.limit(0)).where("kept").count() == 4


def test_documents_with_frequent_phrases_only(spark):
    items = [(1, "the of and to " + " ".join(f"w{k}" for k in range(30)))]
    docs = [(k, f"x{k} the of and to y{k}") for k in range(200)]
    out = B.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(out) == 200 and not any(r.contaminated for r in out)


def test_an_edited_passage_in_hundreds_of_documents_is_found(spark):
    rng = random.Random(11)
    w = [f"w{k}" for k in range(39)]
    other, third = [f"v{k}" for k in range(16)], [f"u{k}" for k in range(39)]
    edited, short = list(w), list(other)
    for k in (5, 15, 26):
        edited[k] = "changed"
    short[7] = "changed"
    docs = [(k, " ".join([f"a{rng.random()}", *(edited if k % 2 else short), f"b{k}"])) for k in range(600)]
    docs += [(k, " ".join([f"a{k}", *third[:22]])) for k in range(600, 700)]
    out = B.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(w)), (2, " ".join(other)), (3, " ".join(third))], "item_id long, text string")).collect()
    assert {r.doc_id: r.item_id for r in out if r.contaminated} == {k: 3 if k >= 600 else 1 if k % 2 else 2 for k in range(700)}


def test_bounds_leave_out_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(4, 20)))) for k in range(60)]
    bench = B.Bench(items, 2, 3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 16, rng.integers(0, 60))).encode() for _ in range(40)]
    word, row = B.folded(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
    every = bench.scores(word, row, 40)
    for most_pairs in (1 << 20, 50):
        monkeypatch.setattr(B, "MOST_PAIRS", most_pairs)
        some = bench.scores(word, row, 40, 0.6)
        for a, b in zip(every, some):
            assert {x for x in a if x[0] >= 0.6} == {x for x in b if x[0] >= 0.6}
            assert min(a, key=lambda x: (-x[0], x[1]), default=None) == min(b, key=lambda x: (-x[0], x[1]), default=None)


def test_clashing_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 9, "x"), (2, "else", 9, "x")], "doc_id long, text string, score int, item_id string")
    items = spark.createDataFrame([(5, "one two three four five six")], "item_id long, text string")
    assert [(r.doc_id, r.score, r.item_id) for r in B.match(docs, items).orderBy("doc_id").collect()] == [(1, 1.0, 5), (2, 0.0, None)]
    assert [tuple(r) for r in B.drop_contaminated(docs, items).collect()] == [(2, "else", 9, "x")]
