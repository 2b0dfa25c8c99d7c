import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tabsieve.llm import op6_quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def rows():
    rng = random.Random(5)
    out = [None, "", " \n\t", "one", "a b c d e a b c d e", "x\n" * 30, "é😀 #*# \x0b zz\x0c|", "\n".join(["same line here"] * 4 + [" ", "same line here ", ""]), "nbsp\xa0is no\x85break " * 9]
    for _ in range(60):
        w = [rng.choice(["aa", "b", "çé", "d#", "e|", "😀"]) for _ in range(rng.randint(0, 60))]
        out.append("".join(x + rng.choice([" ", "\n", "  ", "\t", "\r\n"]) for x in w))
    out.append(" ".join(str(rng.randint(0, 10**6)) for _ in range(200_000)))
    return list(enumerate(out))


def test_base_columns_match_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, kept int").coalesce(2)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.judge(docs, labels).collect()}
    for k, text in data:
        assert got[k] == brute(text), (k, text[:60] if text else text)
    assert Q.judge(docs.limit(0), labels).count() == 0


def test_verdict_on_rows_outside_the_sample(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    taught, rest = labels.where("doc_id % 3 = 0"), labels.where("doc_id % 3 <> 0")  # nothing is learned from the rest
    r = {x.quality: x.k for x in Q.judge(docs, taught).join(rest, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert r[1] > 0.97 and r[0] < 0.1


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert Q.judge(docs, labels).where("NOT kept").count() == 3


def test_grams_are_of_characters():
    import numpy as np

    from tabsieve.llm import common as C

    texts = ["", "é😀", "añbé", "añbé", "xañbéz\u00e9😀", "abc"]
    raw = [t.encode() for t in texts]
    part = Q.Part(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    *_, (bucket, row) = part.families()
    want = []
    for r, t in enumerate(texts):
        for i in range(len(t) - 3):
            g = np.frombuffer(t[i : i + 4].encode(), np.uint8)
            want.append((int(C.span_hash(C.prefix(g), np.array([0]), np.array([len(g)]))[0] >> np.uint64(64 - Q.BITS)), r))
    assert list(zip(bucket.tolist(), row.tolist())) == want


def test_extra_columns_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 900_000, 3, "x"), (2, "", 3, "x")], "doc_id long, text string, n_words int, probability string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    assert got[1].n_words == got[1].n_repeat_words == 900_000 and not got[1].kept and got[2].n_words == 0
