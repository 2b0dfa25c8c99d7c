import itertools

import numpy as np
import public_tokenizers

from pyspark.sql import functions as F
from tabsieve.llm import op2_language as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = L.Pieces([b"a", b"b", b" ", b"ab", b" a", b"bab", b"aba"])
    rng = np.random.default_rng(1)
    probs = np.vstack([rng.random((7, 2)), np.zeros((1, 2))])
    names = [b"a", b"b", b" ", b"ab", b" a", b"bab", b"aba"]
    word = b" abab"
    want = np.zeros(2)
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:k])
                at = k
        parts.append(word[at:])
        if all(p in names for p in parts):
            want += np.prod([probs[names.index(p)] for p in parts], axis=0)
    m = np.frombuffer(word, np.uint8)[None]
    got = L.forward(pieces.lattice(m), probs, len(word))[-1][0]
    assert np.allclose(got, want)


def test_words_of_any_length_keep_all_their_segmentations():
    names = [*(bytes([b]) for b in range(256)), b"ab", b"aba", b" a", b"bc", "世界".encode(), "é".encode()]
    pieces = L.Pieces(sorted(names))
    rng = np.random.default_rng(2)
    probs = np.vstack([rng.random((pieces.n, 2)) / 50, np.zeros((1, 2))])
    place = {x: k for k, x in enumerate(sorted(names))}
    model = L.Model(["x", "y"], pieces, probs)
    for word in ("abc", "世界é" * 400, "ab" * 3000, "zq" * 70 + "aba" * 9, "abcab" * 1700 + "世"):
        b = b" " + word.encode()
        log = np.full((len(b) + 1, 2), -np.inf)
        log[0] = 0
        for j in range(1, len(b) + 1):
            for l in range(1, min(6, j) + 1):
                k = place.get(b[j - l : j])
                if k is not None:
                    log[j] = np.logaddexp(log[j], log[j - l] + np.log(probs[k]))
        parts, _ = L.units([word], pieces)
        assert b"".join(parts) == b
        got = np.zeros(2)
        for _, m, lengths in L.by_length(parts):
            got += L.log_sums(pieces, probs, m, lengths).sum(0)
        assert np.allclose(got, log[-1])
        p = np.exp(log[-1] - log[-1].max())
        assert np.allclose(model.score([word])[0], np.log((1 - L.FOREIGN) * p + L.FOREIGN * p.mean()))


def test_fit_raises_the_likelihood():
    pieces = L.Pieces(sorted([*(bytes([b]) for b in range(256)), b" th", b"the", b"he", b"an", b"and", b" an"]))
    counts = {"the": np.array([9.0, 1]), "and": np.array([5.0, 0]), "than" * 40: np.array([2.0, 1]), "hand": np.array([0.0, 7])}

    def likelihood(model):
        out = 0
        for w, n in counts.items():
            parts, _ = L.units([w], pieces)
            out += sum(n * L.log_sums(pieces, model.probs, m, lengths).sum(0) for _, m, lengths in L.by_length(parts))
        return out

    steps = [likelihood(L.fit(["a", "b"], counts, pieces, rounds=r)) for r in range(4)]
    assert all((y >= x - 0.05).all() for x, y in zip(steps, steps[1:])) and (steps[-1] > steps[0]).all()


def test_ties_go_to_the_first_language(spark):
    rows = [(1, "same words here", "b"), (2, "same words here", "a"), (3, "same", None)]
    out = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False), PATH).collect()
    assert {r.lang_pred for r in out} == {"a"}


def test_held_out_accuracy(spark):
    d = L.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = d.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a >= 0.97 and 0 <= r.lo and r.hi <= 1


def test_odd_rows(spark):
    rows = [(1, "the house is over there", "en"), (2, "das haus ist dort drüben", "de"), (3, None, "en"), (4, "", None), (5, "1234 !!", "en"), (None, "the house", None), (1, "x" * 5000 + " das haus", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    out = L.identify(df, F.lit(False), PATH).collect()
    assert len(out) == 7
    assert [r.lang_pred for r in out if r.doc_id in (3, 4, 5)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in out)
    assert L.identify(df.limit(0), F.lit(False), PATH).count() == 0
    none = L.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False), PATH).collect()
    assert {r.lang_pred for r in none} == {"und"}
