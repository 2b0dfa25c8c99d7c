import numpy as np
from pyspark.sql import functions as F

from tabsieve.llm import op3_toxicity as T
from tabsieve.llm import trees


def test_isotonic_is_monotone_and_matches_pooling():
    rng = np.random.default_rng(0)
    s = rng.random(400)
    y = (rng.random(400) < s).astype(float)
    iso = trees.Isotonic(s, y)
    out = iso(np.sort(s))
    assert (np.diff(out) >= -1e-12).all() and abs(iso(s).mean() - y.mean()) < 1e-9


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    p = trees.fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = T.query(spark, sf).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    p = {x.toxic: x.p for x in r}
    assert p[1] > 0.9 and p[0] < 0.02


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "you idiot", 1), (1, "word " * 20000, 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    out = T.score(docs, labels, T.is_held_out).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert T.score(docs.limit(0), labels, T.is_held_out).count() == 0
    assert {r.score for r in T.score(docs, labels.limit(0), T.is_held_out).collect()} == {0.0}


def brute_features(text, weights):
    """The features, word by word."""
    text = text or ""
    words, low = text.split(), text.lower().split()
    n, look, weight, odd = max(len(low), 1), [], [], 0
    for w in low:
        p = T.plain(w)
        v = weights.get(p)
        if v is None and p and not p.isalpha() and T.disguised(w) in weights:
            v, odd = weights[T.disguised(w)], odd + 1
        look.append(v)
    for k, w in enumerate(low):
        own = look[k]
        for e in T.stems(T.plain(w)):
            if e in weights and sum(e in T.stems(T.plain(x)) for x in low) > 1:
                own = max(0.0 if own is None else own, weights[e])
        weight.append(own)
    at = [k for k, v in enumerate(weight) if v is not None]
    you = [k for k, w in enumerate(low) if T.plain(w) in T.SECOND]
    top = max((sum(a <= b < a + T.WINDOW for b in at) for a in at), default=0)
    near = sum(any(abs(a - b) <= T.NEAR for b in you) for a in at)
    letters = sum(1 for c in text.encode() if 65 <= c <= 90 or 97 <= c <= 122 or 0xC3 <= c < 0xF5)
    upper = sum("A" <= c <= "Z" for c in text)
    shout = sum(len(w) > 2 and w.isupper() for w in words) if upper > 2 else 0
    distinct = {low[k]: weight[k] for k in at}
    return [
        float(np.log1p(len(low))), len(at) / n, float(np.log1p(len(at))), len(distinct), sum(weight[k] for k in at) / n, max(distinct.values(), default=0.0), odd / n, top / T.WINDOW,
        near / max(len(at), 1), near / n, len(you) / n, upper / max(letters, 1), shout / n, text.count("!") / n, text.count("?") / n, len(T.MIXED.findall(text)) / n,
    ]


def test_features_by_brute_force():
    import random

    rng = random.Random(4)
    weights = {"idiot": 3.0, "trash": 2.0, "worm": 1.5, "dumm*": 2.5, "schwach*": 1.2}
    lexicon = T.Lexicon(weights)
    pool = ["idiot", "1d10t", "IDIOT!", "tr@sh", "t.r.a.s.h", "worm,", "dummkopf", "dummheit", "schwachkopf", "you", "Du,", "the", "a", "w0rd", "why?", "Été", "NO", "STOP", "\n", "don't!!"]
    texts = [None, "", " ", "idiot", "dummkopf", "dummkopf dummkopf", *(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 150))) for _ in range(150))]
    for t in texts:
        assert np.allclose(T.features(t, lexicon), brute_features(t, weights)), t


def test_entries_by_brute_force():
    low = "dummkopf dummheit idiot idiot, x du dumm".split()
    plain = {T.plain(w) for w in low}
    want = plain | {p[:k] + "*" for p in plain for k in T.STEMS if sum(T.plain(w)[:k] == p[:k] and len(T.plain(w)) > k for w in low) > 1}
    assert T.entries(low) == want
