import random
import re

from tabsieve.llm import op7_minhash as M


def brute(rows, k=3, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed, n=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    bases = [[word() for _ in range(rng.randint(30, 200))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [word() for _ in range(60)]
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(x.upper() if rng.random() < 0.02 else x for x in w)))
    return rows + [(n, None), (n + 1, " "), (n + 2, "a b"), (n + 3, "A  b"), (n + 4, "b a"), (n + 5, "É é x"), (n + 6, "é é x")]


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_other_parameters_hot_nodes_and_cut_clusters(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(M.near_duplicates(df, shingle=5, percent=80, most_node=10, most_shingles=3000)) == brute(rows, 5, 80)


def test_a_node_twenty_times_too_large(spark):
    """Loosely similar texts of one template, many of them with a partner at the threshold: all share nodes of 20 times the limit."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template, rows = [word() for _ in range(60)], []
    for i in range(0, 400, 2):
        w = list(template)
        at = rng.randrange(0, 40)
        w[at : at + 9] = [word() for _ in range(9)]
        v = list(w)
        for k in rng.sample(range(50, 60), rng.choice([0, 1, 2])):
            v[k] = word()
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
    truth = brute(rows)
    out = got(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most_node=20, most_shingles=1_000))
    assert len({c for _, c, _ in truth.values()}) > 50
    assert sum(out[i] == truth[i] for i in truth) >= 0.99 * len(truth)


def test_long_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:290_000])), (3, " ".join(words[:100_000])), (4, "x" * 3_000_000)]
    assert got(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_real_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert got(M.query(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "a b c d", 0), (1, "a b c d", 0), (None, "a b c d", 0), (None, None, 0), (2, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = M.near_duplicates(df).collect()
    assert len(out) == 5 and sum(r.kept for r in out) == 3
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_large_nodes_branch_on():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**16, (40, M.COORDINATES)).astype("<u2")
    tokens = np.repeat(base, 50, 0)
    tokens[:, :2] = 7  # a popular node: all share two tokens
    change = rng.random(tokens.shape) < 0.05
    tokens = np.where(change, rng.integers(0, 2**16, tokens.shape), tokens).astype("<u2")
    out: list = []
    for key in (12345, 0x7FFFFFFF, 99):
        M._branch(tokens, np.full(len(tokens), 100), np.arange(len(tokens)), key, 0, 0.65, 0.85, out)
    groups = {a // 50: set() for a in range(len(tokens))}
    for a, b in out:
        assert a // 50 == b // 50
        groups[a // 50].update((a, b))
    assert sum(map(len, groups.values())) > 0.9 * len(tokens)


def test_links_between_different_texts_of_a_template_in_a_dealt_node(spark):
    import pyarrow as pa

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(50)]
    rows = []
    for i in range(150):
        own = [word() for _ in range(9)]
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:5] + [word() for _ in range(4)]))]
    truth = brute(rows, percent=86)
    keys = [set(M.tree_keys(M.minwise(s), 2)) for _, s in M.shingle_sets(pa.record_batch({"text": [t for _, t in rows]}), 3)]
    meet = [i for i in range(0, 300, 2) if keys[i] & keys[i + 1] and truth[i][1] == truth[i + 1][1]]
    assert len(meet) > 100
    out = got(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=86, trees=2, most_node=20, most_shingles=1_000))
    assert [i for i in meet if out[i][1] != out[i + 1][1]] == []


def test_large_nodes_part_no_similar_rows():
    import numpy as np

    rng = np.random.default_rng(3)
    tokens = np.repeat(rng.integers(0, 2**16, (300, M.COORDINATES)), 2, 0)
    tokens = np.where(rng.random(tokens.shape) < 0.12, rng.integers(0, 2**16, tokens.shape), tokens).astype("<u2")
    agree = (tokens[::2] == tokens[1::2]).mean(1) >= 0.65
    label = M._labels(600, M._node(tokens, np.full(600, 100), 12345, 0.65, 0.85))
    assert agree.sum() > 250 and ((label[::2] == label[1::2]) == agree).all()


def test_hot_classes_meet_without_a_shuffle(spark):
    rows = [(i, ["a b c d e f", "g h i j k l m", "", None][i % 4] if i < 80 else f"w{i} x{i} y{i} z{i}") for i in range(120)] + [(200, "a b c d e f"), (201, "A b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(M.near_duplicates(df, hot_class=5)) == got(M.near_duplicates(df)) == brute(rows)


def test_rows_with_maps_and_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, long, {"a": 1}), (1, long + " end", {"b": 2}), (None, "a b c d e f", None), (2, "a b c d e f", {"a": 1})]
    out = M.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, facts map<string,int>")).collect()
    assert sorted((r.doc_id, len(r.text)) for r in out) == [(1, len(long)), (2, 11)]
