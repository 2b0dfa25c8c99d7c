import re
from collections import defaultdict

import numpy as np

from tabsieve.llm import op8_mix as M


def test_permutation_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        for key in (1, 99):
            out = M.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(out.tolist()) == list(range(n))


def test_targets_share_again_what_is_above():
    assert M.targets([10, 100, 1000], [5, 2, 1]) == [30.0, 300.0, 780.0]
    got = M.targets([500, 500, 500, 0], [5, 2, 1, 5])
    assert np.allclose(got, [937.5, 375, 187.5, 0])
    assert M.targets([], []) == []


def test_shard_counts_use_all_slots():
    slots = [200_000, 30_000, 7, 0]
    got = [M.shard_counts(slots, 5, k, 1) for k in range(5)]
    assert np.array_equal(sum(own for _, own in got), slots)
    for k, (first, own) in enumerate(got):
        assert np.array_equal(first, sum((x for _, x in got[:k]), np.zeros(4, np.int64)))
        assert abs(own.sum() / (230_007 / 5) - 1) < 0.02 and abs(own[0] / own.sum() - 200_000 / 230_007) < 0.02
    assert np.array_equal(M.shard_counts(slots, 1, 0, 1)[1], slots)


def test_shard_counts_are_multinomial_at_any_size():
    """Mean and variance of a source's slots in a shard, far beyond 32 bits as well."""
    for total, shards in ((64_000, 64), (64 * 10**12, 64)):
        own = np.array([M.shard_counts([total], shards, k, seed)[1][0] for seed in range(12) for k in range(shards)], float)
        mean = total / shards
        assert abs(own.mean() / mean - 1) < 1e-9 and 0.85 < own.var() / (mean * (1 - 1 / shards)) < 1.15


def check(rows, out):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for _, t, s in rows:
        by[s] += size(t)
    names = sorted(x for x in by if x is not None) + [None] * (None in by)
    goal = dict(zip(names, M.targets([by[x] for x in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
    taken = defaultdict(int)
    source = {r[0]: r[2] for r in rows}
    for r in out:
        s = source[r.doc_id]
        assert r.size == size(next(t for i, t, _ in rows if i == r.doc_id)) and r.source_size == by[s] and abs(r.target - goal[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= max(3 * M.BLOCK_WORDS, 0.02 * goal[s]), (s, taken[s], goal[s])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    out = M.query(spark, sf).collect()
    assert len(out) == len(rows)
    check(rows, out)
    assert sorted(map(tuple, M.query(spark, sf).collect())) == sorted(map(tuple, out))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "w " * 9000, "b"), (4, "x y z", None), (5, "x", ""), (6, "é é é", "a"), (7, "w " * 500, "c")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, source string, target int, s int")
    out = M.mix(df).collect()
    assert len(out) == 7
    check(rows, out)
    assert M.mix(df.limit(0)).count() == 0
    assert len(M.mix(df.limit(2)).collect()) == 2
    again = df.unionByName(df)
    assert len(M.mix(again).collect()) == 14
