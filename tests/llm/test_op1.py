import hashlib
import random

from tabsieve.llm.op1_suffix_dedup import suffix_dedup


def brute(rows, length):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                hit[i : i + length] = b"\x01" * length
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if hit[i] and (i == 0 or not hit[i - 1]))
        out[doc_id] = (len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            k = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([p, p[k:], p[: len(p) - k], " ".join(word() for _ in range(40))]))
        rows.append((i, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 500), (n + 3, "xy" * 300), (n + 4, "a" * 120), (n + 5, rows[3][1]), (n + 6, rows[3][1])]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, **kw).collect()}


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows, 100)


def test_hot_groups_and_small_batches(spark):
    rows = corpus(3)
    assert run(spark, rows, most_bytes=300, batch_bytes=4000) == brute(rows, 100)


def test_repeated_ids_extra_columns_and_empty(spark):
    text = "the same text again and again, " * 6
    df = spark.createDataFrame([(1, text, 5), (1, text, 6), (None, text, 7)], "doc_id long, text string, uid int")
    out = sorted((r.doc_id is None, r.n_removed) for r in suffix_dedup(df).collect())
    n = len(text)
    assert [x for x in out if x[1] == n].__len__() == 2
    assert suffix_dedup(df.limit(0)).count() == 0


def test_different_segments_of_one_anchor_stay_apart():
    import numpy as np
    import pyarrow as pa

    from tabsieve.llm import common as C
    from tabsieve.llm import op1_suffix_dedup as M

    rng = np.random.default_rng(6)
    pool = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    at = np.arange(len(pool) - M.GRAM)
    low = int(C.span_hash(C.prefix(pool), at, at + M.GRAM).argmin())  # the gram that is the anchor of any window around it
    n = 300_000
    data = rng.integers(97, 123, (n, 100)).astype(np.uint8)
    data[:, 34:66] = pool[low : low + M.GRAM]
    batch = pa.record_batch({"uid": pa.array(np.arange(n)), "text": pa.array([r.tobytes().decode() for r in data])})
    found = pa.Table.from_batches(list(M._anchors([batch], 100)))
    assert found.num_rows == n and found.column("h").combine_chunks().value_counts()[0]["counts"].as_py() > 0.99 * n
    assert not any(found.column("again").to_pylist())


def test_no_byte_goes_on_a_hash_alone(spark, monkeypatch):
    """With digests of a few bits almost every pointer is wrong, in a batch and across batches; still no wrong byte goes."""
    import numpy as np

    from tabsieve.llm import op1_suffix_dedup as M

    rng = random.Random(8)
    gram = bytes(rng.randrange(97, 123) for _ in range(40)).decode()
    other = lambda: "".join(chr(rng.randrange(97, 123)) for _ in range(40))
    rows = [(i, other() + gram + other()) for i in range(120)]
    true = M._segments

    def short(*args):
        row, a, b, q, h, d = true(*args)
        return row, a, b, q, h, d % np.int64(3)

    monkeypatch.setattr(M, "_segments", short)
    uid, text = [r[0] for r in rows], [r[1] for r in rows]
    import pyarrow as pa

    found = pa.Table.from_batches(list(M._anchors([pa.record_batch({"uid": uid, "text": text})], 100)))
    assert not any(found.column("again").to_pylist())
    who, _, _ = M.repeated_windows(np.array(uid), np.zeros(len(uid), np.int64), [t.encode() for t in text], 100)
    assert not len(who)


def test_copies_in_many_batches_and_a_text_over_four_megabytes(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    long = " ".join(word() for _ in range(900_000))
    assert len(long) > 1 << 22
    part = long[2_000_000:2_009_000]
    rows = [(0, "start " + part), (1, long), (2, long[4_190_000:4_200_000] + "x" + long[100:9_000])]
    rows += [(k, long[5_000:9_500] if k % 3 else part[: 3_000 + k]) for k in range(3, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, batch_bytes=20_000).collect()}
    assert out == brute(rows, 100)


def test_equal_windows_by_brute_force_and_no_further_than_they_reach():
    import time
    from collections import defaultdict

    import numpy as np

    from tabsieve.llm import op1_suffix_dedup as M
    from tabsieve.llm import suffix

    rng = random.Random(12)
    for length in (2, 3, 6, 7, 12, 25):
        for letters in ("a", "ab", "abc\xff"):
            texts = [bytes(ord(rng.choice(letters)) for _ in range(rng.choice([0, 1, length, 60, 90]))) for _ in range(6)]
            texts += [b"a" * 70 + b"b" + b"a" * 40, b"b" * 50, texts[-1][10:] + b"a"]
            t, starts = suffix.concatenated(texts)
            sa, new = suffix.equal_windows(t, length)
            want = defaultdict(set)
            for x, s in zip(texts, starts.tolist()):
                for k in range(len(x) - length + 1):
                    want[x[k : k + length]].add(s + k)
            classes = np.split(sa, np.flatnonzero(new)[1:]) if len(sa) else []
            assert sorted(map(sorted, want.values())) == sorted(sorted(c.tolist()) for c in classes), (length, letters)
    # a long copy: ordering it to its end took a round for every six bytes
    body = bytes(rng.randrange(97, 123) for _ in range(400_000))
    began = time.process_time()
    who, lo, hi = M.repeated_windows(np.array([4, 9]), np.array([0, 7]), [b"x" + body, b"y" + body], 100)
    assert time.process_time() - began < 6
    assert (who.tolist(), lo.tolist(), hi.tolist()) == ([9], [8], [400_008])
