import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tabsieve.llm import op8_mix
from test_op7 import brute

SF = "/root/testdata/sf0.01"


def test_each_stage_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stage = dict(P.STAGES)
    clean = P.common.cut(stage["toxicity"](spark, docs, SF), "t")
    assert clean.columns == columns
    left = {r.doc_id: r for r in clean.collect()}
    assert sum(v == 1 and k in left for k, v in labels.items()) <= 0.1 * sum(labels.values())
    assert sum(v == 0 and k not in left for k, v in labels.items()) <= 0.02 * len(labels)

    single = P.common.cut(stage["near_copies"](spark, clean, SF), "t")
    groups = brute([(k, r.text) for k, r in left.items()], 5, 80)
    left = {r.doc_id: r for r in single.collect()}
    assert single.columns == columns and set(left) == {k for k, (_, _, kept) in groups.items() if kept}

    fresh = P.common.cut(stage["benchmark_passages"](spark, single, SF), "t")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {k for k, r in left.items() if any(t in r.text for t in items)}
    kept = {r.doc_id: r for r in fresh.collect()}
    assert fresh.columns == columns and not holds & set(kept) and len(set(left) - holds - set(kept)) <= 0.01 * len(left)

    mixed = P.common.cut(stage["mixture"](spark, fresh, SF), "t")
    rows = mixed.collect()
    assert mixed.columns == columns and max(Counter(r.doc_id for r in rows).values()) <= 3
    size, got = defaultdict(int), defaultdict(int)
    for r in kept.values():
        size[r.source] += len(r.text.split())
    for r in rows:
        got[r.source] += len(r.text.split())
    names = sorted(size)
    goal = op8_mix.targets([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    assert abs(sum(got.values()) / sum(goal) - 1) < 0.1
    share = np.corrcoef([got[s] for s in names], goal)[0, 1]
    assert share > 0.9

    out = sorted((tuple(r) for r in stage["tokens"](spark, mixed, SF).collect()), key=lambda r: r[1])
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.text)):
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert out == want


def test_run_on_odd_rows(spark, tmp_path):
    sf = f"{tmp_path}/sf"
    docs = spark.createDataFrame(
        [(1, None, "en", "a", 1, 5), (1, "x y z", "en", None, 1, 5), (None, "x y z", None, "a", 1, 5), (2, "x y z w v " * 9, "en", "a", 1, 5), (2, "x y z w v " * 9, "en", "a", 1, 5)],
        "doc_id long, text string, lang string, source string, n_chars long, uid int",
    )
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "nothing like that here")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() >= 1
    empty = f"{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert P.run(spark, empty).count() == 0
