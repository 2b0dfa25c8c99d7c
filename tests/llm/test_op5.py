import io
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabsieve.llm import op5_tokens as T
from tabsieve.llm import sst

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = T.Encoder(open(PATH, encoding="utf-8").read())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sZ1é  \n\t  😀.<|>\x1c\x85")), max_size=30), max_size=5))
def test_pieces_give_the_same_ids(texts):
    texts = texts + ["x <|endoftext|> y", "it's  a\n test \n", " lead", "a\n b \nc"]
    got = [np.frombuffer(b, ENCODER.kind).tolist() for b in ENCODER.encode(texts)]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_table_round_trip_and_lookup():
    rng = random.Random(1)
    keys = sorted({sst.id_key(rng.randint(-(10**12), 10**12), 0) for _ in range(3000)} | {sst.id_key(None, 0), sst.id_key(5, 0), sst.id_key(5, 1)})
    rows = [(k, rng.randbytes(2 * rng.randint(0, 400))) for k in keys]
    f = io.BytesIO()
    w = sst.Writer(f, 2)
    for k, v in rows:
        w.add(k, v)
    w.close()
    r = sst.Reader(f, f.tell())
    assert list(r) == rows and len(r.keys) > 3 and r.total == sum(len(v) // 2 for _, v in rows)
    assert all(r.get(k) == v for k, v in rows[::37])
    gone = [sst.id_key(10**13 + k, 0) for k in range(500)]
    assert all(r.get(k) is None for k in gone) and sum(map(r.may_hold, gone)) < 30


def expected(rows):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_matches_direct_encoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in T.query(spark, "/root/testdata/sf0.001").collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark, tmp_path):
    rows = [(3, None), (1, ""), (2, "a  b "), (2, "a  b "), (2, "zz"), (None, "x"), (-5, "long " * 50000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)
    manifest = T.write_shards(docs, PATH, folder=f"file://{tmp_path}/s")
    got = sorted((tuple(r) for r in T.read_shards(spark, manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    paths = [m["path"] for m in manifest]
    assert next(x for x in (T.lookup(p, -5) for p in paths) if x) == TOKENIZER.encode("long " * 50000).ids + [2]
    assert all(T.lookup(p, 77) is None for p in paths)
    assert T.token_output(docs.limit(0), PATH).count() == 0


def test_a_frequent_id_spreads_over_shards_and_shards_follow_the_bytes(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(200)] + [(None, f"{k * 7919 % 1000} words of no id") for k in range(400)] + [(50, f"{k % 90} again") for k in range(200)] + [(None, None), (50, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    size = sum(len(t or "") for _, t in rows)
    manifest = T.write_shards(docs, PATH, folder=f"file://{tmp_path}/s", shard_bytes=size // 20)
    assert 15 <= len(manifest) <= 22 and max(m["n_docs"] for m in manifest) < 150
    got = [tuple(r) for r in T.read_shards(spark, manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)
    assert sum(bytes(m["first"])[0] for m in manifest) > 3  # shards that start without an id
