"""Quality rules: counted rules, and a hashed n-gram logistic regression with calibrated probabilities.

Features: hashed words, hashed pairs of neighbouring words (a word next to itself is one feature of its own) and hashed grams of 4 characters, each family as
relative frequencies in 2**BITS buckets. Weights are fitted on a bounded sample of labelled rows, at most about `most_rows`, half of each class, drawn by
a hash of doc_id; a quarter of it, kept apart, calibrates the probability (Platt scaling, weighted back to the labels' own shares). A text is kept if it
passes the counted rules and its probability is `threshold` or more.

Scoring works on the bytes of Arrow batches with numpy, in parts of about a MB, without a shuffle and without a loop over words. The 1 MB table of
weights is the only thing sent to the executors.

Defined results: null text has no words; texts of under 10 words fail; documents with several labels count as good only if all are; null labels teach nothing;
without labelled rows of both classes the verdict is the counted rules alone; null or repeated doc_ids are judged row by row; texts of any length are read whole, a
very long one as a part of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm import common as C
from tabsieve.llm import trees

BITS = 18
GRAM = 4
SUB_BYTES = 1 << 18
LEAST_WORDS = 10
REPEAT_WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Bytes that start a character.
LEADS = (np.arange(256) & 0xC0) != 0x80
SCALE = 20.0
SAME = np.uint64(0x5851F42D4C957F2D)


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n).astype(np.int64)


class Part:
    """Words, their rows and hashes, for a few rows of bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.prefix = C.prefix(data)
        self.start, self.end, self.row = C.word_spans(data, offsets)
        self.word = C.span_hash(self.prefix, self.start, self.end)
        self.n_words = np.bincount(self.row, minlength=self.n)

    def base(self):
        """word_chars, n_symbols, n_dup_lines, n_repeat_words for each row."""
        zero = np.zeros(1, np.int64)
        leads = np.concatenate([zero, np.cumsum(LEADS[self.data] & ~C.SPACE[self.data])])
        marks = np.concatenate([zero, np.cumsum(SYMBOLS[self.data])])
        o = self.offsets
        return leads[o[1:]] - leads[o[:-1]], marks[o[1:]] - marks[o[:-1]], self._dup_lines(), self._repeat_words()

    def _dup_lines(self) -> np.ndarray:
        # a line with a word that equals an earlier line of its row
        breaks = np.flatnonzero(self.data == 10)
        row = np.searchsorted(self.offsets, breaks, "right") - 1
        filled = np.flatnonzero(np.diff(self.offsets) > 0)
        start = np.concatenate([self.offsets[filled], breaks + 1])
        owner = np.concatenate([filled, row])
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        end = np.where(last, self.offsets[owner + 1], np.append(start[1:], 0) - 1) if len(owner) else start
        has = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        start, end, owner = start[has], end[has], owner[has]
        h = C.span_hash(self.prefix, start, end) ^ C.mix(owner.astype(np.uint64))
        _, first = np.unique(h, return_index=True)
        again = np.ones(len(h), bool)
        again[first] = False
        return _sums(again, owner, self.n)

    def _repeat_words(self) -> np.ndarray:
        k = REPEAT_WINDOW
        if len(self.word) < k:
            return np.zeros(self.n, np.int64)
        m = len(self.word) - k + 1
        inside = self.row[:m] == self.row[k - 1 :]
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD1342543DE82EF95) + self.word[j : j + m]
        at = np.flatnonzero(inside)
        h = C.mix(h[at] ^ C.mix(self.row[at].astype(np.uint64)))
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        cover = np.zeros(len(self.word) + 1, np.int64)
        starts = at[twice]
        cover[starts] += 1
        np.subtract.at(cover, starts + k, 1)
        return _sums(np.cumsum(cover[:-1]) > 0, self.row, self.n)

    def families(self):
        """(buckets, rows) of each family of n-grams."""
        shift = np.uint64(64 - BITS)
        yield C.mix(self.word + np.uint64(1)) >> shift, self.row
        pair = np.flatnonzero(self.row[1:] == self.row[:-1])
        a, b = self.word[pair], self.word[pair + 1]
        yield C.mix(np.where(a == b, SAME, a * np.uint64(0xD1342543DE82EF95) + b)) >> shift, self.row[pair]
        chars = np.flatnonzero(LEADS[self.data])
        row = np.repeat(np.arange(self.n), np.diff(self.offsets))[chars]
        m = max(len(chars) - GRAM + 1, 0)
        at = np.flatnonzero(row[:m] == row[GRAM - 1 :])
        end = np.append(chars, len(self.data))[at + GRAM]
        yield C.span_hash(self.prefix, chars[at], end) >> shift, row[at]


def parts(batch, most: int = SUB_BYTES):
    data, offsets = C.text_buffer(batch.column("text"))
    for lo, hi in C.slices(offsets, most):
        yield lo, hi, Part(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


class Model:
    def __init__(self, weights: np.ndarray, a: float, b: float):
        self.weights, self.a, self.b = weights.astype(np.float32), a, b

    def predict(self, part: Part) -> np.ndarray:
        z = np.zeros(part.n)
        for bucket, row in part.families():
            z += np.bincount(row, self.weights[bucket], part.n) * SCALE / np.maximum(np.bincount(row, minlength=part.n), 1)
        return trees.sigmoid(self.a * z + self.b)


def _featurised(batches):
    for batch in batches:
        good, share, idx, val = batch.column("good").to_pylist(), batch.column("part").to_pylist(), [], []
        for _, _, p in parts(batch):
            rows = [([], []) for _ in range(p.n)]
            for bucket, row in p.families():
                cuts = np.searchsorted(row, np.arange(p.n + 1))
                for r in range(p.n):
                    k, c = np.unique(bucket[cuts[r] : cuts[r + 1]], return_counts=True)
                    rows[r][0].append(k.astype(np.int32))
                    rows[r][1].append((c * (SCALE / max(cuts[r + 1] - cuts[r], 1))).astype(np.float32))
            idx += [np.concatenate(a) for a, _ in rows]
            val += [np.concatenate(b) for _, b in rows]
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.int32()), pa.array(share, pa.int32()), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["good", "part", "idx", "val"])


def fit(idx: list, val: list, y: np.ndarray, held: np.ndarray, weight: np.ndarray, rounds: int = 40, rate: float = 0.3, l2: float = 1e-4) -> Model:
    """Adam on the logistic loss over the rows not held, then Platt scaling on the held ones."""
    n = 1 << BITS
    tr = np.flatnonzero(~held)
    sizes = np.array([len(idx[k]) for k in tr])
    keys, x, owner = np.concatenate([idx[k] for k in tr]), np.concatenate([val[k] for k in tr]), np.repeat(np.arange(len(tr)), sizes)
    w, b, m, v = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1)
    t = y[tr]
    for k in range(1, rounds + 1):
        r = trees.sigmoid(np.bincount(owner, w[keys] * x, len(tr)) + b) - t
        g = np.append(np.bincount(keys, x * r[owner], n) / len(tr) + l2 * w, r.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    z = np.array([float((w[idx[k]] * val[k]).sum()) for k in np.flatnonzero(held)])
    a, c = 1.0, b
    th, wh = y[held], weight[held]
    if len(z) and th.min() < th.max():
        soft = np.where(th > 0, (th.sum() + 1) / (th.sum() + 2), 1 / ((1 - th).sum() + 2))
        for _ in range(50):  # Newton steps
            p = trees.sigmoid(a * z + c)
            d, h = wh * (p - soft), wh * np.maximum(p * (1 - p), 1e-6)
            H = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
            s = np.linalg.solve(H, np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()]))
            a, c = a - float(np.clip(s[0], -1, 1)), c - float(np.clip(s[1], -5, 5))
    return Model(w, max(a, 1e-3), c)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 2_000) -> Model | None:
    """Fit on docs (doc_id, text) with labels (doc_id, quality 0/1); None without both classes."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("good"))
    n = {r["good"]: r["n"] for r in one.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30))
    share = F.when(F.col("good") == 1, F.lit(min(1.0, most_rows / 2 / n[1]))).otherwise(F.lit(min(1.0, most_rows / 2 / n[0])))
    picked = one.where(draw < share * (1 << 30)).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).cast("int"))
    # the picked ids are bounded by most_rows, so they are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("good", "part", "text")
    table = rows.mapInArrow(_featurised, "good int, part int, idx array<int>, val array<float>").toArrow()
    y, held = table.column("good").to_numpy().astype(float), table.column("part").to_numpy() == 0
    idx = [x for c in table.column("idx").chunks for x in np.split(c.flatten().to_numpy(), np.asarray(c.offsets)[1:-1] - np.asarray(c.offsets)[0])] if len(y) else []
    val = [x for c in table.column("val").chunks for x in np.split(c.flatten().to_numpy(), np.asarray(c.offsets)[1:-1] - np.asarray(c.offsets)[0])] if len(y) else []
    if not len(y) or y[~held].min(initial=1) == y[~held].max(initial=0):
        return None
    weight = np.where(y > 0, n[1] / max(y.sum(), 1), n[0] / max((1 - y).sum(), 1))
    return fit(idx, val, y, held, weight / weight.mean())


def _judged(batches, model: Model | None, threshold: float, most_repeated: int):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for batch in batches:
        out, prob = [], []
        for _, _, p in parts(batch):
            out.append(np.stack([p.n_words, *p.base()]))
            prob.append(model.predict(p) if model else np.ones(p.n))
        m = np.concatenate(out, 1) if out else np.zeros((5, 0), np.int64)
        prob = np.concatenate(prob) if prob else np.zeros(0)
        failed = (m[0] < LEAST_WORDS) | (100 * m[4] > most_repeated * m[0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in m), pa.array(failed), pa.array(~failed & (prob >= threshold)), pa.array(prob)],
            names=["doc_id", *names, "base_failed", "kept", "probability"],
        )


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_rows: int = 2_000, most_repeated: int = 20) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability for each row of docs."""
    model = train(docs, labels, most_rows)
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: _judged(it, model, threshold, most_repeated),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double",
    )


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
