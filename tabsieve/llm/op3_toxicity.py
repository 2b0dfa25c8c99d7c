"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words (plain, and after undoing character substitutions), their share near a second-person pronoun, the densest
window, capitals, punctuation and obfuscation rates. The lexicon is learned: words, and
stems of 4 to 7 letters that a text has twice or more, whose document frequency among toxic training rows is far above the others'. Training uses at most
about `most_rows` labelled rows, drawn by a hash of doc_id. The lexicon of one half of them makes the features of the other half, so no row's features come from its own label; the trees are fitted on three quarters and calibrated on all out-of-fold scores.
Scoring covers every whole text in one Arrow pass without a shuffle; the model is a few hundred kB.

Defined results: null and empty texts are scored as texts without words; null labels teach nothing; a document with several labels is toxic if one says
so; without labelled rows of both kinds every score is the share of toxic rows (0 without any); null or repeated doc_ids are scored row by row; texts of any length
are read whole; an empty table gives no rows; score() ignores other columns, reject_toxic() keeps them.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm import common as C
from tabsieve.llm import trees

#: Second-person pronouns of the four languages (fixed values).
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: What a character in a disguised word stands for (fixed values).
UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
EDGE = "\"'.,;:?()[]{}<>«»„“”‘’…-_"
INNER = re.compile(r"[.\-_*~]")
TRIPLE = re.compile(r"(.)\1{2,}")
N_FEATURES = 16
WINDOW = 40
NEAR = 5
STEMS = (4, 5, 6, 7)


def plain(word: str) -> str:
    return word.strip(EDGE).rstrip("!")


def disguised(word: str) -> str:
    """The word without the usual disguises: substitutions, inner separators, stretched letters."""
    return TRIPLE.sub(r"\1", INNER.sub("", plain(word).translate(UNDO)))


def stems(p: str) -> list[str]:
    """The first letters of a plain word, marked by *."""
    return [p[:k] + "*" for k in STEMS if len(p) > k]


def entries(low: list[str]) -> set[str]:
    """What may be in a lexicon from a text's words: plain words, and stems that at least two of its words have."""
    seen: set[str] = set()
    twice: set[str] = set()
    for w, n in Counter(low).items():
        p = plain(w)
        for e in stems(p):
            if n > 1 or e in seen:
                twice.add(e)
        seen.update(stems(p))
        seen.add(p)
    return {e for e in seen if e and e[-1] != "*"} | twice


UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5))
ODD = b"0123456789@$*!|+"
MIXED = re.compile(r"[^\W\d_][0-9@$*!|+][^\W\d_]")
CACHE = 100_000
ROWS = 512


class Lexicon:
    """Words and stems with weights; remembers what it found for a word."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.seen = weights, {}

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def look(self, w: str):
        """None, or (weight or None, is disguised, stems in the lexicon, is a second-person pronoun) of a lower-case word."""
        p = plain(w)
        v, odd = self.weights.get(p), False
        if v is None and p and not p.isalpha():
            v = self.weights.get(disguised(w))
            odd = v is not None
        found = [e for e in stems(p) if e in self.weights]
        you = p in SECOND
        return (v, odd, found, you) if v is not None or found or you else None

    def notable(self, counts) -> dict[str, tuple]:
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        out = {}
        for w in counts:
            try:
                f = seen[w]
            except KeyError:
                f = seen[w] = self.look(w)
            if f is not None:
                out[w] = f
        return out


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    low = text.lower().split()
    n = max(len(low), 1)
    hits, weight, odd, places, top, near = 0, 0.0, 0, [], 0, 0
    counts = Counter(low)
    notable = lexicon.notable(counts)
    weights: dict[str, float] = {}  # of the words as written
    stemmed: dict[str, list[str]] = {}
    for w, (v, is_odd, found, _) in notable.items():
        if v is not None:
            weights[w] = v
            odd += counts[w] * is_odd
        for e in found:
            stemmed.setdefault(e, []).append(w)
    for e, words in stemmed.items():
        if sum(counts[w] for w in words) > 1:
            for w in words:
                weights[w] = max(weights.get(w, 0.0), lexicon.weights[e])
    n_you = sum(counts[w] for w, f in notable.items() if f[3])
    if weights:
        places = [k for k, w in enumerate(low) if w in weights]
        weight = sum(weights[low[k]] for k in places)
        hits = len(places)
        a = 0
        for b in range(hits):
            while places[b] - places[a] >= WINDOW:
                a += 1
            top = max(top, b - a + 1)
        if n_you:
            pronouns = {w for w, f in notable.items() if f[3]}
            you = np.array([k for k, w in enumerate(low) if w in pronouns])
            at = np.array(places)
            after = np.minimum(np.searchsorted(you, at), len(you) - 1)
            near = int((np.minimum(np.abs(you[after] - at), np.abs(you[np.maximum(after - 1, 0)] - at)) <= NEAR).sum())
    raw = text.encode("utf-8", "replace")
    letters, upper = len(raw) - len(raw.translate(None, LETTERS)), len(raw) - len(raw.translate(None, UPPER))
    shout = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if upper > 2 else 0
    odd_words = len(MIXED.findall(text)) if len(raw.translate(None, ODD)) < len(raw) else 0
    return [
        float(np.log1p(len(low))), hits / n, float(np.log1p(hits)), len(weights), weight / n, max(weights.values(), default=0.0), odd / n, top / WINDOW, near / max(hits, 1), near / n,
        n_you / n, upper / max(letters, 1), shout / n, raw.count(b"!") / n, raw.count(b"?") / n, odd_words / n,
    ]


def _word_rows(batches):
    for batch in batches:
        fold, toxic, word = [], [], []
        for f, y, text in zip(batch.column("fold").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            seen = entries((text or "").lower().split())
            fold += [f] * len(seen)
            toxic += [y] * len(seen)
            word += seen
        yield pa.RecordBatch.from_pydict({"fold": pa.array(fold, pa.int32()), "toxic": pa.array(toxic, pa.int32()), "word": pa.array(word, pa.string())})


class Model:
    def __init__(self, lexicon, boosted, calibrated, constant=None):
        self.lexicon, self.boosted, self.calibrated, self.constant = lexicon, boosted, calibrated, constant

    def predict(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = [features(t, self.lexicon) for at in range(0, len(texts), ROWS) for t in texts.slice(at, ROWS).to_pylist()]
        return np.clip(self.calibrated(self.boosted.predict(np.array(x, float).reshape(len(texts), N_FEATURES))), 0, 1)


def train(labelled: DataFrame, most_rows: int = 12_000, most_words: int = 1_000) -> Model:
    """Fit on labelled (doc_id, text, toxic 0/1)."""
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("fold"))
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1 = sum(n for (_, y), n in sizes.items() if y == 1)
    n0 = sum(n for (_, y), n in sizes.items() if y == 0)
    if not n1 or not n0:
        return Model(Lexicon({}), None, None, 1.0 * bool(n1))
    words = rows.mapInArrow(lambda it: C.trimmed(_word_rows(it)), "fold int, toxic int, word string").groupBy("word").agg(*[F.count(F.when((F.col("fold") == f) & (F.col("toxic") == y), 1)).alias(f"n{f}{y}") for f in (0, 1) for y in (0, 1)])

    def lexicon(folds) -> dict[str, float]:
        t, c = sum(sizes.get((f, 1), 0) for f in folds), sum(sizes.get((f, 0), 0) for f in folds)
        a, b = sum(F.col(f"n{f}1") for f in folds), sum(F.col(f"n{f}0") for f in folds)
        odds = F.log((a + 0.5) / (t + 1)) - F.log((b + 0.5) / (c + 1))
        z = (a * F.lit(float(c)) - b * F.lit(float(t))) / F.sqrt(F.lit(float(max(t, 1) * max(c, 1))) * (a + b + 1))
        found = words.select("word", odds.alias("odds"), z.alias("z"), a.alias("a")).where("odds > 1.2 AND a >= 2 AND z > 1.5").orderBy(F.desc("z"), "word").limit(most_words).collect()
        strong = [r for r in found if r["z"] > 3] or found
        return {r["word"]: float(r["odds"]) for r in strong}

    words = words.where("n01 + n11 >= 2").persist()
    both, lex = Lexicon(lexicon((0, 1))), {0: Lexicon(lexicon((1,))), 1: Lexicon(lexicon((0,)))}
    words.unpersist()

    def made(batches):
        for batch in batches:
            fold = batch.column("fold").to_pylist()
            x = [features(t, lex[f]) for f, t in zip(fold, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), batch.column("part").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "part", "x"])

    got = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("fold"), F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4)).cast("int").alias("part"))
    table = got.mapInArrow(lambda it: C.trimmed(made(it)), "toxic int, part int, x array<double>").toArrow()
    y = table.column("toxic").to_numpy().astype(float)
    part = table.column("part").to_numpy()
    x = np.array(table.column("x").to_pylist(), float).reshape(len(y), N_FEATURES)
    order = np.lexsort((*x.T, y, part))
    x, y, part = x[order], y[order], part[order]
    out = np.zeros(len(y))
    for k in range(4):
        rest = part != k
        out[~rest] = trees.fit(x[rest], y[rest]).predict(x[~rest])
    return Model(both, trees.fit(x, y), trees.Isotonic(out, y))


def _scored(batches, model: Model, keep: list[str]):
    for batch in batches:
        score = model.predict(batch.column("text"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])


def training_rows(docs: DataFrame, labels: DataFrame, usable, most_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most about most_rows labelled documents. The ids are bounded by most_rows, so they are broadcast."""
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(usable(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = one.count()
    picked = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, most_rows / max(n, 1)) * (1 << 30))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def score(docs: DataFrame, labels: DataFrame, held_out, most_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; rows where held_out(doc_id) holds teach nothing."""
    model = train(training_rows(docs, labels, lambda c: ~held_out(c), most_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda it: C.trimmed(_scored(it, model, ["doc_id", "held_out"])), "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic; learns from every label."""
    model = train(training_rows(docs, labels, lambda c: F.lit(True), most_rows))

    def kept(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.predict(batch.column("text")) < 0.5))

    return docs.mapInArrow(lambda it: C.trimmed(kept(it)), docs.schema)


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def query(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), is_held_out)
