"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman alignment scores the passages.

Words are runs of letters and digits in lower case (ASCII punctuation separates). Every n-gram of an item is a seed, however frequent it is. One pass finds
the seeds in each document, gathers the passages around them, and aligns each with the item, word by word (match 2, mismatch -1, gap -1). The score is the
best alignment's share of a perfect one. The share of the item's words that occur in a passage bounds its score from above; a passage is left unaligned only
if this bound is under `least_score` and under the document's best score, so no result depends on it. A document is contaminated if an item scores
`least_score` or more.

Distribution: the pass is narrow; nothing of a document is shuffled or collected. The items go to the executors in blocks of at most `most_words` words, each
block being another pass, so their size is bounded whatever the benchmark.

Defined results: null and empty texts match nothing; items of fewer than `least_words` words are ignored, as are items without id; items shorter than
a seed are one seed as a whole; null or repeated doc_ids are judged row by row; ties go to the smallest item_id; texts of any length are read whole; an empty
table gives no rows; decontaminate() ignores other columns, drop_contaminated() keeps them, match() too but for those called like its results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm import common as C

SEED = 4
MATCH, MISMATCH, GAP = 2, -1, -1
SUB_BYTES = 1 << 18
FILTER_BITS = 22
MOST_PAIRS = 1 << 20
U64 = np.uint64

#: Bytes as they count: letters in lower case, ASCII punctuation and control characters as spaces.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(128)]


def folded(data: np.ndarray, offsets: np.ndarray):
    """Word hashes and their rows."""
    data = FOLD[data]
    start, end, row = C.word_spans(data, offsets)
    return C.span_hash(C.prefix(data), start, end), row


def grams(word: np.ndarray, row: np.ndarray, n: int):
    """Hash of the n words from each position that has n words of its row left, and these positions."""
    m = max(len(word) - n + 1, 0)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * U64(0xD1342543DE82EF95) + word[j : j + m]
    at = np.flatnonzero(row[:m] == row[n - 1 :]) if m else np.zeros(0, np.int64)
    return C.mix(h[at] + U64(n)), at


def align(a: np.ndarray, b: np.ndarray) -> float:
    """Best local alignment of a in b as a share of a perfect match of a."""
    if not len(a) or not len(b):
        return 0.0
    best, steps = 0, np.arange(len(b) + 1) * -GAP
    above = np.zeros(len(b) + 1, np.int64)
    for x in a:
        now = np.zeros(len(b) + 1, np.int64)
        now[1:] = np.maximum(above[:-1] + np.where(b == x, MATCH, MISMATCH), above[1:] + GAP)
        now = np.maximum(now, 0)
        now = np.maximum.accumulate(now + steps) - steps  # gaps in a
        best = max(best, int(now.max()))
        above = now
    return best / (MATCH * len(a))


class Bench:
    """Test items and their seeds."""

    def __init__(self, items: list[tuple[int, str]], seed: int, least_words: int):
        self.ids, self.words, per = [], [], {}
        for item_id, text in items:
            raw = (text or "").encode("utf-8", "surrogatepass")
            word, row = folded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if len(word) < max(least_words, 1):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(word)
            n = min(seed, len(word))
            h, at = grams(word, row, n)
            per.setdefault(n, []).append((h, np.full(len(h), k), at))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known, self.codes = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]), return_inverse=True)
        self.tables = {}
        for n, parts in per.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, item, h))
            self._table(n, h[order], item[order], at[order])

    def _table(self, n: int, h: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        keys, first = np.unique(h, return_index=True)
        sieve = np.zeros(1 << FILTER_BITS, bool)
        sieve[keys >> U64(64 - FILTER_BITS)] = True
        self.tables[n] = keys, np.append(first, len(h)), item, at, sieve

    def find(self, word: np.ndarray, row: np.ndarray):
        """For each gram length: (n, indices of known grams, their positions)."""
        for n, (keys, *_, sieve) in self.tables.items():
            h, at = grams(word, row, n)
            hit = np.flatnonzero(sieve[h >> U64(64 - FILTER_BITS)])
            if len(hit):
                k = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
                same = keys[k] == h[hit]
                yield n, k[same], at[hit[same]]

    def scores(self, word: np.ndarray, row: np.ndarray, n_rows: int, least_score: float = 0.0) -> list[list[tuple[float, int]]]:
        """(score, item_id) of the items with a seed in each row: all that reach least_score, and the best."""
        out: list = [[] for _ in range(n_rows)]
        found, load = [], np.zeros(n_rows, np.int64)
        for n, gram, at in self.find(word, row):
            first = self.tables[n][1]
            many = first[gram + 1] - first[gram]
            found.append((n, row[at], gram, at, many))
            load += np.bincount(row[at], many, n_rows).astype(np.int64)
        if not found:
            return out
        part = np.cumsum(load) // MOST_PAIRS  # whole rows, about MOST_PAIRS seeds at a time
        cuts = np.searchsorted(row, np.arange(n_rows + 1))
        for p in np.unique(part[load > 0]).tolist():
            self._aligned([[n, *(x[part[r] == p] for x in (r, *rest))] for n, r, *rest in found], word, cuts, least_score, out)
        return out

    def _aligned(self, found: list, word: np.ndarray, cuts: np.ndarray, least_score: float, out: list) -> None:
        places = []
        for n, r, gram, at, many in found:
            _, first, item, place, _ = self.tables[n]
            k = np.repeat(first[gram], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            places.append((np.repeat(r, many), item[k], np.repeat(at, many) - place[k]))
        r, item, begin = (np.concatenate(x) for x in zip(*places))
        order = np.lexsort((begin, item, r))
        r, item, begin = r[order], item[order], begin[order]
        slack = np.maximum(4, self.sizes[item] // 3)
        lo, hi = begin - slack, begin + self.sizes[item] + slack
        new = np.r_[True, (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(r)) - 1
        r, item = r[first], item[first]
        lo, hi = np.maximum(lo[first], cuts[r]), np.minimum(hi[last], cuts[r + 1])
        bound = self._bounds(word, item, lo, hi)
        order = np.lexsort((-bound, r))
        best: dict[tuple[int, int], float] = {}
        top: dict[int, float] = {}
        for x, i, a, b, most in zip(*(v[order].tolist() for v in (r, item, lo, hi, bound))):
            if most < least_score and most < top.get(x, 0.0):
                continue
            s = align(self.words[i], word[a:b])
            best[x, i] = max(best.get((x, i), 0.0), s)
            top[x] = max(top.get(x, 0.0), s)
        for (x, i), s in best.items():
            out[x].append((s, self.ids[i]))

    def _bounds(self, word: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Share of the item's words that occur in word[lo:hi]: no alignment there scores more."""
        k = np.minimum(np.searchsorted(self.known, word), len(self.known) - 1)
        at = np.flatnonzero(self.known[k] == word)
        width = len(word) + 1
        seen = np.append(np.sort(k[at] * width + at), np.iinfo(np.int64).max)
        size = self.sizes[item]
        share, done = np.zeros(len(item)), 0
        ends = np.cumsum(size)
        while done < len(item):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + MOST_PAIRS, "right")))
            part = slice(done, upto)
            many, owner = size[part], np.repeat(np.arange(upto - done), size[part])
            code = self.codes[np.repeat(self.starts[item[part]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] * width
            next_ = seen[np.searchsorted(seen, code + lo[part][owner])]
            share[part] = np.bincount(owner, next_ < code + hi[part][owner], upto - done) / many
            done = upto
        return share


def _parts(batch):
    data, offsets = C.text_buffer(batch.column("text"))
    for lo, hi in C.slices(offsets, SUB_BYTES):
        yield hi - lo, *folded(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _matched(batches, bench: Bench, least_score: float, keep: list[str]):
    for batch in batches:
        score, item, many = [], [], []
        for n_rows, word, row in _parts(batch):
            for found in bench.scores(word, row, n_rows, least_score):
                hits = [x for x in found if x[0] >= least_score]
                top = min(found, key=lambda x: (-x[0], x[1]), default=(0.0, None))
                score.append(top[0])
                item.append(top[1] if hits else None)
                many.append(len(hits))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score, pa.float64()), pa.array(item, pa.int64()), pa.array(many, pa.int64())], names=[*keep, "score", "item_id", "n_items"])


def blocks(benchmark: DataFrame, most_words: int):
    """The items in blocks of about most_words words, read one block at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-total // most_words)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


def match(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.5, seed: int = SEED, least_words: int = 3, most_words: int = 2_000_000) -> DataFrame:
    """docs with score (of the best item), item_id (the best contaminating item or null) and n_items (contaminating items)."""
    docs = docs.drop("score", "item_id", "n_items", "_score", "_item", "_n")
    keep = docs.columns
    out = None
    for items in blocks(benchmark, most_words):
        bench = Bench(items, seed, least_words)
        if out is None:
            base, cols = docs, keep
        else:  # further blocks see the results so far
            base, cols = out.withColumnsRenamed({"score": "_score", "item_id": "_item", "n_items": "_n"}), [*keep, "_score", "_item", "_n"]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
        out = base.mapInArrow(lambda it, b=bench, c=cols: C.trimmed(_matched(it, b, least_score, c)), f"{fields}, score double, item_id long, n_items long")
        if "_score" in cols:
            old = (F.col("_score") > F.col("score")) | ((F.col("_score") == F.col("score")) & (F.col("_item") < F.col("item_id")))
            out = out.select(*keep, F.greatest("_score", "score").alias("score"), F.when(old | F.col("item_id").isNull(), F.coalesce("_item", "item_id")).otherwise(F.col("item_id")).alias("item_id"), (F.col("_n") + F.col("n_items")).alias("n_items"))
    if out is None:
        out = docs.select(*keep, F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_items"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, kept, item_id, n_items, score for each row of docs."""
    found = match(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **options)
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), (F.col("n_items") == 0).alias("kept"), "item_id", "n_items", "score")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark passage."""
    row = F.struct(*docs.columns).alias("row")
    return match(docs.select(row, "text"), benchmark, **options).where("n_items = 0").select("row.*")


def query(spark, sf_dir):
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
