"""Mixing sources to target weights: fixed-length blocks, slots drawn for each shard, pseudorandom index permutations.

Every source's documents, in doc_id order, form one stream of words, packed into blocks of `block_words` (the last block of a source may be shorter). Targets
share the corpus's words by weight; a target stops at `most_repeats` times its source, and the excess is shared again among the others.

A source gets as many slots as its target needs blocks. Each output shard draws its counts of slots by source: a source's slots are multinomial over the shards,
so every source's total is met exactly and a shard's counts are multinomial draws by the sources' weights, its own total being `SHARD_SLOTS` on average. The draws
come from binomial splits of the shards in halves, seeded by the half, so a shard finds its own by some twenty of them, alone and alike on every run. The k-th slot of a source takes block
P_e(k mod n) of its n blocks in pass e = k div n, where P_e is a keyed permutation of 0..n-1 (a Feistel network with cycle walking), so no block is taken
more often than another by more than one, and never more than most_repeats times. Slots then meet the documents' blocks in a join by (source, block).

Distribution: stream offsets come from a range partition by (source, doc_id), window sums inside its partitions, and the partitions' sums for each source, which
are few; shards draw their counts and generate their slots in parallel. The join is on
single blocks, so neither hot sources nor long documents gather in one task. Only source totals, a few numbers for each source and range, come to the driver.

Defined results: null text has size 0; sources go by code point with null last; a source without words has target 0; repeated or null doc_ids are separate
rows (null last, then by size); texts of any length are packed whole; an empty table gives no rows; other columns are ignored; the same input gives the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.llm import common as C

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 32
MOST_REPEATS = 3
SHARD_SLOTS = 1 << 16
MOST_FACTS = 100_000


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS, total: float | None = None) -> list[float]:
    """Words that each source should give: shares of total by weight, none above most times its size."""
    total = float(sum(sizes)) if total is None else total
    out = [0.0] * len(sizes)
    open_, left = [k for k, n in enumerate(sizes) if n > 0 and weights[k] > 0], min(total, most * sum(n for n, w in zip(sizes, weights) if w > 0))
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * unit >= most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = weights[k] * unit
            break
        for k in full:
            out[k] = float(most * sizes[k])
            left -= out[k]
        open_ = [k for k in open_ if k not in set(full)]
    return out


def _mixed(x: np.ndarray, key: np.ndarray, rounds: int) -> np.ndarray:
    return C.mix(x ^ C.mix(key + np.uint64(rounds)))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index under the keyed permutation of 0..n-1: four Feistel rounds over the next even number of bits, walked until inside."""
    one = np.uint64(1)
    half = np.ones(len(index), np.uint64)
    while (big := (one << (half + half)) < n.astype(np.uint64)).any():
        half = half + big
    mask = (one << half) - one
    x, key = index.astype(np.uint64), key.astype(np.uint64)
    out = np.zeros(len(index), np.uint64)
    todo = np.arange(len(index))
    while len(todo):
        h, m, k, v = half[todo], mask[todo], key[todo], x[todo]
        left, right = v >> h, v & m
        for r in range(4):
            left, right = right, left ^ (_mixed(right, k, r) & m)
        v = (left << h) | right
        inside = v < n[todo].astype(np.uint64)
        out[todo[inside]] = v[inside]
        x[todo] = v
        todo = todo[~inside]
    return out.astype(np.int64)


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots by source of one output shard: how many come before it, and how many are its own."""
    own, first = np.array(slots, np.int64), np.zeros(len(slots), np.int64)
    lo, hi = 0, shards
    while hi - lo > 1:
        half = (lo + hi) // 2
        left = np.random.Generator(np.random.PCG64([seed, lo, hi])).binomial(own, (half - lo) / (hi - lo))
        if shard < half:
            own, hi = left, half
        else:
            own, first, lo = own - left, first + left, half
    return first, own


def _slots(batches, slots: np.ndarray, shards: int, blocks: np.ndarray, seed: int):
    """From shard numbers to (source, block) of their slots."""
    salt = np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for batch in batches:
        for shard in batch.column("id").to_pylist():
            first, own = shard_counts(slots, shards, shard, seed)
            s = np.repeat(np.arange(len(own)), own)
            k = first[s] + np.arange(len(s)) - np.repeat(np.cumsum(own) - own, own)
            n = blocks[s]
            key = C.mix((s.astype(np.uint64) << np.uint64(20)) + (k // np.maximum(n, 1)).astype(np.uint64) + salt)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(permuted(k % np.maximum(n, 1), n, key)), pa.array(np.full(len(s), shard))], names=["s", "block", "shard"])


def size_of(text):
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long").alias("size")


def repeat_documents(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, most_repeats: int = MOST_REPEATS, seed: int = 8) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes its words: taken / size times, the fraction decided by a hash of its key.

    Documents without words (null, empty) have nothing to weigh and stay once.
    """
    rows = C.keyed_rows(docs)
    sized = rows.select(F.col("uid").alias("doc_id"), F.col("row.source").cast("string").alias("source"), size_of("text"))
    times = F.col("taken") / F.col("size")
    luck = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor(times) + (luck < times - F.floor(times)).cast("int")).cast("int")
    chosen = _mix(sized, weights, block_words, most_repeats, seed).withColumnRenamed("doc_id", "uid").select("uid", F.when(F.col("size") == 0, 1).otherwise(copies).alias("copies")).where("copies > 0")
    return rows.select("uid", "row").join(chosen, "uid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def mix(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, most_repeats: int = MOST_REPEATS, seed: int = 8) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, text, source)."""
    return _mix(docs.select("doc_id", "source", size_of("text")), weights, block_words, most_repeats, seed).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def _mix(sized: DataFrame, weights, block_words: int, most_repeats: int, seed: int) -> DataFrame:
    spark = sized.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("size")]
    ranged = sized.repartitionByRange(n, *order).sortWithinPartitions(*order)
    part = C.cut(ranged.withColumn("row", F.monotonically_increasing_id()), "sizes").withColumn("part", F.shiftright("row", 33))
    sums = part.groupBy("part", "source").agg(F.sum("size").alias("n")).orderBy("part", F.col("source").asc_nulls_last()).collect()
    names = sorted({r["source"] for r in sums if r["source"] is not None}) + [None] * any(r["source"] is None for r in sums)
    place = {name: k for k, name in enumerate(names)}
    sizes, before = [0] * len(names), []
    for r in sums:
        s = place[r["source"]]
        before.append((r["part"], r["source"], s, sizes[s]))
        sizes[s] += r["n"]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], most_repeats)
    blocks = [-(-x // block_words) for x in sizes]
    slots = [min(most_repeats * b, round(g * b / x)) if x else 0 for b, g, x in zip(blocks, goal, sizes)]
    facts = spark.createDataFrame([(p, name, s, at, sizes[s], float(goal[s])) for p, name, s, at in before], "_part long, _source string, s int, base long, source_size long, target double")
    # one row for each (partition, source): at most partitions + sources rows, broadcast only if they are few
    facts = F.broadcast(facts) if len(before) <= MOST_FACTS else facts
    inside = Window.partitionBy("part", "source").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        part.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(facts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
        .select("row", "doc_id", "size", "s", (F.col("base") + F.col("within")).alias("at"), "source_size", "target")
    )
    if not sum(slots):
        return placed.withColumn("taken", F.lit(0).cast("long"))
    shards = -(-sum(slots) // SHARD_SLOTS)
    many, wanted = np.array(blocks, np.int64), np.array(slots, np.int64)
    times = (
        spark.range(shards, numPartitions=min(shards, max(n, shards // 16)))
        .mapInArrow(lambda it: C.trimmed(_slots(it, wanted, shards, many, seed)), "s long, block long, shard long")
        .groupBy("s", "block")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    b = F.lit(block_words)
    parts = (
        placed.where("size > 0")
        .select("row", "s", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("block"))
        .select("row", F.col("s").cast("long").alias("s"), "block", (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("at"), F.col("block") * b)).alias("words"))
    )
    # the planner takes the slots for as few as the shards they come from, and would broadcast them
    taken = parts.join(times.hint("merge"), ["s", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
