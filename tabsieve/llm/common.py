"""Shared pieces of the corpus operators: scratch tables, row keys, byte-level hashing, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

# ----------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master (one machine, as in tests) takes a temporary folder; on a cluster that is an error, as executors would not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tabsieve-shared")
        os.makedirs(found[7:], exist_ok=True)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tabsieve/{name}-{uuid.uuid4().hex}"


#: Tables that cut() has made and nobody has dropped yet.
_made: dict[str, DataFrame] = {}


#: Has Spark delete the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back. The shuffle files behind df, which nothing needs any more, go at once."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    _made[path] = out
    return out


def trimmed(batches):
    """The batches; afterwards the Python worker gives what they took back to the system, as it idles on while others work."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def drop(df: DataFrame) -> None:
    """Delete a table made by cut(); no plan may read it any more."""
    path = getattr(df, "_scratch", None)
    if path and _made.pop(path, None) is not None:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def tables_made() -> set[str]:
    """The tables of cut() that exist now, for sweep()."""
    return set(_made)


def sweep(keep: DataFrame, since: set[str]) -> None:
    """Delete the tables made since then but keep, whose plan is cut and needs none of them any more."""
    for path, df in list(_made.items()):
        if path not in since and path != keep._scratch:
            drop(df)


def with_uid(docs: DataFrame, *cols: str) -> DataFrame:
    """(uid long, doc_id, *cols): a row key that orders as doc_id does.

    It is doc_id itself where ids are unique and not null (one narrow aggregate finds out). Otherwise rows are
    ordered by doc_id (null last), then by the other columns, and numbered; equal rows stay separate rows.
    """
    docs = docs.select("doc_id", *cols)
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    worst = ids.agg(F.max("n").alias("n"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    if not worst["nulls"] and (worst["n"] or 0) <= 1:
        return docs.withColumn("uid", F.col("doc_id").cast("long"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), *[_order(docs, c) for c in cols])
    return cut(ordered.withColumn("uid", F.monotonically_increasing_id()), "uid")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text, row): a key for each row of docs and the whole row as a struct, so that no column can clash."""
    return with_uid(docs.select("doc_id", "text", F.struct("*").alias("row")), "text", "row")


def _order(df: DataFrame, name: str):
    """What rows are ordered by for a column: its JSON where it holds maps or variants, which have no order."""
    kind = df.schema[name].dataType.simpleString()
    col = F.to_json(F.struct(name)) if "map<" in kind or "variant" in kind else F.col(name)
    return col.asc_nulls_last()


# ------------------------------------------------------------------ byte hashing

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_pow[0]) <= n:
        size = max(n + 1, 1 << 18)
        for k, base in enumerate((_BASE, _BASE_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow[0][: n + 1], _pow[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() reads the hash of any span."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0][:-1], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((p[end] - p[start]) * powers(len(p))[1][start] + (end - start).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges of rows with about that many bytes each; one long row makes a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words never cross rows."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first[offsets[-1] :] = True
    start = np.flatnonzero(solid[1:-1] & (first[:-1] | ~solid[:-2]))
    end = np.flatnonzero(solid[1:-1] & (first[1:] | ~solid[2:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


# -------------------------------------------------------------------- components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): (id, component), component being the smallest id reachable.

    Alternating rounds move every neighbour of a node to the smallest one (large star, then small star). Each round is two shuffles with
    map-side minima, so no group of edges is ever collected; it ends when a round changes nothing.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, "edges")

    def star(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
            return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def digest(e: DataFrame):
        row = e.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        return row["n"], row["x"]

    before = digest(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        old, e = e, cut(star(star(e, True), False), "edges")
        drop(old)
        now = digest(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
