"""Suffix-array dedup: remove every byte covered by a long byte string that also starts earlier in the corpus.

How it is distributed:

1. Winnowing. Every window of `length` bytes names one anchor, the smallest-hashed gram inside it. Equal windows name equal anchors at the same
   distance, so all copies of a window meet under the hash of their anchor. Neighbouring windows with one anchor form a segment; there is one
   narrow row (hash, digest, document, position) for about 35 bytes of text. Copies inside one Arrow batch are merged to passages, compared byte by byte
   and settled at once, which is the pre-aggregation that keeps hot anchors from travelling: a batch sends each segment once.
2. One shuffle by anchor and window functions (streamed, spillable). Anchors seen once go. What is left are pointers, no decisions: a segment whose
   64-bit hashes of anchor and bytes both equal an earlier one's points at that one; first copies of segments that differ although they share an anchor (the
   borders of repeated passages) are grouped under the anchor.
3. Neighbouring pointers into one document merge to passages, cut at every `CELL` bytes of the document they point into. A group is such a cell (salted
   beyond `SALT` passages) with the passages that point into it, or an anchor with its border segments. Only these pieces of text get their bytes. Suffix arrays
   built by two-stage sorting (suffix.py) order the suffixes of bounded batches of groups, an identical piece taken once for all its owners, up to their first
   `length` symbols; neighbours that share these are the classes of equal windows, and all but the first window of a class are removed. So a hash only says what to compare.
   A passage needs its cell only, so a cell's group is settled `batch_bytes` at a time; an anchor's group of more than `most_bytes` is dealt out by window.
4. Spans are merged per document.

Defined results: null text counts as empty; repeated or null doc_ids are separate rows, ordered by doc_id (null last), then text; texts under
`length` bytes are kept whole; texts of any length are read whole, those over `LONG` bytes in pieces whose windows do not overlap; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.llm import common as C
from tabsieve.llm import suffix

GRAM = 32
SUB_BYTES = 1 << 18
LONG = 1 << 22
MAX_BITS = 24
CELL = 1 << 12
SALT = 2048
PLACE = 40
U64 = np.uint64


def _segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """Segments of the rows: row, a, b (first and last window), q (anchor), anchor hash, digest; positions from the row's start.

    The buffer must be under 2**24 bytes. All windows of a segment name the same anchor.
    """
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= length)
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none, none, none, none
    gram = min(GRAM, length)
    p = C.prefix(data)
    n = len(data) - gram + 1
    h = C.span_hash(p, np.arange(n), np.arange(gram, gram + n))
    width = length - gram + 1
    low = U64((1 << MAX_BITS) - 1)
    m = (h & ~low) | np.arange(n, dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:]) if len(m) > step else m
        step *= 2
    if width > step and len(m) > width - step:
        m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
    counts = sizes[rows] - length + 1
    ends = np.cumsum(counts)
    at = np.arange(ends[-1]) + np.repeat(offsets[rows] - (ends - counts), counts)
    q = (m[at] & low).astype(np.int64)
    cut = np.flatnonzero(q[1:] != q[:-1]) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(q)] - 1
    a, b, q = at[first], at[last], q[first]
    row = np.searchsorted(offsets, a, "right") - 1
    while len(bad := np.flatnonzero(sizes[row] == 0)):  # empty rows share their offset
        row[bad] += 1
    digest = C.span_hash(p, a, b + length) ^ C.mix(((q - a) * 4096 + (b - a)).astype(np.uint64))
    o = offsets[row]
    return row, a - o, b - o, q - o, h[q].astype(np.int64), digest.astype(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Segments of all rows; rows over LONG bytes in pieces whose windows do not overlap."""
    for lo, hi in C.slices(offsets, SUB_BYTES):
        if hi - lo > 1 or offsets[hi] - offsets[lo] <= LONG:
            row, *rest = _segments(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
            yield row + lo, *rest
        else:
            for at in range(0, int(offsets[hi] - offsets[lo]) - length + 1, LONG):
                part = data[offsets[lo] + at : min(offsets[hi], offsets[lo] + at + LONG + length - 1)]
                row, a, b, q, h, d = _segments(part, np.array([0, len(part)]), length)
                yield row + lo, a + at, b + at, q + at, h, d


def _runs(owner: np.ndarray, a: np.ndarray, b: np.ndarray, to: np.ndarray, shift: np.ndarray):
    """Merge segments (windows a..b of owner, which equal those shift bytes on in `to`) that continue each other: order, and the first and last of each run in it."""
    order = np.lexsort((a, owner))
    o, x, y, t, s = (v[order] for v in (owner, a, b, to, shift))
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (x[1:] > y[:-1] + 1)
    first = np.flatnonzero(new)
    return order, first, np.append(first[1:], len(o)) - 1 if len(o) else first


def _settled(data, offsets, row, a, b, copy, of, length: int):
    """Segments `copy`, each with an equal one `of` in the batch by hash: runs (row, from, to) whose bytes are equal, and the segments of all other runs."""
    order, first, last = _runs(row[copy], a[copy], b[copy], row[of], a[of] - a[copy])
    copy, of = copy[order], of[order]
    spans, rest = [], []
    for i, j in zip(first.tolist(), last.tolist()):
        c, o = copy[i], of[i]
        lo, n = int(a[c]), int(b[copy[j]] - a[c]) + length
        x, y = offsets[row[c]] + lo, offsets[row[o]] + int(a[o])
        if np.array_equal(data[x : x + n], data[y : y + n]):
            spans.append((row[c], lo, lo + n))
        else:
            rest.append(copy[i : j + 1])
    return np.array(spans, np.int64).reshape(-1, 3), np.concatenate(rest) if rest else np.zeros(0, np.int64)


def _anchors(batches, length: int):
    """Segments (again false), and runs settled inside the batch (again true, d: end, place: start)."""
    for batch in batches:
        uid = batch.column("uid").to_numpy()
        data, offsets = C.text_buffer(batch.column("text"))
        found = list(_pieces(data, offsets, length))
        if not found:
            continue
        row, a, b, q, h, d = map(np.concatenate, zip(*found))
        order = np.lexsort((q, uid[row], d, h))
        row, a, b, q, h, d = (x[order] for x in (row, a, b, q, h, d))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        copy = np.flatnonzero(~new)
        spans, rest = _settled(data, offsets, row, a, b, copy, np.flatnonzero(new)[np.cumsum(new)[copy] - 1], length)
        goes = new
        goes[rest] = True
        who, key = uid[row[goes]], uid[spans[:, 0]]
        again = np.r_[np.zeros(len(who), bool), np.ones(len(spans), bool)]
        # a settled run needs no company, so it gets a key of its own
        alone = C.mix((key * 1_000_003 + spans[:, 1]).astype(np.uint64)).astype(np.int64)
        place = (q << 24) | ((q - a) << 12) | (b - a)
        columns = (np.r_[h[goes], alone], np.r_[d[goes], spans[:, 2]], np.r_[who, key], np.r_[place[goes], spans[:, 1]], again)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "d", "uid", "place", "again"])


def _merged(batches, length: int):
    """Pointers of each document merged to passages (lo, hi, to, at), cut at the cells of the document they point into."""
    passage = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("to", pa.int64()), ("at", pa.int64())]))
    for batch in batches:
        col = batch.column("copies")
        flat, sizes = col.flatten(), np.diff(col.offsets.to_numpy())
        row = np.repeat(np.arange(len(col)), sizes)
        a, b, to, at = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "to", "at"))
        order, first, last = _runs(row, a, b, to, at - a)
        row, lo, end, to, shift = row[order][first], a[order][first], b[order][last], to[order][first], (at - a)[order][first]
        cells = (end + shift) // CELL - (lo + shift) // CELL + 1
        k = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        row, lo, end, to, shift = (np.repeat(x, cells) for x in (row, lo, end, to, shift))
        cell = (lo + shift) // CELL + k
        lo, end = np.maximum(lo, cell * CELL - shift), np.minimum(end, (cell + 1) * CELL - 1 - shift)
        values = pa.StructArray.from_arrays([pa.array(x) for x in (lo, end + length, to, lo + shift)], fields=list(passage.value_type))
        offsets = np.searchsorted(row, np.arange(len(col) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("spans"), batch.column("wanted"), pa.ListArray.from_arrays(pa.array(offsets), values, type=passage)], names=["uid", "spans", "wanted", "passages"])


def _slice(batches, length: int):
    """Bytes of the listed pieces; those of hot anchors window by window."""
    for batch in batches:
        out = {k: [] for k in ("g", "uid", "a", "cell", "body")}

        def put(*values):
            for k, v in zip(out, values):
                out[k].append(v)

        for uid, text, pieces in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), batch.column("pieces").to_pylist()):
            body = (text or "").encode("utf-8", "surrogatepass")
            for w in pieces:
                part = body[w["a"] : w["b"] + length]
                if not w["hot"]:
                    put(w["g"], uid, w["a"], w["cell"], part)
                    continue
                p, at = C.prefix(np.frombuffer(part, np.uint8)), np.arange(w["b"] - w["a"] + 1)
                for k, g in zip(at.tolist(), C.span_hash(p, at, at + length).astype(np.int64).tolist()):
                    put(g, uid, w["a"] + k, False, part[k : k + length])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


def repeated_windows(uid: np.ndarray, a: np.ndarray, bodies: list[bytes], length: int):
    """(uid, from, to) of the windows that equal an earlier window among these pieces, merged to runs of neighbouring windows.

    Identical pieces are sorted once; all windows of the later ones are repeated.
    """
    order = np.lexsort((a, uid))
    first: dict[bytes, int] = {}
    copies = [k for k in order.tolist() if (f := first.setdefault(bodies[k], k)) != k and (uid[f], a[f]) != (uid[k], a[k])]
    own = np.array(list(first.values()), np.int64)
    t, starts = suffix.concatenated(list(first))
    sa, new = suffix.equal_windows(t, length)
    # a place as one number: documents in order, then the window; the first place of a class stays
    docs, doc = np.unique(uid[own], return_inverse=True)
    place = (np.repeat((doc << PLACE) + a[own] - starts[:-1], np.diff(starts)) + np.arange(len(t)))[sa]
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(place, begin) if len(begin) else place
    # pieces may overlap: one place in two of them is one window
    again = np.sort(place[place != np.repeat(least, np.diff(begin, append=len(place)))])
    new = np.flatnonzero(np.r_[True, again[1:] > again[:-1] + 1]) if len(again) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(again)][: len(new)] - 1
    who, low = docs[again[new] >> PLACE], (1 << PLACE) - 1
    same = np.array([k for k in copies if len(bodies[k]) >= length], np.int64)
    sizes = np.array([len(bodies[k]) for k in same.tolist()], np.int64)
    return np.r_[who, uid[same]], np.r_[again[new] & low, a[same]], np.r_[(again[last] & low) + length, a[same] + sizes]


def _sorted_groups(batches, length: int, batch_bytes: int):
    """Suffix arrays over groups (rows come ordered by g, the cell first, then uid, a), about batch_bytes at a time."""
    held = {k: [] for k in ("g", "uid", "a", "cell", "body")}
    size = 0

    def settle(upto: int):
        uid, a, bodies = np.array(held["uid"][:upto], np.int64), np.array(held["a"][:upto], np.int64), held["body"][:upto]
        who, lo, hi = repeated_windows(uid, a, bodies, length)
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(lo), pa.array(hi)], names=["uid", "lo", "hi"])

    for whole in batches:
        for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
            for k in held:
                held[k] += batch.column(k).to_pylist()
            size += batch.column("body").nbytes
            if size < batch_bytes:
                continue
            if held["g"][0] != held["g"][-1]:
                at = held["g"].index(held["g"][-1])
                yield settle(at)
                held = {k: v[at:] for k, v in held.items()}
            elif held["cell"][0] or (len(held["body"][0]) == length and len(set(held["body"])) == 1):
                # a cell, or a hot window's first row, stands for all that is settled
                yield settle(len(held["g"]))
                held = {k: v[:1] for k, v in held.items()}
            size = sum(map(len, held["body"]))
    if held["g"]:
        yield settle(len(held["g"]))


def _result(batches):
    for batch in batches:
        n_removed, n_spans, n_bytes, sha = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            body = (text or "").encode("utf-8", "surrogatepass")
            digest, at, removed, runs = hashlib.sha256(), 0, 0, []
            for s in sorted((x["lo"], x["hi"]) for x in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            for lo, hi in runs:
                digest.update(body[at:lo])
                removed += hi - lo
                at = hi
            digest.update(body[at:])
            n_bytes.append(len(body))
            n_removed.append(removed)
            n_spans.append(len(runs))
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _pointers(docs: DataFrame, length: int, most_bytes: int) -> DataFrame:
    """(uid, spans, wanted, passages) of docs (uid, text): settled spans, border segments by anchor, and passages that seem to be copies."""
    rows = docs.select("uid", "text").mapInArrow(lambda it: _anchors(it, length), "h long, d long, uid long, place long, again boolean")
    same, group = Window.partitionBy("h", "d").orderBy("uid", "place"), Window.partitionBy("h")
    place = F.col("place")
    start = lambda p: F.shiftright(p, 24) - F.shiftright(p, 12).bitwiseAND(4095)
    windows = place.bitwiseAND(4095)
    found = (
        rows.withColumn("rn", F.row_number().over(same))
        .withColumn("of", F.first(F.struct("uid", "place")).over(same))
        .withColumn("low", F.min("d").over(group))
        .withColumn("high", F.max("d").over(group))
        .withColumn("bytes", F.sum(F.when(F.col("rn") == 1, windows + length)).over(group))
        .where("again or rn > 1 or low < high")
        .select("uid", "h", "d", "again", place, start(place).alias("a"), (start(place) + windows).alias("b"), (F.col("rn") > 1).alias("copy"), F.col("of.uid").alias("to"), start(F.col("of.place")).alias("at"), (F.col("bytes") > most_bytes).alias("hot"))
    )
    settled, copy = F.col("again"), F.col("copy")
    per = found.groupBy("uid").agg(
        F.collect_list(F.when(settled, F.struct(F.col("place").alias("lo"), F.col("d").alias("hi")))).alias("spans"),
        F.collect_list(F.when(~settled & ~copy, F.struct(F.col("h").alias("g"), "a", "b", "hot"))).alias("wanted"),
        F.collect_list(F.when(~settled & copy, F.struct("a", "b", "to", "at"))).alias("copies"),
    )
    return per.mapInArrow(
        lambda it: _merged(it, length),
        "uid long, spans array<struct<lo:long,hi:long>>, wanted array<struct<g:long,a:long,b:long,hot:boolean>>, passages array<struct<lo:long,hi:long,to:long,at:long>>",
    )


def _listed(per: DataFrame, length: int) -> DataFrame:
    """(uid, pieces): the pieces of text that the groups need, listed by document."""
    one = per.select("uid", F.explode("passages").alias("p")).select("uid", "p.*").withColumn("cell", F.floor(F.col("at") / CELL))
    many = one.groupBy("to", "cell").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts")).where("salts > 1")
    salted = one.join(many, ["to", "cell"], "left").withColumn("salt", F.pmod(F.xxhash64("uid"), F.coalesce("salts", F.lit(1))))
    grouped = salted.withColumn("g", F.xxhash64("to", "cell", "salt"))
    no = F.lit(False)
    copies = grouped.select("uid", "g", F.col("lo").alias("a"), (F.col("hi") - length).alias("b"), no.alias("hot"), no.alias("cell"))
    cells = grouped.groupBy("to", "cell", "g").agg(F.min("at").alias("a"), (F.max(F.col("at") + F.col("hi") - F.col("lo")) - length).alias("b")).select(F.col("to").alias("uid"), "g", "a", "b", no.alias("hot"), F.lit(True).alias("cell"))
    borders = per.select("uid", F.explode("wanted").alias("w")).select("uid", "w.*", no.alias("cell"))
    return copies.unionByName(cells).unionByName(borders).groupBy("uid").agg(F.collect_list(F.struct("g", "a", "b", "hot", "cell")).alias("pieces"))


def suffix_dedup(docs: DataFrame, length: int = 100, most_bytes: int = 1 << 22, batch_bytes: int = 1 << 19) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (see the module's text)."""
    if length < 2 or length > 2000:
        raise ValueError("length must lie between 2 and 2000 bytes")
    docs = C.with_uid(docs, "text")
    numbered = hasattr(docs, "_scratch")
    per = C.cut(_pointers(docs, length, most_bytes), "segments")
    texts = docs.select("uid", "text").where("uid IS NOT NULL")  # the same plan in both joins: the texts are shuffled once
    bodies = texts.join(_listed(per, length), "uid").select("uid", "text", "pieces").mapInArrow(lambda it: _slice(it, length), "g long, uid long, a long, cell boolean, body binary")
    windows = (
        bodies.repartition("g").sortWithinPartitions("g", F.desc("cell"), "uid", "a").mapInArrow(lambda it: _sorted_groups(it, length, batch_bytes), "uid long, lo long, hi long")
    )
    borders = windows.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("more"))
    settled = per.where("size(spans) > 0").select("uid", "spans")
    spans = settled.join(borders, "uid", "full").select("uid", F.concat(F.coalesce("spans", F.expr("array()")), F.coalesce("more", F.expr("array()"))).alias("spans"))
    out = (
        texts.join(spans, "uid", "left")
        .select(F.col("uid").alias("doc_id"), "text", "spans")
        .mapInArrow(_result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
    if numbered:
        ids = docs.select(F.col("uid").alias("_uid"), F.col("doc_id").cast("long").alias("_id"))
        out = out.join(ids, F.col("doc_id") == F.col("_uid")).select(F.col("_id").alias("doc_id"), *out.columns[1:])
    return out


def query(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by a table of all windows (DuckDB).
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (length(h) / 2)::bigint AS n_bytes FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS win FROM (SELECT doc_id, h, unnest(generate_series(0, n_bytes - 100)) AS i FROM n WHERE n_bytes >= 100)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later)) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_, hi FROM runs),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY pos) AS body FROM (
  SELECT c.doc_id, from_ AS pos, substr(h, (2 * from_ + 1)::bigint, (2 * (lo - from_))::bigint) AS part FROM cuts c JOIN n USING (doc_id)
  UNION ALL SELECT r.doc_id, r.hi, substr(h, (2 * r.hi + 1)::bigint) FROM (SELECT doc_id, max(hi) AS hi FROM runs GROUP BY doc_id) r JOIN n USING (doc_id)) GROUP BY doc_id),
s AS (SELECT doc_id, sum(hi - lo)::bigint AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT n.doc_id, n.n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans, sha256(unhex(coalesce(body, h))) AS kept_sha256
FROM n LEFT JOIN s USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
