"""MinHash near-dedup: chosen-path set similarity join, exact confirmation, connected components.

1. One pass over the texts makes each document's set of word shingles (64-bit hashes) and keeps of it the size, a 128-bit digest and `COORDINATES`
   minwise tokens. Documents with equal sets are one class from here on; its smallest row stands for it.
2. Trees. In each of `trees` independent trees a class walks down two levels; at every node the path picks the coordinate whose minwise token chooses the
   branch. Two sets of similarity s stay together with probability s for a level. Nodes are gathered by key, and any two classes of a node are compared by
   their tokens unless they are connected already. In a node of more than `SMALL` classes, branching on inside the task connects most of them first. A node of
   more than `most_node` classes is dealt out in blocks by hash, each with the node's first and last class, which tie similar blocks together; the classes
   that are then not connected with the node's largest cluster meet all other blocks of the node, so no pair of a node goes unseen, whatever its size. (Such classes
   cost a comparison a pair, in blocks, in the one case of a huge node whose classes are alike but not similar.) What comes out is not pairs but, for each
   node, the loosely similar classes as stars (agreement within `SLACK` of the threshold, sizes that allow the threshold).
3. The stars' connected components are clusters. Only classes in clusters get their full sets (second pass). Sets of one cluster meet in one task if they
   have up to `most_shingles` shingles in all; those of a larger cluster meet in the trees' nodes again (and in all pairs of blocks of a dealt node that are not
   yet connected). There, every two sets that are not yet connected are compared exactly (size of the intersection, 100 * common >= percent * union). Connected ones need no comparison, so a large group of copies costs one
   comparison a copy.
4. Components of the confirmed links, spread to all members of each class.

Recall: nodes lie two levels deep whatever their size, so a pair of similarity s misses a tree with probability about 1 - s**2, and all of them with about
(1 - s**2)**trees: 1.6e-8 at 0.85 with 14 trees, 8e-8 at 0.8 with 16. Having met, it is overlooked if fewer than s - SLACK of its coordinates agree: under 1e-7.

Defined results: null or wordless texts have empty sets and are linked with nothing; texts with fewer words than a shingle are one shingle; repeated or null
doc_ids are separate rows, the first of them by text being the one that is kept; texts of any length give all their shingles; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm import common as C

COORDINATES = 64
SLACK = 0.3
SMALL = 256
DEEP = 6
MOST_HOT = 10_000
SUB_BYTES = 1 << 18
U64 = np.uint64
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(batch, k: int):
    """(row, sorted distinct shingle hashes) of each row of a batch with `text`, in order."""
    data, offsets = C.text_buffer(batch.column("text"))
    for lo, hi in C.slices(offsets, SUB_BYTES):
        part = C.LOWER[data[offsets[lo] : offsets[hi]]]
        o = offsets[lo : hi + 1] - offsets[lo]
        start, end, row = C.word_spans(part, o)
        word = C.span_hash(C.prefix(part), start, end)
        m = max(len(word) - k + 1, 0)
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = C.mix(h * U64(0xD1342543DE82EF95) + word[j : j + m])
        cuts = np.searchsorted(row, np.arange(hi - lo + 1))
        for r in range(hi - lo):
            a, b = int(cuts[r]), int(cuts[r + 1])
            if b - a >= k:
                yield lo + r, np.unique(h[a : b - k + 1])
            elif b > a:
                x = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    x = C.mix(x * U64(0xD1342543DE82EF95) + word[j])
                yield lo + r, x
            else:
                yield lo + r, np.zeros(0, np.uint64)


def minwise(s: np.ndarray) -> np.ndarray:
    """COORDINATES minwise tokens of a set that is not empty."""
    if len(s) <= 4096:
        return (s[None, :] * _FACTORS[:, None]).min(1)
    return np.array([(s * f).min() for f in _FACTORS])


def tree_keys(tokens: np.ndarray, trees: int) -> list[int]:
    """The node each tree leads to after two levels."""
    path = C.mix(np.arange(trees, dtype=np.uint64) + U64(101))
    for _ in range(2):
        path = C.mix(path ^ tokens[(path % U64(COORDINATES)).astype(np.int64)])
    return path.astype(np.int64).tolist()


def _signed(batches, k: int, trees: int):
    names = ("uid", "doc_id", "n", "s1", "s2", "tokens", "keys")
    for batch in batches:
        out = {x: [] for x in names[2:]}
        for _, s in shingle_sets(batch, k):
            out["n"].append(len(s))
            out["s1"].append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            out["s2"].append(int(np.bitwise_xor.reduce(C.mix(s)).astype(np.int64)) if len(s) else 0)
            t = minwise(s) if len(s) else None
            out["tokens"].append(b"" if t is None else (t >> U64(20)).astype("<u2").tobytes())
            out["keys"].append([] if t is None else tree_keys(t, trees))
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), batch.column("doc_id").cast(pa.int64()), *(pa.array(out[x], pa.int64()) for x in names[2:5]), pa.array(out["tokens"], pa.binary()), pa.array(out["keys"], pa.list_(pa.int64()))],
            names=list(names),
        )


def _groups(batches, keys: tuple[str, ...]):
    """Whole groups of equal keys from batches that come ordered by them: (keys, columns as lists)."""
    held: dict[str, list] = {}
    current = None
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        ids = list(zip(*(cols[k] for k in keys)))
        at = 0
        while at < len(ids):
            end = at
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            if ids[at] != current:
                if current is not None:
                    yield current, held
                current, held = ids[at], {c: [] for c in cols}
            for c in cols:
                held[c] += cols[c][at:end]
            at = end
    if current is not None:
        yield current, held


def _stars(tokens: np.ndarray, n: np.ndarray, at: np.ndarray, least: float, ratio: float, out: list) -> None:
    """Compare the rows `at` exhaustively by tokens, skipping what is connected; append (row, root)."""
    todo = at
    while len(todo):
        root, queue, todo = todo[0], [todo[0]], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            same = (tokens[todo] == tokens[x]).mean(1)
            hit = (same >= least) & (np.minimum(n[todo], n[x]) >= ratio * np.maximum(n[todo], n[x]) - 1e-6)
            new = todo[hit]
            out += [(y, root) for y in new.tolist()]
            queue += new.tolist()
            todo = todo[~hit]


def _branch(tokens, n, at, path: int, depth: int, least, ratio, out) -> None:
    if len(at) < 2:
        return
    if len(at) <= SMALL or depth >= DEEP:
        _stars(tokens, n, at, least, ratio, out)
        return
    for b in range(2 if depth == 0 else 1):
        seed = int(C.mix(np.array([(path * 31 + b * 7 + depth + 1) & (2**64 - 1)], np.uint64))[0])
        column = tokens[at, seed % COORDINATES]
        order = np.argsort(column, kind="stable")
        cuts = np.flatnonzero(np.diff(column[order])) + 1
        for child in np.split(at[order], cuts):
            if len(child) > len(at) // 2:
                _stars(tokens, n, child, least, ratio, out)
            else:
                _branch(tokens, n, child, seed ^ int(tokens[child[0], seed % COORDINATES]), depth + 1, least, ratio, out)


def _across(tokens, n, label, probes, base, least: float, ratio: float, out: list) -> None:
    """Compare probes with base by tokens where their labels differ; append one (row, row) for each two labels found similar and merge them."""
    t, nb = np.ascontiguousarray(tokens[base].T), n[base]
    lb = label[base]
    for x in probes.tolist():
        own = label[x]
        same = (t == tokens[x][:, None]).sum(0, dtype=np.uint8) / COORDINATES
        hit = np.flatnonzero((same >= least) & (lb != own) & (np.minimum(nb, n[x]) >= ratio * np.maximum(nb, n[x]) - 1e-6))
        if len(hit):
            old, at = np.unique(lb[hit], return_index=True)
            out += [(int(base[hit[k]]), x) for k in at.tolist()]
            lb = np.where(np.isin(lb, old), own, lb)
            label[np.isin(label, old)] = own


def _labels(n: int, links: list) -> np.ndarray:
    """The stars' components: a label for each of n rows."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return np.array([find(x) for x in range(n)])


def _node(tokens, n, path: int, least: float, ratio: float) -> list:
    """Links that connect all loosely similar rows of a node."""
    out: list = []
    every = np.arange(len(tokens))
    _branch(tokens, n, every, path, 0, least, ratio, out)
    if len(tokens) > SMALL:  # branching on may have parted similar rows
        label = _labels(len(tokens), out)
        names, sizes = np.unique(label, return_counts=True)
        _across(tokens, n, label, np.flatnonzero(label != names[sizes.argmax()]), every, least, ratio, out)
    return out


def _placed(walked: DataFrame, most_node: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, block, uid): members of all nodes of two or more classes; and (key, cut, uid) of the nodes of more than most_node classes, if any.

    The latter are dealt out in `cut` blocks by a hash, and each block also gets the node's first and last class as ties; _rest() pairs the blocks.
    """
    nodes = walked.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("uid").alias("first"), F.max("uid").alias("last")).where("size > 1").withColumn("cut", F.ceil(F.col("size") / most_node).cast("int"))
    member = walked.join(nodes, "key")
    small = member.where("cut = 1").select("key", F.lit(0).alias("block"), "uid")
    large = C.cut(member.where("cut > 1").select("key", "uid", "first", "last", "cut"), "large")
    if not large.limit(1).count():
        return small, None
    every = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    ends = large.select("key", "first", "last", "cut").distinct().select("key", every.alias("block"), F.array("first", "last").alias("ends"))
    dealt = large.select("key", _block("cut").alias("block"), "uid").unionByName(ends.select("key", "block", F.explode("ends").alias("uid"))).distinct()
    return small.unionByName(dealt), large.select("key", "cut", "uid")


def _block(cut: str):
    return F.pmod(F.xxhash64("uid", "key"), F.col(cut)).cast("int")


def _rest(large: DataFrame, known: DataFrame, most_node: int) -> DataFrame:
    """(key, block, other, uid, label, probe): each block of a large node with each block of its members (probes) outside the node's largest component.

    known is (id, component). Two members that are not connected meet in one group, at least one of them as a probe.
    """
    labelled = C.cut(large.join(known.select(F.col("id").alias("uid"), "component"), "uid", "left").select("key", "cut", "uid", F.coalesce("component", "uid").alias("label")), "labelled")
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    open_ = labelled.join(main.withColumn("parts", F.ceil(F.col("others") / most_node).cast("int")), "key")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    base = open_.select("key", _block("cut").alias("block"), upto("parts").alias("other"), "uid", "label", F.lit(False).alias("probe"))
    probes = open_.where("label <> main").select("key", upto("cut").alias("block"), _block("parts").alias("other"), "uid", "label", F.lit(True).alias("probe"))
    return base.unionByName(probes)


def _edges(pairs):
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _node_edges(batches, least: float, ratio: float):
    for (key, _), g in _groups(batches, ("key", "block")):
        tokens = np.frombuffer(b"".join(g["tokens"]), "<u2").reshape(-1, COORDINATES)
        pairs = {(g["uid"][a], g["uid"][b]) for a, b in _node(tokens, np.array(g["n"]), key & 0x7FFFFFFF, least, ratio)}
        if pairs:
            yield _edges(pairs)


def _rest_edges(batches, least: float, ratio: float):
    for _, g in _groups(batches, ("key", "block", "other")):
        tokens = np.frombuffer(b"".join(g["tokens"]), "<u2").reshape(-1, COORDINATES)
        probe, found = np.array(g["probe"]), []
        _across(tokens, np.array(g["n"]), np.array(g["label"]), np.flatnonzero(probe), np.flatnonzero(~probe), least, ratio, found)
        if found:
            yield _edges({(g["uid"][a], g["uid"][b]) for a, b in found})


def _full_sets(batches, k: int):
    for batch in batches:
        sets = [s.astype("<u8").tobytes() for _, s in shingle_sets(batch, k)]
        keep = [batch.column(c) for c in ("cluster", "uid")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sets, pa.binary())], names=["cluster", "uid", "shingles"])


def confirmed(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the sets, as stars of their components: two sets not yet connected are compared exactly."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(ids.max(initial=-1) + 1, bool)
    out = []
    todo = np.argsort(-sizes, kind="stable")
    live = todo

    def pack(rows):
        return np.concatenate([ids[ptr[r] : ptr[r + 1]] for r in rows]), np.concatenate([[0], np.cumsum(sizes[rows])])[:-1]

    open_ = np.ones(len(sets), bool)
    flat, lptr = pack(live) if len(live) else (None, None)
    for root in todo.tolist():
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            if open_.sum() * 2 < len(live):
                live = live[open_[live]]
                if not len(live):
                    break
                flat, lptr = pack(live)
            if not len(live):
                break
            mark[ids[ptr[x] : ptr[x + 1]]] = True
            common = np.add.reduceat(mark[flat], lptr, dtype=np.int64)
            mark[ids[ptr[x] : ptr[x + 1]]] = False
            hit = open_[live] & (100 * common >= percent * (sizes[live] + sizes[x] - common))
            new = live[hit]
            open_[new] = False
            out += [(r, root) for r in new.tolist()]
            queue += new.tolist()
    return out


def _confirm(batches, percent: int):
    for _, g in _groups(batches, ("g", "block")):
        order = np.argsort(np.array(g["uid"]))
        uid = [g["uid"][k] for k in order]
        sets = [np.frombuffer(g["shingles"][k], "<u8") for k in order]
        links = confirmed(sets, percent)
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array([uid[k] for k in a], pa.int64()), pa.array([uid[k] for k in b], pa.int64())], names=["a", "b"])


def _rest_confirm(batches, percent: int):
    """Exact links between probes and the others of a group where their labels differ, one for each two labels."""
    for _, g in _groups(batches, ("key", "block", "other")):
        probe, label = np.array(g["probe"]), np.array(g["label"])
        base = np.flatnonzero(~probe)
        if not len(base):
            continue
        sets = [np.frombuffer(x, "<u8") for x in g["shingles"]]
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        sizes = np.array([len(x) for x in sets])
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate([ids[ptr[r] : ptr[r + 1]] for r in base.tolist()])
        lptr, lb, nb = np.cumsum(sizes[base]) - sizes[base], label[base], sizes[base]
        mark = np.zeros(ids.max(initial=-1) + 1, bool)
        pairs = []
        for x in np.flatnonzero(probe).tolist():
            mine = ids[ptr[x] : ptr[x + 1]]
            mark[mine] = True
            common = np.add.reduceat(mark[flat], lptr, dtype=np.int64)
            mark[mine] = False
            hit = np.flatnonzero((lb != label[x]) & (100 * common >= percent * (nb + sizes[x] - common)))
            if len(hit):
                own = label[x]
                old, at = np.unique(lb[hit], return_index=True)
                pairs += [(g["uid"][base[hit[k]]], g["uid"][x]) for k in at.tolist()]
                lb = np.where(np.isin(lb, old), own, lb)
                label[np.isin(label, old)] = own
        if pairs:
            yield _edges(pairs)


def _owned(rows: DataFrame, owner: DataFrame, classes: DataFrame, hot_class: int) -> DataFrame:
    """rows with the component of their class. Classes of more than hot_class rows and of a share of rows above 1 / MOST_HOT, so at most MOST_HOT, are broadcast."""
    keys = ["n", "s1", "s2"]
    total = classes.agg(F.sum("members")).first()[0] or 0
    is_hot = F.col("members") > max(hot_class, total // MOST_HOT)
    if not classes.where(is_hot).limit(1).count():
        return rows.join(owner.drop("members"), keys)
    hot = C.cut(owner.where(is_hot).drop("members"), "hot")
    met = rows.join(F.broadcast(hot), keys, "left")
    rest = met.where("component IS NULL").drop("component").join(owner.where(~is_hot).drop("members"), keys)
    return met.where("component IS NOT NULL").unionByName(rest)


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, trees: int = 14, most_node: int = 4_000, most_shingles: int = 2_000_000, hot_class: int = 100_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, uid for each row of docs (doc_id, text)."""
    docs = C.with_uid(docs, "text")
    return _near(docs, hasattr(docs, "_scratch"), shingle, percent, trees, most_node, most_shingles, hot_class)


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = 16) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their group of near copies."""
    rows = C.keyed_rows(docs)
    kept = _near(rows.select("uid", "doc_id", "text"), hasattr(rows, "_scratch"), shingle, percent, trees).where("kept").select("uid")
    return rows.select("uid", "row").join(kept, "uid", "left_semi").select("row.*")


def _near(docs: DataFrame, numbered: bool, shingle: int, percent: int, trees: int, most_node: int = 4_000, most_shingles: int = 2_000_000, hot_class: int = 100_000) -> DataFrame:
    sig = C.cut(docs.select("uid", "doc_id", "text").mapInArrow(lambda it: C.trimmed(_signed(it, shingle, trees)), "uid long, doc_id long, n long, s1 long, s2 long, tokens binary, keys array<long>"), "signatures")
    least, ratio = percent / 100 - SLACK, percent / 100

    # classes of equal sets: partial minima first, so a third of all rows in one class is no burden
    classes = C.cut(sig.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    reps = sig.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")

    placed, oversized = _placed(reps.select("uid", F.explode("keys").alias("key")), most_node)
    loose = placed.join(reps.select("uid", "n", "tokens"), "uid").repartition("key", "block").sortWithinPartitions("key", "block", "uid").mapInArrow(lambda it: C.trimmed(_node_edges(it, least, ratio)), "a long, b long")
    known = C.components(loose)
    group = ("key", "block", "other")
    if oversized is not None:
        more = _rest(oversized, known, most_node).join(reps.select("uid", "n", "tokens"), "uid").repartition(*group).sortWithinPartitions(*group, "uid").mapInArrow(lambda it: C.trimmed(_rest_edges(it, least, ratio)), "a long, b long")
        known = C.components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    clusters = known.withColumnRenamed("component", "cluster")

    sized = clusters.join(reps.select(F.col("uid").alias("id"), "n"), "id")
    blocks = sized.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / most_shingles)).cast("int").alias("blocks"))
    where = C.cut(clusters.join(blocks, "cluster").select(F.col("id").alias("uid"), "cluster", "blocks"), "clusters")
    large = where.where("blocks > 1").limit(1).count()
    texts = docs.select("uid", "text")

    def sets_of(part: DataFrame) -> DataFrame:
        return part.join(texts, "uid").select("cluster", "uid", "text").mapInArrow(lambda it: C.trimmed(_full_sets(it, shingle)), "cluster long, uid long, shingles binary")

    alone = sets_of(where.where("blocks = 1")).select(F.col("cluster").alias("g"), F.lit(-1).alias("block"), "uid", "shingles")
    if large:
        alone = alone.unionByName(sets_of(where.where("blocks > 1")).join(placed.select(F.col("key").alias("g"), "block", "uid"), "uid").select("g", "block", "uid", "shingles"))
    links = alone.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(lambda it: C.trimmed(_confirm(it, percent)), "a long, b long")
    if large:
        found = C.components(links)
        if oversized is not None:
            inside = oversized.join(where.where("blocks > 1").select("uid"), "uid", "left_semi")
            texted = sets_of(where.where("blocks > 1")).select("uid", "shingles")
            more = _rest(inside, found, most_node).join(texted, "uid").repartition(*group).sortWithinPartitions(*group, "uid").mapInArrow(lambda it: C.trimmed(_rest_confirm(it, percent)), "a long, b long")
            found = C.components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    else:  # a cluster's links are all in one place: stars are components already, but for the name
        links = C.cut(links, "links")
        named = links.groupBy("b").agg(F.min("a").alias("m")).select("b", F.least("b", "m").alias("component"))
        found = links.join(named, "b").select(F.col("a").alias("id"), "component").unionByName(named.select(F.col("b").alias("id"), "component"))

    owner = classes.join(found.select(F.col("id").alias("rep"), F.col("component").alias("found")), "rep", "left").select("n", "s1", "s2", F.coalesce("found", "rep").alias("component"), "members")
    # wordless documents are one key, and need no join; frequent texts are hot keys, and meet their few classes without a shuffle
    found = _owned(sig.where("n > 0").select("uid", "doc_id", "n", "s1", "s2"), owner, classes, hot_class).select("uid", "doc_id", F.col("n").alias("n_shingles"), "component")
    out = found.unionByName(sig.where("n = 0").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.col("uid").alias("component")))
    if numbered:
        out = out.join(sig.select(F.col("uid").alias("component"), F.col("doc_id").alias("component_id")), "component")
    else:
        out = out.withColumn("component_id", F.col("component"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("uid") == F.col("component")).alias("kept"), "uid")


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("uid")


#: The same by a join on shingles and transitive closure (DuckDB).
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] ELSE array_to_string(w, ' ') || ' ' || len(w) END AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
