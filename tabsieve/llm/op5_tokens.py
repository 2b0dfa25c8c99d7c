"""Token-ID / binary output: sorted-string-table shards of token ids, keyed by doc_id, written and read back.

The rows are range-partitioned and sorted by doc_id; each task encodes its texts and streams them into one file (sst.py) in the shared folder, under a
temporary name until it is whole, so a repeated task replaces the same file. There are as many shards as shuffle partitions, and more where one would hold over
`shard_bytes` of text. The driver sees one manifest row for each shard; from the shards' sums of ids it gives each reader the offset at which its shard
starts. Readers go block by block.

Rows of one doc_id (or of none) are dealt out by the first characters of their texts, in order, so a frequent id is no single task; only copies of one text
under one id stay together. Such an id may stand in neighbouring shards, where its repeats are numbered anew.

Encoding uses the tokenizers library. A single space or newline between other characters always starts a new pre-token of this byte-level vocabulary, so a text
is cut there, and each different word is encoded once for a Python worker (at most CACHE remembered); texts where that does not hold (white space side by
side or at an end, the text of a special token) are encoded whole.

Defined results: null text counts as empty and holds only the end id; repeated doc_ids are separate entries, ordered by text; null doc_ids come last; an
empty table gives no shard and no rows; a very long text is encoded whole, as one entry; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm import common as C
from tabsieve.llm import sst

END = 2
CACHE = 450_000
#: Characters of a text that say which shard takes it among rows of the same doc_id. Spark samples at most some 3 million such keys for its ranges.
PLACE = 16
JOIN = 1 << 16
MARKS = ".,"


class Encoder:
    """Texts to bytes of ids (width bytes each, little-endian)."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        n = max(vocab.values()) + 1
        self.width = 2 if n <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.spaced = np.zeros(n, bool)
        self.spaced[[k for x, k in vocab.items() if x.startswith("Ġ")]] = True
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids = [np.array([k], self.kind).tobytes() for k in range(n)]
        self.newline, self.marks = self.whole(["\n"])[0], {c: self.whole([c])[0] for c in MARKS}
        # what a byte looks like to the model, as the vocabulary's own alphabet shows it
        self.letters = {b: c for b, c in byte_letters().items() if b != 10}
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of words after a space: one text, cut where an id starts with a space."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        body, at = ids.tobytes(), np.flatnonzero(self.spaced[ids]).tolist()
        if len(at) != len(words) or at[0]:
            raise AssertionError("words can't be told apart")
        return [body[a * self.width : b * self.width] for a, b in zip(at, [*at[1:], len(ids)])]

    def _letters_only(self, words: list[str], before: str) -> list[bytes]:
        """The ids of words of letters: each is a single pre-token, which the vocabulary's model takes as it is."""
        tokenize, ids = self.tokenizer.model.tokenize, self.ids
        shown = "\n".join(words).encode().decode("latin-1").translate(self.letters).split("\n")
        return [b"".join([ids[k.id] for k in tokenize(before + x)]) for x in shown]

    def learn(self, new: set[str]) -> None:
        """Remember the ids of new words: with the space before them or, if they start with a newline, with that. A letter and a final mark are two
        pre-tokens, so a mark is left off and put back."""
        known, marked, rest, done = self.known, [], [], set()
        for x in new:
            if x[-1] in MARKS and len(x) > 1 and x[-2].isalpha():
                marked.append(x)
                x = x[:-1]
                if x in known or x in new or x in done:
                    continue
                done.add(x)
            rest.append(x)
        after, first, odd, odd_first = [], [], [], []
        for x in rest:
            if x[0] == "\n":
                (first if x[1:].isalpha() else odd_first).append(x)
            else:
                (after if x.isalpha() else odd).append(x)
        known.update(zip(after, self._letters_only(after, "Ġ") if after else ()))
        if first:
            known.update(zip(first, (self.newline + b for b in self._letters_only([x[1:] for x in first], ""))))
        known.update(zip(odd_first, self.whole(odd_first) if odd_first else ()))
        at = 0
        while at < len(odd):
            end, size = at, 0
            while end < len(odd) and (end == at or size < JOIN):
                size += len(odd[end])
                end += 1
            known.update(zip(odd[at:end], self._joined(odd[at:end])))
            at = end
        for x in marked:
            known[x] = known[x[:-1]] + self.marks[x[-1]]

    def words(self, text: str) -> list[str] | None:
        """The words of a text whose spaces and newlines all stand alone between other characters, the first of a line with a newline; None for others."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or any(s in text for s in self.special):
            return None
        words = f"\n{text}".replace("\n", " \n").split(" ")
        del words[0]
        return words

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        words = [self.words(t) if t else None for t in texts]
        new = set().union(*filter(None, words)).difference(self.known)
        # a newline and other white space after it would be one pre-token
        bad = {x for x in new if x[0] == "\n" and x[1].isspace()}
        if bad:
            words = [None if w is None or bad.intersection(w) else w for w in words]
            new -= bad
        if new:
            self.learn(new)
        get, skip = self.known.__getitem__, len(self.newline)
        out = [b"" if w is None else b"".join(map(get, w))[skip:] for w in words]
        odd = [k for k, t in enumerate(texts) if t and words[k] is None]
        for k, b in zip(odd, self.whole([texts[k] for k in odd]) if odd else ()):
            out[k] = b
        return out


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder_of(tokenizer_json: str) -> Encoder:
    """One encoder for a Python worker, so that what one task has learned serves the next."""
    if tokenizer_json not in _encoders:
        _encoders[tokenizer_json] = Encoder(tokenizer_json)
    return _encoders[tokenizer_json]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def batches_of(batch, rows: int = 256):
    """Rows of a batch, a few at a time, as Python objects."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]


def _write(batches, folder: str, tokenizer_json: str, end_id: int):
    from pyspark import TaskContext

    encoder = writer = None
    n = TaskContext.get().partitionId()
    store, base = _open(folder)
    temp, final = f"{base}/.{n:06d}-{uuid.uuid4().hex}", f"{base}/shard-{n:06d}.sst"
    last, repeat, first = None, 0, None
    for batch in batches:
        for ids, texts in batches_of(batch):
            if writer is None:
                encoder = encoder_of(tokenizer_json)
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(temp)
                writer = sst.Writer(out, encoder.width)
                end = np.array([end_id], encoder.kind).tobytes()
            for doc_id, body in zip(ids, encoder.encode(texts)):
                repeat = repeat + 1 if first is not None and doc_id == last else 0
                last = doc_id
                key = sst.id_key(doc_id, repeat)
                first = first or key
                writer.add(key, body + end)
    if writer:
        writer.close()
        out.close()
        store.move(temp, final)
        yield pa.RecordBatch.from_pydict({"shard": [n], "path": [f"{folder}/shard-{n:06d}.sst"], "first": pa.array([first], pa.binary()), "n_docs": [writer.entries], "n_ids": [writer.total]})


def _read(batches):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            store, name = _open(path)
            with store.open_input_file(name) as f:
                table = sst.Reader(f, f.size())
                kind = f"<u{table.width}"
                for k in range(len(table.keys)):
                    out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for key, value in table.block(k):
                        ids = np.frombuffer(value, kind)
                        out["doc_id"].append(sst.key_id(key))
                        out["start"].append(start)
                        out["n_tokens"].append(len(ids))
                        out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                        start += len(ids)
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END, folder: str | None = None, shard_bytes: int = 512 << 20):
    """Write docs (doc_id, text) as table shards; returns the manifest: one Row for each shard, in key order."""
    spark = docs.sparkSession
    folder = folder or C.new_path(spark, "shards")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    order = F.col("doc_id").asc_nulls_last()
    done = rows.repartitionByRange(n, order, F.substring("text", 1, PLACE)).sortWithinPartitions(order, "text").mapInArrow(lambda it: C.trimmed(_write(it, folder, tokenizer_json, end_id)), "shard long, path string, first binary, n_docs long, n_ids long")
    return sorted(done.collect(), key=lambda r: r["shard"])


def read_shards(spark, manifest) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the shards' files."""
    places, start = [], 0
    for r in manifest:
        places.append((r["path"], start))
        start += r["n_ids"]
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shards = spark.createDataFrame(places, "path string, start long")
    return shards.repartition(max(1, len(places))).mapInArrow(_read, out)


def lookup(path: str, doc_id: int, repeat: int = 0) -> list[int] | None:
    """The ids of one document from one shard, by binary search."""
    store, name = _open(path)
    with store.open_input_file(name) as f:
        table = sst.Reader(f, f.size())
        value = table.get(sst.id_key(doc_id, repeat))
        return None if value is None else np.frombuffer(value, f"<u{table.width}").tolist()


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = END, folder: str | None = None) -> DataFrame:
    return read_shards(docs.sparkSession, write_shards(docs, tokenizer_path, end_id, folder))


def query(spark, sf_dir):
    import public_tokenizers

    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
