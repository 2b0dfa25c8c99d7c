"""Language ID: segmentation-marginalised unigrams over a fixed public vocabulary.

A word (with the space before it) has under each language the sum, over all its segmentations into vocabulary pieces, of the product of that language's piece
probabilities: a forward pass over the word's bytes. Every single byte is a piece too, so every text has a segmentation. Words count whole, however long:
where no piece of the vocabulary spans two neighbouring bytes, the sum is a product of two sums, so long words are taken apart there without changing it.

A document's likelihood under a language is the product over its words of (1 - FOREIGN) times the word's probability in the language plus FOREIGN times its mean
probability over all languages: in any text a word may be a foreign one, so a quoted passage does not outweigh a longer text. The score is the language's share of
the documents' likelihoods (equal priors). Words without a letter are left out. The probabilities are fitted by expectation-maximisation (forward-backward) on
word counts of a bounded sample: at most about `most_documents` training documents for each language, drawn by a hash of doc_id; of their words the `most_words` most
frequent ones (ties by a hash) of up to `LONGEST` bytes. Scoring covers every whole text.

Distribution: fitting is one narrow aggregate; scoring is one Arrow pass without a shuffle. A task remembers the scores of words it has met, at most
`CACHE` of them and `CACHE_CHARS` characters, so memory is bounded and a forward pass runs once for most words.

Defined results: `und` with score 0 for null text and text without a letter; ties go to the language first in code-point order; null or repeated doc_ids are
scored row by row; without any labelled training row every prediction is `und`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 400_000
CACHE_CHARS = 1 << 25
SUB_CHARS = 1 << 20
FLOOR = 1e-7
BYTE_FLOOR = 1e-5
FOREIGN = 0.05
LONGEST = 4096
BLOCK = 1 << 12
CELLS = 1 << 16
U64 = np.uint64


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model as bytes (word start: a space), without control pieces, and all single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            found.add(sp.id_to_piece(i).replace("▁", " ").encode())
    return sorted(found)


class Pieces:
    """Looks up pieces by hash: two open tables, the second for what collides in the first."""

    def __init__(self, pieces: list[bytes]):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        self.single = np.array([len(x) == 1 for x in pieces])
        h = np.zeros(self.n, np.uint64)
        for k, x in enumerate(pieces):
            v = 0
            for c in x:
                v = (v * 0x9E3779B97F4A7C15 + c + 1) & (2**64 - 1)
            h[k] = v
        if len(np.unique(h)) < self.n:
            raise ValueError("piece hashes collide")
        self.h = np.append(h, U64(0))
        self.first, self.second = np.full(1 << 20, self.n, np.int32), np.full(1 << 20, self.n, np.int32)
        late = []
        for k, s in enumerate(self._slot(h, 44).tolist()):
            if self.first[s] == self.n:
                self.first[s] = k
            else:
                late.append(k)
        for k in late:
            s = int(self._slot(h[k : k + 1], 20)[0])
            if self.second[s] != self.n:
                raise ValueError("piece slots collide")
            self.second[s] = k

    @staticmethod
    def _slot(h: np.ndarray, shift: int) -> np.ndarray:
        return (((h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)) >> U64(shift)) & U64((1 << 20) - 1)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash; n where there is none."""
        k = self.first[self._slot(h, 44)]
        miss = self.h[k] != h
        if miss.any():
            m = self.second[self._slot(h[miss], 20)]
            k[miss] = np.where(self.h[m] == h[miss], m, self.n)
        return k

    def lattice(self, words: np.ndarray) -> list[np.ndarray]:
        """For words (n, L) of bytes: for each piece length l, the piece at [i, i+l) or n."""
        out, h = [], np.zeros(words.shape, np.uint64)
        for l in range(1, min(self.longest, words.shape[1]) + 1):
            h = h[:, : words.shape[1] - l + 1] * U64(0x9E3779B97F4A7C15) + words[:, l - 1 :].astype(np.uint64) + U64(1)
            out.append(self.lookup(h))
        return out


    def breaks(self, word: bytes) -> list[int]:
        """Places inside a word that no piece spans."""
        x, out = np.frombuffer(word, np.uint8)[None], []
        for at in range(0, len(word), BLOCK):
            lo = max(0, at - self.longest)
            lattice = self.lattice(x[:, lo : at + BLOCK + self.longest])
            spanned = np.zeros(lattice[0].shape[1] + self.longest + 1, np.int64)
            for l, ks in enumerate(lattice[1:], 2):
                i = np.flatnonzero(ks[0] < self.n)
                spanned[i + 1] += 1
                spanned[i + l] -= 1
            free = np.flatnonzero(np.cumsum(spanned)[: lattice[0].shape[1]] == 0) + lo
            out += free[(free >= max(at, 1)) & (free < at + BLOCK)].tolist()
        return out


def forward(lattice: list[np.ndarray], probs: np.ndarray, length: int, tilt: np.ndarray | None = None) -> list[np.ndarray]:
    """alpha[j] (n, languages): total probability of all segmentations of the first j bytes. probs: (pieces + 1, languages), last row 0.

    tilt (n, languages): a factor for each byte, against underflow.
    """
    n = lattice[0].shape[0]
    found = [(ks < len(probs) - 1).any(0) for ks in lattice]
    alpha = [np.ones((n, probs.shape[1]))]
    for j in range(1, length + 1):
        a = np.zeros((n, probs.shape[1]))
        for l in range(1, min(len(lattice), j) + 1):
            if found[l - 1][j - l]:
                p = probs[lattice[l - 1][:, j - l]]
                a += alpha[j - l] * (p if tilt is None else p * tilt**l)
        alpha.append(a)
    return alpha


def log_sums(pieces: Pieces, probs: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logarithm (n, languages) of the total probability of all segmentations of each word: the first lengths bytes of a row of words.

    The forward pass keeps as many sums as the longest piece has bytes, scaled by the newest now and then, and looks pieces up a block of bytes at a time.
    """
    n, length = words.shape
    out, scale = np.zeros((n, probs.shape[1])), np.zeros((n, probs.shape[1]))
    alpha = [np.ones((n, probs.shape[1]))]
    for at in range(0, length, BLOCK):
        lo = max(0, at + 1 - pieces.longest)
        lattice = pieces.lattice(words[:, lo : at + BLOCK])
        found = [(ks < pieces.n).any(0) for ks in lattice]
        for j in range(at + 1, min(at + BLOCK, length) + 1):
            a = np.zeros_like(scale)
            for l in range(1, min(len(lattice), j) + 1):
                if found[l - 1][j - l - lo]:
                    a += alpha[-l] * probs[lattice[l - 1][:, j - l - lo]]
            alpha.append(a)
            done = lengths == j
            if done.any():
                out[done] = np.log(a[done]) + scale[done]
            if j % 8 == 0:
                scale += np.log(a)
                alpha = [x / a for x in alpha[-pieces.longest :]]
    return out


def units(words: list[str], pieces: Pieces) -> tuple[list[bytes], np.ndarray]:
    """The words as bytes behind a space, long ones in parts that no piece joins, and the word that each part belongs to."""
    out, owner = [], []
    for k, w in enumerate(words):
        b = b" " + w.encode("utf-8", "surrogatepass")
        cuts = [0, *pieces.breaks(b), len(b)] if len(b) > 64 else [0, len(b)]
        out += [b[x:y] for x, y in zip(cuts, cuts[1:])]
        owner += [k] * (len(cuts) - 1)
    return out, np.array(owner, np.int64)


def by_length(parts: list[bytes], cells: int = CELLS):
    """Rows of parts of about one length, their bytes as a matrix filled up with zeros, and their lengths."""
    sizes = np.array([len(x) for x in parts], np.int64)
    step = np.maximum(4, 1 << np.maximum(np.log2(np.maximum(sizes, 1)).astype(np.int64) - 2, 0))
    padded = -(-sizes // step) * step
    for length in np.unique(padded).tolist():
        rows = np.flatnonzero(padded == length)
        most = max(1, cells // length)
        for at in range(0, len(rows), most):
            r = rows[at : at + most]
            yield r, np.frombuffer(b"".join(parts[k].ljust(length, b"\0") for k in r), np.uint8).reshape(len(r), length), sizes[r]


class Model:
    def __init__(self, languages: list[str], pieces: Pieces, probs: np.ndarray):
        self.languages, self.pieces, self.probs = languages, pieces, probs

    def score(self, words: list[str]) -> np.ndarray:
        """What each word adds to the log-likelihood of each language, up to a constant for the word; nothing for words without a letter."""
        parts, owner = units(words, self.pieces)
        logs = np.zeros((len(parts), len(self.languages)))
        out = np.zeros((len(words), len(self.languages)))
        if not len(self.languages):
            return out
        for rows, m, lengths in by_length(parts):
            logs[rows] = log_sums(self.pieces, self.probs, m, lengths)
        np.add.at(out, owner, logs)
        p = np.exp(out - out.max(1, keepdims=True))
        out = np.log((1 - FOREIGN) * p + FOREIGN * p.mean(1, keepdims=True))
        out[[k for k, w in enumerate(words) if not w.isalpha() and not has_letter(w)]] = 0
        return out


def fit(languages: list[str], counts: dict[str, np.ndarray], pieces: Pieces, rounds: int = 2) -> Model:
    """Piece probabilities for each language from word counts (word: one count for each language)."""
    words = list(counts)
    weight = np.array([counts[w] for w in words], float).reshape(len(words), len(languages))
    parts, owner = units(words, pieces)
    weight = weight[owner] if len(parts) else np.zeros((0, len(languages)))
    batches = [(weight[rows], m, lengths) for rows, m, lengths in by_length(parts)]
    floor = np.where(pieces.single, BYTE_FLOOR, FLOOR)[:, None]

    def lattice_of(m, lengths):
        """Pieces at each place, none of them beyond a word's end."""
        out = pieces.lattice(m)
        for l, ks in enumerate(out, 1):
            ks[np.arange(ks.shape[1])[None, :] + l > lengths[:, None]] = pieces.n
        return out

    def normal(c: np.ndarray) -> np.ndarray:
        p = np.maximum(c / np.maximum(c.sum(0), 1e-300), floor)
        return np.vstack([p / p.sum(0), np.zeros((1, len(languages)))])

    expected = np.zeros((pieces.n + 1, len(languages)))
    for w, m, lengths in batches:  # first: every occurrence of a piece counts
        for ks in lattice_of(m, lengths):
            for g in range(len(languages)):
                expected[:, g] += np.bincount(ks.ravel(), np.repeat(w[:, g], ks.shape[1]), pieces.n + 1)
    probs = normal(expected[:-1])
    for _ in range(rounds):
        expected[:] = 0
        for w, m, lengths in batches:
            lattice, length = lattice_of(m, lengths), m.shape[1]
            whole = log_sums(pieces, probs, m, lengths)
            tilt = np.exp(-whole / lengths[:, None]) if length > 32 else None
            alpha = forward(lattice, probs, length, tilt)
            total = np.exp(whole) if tilt is None else np.ones_like(whole)
            found = [(ks < pieces.n).any(0) for ks in lattice]
            beta = [None] * (length + 1)
            for i in range(length, -1, -1):
                b = np.where((lengths == i)[:, None], w / total, 0.0)
                for l in range(1, min(len(lattice), length - i) + 1):
                    if not found[l - 1][i]:
                        continue
                    k = lattice[l - 1][:, i]
                    p = probs[k]
                    t = (p if tilt is None else p * tilt**l) * beta[i + l]
                    b += t
                    for g in range(len(languages)):
                        expected[:, g] += np.bincount(k, alpha[i][:, g] * t[:, g], pieces.n + 1)
                beta[i] = b
        probs = normal(expected[:-1])
    return Model(languages, pieces, probs)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _counted(batches):
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            seen.setdefault(lang, Counter()).update(text.lower().split())
        for lang, c in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "word": list(c), "n": pa.array(list(c.values()), pa.int64())})


def _predicted(batches, model: Model):
    cache: dict[str, int] = {}
    logs, chars = np.zeros((0, len(model.languages))), 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        pred, score = [], []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= SUB_CHARS):
                size += len(texts[end] or "")
                end += 1
            words = [(t or "").lower().split() for t in texts[at:end]]
            if len(cache) > CACHE or chars > CACHE_CHARS:
                cache, logs, chars = {}, logs[:0], 0
            new = list(set().union(*words).difference(cache))
            chars += sum(map(len, new))
            cache.update(zip(new, range(len(cache), len(cache) + len(new))))
            logs = np.concatenate([logs, model.score(new)]) if new else logs
            for t, w in zip(texts[at:end], words):
                if not t or not len(model.languages) or not has_letter(t):
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = logs[[cache[x] for x in w]].sum(0)
                k = int(total.argmax())
                pred.append(model.languages[k])
                score.append(float(1 / np.exp(total - total[k]).sum()))
            at = end
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )


def train(rows: DataFrame, vocabulary_path: str, most_documents: int = 800, most_words: int = 150_000) -> Model:
    """Fit on rows (doc_id, text, lang): about most_documents of each language, and the most_words most frequent (language, word) of up to LONGEST bytes in them."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    pieces = Pieces(vocabulary(vocabulary_path))
    if not languages:
        return Model([], pieces, np.zeros((pieces.n + 1, 0)))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, most_documents / n))) for k, n in sizes.items()])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    counted = sample.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counted.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), F.xxhash64("word", "lang"), "word", "lang").limit(most_words)
    table: dict[str, np.ndarray] = {}
    place = {k: i for i, k in enumerate(languages)}
    for r in top.toArrow().to_batches():
        for lang, word, n in zip(*(r.column(c).to_pylist() for c in ("lang", "word", "n"))):
            table.setdefault(word, np.zeros(len(languages)))[place[lang]] += n
    return fit(languages, table, pieces)


def identify(docs: DataFrame, held_out, vocabulary_path: str, most_documents: int = 800, most_words: int = 150_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang); the rows where held_out holds teach nothing."""
    docs = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = train(docs.where("NOT held_out"), vocabulary_path, most_documents, most_words)
    return docs.select("doc_id", "held_out", "text").mapInArrow(lambda it: _predicted(it, model), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs, held, public_tokenizers.path("piece_bpe_32k.model"))
