"""Sorted-string-table files: entries in key order in prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

File (integers little-endian, varints as in LEB128):

    block*   zstd of entries, then crc32 (4 bytes) of the compressed bytes.
             entry: varint shared, varint rest, varint value size, rest of the key, value; `shared` leading bytes are those of the key before it
             (0 for a block's first entry)
    index    zstd of: for each block varint key size, first key, varint offset, varint size, varint entries
    bloom    bit array; a key sets PROBES bits (h1 + i * h2) mod bits, h1 and h2 being the halves of its 16-byte blake2b digest
    footer   struct FOOTER: index offset and size, bloom offset and size, entries, sum of counts, width, magic

Keys are byte strings compared as such. A value is an array of unsigned integers, `width` bytes each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right

import numpy as np
import zstandard

MAGIC = b"TSST0001"
FOOTER = struct.Struct("<QQQQQQQ8s")
BLOCK = 1 << 17
PROBES = 7
BITS = 10


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def id_key(doc_id: int | None, repeat: int) -> bytes:
    """Orders as doc_id does (null last), then by the number of the repeat."""
    return (b"\1" + bytes(8) if doc_id is None else b"\0" + (doc_id + (1 << 63)).to_bytes(8, "big")) + repeat.to_bytes(4, "big")


def key_id(key: bytes) -> int | None:
    return None if key[0] else int.from_bytes(key[1:9], "big") - (1 << 63)


def _probes(key: bytes, bits: int):
    d = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Streams entries, given in key order, into an open binary file. Holds one block, the index and the keys' digests."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.size, self.first, self.last, self.n = [], 0, None, b"", 0
        self.index, self.digests, self.entries, self.total = [], [], 0, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += [varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value]
        self.size += len(key) - shared + len(value)
        self.last = key
        self.n += 1
        self.entries += 1
        self.total += len(value) // self.width
        self.digests.append(hashlib.blake2b(key, digest_size=16).digest())
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.n:
            body = self.pack(b"".join(self.block))
            self.out.write(body + struct.pack("<I", zlib.crc32(body)))
            self.index.append(varint(len(self.first)) + self.first + varint(self.at) + varint(len(body) + 4) + varint(self.n))
            self.at += len(body) + 4
            self.block, self.size, self.first, self.n = [], 0, None, 0

    def close(self) -> None:
        self.flush()
        index = self.pack(b"".join(self.index))
        bits = max(64, (self.entries * BITS + 7) // 8 * 8)
        bloom = np.zeros(bits, bool)
        d = np.frombuffer(b"".join(self.digests), "<u8").reshape(-1, 2)
        for a, b in zip(d[:, 0].tolist(), d[:, 1].tolist()):
            b |= 1
            bloom[[(a + i * b) % bits for i in range(PROBES)]] = True
        filt = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + filt + FOOTER.pack(self.at, len(index), self.at + len(index), len(filt), self.entries, self.total, self.width, MAGIC))


class Reader:
    """Reads an open, seekable binary file of the given size."""

    def __init__(self, file, size: int):
        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        at, n, self.bloom_at, self.bloom_size, self.entries, self.total, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table")
        self.keys, self.places, b, k = [], [], self.unpack(self._read(at, n)), 0
        while k < len(b):
            n, k = read_varint(b, k)
            self.keys.append(b[k : k + n])
            place, k = read_varint(b, k + n)
            size, k = read_varint(b, k)
            _, k = read_varint(b, k)
            self.places.append((place, size))
        self.bloom = None

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int):
        """(key, value) of each entry of block k."""
        raw = self._read(*self.places[k])
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        b, at, key = self.unpack(raw[:-4]), 0, b""
        while at < len(b):
            shared, at = read_varint(b, at)
            rest, at = read_varint(b, at)
            size, at = read_varint(b, at)
            key = key[:shared] + b[at : at + rest]
            at += rest
            yield key, b[at : at + size]
            at += size

    def __iter__(self):
        for k in range(len(self.keys)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = np.frombuffer(self._read(self.bloom_at, self.bloom_size), np.uint8)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * self.bloom_size))

    def get(self, key: bytes) -> bytes | None:
        """The value of key, by Bloom filter, binary search of the index and one block."""
        k = bisect_right(self.keys, key) - 1
        if k < 0 or not self.may_hold(key):
            return None
        return next((v for x, v in self.block(k) if x == key), None)
