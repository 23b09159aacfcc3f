"""Fixed-width packing of token ids, and a file format over it.

A file holds whole documents one after another:

    bytes 0-3    b"TIDS"
    u16          version (1)
    u16          bits per id
    u32          ids per block
    u64          ids
    u64          documents
    u64 x blocks byte offset of each block, from the start of the payload
    u64 x docs   end of each document, in ids
    i64 x docs   doc_id
    u8  x docs   1 where doc_id is null
    payload      the ids, ``bits`` each, lowest bit first, blocks byte-aligned

All integers are little-endian. Eight ids fill exactly ``bits`` bytes, so packing
and unpacking are a few vector operations for each of the eight places, for
any width, and any block can be read alone.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TIDS"
VERSION = 1
BLOCK_IDS = 4096
HEAD = struct.Struct("<4sHHIQQ")


def width(vocab_size: int) -> int:
    """Fewest bits that hold every id below ``vocab_size``."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    n = len(ids)
    if n and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    v = np.zeros(-(-n // 8) * 8, dtype=np.uint64)
    v[:n] = ids
    v = v.reshape(-1, 8)
    out = np.zeros((len(v), bits), dtype=np.uint8)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        x = v[:, j] << np.uint64(shift)
        for k in range(-(-(bits + shift) // 8)):
            out[:, byte + k] |= (x >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    groups = -(-n // 8)
    raw = np.zeros(groups * bits, dtype=np.uint8)
    got = np.frombuffer(data, dtype=np.uint8, count=-(-n * bits // 8))
    raw[: len(got)] = got
    raw = raw.reshape(groups, bits)
    out = np.empty((groups, 8), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        x = raw[:, byte].astype(np.uint64)
        for k in range(1, -(-(bits + shift) // 8)):
            x |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (x >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


def encode_file(ids: np.ndarray, ends: np.ndarray, doc_ids: list[int | None], bits: int, block: int = BLOCK_IDS) -> bytes:
    if block % 8:
        raise ValueError("ids per block: a multiple of 8")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0] + [len(b) for b in blocks[:-1]], dtype="<u8") if blocks else np.zeros(0, "<u8")
    return b"".join(
        [
            HEAD.pack(MAGIC, VERSION, bits, block, len(ids), len(doc_ids)),
            offsets.tobytes(),
            np.asarray(ends, dtype="<u8").tobytes(),
            np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
            np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
            *blocks,
        ]
    )


class TokenFile:
    """Reader of one file's bytes, with random access by id and by document."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, self.n_ids, self.n_docs = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at, n = HEAD.size, -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n, at)
        at += 8 * n
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        null = np.frombuffer(data, np.uint8, self.n_docs, at)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.payload = memoryview(data)[at + self.n_docs :]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop``, reading only the blocks that hold them."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.payload[int(self.offsets[b]) :], n, self.bits))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))
