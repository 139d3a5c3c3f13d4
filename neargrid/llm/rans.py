"""Token-ID output by a static range asymmetric numeral system (rANS).

The file format is a table of blocks. A block holds whole documents in ascending doc_id order and can be read alone,
given the frequency table that all blocks of a data set share:

    magic "rB1\\0", lanes u32, documents u32, ids u64, steps between checkpoints u32, checkpoints u32, crc32 of the rest u32
    lengths of the documents, u32 each
    for each checkpoint: number of 32-bit words read before it u64, then the states of all lanes u64
    words u32

Id i of a block belongs to lane i % lanes. Lanes have 63-bit states and put out 32-bit words; at every step, the lanes
that need a word read one each, in the order of lanes. A checkpoint holds all that decoding needs to begin at its step,
so all parts between checkpoints are decoded at once, as so many more lanes.

The table has 2**20 slots. Every id that occurs has one slot at least; it is made from the counts of all ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
LOW = np.uint64(1 << 31)
MAGIC = b"rB1\0"
_HEAD = struct.Struct("<4sIIQIII")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Slots (sum 2**BITS) of each id from its count; 0 where the count is 0."""
    total = int(counts.sum())
    out = np.zeros(len(counts), dtype=np.int64)
    if not total:
        return out
    seen = counts > 0
    out[seen] = np.maximum(1, np.floor(counts[seen] * ((1 << BITS) / total))).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    rest = (1 << BITS) - int(out.sum())
    if rest > 0:
        out[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        take = min(-rest, int(out[i]) - max(1, int(out[i]) // 2))
        out[i] -= take
        rest += take
    return out


class Coder:
    """Encoder and decoder of blocks over one frequency table (at most 65,536 ids)."""

    def __init__(self, freqs: np.ndarray, lanes: int = 4096, every: int = 128):
        self.freq = freqs.astype(np.uint64)
        self.start = (np.cumsum(freqs) - freqs).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freqs), dtype=np.uint16), freqs)
        self.lanes, self.every = lanes, every

    def encode(self, ids: np.ndarray, lengths: np.ndarray) -> bytes:
        lanes, n = self.lanes, len(ids)
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        put = 0
        shift, up = np.uint64(63 - BITS), np.uint64(BITS)
        for t in range(steps - 1, -1, -1):
            some = ids[t * lanes : (t + 1) * lanes]
            x, f = state[: len(some)], self.freq[some]
            over = x >= (f << shift)
            if over.any():
                words.append((x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                put += len(words[-1])
                x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            state[: len(some)] = (q << up) + (x - q * f) + self.start[some]
            if t % self.every == 0:
                marks.append((put, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)
        body = [lengths.astype("<u4").tobytes()]
        for at, states in marks[::-1]:
            body += [struct.pack("<Q", put - at), states.astype("<u8").tobytes()]
        rest = b"".join([*body, stream.astype("<u4").tobytes()])
        return _HEAD.pack(MAGIC, lanes, len(lengths), n, self.every, len(marks), zlib.crc32(rest)) + rest

    def decode(self, block: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block and the lengths of its documents. A damaged block raises ValueError."""
        magic, lanes, docs, n, every, marks, crc = _HEAD.unpack_from(block)
        if magic != MAGIC or zlib.crc32(memoryview(block)[_HEAD.size :]) != crc:
            raise ValueError("damaged block")
        at = _HEAD.size
        lengths = np.frombuffer(block, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        table = np.frombuffer(block, np.dtype([("read", "<u8"), ("state", "<u8", (lanes,))]), marks, at)
        words = np.frombuffer(block, "<u4", -1, at + table.nbytes).astype(np.uint64)
        words = np.append(words, np.uint64(0))
        state = table["state"].astype(np.uint64)
        read = table["read"].astype(np.int64)
        out = np.zeros((marks, every, lanes), dtype=np.uint16)
        low, mask, up = LOW, np.uint64((1 << BITS) - 1), np.uint64(BITS)
        left = n - np.arange(marks) * every * lanes
        for t in range(min(every, -(-n // lanes) if n else 0)):
            live = left - t * lanes  # ids at this step and after it, for each part
            slot = state & mask
            ids = self.slots[slot.astype(np.int64)]
            x = self.freq[ids] * (state >> up) + slot - self.start[ids]
            on = np.arange(lanes)[None, :] < live[:, None]
            need = (x < low) & on
            where = np.minimum(read[:, None] + np.cumsum(need, axis=1) - 1, len(words) - 1)
            x = np.where(need, (x << np.uint64(32)) | words[where], x)
            state = np.where(on, x, state)
            read = read + need.sum(axis=1)
            out[:, t] = ids
        return out.reshape(-1)[:n], lengths
