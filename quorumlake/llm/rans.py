"""Frames of token ids: static range asymmetric numeral systems over numpy arrays.

A frame is self-contained. It holds one frequency table, shared by all its
blocks, and the blocks, each coded by itself in ``LANES`` interleaved lanes
(id i of a block belongs to lane i mod ``LANES``). Every ``STEPS`` ids of a
lane there is a checkpoint: the lanes' states and the place in the block's
words, so that decoding can begin there. Layout, little-endian:

    "QLR1", bits u8, 3 bytes 0, ids u64, symbols u32, blocks u32, segments u32, table's bytes u32
    the table, deflated: steps between symbols u32[symbols], frequencies u32[symbols] (they sum to 2**bits)
    per block: ids u32, words u32, crc32 of its ids as u32 u32, crc32 of its states and words u32
    per segment, block by block: first word u32; then all segments' states u64[LANES]
    all blocks' words u32
    crc32 of everything before u32

Any damage raises ValueError. A frame of no ids is valid.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"QLR1"
HEAD = struct.Struct("<4sB3xQIIII")
LANES, BLOCK, STEPS = 64, 1 << 16, 256
#: A state lies in [LOW, 2**64) between symbols; 32 bits move at a time.
LOW = np.uint64(1 << 32)
WORD = np.uint64(32)
SEGMENT = LANES * STEPS


def frequencies(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of 1 or more in proportion to ``counts`` (all positive), and the power of two they sum to."""
    bits = min(24, max(12, int(8 * len(counts) - 1).bit_length()))
    if not len(counts):
        return np.zeros(0, dtype=np.uint32), bits
    size = 1 << bits
    if len(counts) > size:
        raise ValueError("more symbols than a frame's table has room for")
    exact = counts.astype(np.float64) * ((size - len(counts)) / counts.sum())
    out = 1 + np.floor(exact).astype(np.int64)
    short = size - int(out.sum())
    out[np.argsort(np.floor(exact) - exact, kind="stable")[:short]] += 1  # largest remainders first
    return out.astype(np.uint32), bits


def _starts(freq: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(freq.astype(np.uint64))[:-1])).astype(np.uint64) if len(freq) else np.zeros(0, dtype=np.uint64)


def _coded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids in order, the place of each id among them, and their counts."""
    if not len(ids) or ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), dtype=np.int32)
    place[symbols] = np.arange(len(symbols), dtype=np.int32)
    return symbols, place[ids], counts[symbols]


def pack(ids: np.ndarray) -> bytes:
    """A frame of ``ids``."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    symbols, codes, counts = _coded(ids)
    freq, bits = frequencies(counts)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    rows = -(-min(n, BLOCK) // LANES)
    # one row of lanes per step; places beyond the last id are not coded
    padded = np.zeros(blocks * BLOCK, dtype=np.int32)
    padded[:n] = codes.reshape(-1)
    table = padded.reshape(blocks, BLOCK // LANES, LANES)
    wide, first, shift = freq.astype(np.uint64), _starts(freq), np.uint64(bits)
    full_shift = np.uint64(64 - bits)
    state = np.full((blocks, LANES), LOW)
    left = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    lane = np.arange(LANES)
    written = np.zeros(blocks, dtype=np.int64)
    words, owners, marks, states = [], [], {}, {}
    for step in range(rows - 1, -1, -1):
        here = left[:, None] > step * LANES + lane
        code = table[:, step]
        f = wide[code]
        out = here & ((state >> full_shift) >= f)
        block, _ = np.nonzero(out)
        words.append((state[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        owners.append(block)
        written += np.bincount(block, minlength=blocks)
        x = np.where(out, state >> WORD, state)
        whole = x // f
        coded = (whole << shift) + (x - whole * f) + first[code]
        state = np.where(here, coded, state)
        if step % STEPS == 0:
            marks[step // STEPS], states[step // STEPS] = written.copy(), state.copy()
    segments = -(-left // SEGMENT)
    word = np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)
    owner = np.concatenate(owners[::-1]) if owners else np.zeros(0, dtype=np.int64)
    word = word[np.argsort(owner, kind="stable")]
    ends = np.cumsum(written)
    block_rows, segment_rows, segment_states = [], [], []
    for b in range(blocks):
        places = [int(written[b] - marks[s][b]) for s in range(segments[b])]
        kept = np.stack([states[s][b] for s in range(segments[b])]).astype("<u8")
        own = word[ends[b] - written[b] : ends[b]].astype("<u4")
        check = zlib.crc32(own.tobytes(), zlib.crc32(kept.tobytes()))
        block_rows.append((int(left[b]), len(own), zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].tobytes()), check))
        segment_rows += places
        segment_states.append(kept)
    shared = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes())
    body = b"".join(
        (
            HEAD.pack(MAGIC, bits, n, len(symbols), blocks, len(segment_rows), len(shared)),
            shared,
            np.array(block_rows, dtype="<u4").tobytes(),
            np.array(segment_rows, dtype="<u4").tobytes(),
            *(s.tobytes() for s in segment_states),
            word.astype("<u4").tobytes(),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Frame:
    """A frame opened for reading; ``ids`` decodes all of it, or only what a range of ids needs."""

    def __init__(self, data: bytes) -> None:
        if len(data) < HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a frame of ids is damaged")
        magic, self.bits, self.n, symbols, blocks, segments, size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("this is no frame of ids")
        shared = np.frombuffer(zlib.decompress(data[HEAD.size : HEAD.size + size]), dtype="<u4")
        self.symbols, self.freq = np.cumsum(shared[:symbols], dtype=np.uint32), shared[symbols:]
        at = HEAD.size + size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.blocks = take("<u4", 4 * blocks).reshape(blocks, 4)
        self.first_word, self.states = take("<u4", segments), take("<u8", segments * LANES).reshape(segments, LANES)
        self.words = take("<u4", (len(data) - 4 - at) // 4)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from ``start`` to before ``end``; decoding begins at the checkpoint before ``start``, all checkpoints side by side."""
        end = self.n if end is None else min(end, self.n)
        if start >= end:
            return np.zeros(0, dtype=np.uint32)
        low, high = start // SEGMENT, -(-end // SEGMENT)  # BLOCK is a multiple of SEGMENT, so segments are dealt evenly
        per = BLOCK // SEGMENT
        size = np.minimum(SEGMENT, self.n - SEGMENT * np.arange(low, high))
        word_base = np.concatenate(([0], np.cumsum(self.blocks[:, 1].astype(np.int64))))
        place = word_base[np.arange(low, high) // per] + self.first_word[low:high]
        state = self.states[low:high].astype(np.uint64)
        which = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) < 1 << 16 else np.uint32), self.freq)
        wide, first = self.freq.astype(np.uint64), _starts(self.freq)
        mask, shift, lane = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.arange(LANES)
        words = np.append(self.words, np.uint32(0)).astype(np.uint64)
        steps = -(-int(size.max()) // LANES)
        out = np.zeros((high - low, STEPS, LANES), dtype=which.dtype)
        for step in range(steps):
            here = size[:, None] > step * LANES + lane
            slot = state & mask
            code = which[slot]
            x = wide[code] * (state >> shift) + slot - first[code]
            need = here & (x < LOW)
            row = np.cumsum(need, axis=1)
            at = np.where(need, place[:, None] + row - 1, len(self.words))
            if at.min() < 0 or at.max() > len(self.words):
                raise ValueError("a frame of ids is damaged")
            x = np.where(need, (x << WORD) | words[at], x)
            place += row[:, -1]
            state = np.where(here, x, state)
            out[:, step] = code
        got = self.symbols[out.reshape(-1)[: (high - low) * SEGMENT]]
        got = got[: min(len(got), self.n - low * SEGMENT)].astype("<u4")
        for b in range(-(-low * SEGMENT // BLOCK), high * SEGMENT // BLOCK if high * SEGMENT < self.n else len(self.blocks)):
            own = got[b * BLOCK - low * SEGMENT : b * BLOCK - low * SEGMENT + int(self.blocks[b, 0])]
            if zlib.crc32(own.tobytes()) != self.blocks[b, 2]:
                raise ValueError("decoded ids differ from those that were coded")
        return got[start - low * SEGMENT : end - low * SEGMENT]
