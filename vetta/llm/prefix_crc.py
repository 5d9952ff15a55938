"""CRC-32 of every n-gram of a batch of texts from one scan.

A text is separator-normalised (words joined by one blank) and scanned once; the register
after every byte is stored. The register is linear over GF(2), so that of a substring is
the register at its end XOR that at its start shifted over the substring's length: feeding
L zero bytes is a fixed linear map for each L, applied by the binary digits of L.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
LANES = 4096                            # how many pieces of a batch are scanned side by side

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)           # bytes of a word: 0-9, a-z (A-Z once lower-cased), non-ASCII
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _byte_table() -> np.ndarray:
    reg = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        reg = np.where(reg & np.uint32(1), (reg >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), reg >> np.uint32(1))
    return reg


BYTE = _byte_table()


def _apply(maps: np.ndarray, reg: np.ndarray) -> np.ndarray:
    """The linear map given by ``maps`` (4, 256), one table for each byte of the register."""
    return maps[0][reg & np.uint32(255)] ^ maps[1][(reg >> np.uint32(8)) & np.uint32(255)] \
        ^ maps[2][(reg >> np.uint32(16)) & np.uint32(255)] ^ maps[3][reg >> np.uint32(24)]


_UNIT = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]


def _zero_maps() -> list[np.ndarray]:
    """Element p: the map of feeding 2^p zero bytes."""
    out = [BYTE[_UNIT & np.uint32(255)] ^ (_UNIT >> np.uint32(8))]
    for _ in range(31):
        out.append(_apply(out[-1], out[-1]))
    return out


ZEROS = _zero_maps()


def shift(reg: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Every register after ``length`` zero bytes."""
    reg = reg.copy()
    for p in range(int(length.max()).bit_length() if len(length) else 0):
        at = np.flatnonzero((length >> p) & 1)
        reg[at] = _apply(ZEROS[p], reg[at])
    return reg


def running(data: np.ndarray) -> np.ndarray:
    """The register (from zero, nothing inverted) before the first and after every byte.

    The bytes are scanned once, as up to ``LANES`` pieces side by side, each from zero; by
    linearity what the pieces before add is then the zero-byte run of the register there."""
    n = len(data)
    width = max(64, -(-n // LANES))
    lanes = max(1, -(-n // width))
    padded = np.zeros(lanes * width, np.uint8)
    padded[:n] = data
    columns = np.ascontiguousarray(padded.reshape(lanes, width).T)
    out = np.empty((width, lanes), np.uint32)
    reg = np.zeros(lanes, np.uint32)
    for c in range(width):
        reg = BYTE[(reg ^ columns[c]) & np.uint32(255)] ^ (reg >> np.uint32(8))
        out[c] = reg
    upto, hop = out[-1].copy(), 1                       # of the pieces so far, by doubling
    maps = shift(_UNIT.reshape(-1), np.full(_UNIT.size, width)).reshape(4, 256)
    while hop < lanes:
        upto[hop:] ^= _apply(maps, upto[:-hop])
        maps, hop = _apply(maps, maps), 2 * hop
    heads = np.concatenate([np.zeros(1, np.uint32), upto[:-1]])
    for c in range(width):
        heads = BYTE[heads & np.uint32(255)] ^ (heads >> np.uint32(8))
        out[c] ^= heads
    return np.concatenate([np.zeros(1, np.uint32), out.T.reshape(-1)[:n]])


def ngram_crcs(texts: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 .. ``most``: the CRC-32 of the UTF-8 bytes of every run of k words of every
    text, in order, and the offsets of each text in them. Words are runs of the bytes above."""
    parts = [t.encode() for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = _INSIDE[raw]
    after = np.concatenate([[False], inside[:-1]])
    starts_raw = np.flatnonzero(inside & ~after)
    limits = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    offsets = np.searchsorted(starts_raw, limits)
    keep = inside | after                               # a word's bytes and one separator after it
    data = np.where(inside, _LOWER[raw], np.uint8(32))[keep]
    ends = np.flatnonzero(~inside[keep])
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    regs = running(data)
    sizes = np.diff(offsets)
    for k in range(1, most + 1):
        left = np.maximum(sizes - (k - 1), 0)
        own = np.concatenate([[0], np.cumsum(left)])
        first = np.arange(own[-1]) + np.repeat(offsets[:-1] - own[:-1], left)
        a, b = starts[first], ends[first + (k - 1)]
        yield regs[b] ^ shift(regs[a] ^ ONES, b - a) ^ ONES, own
