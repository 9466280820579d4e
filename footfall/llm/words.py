"""Word hashes of whole batches of texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Bytes of text hashed at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

# ASCII letters and digits and all bytes of characters outside ASCII.
WORD_BYTES = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


@lru_cache(4)
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def mix(hashes: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes."""
    hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ hashes >> np.uint64(29)


def word_hashes(buffer: bytes, word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start, the end and a 64-bit hash of each maximal run of word bytes in the buffer.

    Hashes are differences of prefix sums of a polynomial modulo 2**64, so equal words have equal hashes
    wherever they stand.
    """
    inside = word_bytes[np.frombuffer(buffer, np.uint8)]
    found, at = [], 0
    while at < len(buffer) or not found:
        end = len(buffer)
        if end - at > BLOCK_BYTES:  # long texts are cut between words
            gaps = np.flatnonzero(~inside[at : at + BLOCK_BYTES])
            end = at + int(gaps[-1]) + 1 if len(gaps) else _next_gap(inside, at + BLOCK_BYTES)
        found.append(_block_hashes(np.frombuffer(buffer[at:end], np.uint8), inside[at:end], at))
        at = max(end, at + 1)
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found))
    return starts, ends, hashes


def _next_gap(inside: np.ndarray, at: int) -> int:
    gap = int(inside[at:].argmin())
    return at + gap if not inside[at + gap] else len(inside)


def _block_hashes(data: np.ndarray, inside: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = 1 << max(10, (len(data) - 1).bit_length())
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, size)[starts]
    return starts + offset, ends + offset, mix(hashes)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words (none if there are fewer)."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        total = total * np.uint64(_BASE) + hashes[i : len(hashes) - width + 1 + i]
    return mix(total)


def blocks(texts: list[bytes]):
    """Runs of texts of about BLOCK_BYTES: (first, last + 1)."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)
