"""Words and their hashes for many texts at once, in numpy: what tasks of several operators do to a batch of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of text hashed in one go; a longer single text is hashed alone.
CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
VALUES = np.random.RandomState(11).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: The C library's call that returns freed memory, where it has one.
MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64, to the powers below n. Only those of a chunk are kept; a longer word's are not."""

    def made(size: int, base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    inverse = pow(BASE, -1, 1 << 64)
    if n > CHUNK + 1024:
        return made(n, BASE), made(n, inverse)
    if not _powers:
        _powers["up"], _powers["down"] = made(CHUNK + 1024, BASE), made(CHUNK + 1024, inverse)
    return _powers["up"][:n], _powers["down"][:n]


def trim() -> None:
    """Give freed memory back to the system, as Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    if MALLOC_TRIM is not None:
        MALLOC_TRIM(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: Sequence[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as UTF-8) with about `most` bytes each; null is empty."""
    held: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        if held and size + len(b) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, a space after each text, and where each text starts (one start more for the end)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buf, starts


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal non-zero values."""
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], edge)) if len(kind) else edge
    ends = np.concatenate((edge, [len(kind)])) if len(kind) else edge
    real = kind[starts] != 0
    return starts[real], ends[real]


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment of buf, by its bytes alone; segments of about CHUNK bytes in one go."""
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
        part = buf[lo : int(ends[b - 1])]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUES[part] * up[:-1], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def lower_ascii(texts: list[bytes]) -> list[bytes]:
    """A-Z to a-z, all other bytes as they are."""
    return [t.lower() for t in texts]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `width`-word shingles, words lower-cased in A-Z.

    A text of fewer words is one shingle of all its words; without words the set is empty.
    """
    buf, at = lay_out(lower_ascii(texts))
    starts, ends = runs((~IS_SPACE[buf]).astype(np.int8))
    words = segment_hashes(buf, starts, ends)
    first = np.searchsorted(starts, at)  # the first word of each text
    shingles = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        shingles = mix(shingles * np.uint64(BASE) + words[k : k + len(shingles)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(shingles[a : b - width + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = mix(h * np.uint64(BASE) + words[k : k + 1])
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
