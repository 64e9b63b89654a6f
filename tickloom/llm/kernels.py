"""Words and their hashes for whole Arrow batches of texts, by numpy.

Used inside Python workers. A-Z is lowered, words end at ASCII white space.
Texts are handled in chunks of bounded size, so memory does not follow the
batch; a single text longer than a chunk is a chunk of its own.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
FIRST, SECOND = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)  # fixed values of the splitmix64 finaliser


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return lower, space


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * FIRST
    x = (x ^ (x >> U(27))) * SECOND
    return x ^ (x >> U(31))


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending powers of the base and of its inverse, modulo 2**64."""
    inverse = U(pow(int(BASE), -1, 1 << 64))
    ones = np.ones(count, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = BASE, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of some texts: ``data[starts[i]:ends[i]]``; text t has words ``bounds[t]`` to ``bounds[t + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tables):
        lower, space = tables
        self.data = lower[data]
        self.offsets = offsets
        solid = ~space[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        stops = solid.copy()
        stops[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, tables) -> np.ndarray:
        """64-bit hashes of the words."""
        up, down = tables
        if len(up) < len(self.data) + 1:
            up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + U(1)) * up[:len(self.data)], out=total[1:])
        value = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mixed(value ^ (self.ends - self.starts).astype(np.uint64) * SECOND)

    def of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))


def chunked(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of consecutive texts of about ``limit`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(texts))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def shingles(found: Words, hashes: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``width`` words; of fewer words, of them all."""
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64))
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += hashes[k:k + len(rolled)] * factors[k]
    rolled = mixed(rolled ^ U(width))
    for low, high in zip(found.bounds[:-1], found.bounds[1:], strict=True):
        if high - low >= width:
            yield np.unique(rolled[low:high - width + 1])
        elif high > low:
            short = (hashes[low:high] * factors[:high - low]).sum(dtype=np.uint64)
            yield mixed(np.array([short ^ U(high - low)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
