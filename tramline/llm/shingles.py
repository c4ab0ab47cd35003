"""Hashed words and word shingles of whole texts, computed on arrays.

Words are runs of characters other than the six ASCII white-space characters, with A-Z lowered. A
text's set holds its distinct shingles of ``size`` words; a text with fewer words has its whole
sequence as one shingle, and a text without words the empty set. Hashes have 64 bits.
"""

import numpy as np

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x):
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they have been needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n):
        if n > len(self.up):
            size = max(n, 1 << 16)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = np.full(size, _BASE), np.full(size, inverse)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def chunks(texts, limit=CHUNK_BYTES):
    """Groups of consecutive texts, as bytes, of about ``limit`` bytes; a longer text is alone."""
    group, size = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text or b"")
        if group and size + len(data) > limit:
            yield group
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield group


def words(group):
    """Hashes of all words of a group of texts, and the number of words of each text."""
    data = _LOWER[np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)]
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    up, down = _POWERS.upto(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in group])
    return hashes, np.diff(np.searchsorted(begins, bounds), prepend=0)


def shingle_sets(texts, size=5):
    """The sorted distinct shingle hashes of each text, in order."""
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    for group in chunks(texts):
        hashes, counts = words(group)
        n = max(0, len(hashes) - size + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            rolled += hashes[k : k + n] * factors[k]
        rolled = mix(rolled)
        at = 0
        for count in counts.tolist():
            if count >= size:
                yield np.unique(rolled[at : at + count - size + 1])
            elif count:
                short = (hashes[at : at + count] * factors[:count]).sum(dtype=np.uint64)
                yield mix(np.array([short + np.uint64(count)], dtype=np.uint64))
            else:
                yield np.empty(0, dtype=np.uint64)
            at += count
