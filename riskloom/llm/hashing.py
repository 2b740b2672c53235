"""Word and shingle hashes of text batches in numpy, for tasks that run in Arrow batches."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes hashed at once: bounds a task's memory whatever the length of its texts.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, base: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers, from a rule: the counter times the golden ratio, mixed."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(base)) * U64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOOKUP = seeds(256, 1 << 20)


def word_hashes(buffer: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each maximal run of bytes other than ASCII white space in UTF-8 bytes.

    A word's hash is a sum of byte values, each mixed with its place in the word, mixed once more with the length.
    """
    space = _SPACE[buffer]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, U64), starts, ends
    lengths = ends - starts
    inside = ~space
    place = np.arange(len(buffer), dtype=np.int64)[inside] - np.repeat(starts, lengths)
    data = buffer[inside]
    values = mix(_LOOKUP[_LOWER[data] if lower else data] + place.astype(U64) * U64(0x9E3779B97F4A7C15))
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return mix(np.add.reduceat(values, firsts) + lengths.astype(U64)), starts, ends


def slices(batches, rows: int = 1000):
    """The batches in slices of so many rows at most, so that a task holds few texts in more than one form."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(texts: list[bytes]):
    """Yields (index of the first text, bytes of several texts with a line feed between, where each begins and the end).

    Texts are taken together up to CHUNK_BYTES; a longer text makes a chunk of its own.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK_BYTES):
            size += len(texts[end]) + 1
            end += 1
        yield at, np.frombuffer(b"\n".join(texts[at:end]), dtype=np.uint8), np.cumsum([0] + [len(x) + 1 for x in texts[at:end]])
        at = end


def batches_of_words(texts: list[bytes], lower: bool = True):
    """Yields (index of the first text, word hashes of several texts, offsets of each text's words)."""
    for at, buffer, begins in chunks(texts):
        hashes, starts, _ = word_hashes(buffer, lower)
        yield at, hashes, np.searchsorted(starts, begins)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; the whole run if there are fewer words; none of none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = mix(out) + words[k: len(words) - size + 1 + k]
    return mix(out + U64(size))
