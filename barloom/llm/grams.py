"""Hashes of runs of words in UTF-8 texts.

A word is hashed by 128-bit xxh3 over its bytes. A run's hash has two halves of 64 bits: each adds up its words' halves times a random
odd number for each place (multilinear hashing), so nothing in how words follow one another can make different runs meet more often
than chance does: among 10**13 different runs, two of equal hash are met with a probability of about 10**-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

U = np.uint64
#: The longest runs that callers ask for.
MOST_WORDS = 256
_PLACES = np.random.default_rng(81).integers(0, 1 << 63, (2, MOST_WORDS + 1), dtype=np.int64).astype(U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that only a few texts at a time are Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def run_hashes(text: bytes, k: int, whole_if_short: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words (anything but space and the controls 9 to 13), and both halves of the hashes of a text's runs of k words in order.

    A text of fewer words has no run, or with whole_if_short one run of all its words if it has any.
    """
    words = text.split()
    n = len(words)
    size = k if n >= k else n if whole_if_short else 0
    if not size:
        return n, np.empty(0, U), np.empty(0, U)
    each = np.frombuffer(b"".join(map(xxh3_128_digest, words)), U).reshape(-1, 2)
    halves = []
    for half, place in enumerate(_PLACES):
        word = np.ascontiguousarray(each[:, half])
        total, term = np.full(n - size + 1, size, U) * place[MOST_WORDS], np.empty(n - size + 1, U)
        for i in range(size):
            np.multiply(word[i : i + len(total)], place[i], out=term)
            total += term
        halves.append(mix(total))
    return n, halves[0], halves[1]
