"""Word splitting and 64-bit hashing shared by the text operators.

All functions take bytes (UTF-8), so "code point class" regexes on ASCII become
byte translations: bytes of multi-byte characters are never ASCII.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

xxh64 = xxhash.xxh3_64_intdigest

#: A-Z to a-z, every other ASCII byte that is no letter or digit to a space.
ALNUM = bytes(
    (b + 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_C = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_CINV = pow(_C, -1, 1 << 64)
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


#: Powers kept from one text to the next; a longer text makes its own.
_KEPT = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """c^i and c^-i modulo 2^64 for i < n, grown on demand."""
    global _POW, _INV
    power, inverse = _POW, _INV
    while len(power) < n:
        m = len(power)
        step, back = np.uint64(pow(_C, m, 1 << 64)), np.uint64(pow(_CINV, m, 1 << 64))
        power, inverse = np.concatenate([power, power * step]), np.concatenate([inverse, inverse * back])
        if len(power) <= _KEPT:
            _POW, _INV = power, inverse
    return power[:n], inverse[:n]


# ---- bounded steps of Arrow functions ------------------------------------------------------

#: Bytes of text that one step of a text function takes on.
PIECE = 4 << 20


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of every value of a string or binary column; null has none."""
    return pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], *text: int, most: int = PIECE, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in the columns ``text`` and at most ``rows`` rows, one row at least."""
    for batch in batches:
        n, start = batch.num_rows, 0
        ends = np.cumsum(sum(sizes(batch.column(c)) for c in text) if n else np.empty(0, np.int64))
        while start < n:
            before = int(ends[start - 1]) if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, before + most, side="right"))), start + rows, n)
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Hand free memory of this worker back to the system, which else keeps the peak of every task for life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


_TABLES: dict[str, object] = {}


def worker_table(name: str, make: Callable[[], object]) -> object:
    """An object that a worker keeps from task to task, until it is given another kind of work."""
    if name not in _TABLES:
        _TABLES[name] = make()
    return _TABLES[name]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = ""):
    """The Arrow function, with memory given back when a task's last batch is through.

    Tables that the worker kept for other work than ``keeps`` go first.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [x for x in _TABLES if x != keeps]:
            del _TABLES[name]
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have."""
    return [f"{stem}_{uuid4().hex}" for stem in stems]


# ---- words and hashes ----------------------------------------------------------------------


def space_words(text: bytes) -> list[bytes]:
    """Maximal runs without 0x20 and 0x09-0x0D."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and non-ASCII characters."""
    return text.translate(ALNUM).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (empty when there are fewer)."""
    n = len(hashes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    power, inverse = _powers(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(hashes * power, out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: n - k + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a lower-cased text.

    With fewer than k words the whole sequence is the only shingle; null or
    wordless texts have none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(k, len(words))))
