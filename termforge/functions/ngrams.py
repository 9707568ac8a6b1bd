"""Character n-grams of many texts at once, as whole numbers; runs in tasks on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters that are worked on at once, some 30 bytes each; a text is never cut.
BLOCK = 8_000_000
#: Whole numbers below this are told apart by a table, larger ones by sorting.
TABLE = 1 << 25


def decoded(column: pa.Array) -> list[str]:
    """Texts of a column; null is empty, and bytes that are no UTF-8 are replacement characters."""
    return [b.decode("utf-8", "replace") if b else "" for b in column.cast(pa.binary()).to_pylist()]


def distinct(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ``keys`` (from 0, below ``size``), ascending, and the place among them of every key."""
    if size > TABLE:
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(size, dtype=bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[keys]


class Windows:
    """All windows of ``n`` characters of ``texts``, in order; none reaches into the next text.

    ``places`` has a number for each window, the same for equal grams and below ``size``; ``per_text`` has the windows of each text.
    """

    def __init__(self, texts: list[str], n: int):
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        self.n, self.per_text = n, np.maximum(lengths - n + 1, 0)
        inside = np.ones(len(points), dtype=bool)
        ends = np.cumsum(lengths)
        for k in range(1, n):
            inside[np.maximum(ends[ends > 0] - k, 0)] = False
        self.letters, codes = distinct(points, 0x110000)
        self.places, self.size, self._steps = codes, len(self.letters), []
        for k in range(1, n):  # a gram is the place of its first characters and one more
            size = self.size * len(self.letters)
            keys = self.places[:-1].astype(np.int32 if size < 1 << 31 else np.int64) * len(self.letters) + codes[k:]
            if k == n - 1:
                keys = keys[inside[: len(keys)]]
            step, self.places = distinct(keys, size)
            self._steps.append(step)
            self.size = len(step)

    def grams(self, places: np.ndarray) -> list[str]:
        """The grams of some places."""
        points = np.empty((len(places), self.n), dtype=np.uint32)
        for k in range(self.n - 1, 0, -1):
            keys = self._steps[k - 1][places]
            points[:, k] = self.letters[keys % len(self.letters)]
            places = keys // len(self.letters)
        points[:, 0] = self.letters[places]
        text = points.tobytes().decode("utf-32-le")
        return [text[i : i + self.n] for i in range(0, len(text), self.n)]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(keys, texts) of batches with a key and a text, about BLOCK characters at a time."""
    keys, texts, held = [], [], 0
    for batch in batches:
        first = 0
        for i, text in enumerate(found := decoded(batch.column(1))):
            held += len(text)
            if held >= BLOCK:
                yield pa.concat_arrays([*keys, batch.column(0)[first : i + 1]]), texts + found[first : i + 1]
                keys, texts, held, first = [], [], 0, i + 1
        keys.append(batch.column(0)[first:])
        texts += found[first:]
    if texts:
        yield pa.concat_arrays(keys), texts


def counted(keys: pa.Array, texts: list[str], n: int) -> tuple[pa.Array, list[str], np.ndarray]:
    """Keys, grams and their numbers: how often the texts of a key hold a gram."""
    by = keys.dictionary_encode("encode")
    w = Windows(texts, n)
    owner = np.repeat(by.indices.to_numpy(), w.per_text)
    pairs, place = distinct(w.places.astype(np.int64) * len(by.dictionary) + owner, w.size * len(by.dictionary))
    return by.dictionary.take(pa.array(pairs % len(by.dictionary))), w.grams(pairs // len(by.dictionary)), np.bincount(place, minlength=len(pairs))
