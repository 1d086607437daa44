"""Words of texts by Arrow kernels, for operators that count or look up words inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are split into words in pieces of about so many bytes (or of one text), which bounds a task's memory.
PIECE_BYTES = 4 << 20


@dataclass(frozen=True)
class Words:
    """The words of some texts in order: text ``i`` has the ``codes`` from ``ends[i]`` to ``ends[i + 1]``, numbers of ``distinct``."""

    ends: np.ndarray
    codes: np.ndarray
    distinct: pa.Array

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.ends) - 1), self.sizes)


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each; a longer text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def split_words(texts: pa.Array, split: Callable[[pa.Array], pa.Array]) -> Words:
    """The non-empty parts that ``split`` (from texts to lists of strings) makes of each text; null has none."""
    lists = split(pc.fill_null(texts, ""))
    flat = pc.list_flatten(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    encoded = pc.dictionary_encode(pc.filter(flat, some))
    kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return Words(kept[ends], encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary)


def sums_by_text(values: np.ndarray, words_ends: np.ndarray) -> np.ndarray:
    """Sums of each text's values, 0 for a text without any."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[words_ends[1:]] - total[words_ends[:-1]]
