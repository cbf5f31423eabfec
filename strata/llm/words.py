"""Words of texts as Arrow arrays, a window of bytes at a time.

Only A-Z are lower-cased. Nothing is remembered from one window to the next; a window ends
at white space, which is no part of a word of either class, or at another text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from strata.llm.bpe import LOWER, stretches, text_buffers, window_end

BYTES = np.arange(256)
LETTER = (BYTES >= 97) & (BYTES <= 122)
SOLID = LETTER | (BYTES >= 48) & (BYTES <= 57) | (BYTES >= 128)


def letters_and_digits(low: np.ndarray) -> np.ndarray:
    """Which bytes are of words: letters, digits, and all characters beyond ASCII."""
    return SOLID[low]


def letters(low: np.ndarray) -> np.ndarray:
    """Which bytes are of words: ASCII letters and the characters U+00C0 to U+00FF."""
    out = LETTER[low]
    lead = np.flatnonzero(low[:-1] == 0xC3)
    out[lead] = out[lead + 1] = True
    return out


def words(texts: pa.Array, solid_of: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Window by window the words in order (large_binary) and the place in texts of the one each is of."""
    data, begins = text_buffers(texts)
    here = 0
    while here < len(data):
        end = window_end(data, begins, here)
        low = LOWER[data[here:end]]
        solid = solid_of(low)
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        own = begins[np.searchsorted(begins, here) : np.searchsorted(begins, end)] - here
        start[own] = solid[own]
        yield stretches(low, solid, start), np.searchsorted(begins, np.flatnonzero(start) + here, "right") - 1
        here = end
