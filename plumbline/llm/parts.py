"""Cutting texts where no token crosses, so that each distinct part is looked at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .tables import text_bytes

#: Bytes of text that are cut at a time; a longer text is cut alone.
TEXT_BYTES = 8 << 20


def slices(column: pa.Array, most: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most so many bytes, or of one row."""
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def _ends_in_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte before each place is white space, a control, or may be the last of a Unicode space."""
    last, before = data[at - 1], data[np.maximum(at - 2, 0)]
    space = last <= 0x20
    space |= (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
    space |= (before == 0x80) & (((last >= 0x80) & (last <= 0x8A)) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF) | (last == 0x80))
    return space | ((before == 0x9A) & (last == 0x80)) | ((before == 0x81) & (last == 0x9F))


#: ASCII marks that the byte-level pattern never puts into one token with a letter or number before them; the bar is in special tokens.
_MARKS = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"))
_ALPHANUMERIC = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


def cut(data: np.ndarray, offsets: np.ndarray, marks: bytes = b" \n", stems: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the parts of texts, and the number of parts before each text (n+1).

    A part begins at the start of a text and at any of the marks that follows
    something else than white space, so the byte-level pattern, whose tokens
    have white space at their start only, gives each part the tokens that it
    has in its text. stems: punctuation after a Latin letter or a digit begins a
    part too. Parts cover the bytes without gaps.
    """
    chosen = np.zeros(len(data) + 1, bool)
    if len(data):
        found = np.zeros(len(data), bool)
        for mark in marks:
            found |= data == mark
        at = np.flatnonzero(found)
        at = at[at > 0]
        chosen[at[~_ends_in_space(data, at)]] = True
        if stems:
            at = np.flatnonzero(_MARKS[data])
            at = at[at > 0]
            last = data[at - 1]
            chosen[at[_ALPHANUMERIC[last] | ((data[np.maximum(at - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))]] = True
    chosen[offsets] = True
    borders = np.flatnonzero(chosen)
    return borders, np.searchsorted(borders, offsets)


def distinct(data: np.ndarray, borders: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct parts and each part's place among them."""
    if len(borders) < 2:
        return [], np.empty(0, np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def joined(lists: list[np.ndarray] | list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Lists as one array and the n+1 places where they start."""
    lists = [x if isinstance(x, bytes) else x.tobytes() for x in lists]
    flat = np.frombuffer(b"".join(lists), dtype)
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) // flat.itemsize for x in lists], out=starts[1:])
    return flat, starts


def gather(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that are asked for, one after the other, and the n+1 places where they start."""
    sizes = starts[which + 1] - starts[which]
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    places = np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], sizes)
    return flat[places], ends
