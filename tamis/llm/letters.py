"""Texts of a batch as numpy arrays of code points."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np

#: Characters laid out at once; one longer text is laid out alone.
CHUNK = 1 << 18
SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], np.uint32)

_letters: list[np.ndarray] = []


def is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0][codes]


def layouts(texts: list[str | None]) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(numbers of the texts, code points of all, where each begins with the end of the last); a line feed ends each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") < CHUNK):
            size += len(texts[end] or "")
            end += 1
        part = [(t or "") + "\n" for t in texts[at:end]]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "replace"), np.uint32)
        starts = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(t) for t in part], out=starts[1:])
        yield range(at, end), codes, starts
        at = end


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(mask.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
