"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from talweg.llm.common import code_points

_MULTIPLIER = np.uint32(0x9E3779B1)


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter or a mark that belongs to one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)], bool)


def letters_only(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of other characters become one blank; every text begins with a blank."""
    keep = _letters()[codes]
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    blank = ~keep & (first | np.r_[True, keep[:-1]]) if len(codes) else keep
    chosen = np.flatnonzero(keep | blank)
    symbols = np.where(keep[chosen], codes[chosen], 32).astype(np.uint32)
    at = np.searchsorted(chosen, offsets)
    # A blank before each text, so that first letters count as word beginnings.
    out = np.insert(symbols, at[:-1], 32)
    return out, at + np.arange(len(offsets))


def gram_ids(symbols: np.ndarray, offsets: np.ndarray, size: int, bits: int) -> np.ndarray:
    """For each position the hash in [0, 2**bits) of the n-gram that ends there; 2**bits where a text has no room for it."""
    h = np.zeros(len(symbols), np.uint32)
    for j in range(size - 1, -1, -1):
        h *= np.uint32(0x01000193)
        if j:
            h[j:] += symbols[:-j]
        else:
            h += symbols
    h ^= h >> np.uint32(15)
    h += np.uint32(size)
    h *= _MULTIPLIER
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x85EBCA6B)
    ids = (h >> np.uint32(32 - bits)).astype(np.int32)
    for j in range(size - 1):
        starts = offsets[:-1] + j
        ids[starts[starts < offsets[1:]]] = 1 << bits
    return ids


def lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return code_points([t.lower() for t in texts])
