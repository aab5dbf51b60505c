"""Words of many texts at once, in numpy: where they are, their hashes, hashes of runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import mix64, text_slices

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ONE = np.uint64(1)


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | _ONE


def byte_codes(fold_case: bool) -> np.ndarray:
    codes = constants(256, 7)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def is_blank() -> np.ndarray:
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return blank


class Powers:
    """Powers of one base and of its inverse, grown when a longer text needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))
        return self.up[:n], self.down[:n]


@dataclass
class Words:
    """Words of a run of texts: one hash each, and the first word of each text, with the end."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``length`` words from each word on, and which of them stay in one text."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        for k, c in enumerate(constants(length, seed)):
            out[: max(0, n - k)] += self.hashes[k:] * c
        return mix64(out), self.room() >= length

    def room(self) -> np.ndarray:
        """How many words are left in its text from each word on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))


class WordReader:
    def __init__(self, fold_case: bool = False):
        self.codes, self.blank, self.powers = byte_codes(fold_case), is_blank(), Powers()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        if not len(data):
            return Words(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
        inside = ~self.blank[data]
        before = np.empty(len(data), bool)
        before[0], before[1:] = False, inside[:-1]
        starts_text = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins = inside & ~before
        begins[starts_text] = inside[starts_text]
        begin = np.flatnonzero(begins)
        # A word ends before a blank or the next text.
        closes = ~inside & before
        closes[starts_text] = before[starts_text]
        end = np.flatnonzero(closes)
        if before.size and inside[-1]:
            end = np.append(end, len(data))
        up, down = self.powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * up[:-1], out=sums[1:])
        hashes = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        return Words(hashes, np.searchsorted(begin, offsets))

    def texts(self, column: pa.Array) -> Iterator[tuple[int, Words]]:
        """(first row, words) of runs of whole texts."""
        for i, data, offsets in text_slices(column):
            yield i, self(data, offsets)


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, wrapping; texts may have none."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def shared_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, member, partner) of keys with two members or more.

    The batches come sorted by key and member. Members are given once for each key, each with
    another member of the key: the next one in an order that a hash makes, round about.
    A key of any number of rows passes through; only one member is remembered for it.
    """
    last_key = last_member = kept = None
    alone = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, member = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
        new = np.empty(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
        new[0] = last_key is None or key[0] != last_key or member[0] != last_member
        key, member = key[new], member[new]
        if not len(key):
            continue
        last_member = member[-1]
        goes_on = last_key is not None and key[0] == last_key
        if goes_on:  # a member of the part before takes part in this one
            key, member = np.concatenate(([last_key], key)), np.concatenate(([kept], member))
        group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
        order = np.lexsort((mix64(member.view(np.uint64) ^ mix64(key.view(np.uint64))), group))
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        after = np.arange(1, len(key) + 1)
        after[starts + sizes - 1] = starts
        partner = np.empty(len(key), member.dtype)
        partner[order] = member[order[after]]
        keep = np.repeat(sizes > 1, sizes)
        if goes_on and not alone:
            keep[0] = False  # given already
        last_key, kept, alone = key[-1], member[-1], sizes[-1] == 1
        if keep.any():
            yield key[keep], member[keep], partner[keep]
