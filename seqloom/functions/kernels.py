"""Scans of sequences as Arrow functions: for what array functions can't do in one linear pass.

A batch's sequences are one array of bytes; each scan is a few NumPy passes over it, so that short sequences cost no Python
call each. Work is done in slices of about SLICE bytes. Sequences are ASCII; a null gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import COMPLEMENTS, LETTERS

SLICE = 4 << 20
PLACES = "array<struct<start:int,end:int,strand:int>>"
_PLACE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("strand", pa.int32())]))
_SWAP = np.arange(256, dtype=np.uint8)
_SWAP[list(LETTERS.encode())] = list(COMPLEMENTS.encode())
_GC = np.zeros(256, np.int64)
_GC[list(b"GC")] = 1
_TWO_BITS = np.full(256, 255, np.uint8)
_TWO_BITS[list(b"ACGT")] = range(4)


class Rows:
    """Some sequences as bytes, with where each begins and ends and the row of each byte."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        self.row = np.repeat(np.arange(len(starts)), ends - starts)

    def fits(self, size: int) -> np.ndarray:
        """The places where a piece of this size lies in one row."""
        n = len(self.data) - size + 1
        return np.flatnonzero(np.arange(n) + size <= self.ends[self.row[:n]]) if n > 0 else np.zeros(0, np.int64)


def slices(column: pa.Array):
    """The column as Rows of about SLICE bytes, in order; nulls are empty."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        cut = offsets[at : end + 1] - offsets[at]
        yield Rows(data[offsets[at] : offsets[end]], cut[:-1], cut[1:])
        at = end


def by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, minlength=n)


def greedy_runs(positions: np.ndarray, spread: int) -> list[tuple[int, int]]:
    """First and last of each run of sorted positions: a position joins while it is less than spread behind the first."""
    out, i = [], 0
    while i < len(positions):
        j = int(np.searchsorted(positions, positions[i] + spread))
        out.append((int(positions[i]), int(positions[j - 1])))
        i = j
    return out


def place_array(lists: list[list[tuple[int, int, int]] | None]) -> pa.Array:
    offsets = np.cumsum([0, *(len(x) if x else 0 for x in lists)])
    flat = [p for x in lists if x for p in x]
    parts = [pa.array([p[k] for p in flat], pa.int32()) for k in range(3)]
    values = pa.StructArray.from_arrays(parts, ["start", "end", "strand"])
    if any(x is None for x in lists):
        marked = pa.array([None if lists[i] is None else int(o) for i, o in enumerate(offsets[:-1])] + [int(offsets[-1])], pa.int32())
        return pa.ListArray.from_arrays(marked, values, type=_PLACE)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=_PLACE)


def scores_of(scan: Callable[[Rows], np.ndarray], q: Column) -> Column:
    """A number for each sequence."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        out = np.concatenate([scan(r) for r in slices(column)]) if len(column) else np.zeros(0)
        return pa.array(out, pa.float64(), mask=column.is_null().to_numpy(zero_copy_only=False))

    return run(q)


def places_of(scan: Callable[[Rows], list[list[tuple[int, int, int]]]], q: Column) -> Column:
    """Places in each sequence."""

    @F.arrow_udf(PLACES)
    def run(column: pa.Array) -> pa.Array:
        lists = [x for r in slices(column) for x in scan(r)]
        return place_array([x if ok else None for x, ok in zip(lists, column.is_valid().to_pylist(), strict=True)])

    return run(q)


# windows of G and C


def window_breaches(rows: Rows, window: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin whose share of G and C is outside of the limits, and by how much."""
    sums = np.concatenate(([0], np.cumsum(_GC[rows.data])))
    at = rows.fits(window)
    gc = (sums[at + window] - sums[at]) / window
    bad = np.maximum(0.0, low - gc) + np.maximum(0.0, gc - high)
    on = bad > 0
    return at[on], bad[on]


def gc_window_score(q: Column, window: int, low: float, high: float) -> Column:
    def scan(rows: Rows) -> np.ndarray:
        at, bad = window_breaches(rows, window, low, high)
        return -by_row(bad, rows.row[at], len(rows.starts))

    return scores_of(scan, q)


def grouped_places(rows: Rows, at: np.ndarray, size: int, spread: int) -> list[list[tuple[int, int, int]]]:
    """Starts as places: runs of starts that spread over less than `spread`, from the first to the last one's end, which is
    within the row."""
    cut = np.searchsorted(at, np.concatenate((rows.starts, rows.ends[-1:]))) if len(rows.starts) else np.zeros(1, int)
    out = []
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        n = int(rows.ends[k] - rows.starts[k])
        out.append([(x, min(y + size, n), 0) for x, y in greedy_runs(at[a:b] - rows.starts[k], spread)] if b > a else [])
    return out


def gc_window_places(q: Column, window: int, low: float, high: float, spread: int = 50) -> Column:
    return places_of(lambda rows: grouped_places(rows, window_breaches(rows, window, low, high)[0], window, spread), q)


# words


def word_keys(rows: Rows, k: int, at: np.ndarray, reverse: bool = False) -> np.ndarray:
    """A number for the word at each place, or for its reverse complement; equal words have equal numbers. Numbers are the
    words themselves, two bits a base, where that can be, else the ranks of a hash that is checked against the words."""
    data = _SWAP[rows.data] if reverse else rows.data
    two = _TWO_BITS[data]
    steps = range(k - 1, -1, -1) if reverse else range(k)
    if k <= 31 and not (two == 255).any():
        key = np.zeros(len(at), np.int64)
        for j in steps:
            key = key << 2 | two[at + j]
        return key
    # byte strings of k letters, eight at a time
    key = np.zeros(len(at), np.uint64)
    for j in steps:
        key = (key ^ data[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def starts_of_words(rows: Rows, k: int, last: bool) -> np.ndarray:
    """The places of words; without the last word of each row unless it counts."""
    at = rows.fits(k)
    return at if last else at[at + k < rows.ends[rows.row[at]]]


def repeated(rows: Rows, k: int, both_strands: bool, last: bool) -> np.ndarray:
    """The places of words that their row has more than once."""
    at = starts_of_words(rows, k, last)
    key = word_keys(rows, k, at)
    if both_strands:
        key = np.minimum(key, word_keys(rows, k, at, True))
    row = rows.row[at]
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    same = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    on = np.zeros(len(at), bool)
    on[1:] |= same
    on[:-1] |= same
    return np.sort(at[order[on]])


def repeated_words_score(q: Column, k: int, both_strands: bool, last: bool) -> Column:
    def scan(rows: Rows) -> np.ndarray:
        at = repeated(rows, k, both_strands, last)
        return 0.0 - np.bincount(rows.row[at], minlength=len(rows.starts))

    return scores_of(scan, q)


def single_places(rows: Rows, at: np.ndarray, size: int) -> list[list[tuple[int, int, int]]]:
    cut = np.searchsorted(at, np.concatenate((rows.starts, rows.ends[-1:]))) if len(rows.starts) else np.zeros(1, int)
    return [[(x, x + size, 0) for x in (at[a:b] - rows.starts[k]).tolist()] for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def repeated_words_places(q: Column, k: int, both_strands: bool, last: bool) -> Column:
    return places_of(lambda rows: single_places(rows, repeated(rows, k, both_strands, last), k), q)


def hairpins(rows: Rows, stem: int, window: int) -> np.ndarray:
    """The places of words whose reverse complement begins behind them and ends within the window."""
    every = rows.fits(stem)
    at = every[every + stem < rows.ends[rows.row[every]]]
    if not len(at):
        return at
    forward, back = word_keys(rows, stem, every), word_keys(rows, stem, at, True)
    ids = np.unique(np.concatenate((forward, back)), return_inverse=True)[1]
    wide = np.int64(len(rows.data) + 1)
    places = np.sort(ids[: len(every)] * wide + every)
    wanted = ids[len(every) :] * wide
    i = np.searchsorted(places, wanted + at + stem)
    found = np.where(i < len(places), places[np.minimum(i, len(places) - 1)], np.iinfo(np.int64).max)
    return at[found <= wanted + np.minimum(at + window, rows.ends[rows.row[at]]) - stem]


def hairpin_score(q: Column, stem: int, window: int) -> Column:
    return scores_of(lambda rows: 0.0 - np.bincount(rows.row[hairpins(rows, stem, window)], minlength=len(rows.starts)), q)


def hairpin_places(q: Column, stem: int, window: int, spread: int = 10) -> Column:
    return places_of(lambda rows: grouped_places(rows, hairpins(rows, stem, window), window, spread), q)


# words of others


def match_scan(rows: Rows, k: int, known: frozenset[bytes]) -> np.ndarray:
    """The places of words that are among the known ones: candidates by number, confirmed as words."""
    at = rows.fits(k)
    if not len(at) or not known:
        return at[:0]
    joined = np.frombuffer(b"".join(sorted(known)), np.uint8)
    others = Rows(joined, np.arange(0, len(joined), k), np.arange(k, len(joined) + 1, k))
    # numbers of both are of one kind only if taken together
    both = Rows(np.concatenate((rows.data, joined)), np.concatenate((rows.starts, others.starts + len(rows.data))), np.concatenate((rows.ends, others.ends + len(rows.data))))
    key = word_keys(both, k, np.concatenate((at, others.starts + len(rows.data))))
    hits = at[np.isin(key[: len(at)], key[len(at) :])]
    return hits[[rows.data[i : i + k].tobytes() in known for i in hits.tolist()]] if len(hits) else hits


def match_score(q: Column, k: int, known: frozenset[bytes]) -> Column:
    return scores_of(lambda rows: 0.0 - np.bincount(rows.row[match_scan(rows, k, known)], minlength=len(rows.starts)), q)


def match_places(q: Column, k: int, known: frozenset[bytes]) -> Column:
    return places_of(lambda rows: single_places(rows, match_scan(rows, k, known), k), q)
