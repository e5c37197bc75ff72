"""Periodic runs of words: harmonic grid with suffix arrays.

A run is a stretch of words that repeats with period p, at least ``MIN_WORDS`` words and ``MIN_PERIODS`` periods long,
that neither neighbour extends. For every period p the grid points jp and (j+1)p are compared; where they can lie in a
run, the longest common extensions forward (suffix array, LCP array, range-minimum table) and backward (the same over
the reversed words) give the whole run. A run of multiples of its smallest period is found at the same place by that
period too, so the smallest period of equal places is kept.

Documents are worked on where the scan reads them, many at a time: their words, numbered so that different documents
share none, stand in one array with a separator of its own between any two, so neither grid nor extensions cross. Only
documents in which consecutive grid points agree are given suffix arrays. Nothing is shuffled; memory is bounded by
``LOT`` words or the longest document, and grid points are extended ``POINTS`` at a time.

Defined cases: a null or blank text has no words and no run; words of texts of any length count whole; of runs with
equal exponents the one that starts first, then the one of smaller period, is the strongest; repeated rows and rows
with equal or null ids are worked on one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batch, map_arrow

#: A run's least length in words and in periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Words worked on at a time (more for a longer document); grid points extended at a time.
LOT, POINTS = 1 << 16, 1 << 18


class Extensions:
    """Longest common extensions of an array whose last key is found nowhere else."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        # Prefix doubling: a rank is the place of the first suffix that shares its prefix; only shared ranks are refined.
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, keys[order][1:] != keys[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        levels, width = [rank], 1
        shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        while len(shared):
            one, two = rank[shared], rank[shared + width]
            order = np.lexsort((two, one))
            shared, one, two = shared[order], one[order], two[order]
            group = np.r_[True, one[1:] != one[:-1]]
            own = group | np.r_[True, two[1:] != two[:-1]]
            at = np.arange(len(shared))
            new = one + np.maximum.accumulate(np.where(own, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            rank = rank.copy()
            rank[shared] = new
            levels.append(rank)
            alone = own & np.r_[own[1:], True]
            shared, width = shared[~alone], 2 * width
        self.rank = rank
        places = np.empty(n, np.int64)
        places[rank] = np.arange(n)
        # LCP of neighbours in suffix order, from the widest prefixes down.
        lcp = np.zeros(n, np.int64)
        at = 1 + np.flatnonzero(levels[0][places[1:]] == levels[0][places[:-1]])
        a, b, found = places[at - 1], places[at], np.zeros(len(at), np.int64)
        for k in reversed(range(len(levels))):
            found += np.where(levels[k][a + found] == levels[k][b + found], 1 << k, 0)
        lcp[at] = found
        # Minima of all power-of-two ranges, as long as the longest stretch of neighbours with anything in common.
        self.minima = [lcp]
        stops = np.flatnonzero(lcp == 0)
        longest = int(np.diff(np.r_[stops, n]).max()) if n else 0
        step = 1
        while 2 * step <= longest:
            last = self.minima[-1]
            new = last.copy()
            np.minimum(last[:-step], last[step:], out=new[:-step])
            self.minima.append(new)
            step *= 2
        self.minima = np.stack(self.minima)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many keys from places a and b on agree; the keys at a and b agree, a differs from b."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp(high - low + 1)[1] - 1
        return np.minimum(self.minima[k, low], self.minima[k, high - (1 << k) + 1])


def _grid(keys: np.ndarray, longest: int, min_words: int, min_periods: int):
    """(period, places) of grid points that can begin a run's part: as many points in a row agree as any run covers."""
    for p in range(1, longest // min_periods + 1):
        points = keys[::p]
        same = points[1:] == points[:-1]
        covered = max(min_words // p, min_periods) - 1
        if len(same) < covered:
            return
        row = same
        for k in range(1, covered):
            row = row[:-1] & same[k:]
        at = np.flatnonzero(row)
        if len(at):
            yield p, at * p


def runs_of(documents: list[np.ndarray], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[np.ndarray]:
    """For each document, given as non-negative word numbers, its runs (start, length, period) by start, then period."""
    none = np.zeros((0, 3), np.int64)
    found = [none] * len(documents)
    chosen = [d for d, x in enumerate(documents) if len(x) >= max(min_words, min_periods)]
    for only_candidates in (True, False):  # first which documents have any candidate, then those alone
        if not chosen:
            return found
        span = 1 + max(int(documents[d].max()) for d in chosen)
        parts, starts, at = [np.array([-1])], [], 1
        for i, d in enumerate(chosen):
            parts += [documents[d] + i * span, np.array([-2 - i])]
            starts.append(at)
            at += len(documents[d]) + 1
        keys, starts = np.concatenate(parts), np.array(starts)
        longest = max(len(documents[d]) for d in chosen)
        if only_candidates:
            hit = np.zeros(len(chosen), bool)
            for _, a in _grid(keys, longest, min_words, min_periods):
                hit[np.searchsorted(starts, a, "right") - 1] = True
            chosen = [d for d, x in zip(chosen, hit, strict=True) if x]
    forward, backward, n = Extensions(keys), Extensions(keys[::-1]), len(keys)
    kept = none

    def extend(held):
        a = np.concatenate([x for _, x in held])
        p = np.repeat([q for q, _ in held], [len(x) for _, x in held])
        b = a + p
        end = b + forward(a, b)
        back = np.zeros(len(a), np.int64)
        more = np.flatnonzero(keys[a - 1] == keys[b - 1])
        back[more] = backward(n - a[more], n - b[more])
        rows = np.stack([a - back, end - a + back, p], 1)
        rows = np.concatenate([kept, rows[rows[:, 1] >= np.maximum(min_words, min_periods * p)]])
        rows = rows[np.lexsort(rows.T[::-1])]
        return rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]] if len(rows) else rows

    held, size = [], 0
    for p, a in _grid(keys, longest, min_words, min_periods):
        for piece in np.array_split(a, len(a) // POINTS + 1):
            held.append((p, piece))
            size += len(piece)
            if size >= POINTS:
                kept, held, size = extend(held), [], 0
    if held:
        kept = extend(held)
    kept = kept[np.lexsort((kept[:, 2], kept[:, 0]))]
    owner = np.searchsorted(starts, kept[:, 0], "right") - 1
    for i, d in enumerate(chosen):
        own = kept[owner == i] if len(chosen) < 8 else kept[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
        found[d] = own - np.array([starts[i], 0, 0])
    return found


def strongest(runs: np.ndarray) -> int | None:
    """Place of the run with the greatest exact length / period, ties by start, then period; None without runs."""
    return min(range(len(runs)), key=lambda i: (-Fraction(int(runs[i][1]), int(runs[i][2])), runs[i][0], runs[i][2])) if len(runs) else None


def collapse(words: list, runs: np.ndarray) -> list:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def repeat_tail(doc_id, words: list) -> list:
    """Every tenth document, by crc32 of its id, with its words from a place on replaced by repeats of the first of them."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, strongest int, collapsed string"


def find_runs(docs: DataFrame, rewrite: Callable[[object, list], list] | None = None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(doc_id, runs, strongest, collapsed) of every row: its runs by start and period, the place of the strongest among
    them (from 0), and the text of the words that stay, joined by single spaces. ``rewrite`` changes a row's words first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    out = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run)), ("strongest", pa.int32()), ("collapsed", pa.string())])

    def work(lot):
        number = defaultdict(count().__next__)
        runs = runs_of([np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for _, words in lot], min_words, min_periods)
        lists = pa.StructArray.from_arrays([pa.array(np.concatenate([r[:, k] for r in runs])) for k in range(3)], fields=list(run))
        offsets = np.cumsum([0, *map(len, runs)])
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in lot], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists),
            pa.array([strongest(r) for r in runs], pa.int32()), pa.array([b" ".join(collapse(w, r)).decode() for (_, w), r in zip(lot, runs, strict=True)], pa.string()),
        ], schema=out)

    def go(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text.split()
                rows.append((doc_id, rewrite(doc_id, words) if rewrite else words))
            rows.sort(key=lambda x: len(x[1]))
            lot, size = [], 0
            for row in rows:
                if lot and size + len(row[1]) > LOT:
                    yield work(lot)
                    lot, size = [], 0
                lot.append(row)
                size += len(row[1])
            if lot:
                yield work(lot)

    return map_arrow(rows, go, RUNS)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of what :func:`find_runs` gives."""
    best = F.get("runs", F.col("strongest"))
    field = lambda c: best[c].alias(c)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed: Column = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), field("start"), field("length"), field("period"), F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
