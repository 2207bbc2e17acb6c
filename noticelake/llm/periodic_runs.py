"""Periodic runs of words, found while a suffix automaton grows under link-cut access.

The automaton's suffix links form a tree; the states from a prefix's state to the root are its suffixes. Each state belongs
to the path of the last prefix that came through it, so a path carries the end of its strings' last occurrence. Appending
a word accesses its state: the way to the root crosses pieces of older paths, each with a previous end, and becomes one
path with the new end. Where the new end is no further from a previous one than the piece's longest string is long, the
last words are a square, and that string with the distance is exactly as far as the period reaches back. The last append
that reports a run gives its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import texts

LEAST = 6
TIMES = 4


class LastOccurrences:
    """A suffix automaton of a growing word sequence, whose link tree is kept as paths in splay trees.

    Arrays are indexed by state; 0 stands for no state and 1 for the root. ``up`` is the parent in a splay tree or, at its
    root, the state a path hangs on. ``end`` counts at the roots of splay trees only: the last place where strings of the
    path end.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        self.up, self.left, self.right, self.end = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.size = 1, 0

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        for links in (self.up, self.left, self.right):
            links.append(0)
        self.end.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        """Make a state the root of its path's tree; the path's end goes with the root."""
        up, left, right, end = self.up, self.left, self.right, self.end
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            # One rotation, of the parent first where both lie on the same side.
            for lower in ((y, x) if (left[y] == x) == (left[z] == y) else (x, x)) if inner else (x,):
                upper = up[lower]
                above = up[upper]
                if left[upper] == lower:
                    moved = left[upper] = right[lower]
                    right[lower] = upper
                else:
                    moved = right[upper] = left[lower]
                    left[lower] = upper
                if moved:
                    up[moved] = upper
                if above and left[above] == upper:
                    left[above] = lower
                elif above and right[above] == upper:
                    right[above] = lower
                else:
                    end[lower] = end[upper]
                up[lower] = above
                up[upper] = lower

    def _clone(self, at: int, word: int, old: int) -> int:
        """A state between ``old`` and its link, on the same path: its strings end where those of ``old`` last did."""
        new = self._state(self.length[at] + 1, dict(self.next[old]))
        self.link[new], self.link[old] = self.link[old], new
        self._splay(old)
        above = self.left[old]
        self.left[new], self.right[new], self.up[new] = above, old, self.up[old]
        if above:
            self.up[above] = new
        self.left[old], self.up[old] = 0, new
        self.end[new] = self.end[old]
        while at and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def append(self, word: int) -> list[tuple[int, int]]:
        """Take the next word; previous ends and longest strings of the pieces that its state's way to the root crosses."""
        follow, link, length = self.next, self.link, self.length
        here = self.size
        self.size = here + 1
        at = self.last
        new = self.last = self._state(here + 1, {})
        while at and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if not at:
            parent = 1
        else:
            met = follow[at][word]
            parent = met if length[met] == length[at] + 1 else self._clone(at, word, met)
        link[new] = self.up[new] = parent
        # Access: the pieces above join the new state's path, what hung below them goes on as paths of its own.
        up, right, end, pieces = self.up, self.right, self.end, []
        below, x = new, parent
        while x:
            self._splay(x)
            if end[x] >= 0:
                pieces.append((end[x], length[x]))
            cut = right[x]
            if cut:
                end[cut] = end[x]
            right[x] = below
            below, x = x, up[x]
        end[below] = here
        return pieces


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run of at least ``least`` words and ``times`` periods, by start and period."""
    seen, ends = LastOccurrences(), {}
    for here, word in enumerate(words):
        for before, longest in seen.append(word):
            period = here - before
            if longest >= (times - 1) * period and longest + period >= least:
                ends[here - longest - period + 1, period] = here + 1
    smallest: dict[tuple[int, int], int] = {}
    for (start, period), stop in ends.items():
        smallest[start, stop] = min(period, smallest.get((start, stop), period))
    return sorted((start, stop - start, period) for (start, stop), period in smallest.items())


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equal ones the first, then that of the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def text_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """:func:`runs_of` for words as they are."""
    numbers: dict[bytes, int] = {}
    return runs_of([numbers.setdefault(w, len(numbers)) for w in words], least, times)


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Every row's ``doc_id, n_words, runs, best, collapsed, runs_sha256``.

    ``runs`` has ``start, length, period`` of each maximal stretch of words with that smallest period, of at least
    ``least`` words and ``times`` periods, ordered by start and period; ``best`` the one with the greatest length / period,
    NULL without runs; ``collapsed`` the words that no run contains after its first period, joined by blanks;
    ``runs_sha256`` the lowercase digest of lines ``start,length,period``. NULL, empty and blank texts have no words and no
    runs. NULL ids, equal ids and repeated rows each keep their row; other columns are left out. Texts are whole, rows
    never meet, and nothing is shuffled; a task holds a few megabytes of text, or one text and the automaton of one
    stretch of it.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def as_run(run: tuple[int, int, int]) -> dict[str, int]:
        return dict(zip(("start", "length", "period"), run, strict=True))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                words = [t.split() if t else [] for t in texts(batch)]
                found = [text_runs(w, least, times) for w in words]
                best = [best_run(r) for r in found]
                lines = ["".join(f"{s},{n},{p}\n" for s, n, p in r).encode() for r in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(list(map(len, words)), pa.int64()),
                        pa.array([[as_run(x) for x in r] for r in found], pa.list_(run_type)),
                        pa.array([b and as_run(b) for b in best], run_type),
                        pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.binary()).cast(pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in lines]),
                    ],
                    names=["doc_id", "n_words", "runs", "best", "collapsed", "runs_sha256"],
                )

    run = "struct<start:long,length:long,period:long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(find, f"doc_id long, n_words long, runs array<{run}>, best {run}, collapsed string, runs_sha256 string")
