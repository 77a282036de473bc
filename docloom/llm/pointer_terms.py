"""Terms of texts counted by sorting pointers to where they start.

A shard of texts stays one Arrow buffer. The start of every word is a pointer into
it, and the pointers are sorted by the words they point to with a multikey
quicksort: pointers are sorted by one character, a block of eight bytes, and only
runs that are still equal and go on are sorted by their next block. No word is
copied before the equal runs are known, and then once per run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from docloom.llm import common as C

#: Bytes of one character of the sort.
BLOCK = 8
#: Bytes of terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
LETTERS = C.byte_table(bytes(b for b in range(128) if not chr(b).isalpha()))

_KEPT = np.array([(1 << 64) - (1 << 8 * (BLOCK - n)) for n in range(BLOCK + 1)], np.uint64)


def pointers(off: np.ndarray, buf: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word of the texts ``buf[off[i] : off[i + 1]]``, and its text."""
    inside = member[buf]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = off[:-1] < off[1:]
    before[off[:-1][filled]] = False
    after[off[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    length = np.flatnonzero(inside & ~after) + 1 - start
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    return start, length, row


def padded(buf: np.ndarray) -> np.ndarray:
    """Every eight bytes of a buffer, from each of its places on, as numbers that sort like them."""
    longer = np.concatenate((buf, np.zeros(BLOCK, np.uint8)))
    return np.ndarray((len(buf) + 1,), ">u8", longer.data, 0, (1,))


def blocks(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next block of words that have ``left`` bytes from ``at`` on; what lies behind them is 0."""
    return view[np.minimum(at, len(view) - 1)].astype(np.uint64) & _KEPT[np.clip(left, 0, BLOCK)]


def pointer_sort(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their words, and for each whether another word begins there.

    Words must not hold zero bytes, so that the zeros behind the end of a word sort
    it before its continuations.
    """
    view = padded(buf)
    order = np.arange(len(start))
    fresh = np.zeros(len(start), bool)
    fresh[:1] = True
    place, run, depth = np.arange(len(start)), np.zeros(len(start), np.int64), 0
    while len(place):
        at = order[place]
        key = blocks(view, start[at] + depth, length[at] - depth)
        by = np.lexsort((key, run)) if depth else np.argsort(key)
        key, at = key[by], at[by]
        order[place] = at
        cut = np.zeros(len(place), bool)
        cut[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
        fresh[place[cut]] = True
        cut[:1] = True
        run = np.cumsum(cut) - 1
        depth += BLOCK
        # Runs of several words that fill the block, of which one at least goes on.
        more = np.bincount(run, length[at] > depth)[run] > 0
        more &= np.bincount(run)[run] > 1
        place, run = place[more], run[more]
    return order, fresh


@dataclass
class Runs:
    """Equal words of a shard, in order, and in which texts they are."""

    start: np.ndarray  # of one word of each run
    length: np.ndarray
    run: np.ndarray  # of each cell (run, text), by run
    row: np.ndarray
    times: np.ndarray

    def strings(self, buf: np.ndarray, chosen: np.ndarray) -> pa.Array:
        size = self.length[chosen]
        return C.strings(np.cumsum(size), buf[C.spans(self.start[chosen], size)])


def equal_runs(off: np.ndarray, buf: np.ndarray, member: np.ndarray) -> Runs:
    """Sort the pointers of a shard and read off how often each text has each word."""
    start, length, row = pointers(off, buf, member)
    order, fresh = pointer_sort(buf, start, length)
    run = np.cumsum(fresh) - 1
    texts = max(1, len(off) - 1)
    cell, times = np.unique(run * texts + row[order], return_counts=True)
    first = order[fresh]
    return Runs(start[first], length[first], cell // texts, cell % texts, times)
