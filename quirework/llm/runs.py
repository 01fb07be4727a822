"""Periodic runs of words by partition refinement, and texts with their repetitions collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least `least_words` long and at least `power` periods,
that no neighbouring word extends. Dropping what follows a run's first period leaves one copy of what repeats.

Crochemore's refinement, for all texts of a portion side by side:
1. Places of equal words are one class (of factors of length 1); a text ends in a mark that equals nothing.
2. From length l to l + 1 two places stay together if the places after them do. A class is split by the classes of its successors,
   and of those only by the ones that were split off at the last length and aren't the largest of their parent (the smaller half): a
   place is touched a logarithmic number of times, however many lengths there are.
3. At length l, members of a class at distance l show a square of period l. A run of four periods or more holds at least two places in a row that
   are multiples of l where this is so, so these alone are looked at: altogether n log n looks. Squares in a row merge into a run, whose ends
   are then found word by word, less than a period away.
4. A stretch that was already found under a smaller period has that one as its smallest.
A text is left when l exceeds a `power`-th of its words, and all when no class was split.

Everything happens within a document, so portions of documents are all a task needs; nothing is shuffled.

Defined results: null and empty texts have no words, no runs and the digest of the empty text; very long texts are a portion alone; among equally strong runs the
first start, then the smaller period is named; repeated rows each get a row; rows without an id are never repeated in part; an empty table gives no rows.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, small_batches


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] values, and so on, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Classes:
    """Classes of equal factors. Members of a class stand together in `order`, from begin[c], size[c] of them; splitting never makes more classes than places."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.of = symbols.astype(np.int64)
        self.number = int(self.of.max(initial=-1)) + 1
        self.size = np.bincount(self.of, minlength=n)
        self.begin = np.cumsum(self.size) - self.size
        self.order = np.argsort(self.of, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.going = np.zeros(n, bool)
        self.fresh = np.arange(n)  # members of the classes that split others at the next length: at first all

    def refine(self, limits: np.ndarray, length: int) -> None:
        """From factors of a length less by one to those of this length, around places whose limit isn't below it."""
        at = self.fresh[self.fresh > 0] - 1
        at = at[(self.size[self.of[at]] > 1) & (limits[at] >= length)]
        own, by = self.of[at], self.of[at + 1]
        turn = np.lexsort((by, own))
        self.fresh = at = at[turn]
        if not len(at):
            return
        own, by = own[turn], by[turn]
        # Parts: members of one class whose successors share a class. Parts of one class stand together.
        part = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (by[1:] != by[:-1])]))
        part_size = np.diff(part, append=len(at))
        owner = own[part]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        parts = np.diff(first, append=len(part))
        old, moved = owner[first], np.add.reduceat(part_size, first)
        rest = self.size[old] - moved
        # Members that go change places with those that stay, and then stand at the end of their class, part after part.
        low = self.begin[old] + rest
        slots = _ranges(low, moved)
        there = self.order[slots]
        self.going[at] = True
        stays = there[~self.going[there]]
        self.going[at] = False
        holes = self.place[at]
        holes = holes[holes < np.repeat(low, moved)]
        self.order[holes], self.place[stays] = stays, holes
        self.order[slots], self.place[at] = at, slots
        # A part is a new class. Where nothing is left of the old one, its largest part keeps the number.
        largest = np.maximum.reduceat(part_size, first)
        marks = np.flatnonzero(part_size == np.repeat(largest, parts))
        biggest = marks[np.searchsorted(marks, first)]
        new = np.ones(len(part), bool)
        new[biggest[rest == 0]] = False
        number = owner.copy()
        number[new] = self.number + np.arange(int(new.sum()))
        self.number += int(new.sum())
        self.size[old] = rest
        self.size[number], self.begin[number] = part_size, slots[part]
        self.of[at] = np.repeat(number, part_size)
        # All but the largest of what a class fell into split others at the next length. A class that stayed whole splits none.
        small = np.repeat((rest > 0) | (parts > 1), parts)
        small[biggest[rest < largest]] = False
        less = (rest > 0) & (rest < largest)
        self.fresh = np.concatenate([at[np.repeat(small, part_size)], self.order[_ranges(self.begin[old[less]], rest[less])]])


def runs(symbols: np.ndarray, limits: np.ndarray, least_words: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs. symbols: a number for each place, from 0 without gaps, with marks that stand nowhere else between texts.

    limits: the largest period that is looked for around each place. The order is that of periods, then of starts.
    """
    found: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    classes = Classes(symbols)
    for period in range(1, int(limits.max(initial=0)) + 1):
        if period > 1:
            classes.refine(limits, period)
            if not len(classes.fresh):  # no two places are alike any more
                break
        least = max(least_words, power * period) - period  # words that must equal the one a period later
        anchors = max(1, (least - period + 1) // period)
        ours = classes.of[::period]
        square = (ours[1:] == ours[:-1]) & (limits[::period][1:] >= period)
        if not (square[1:] & square[:-1] if anchors > 1 else square).any():
            continue
        edges = np.flatnonzero(np.diff(square, prepend=False, append=False))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < anchors:
                continue
            low, high = a * period, b * period
            before = symbols[max(low - period, 0) : low] == symbols[max(low - period, 0) + period : low + period]
            further = symbols[high + period : high + 2 * period]
            after = symbols[high : high + len(further)] == further
            low -= len(before) if before.all() else int(np.argmin(before[::-1]))
            high += len(after) if after.all() else int(np.argmin(after))
            key = low, high - low + period
            if high - low >= least and key not in seen:
                seen.add(key)
                found.append((*key, period))
    return found


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all texts and for a mark after each text: equal within a text where words are. And the place where each text begins."""
    parts, n, at = [], 0, [0]
    for words in texts:
        index = dict(zip(dict.fromkeys(words), range(n, n + len(words)), strict=False))
        n += len(index)
        parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([n]))
        n += 1
        at.append(at[-1] + len(words) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(at)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut to about `most` bytes of text: lengths are gone through once for all texts side by side."""
    held, size = [], 0
    for batch in batches:
        for part in portions(batch, "text", most):
            n = part.column("text").nbytes
            if held and size + n > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += n
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def collapsed(docs: DataFrame, least_words: int = 6, power: int = 4, most: int = 8 << 20) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and period) and text: its words without what runs repeat, joined by one space.

    power: 3 at least.
    """
    if power < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches, most):
            texts = [(text or b"").split() for text in part.column("text").cast(pa.large_binary()).to_pylist()]
            symbols, at = numbered(texts)
            limits = np.repeat((np.diff(at) - 1) // power, np.diff(at))
            own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for start, length, period in runs(symbols, limits, least_words, power):
                k = int(np.searchsorted(at, start, "right")) - 1
                own[k].append((start - int(at[k]), length, period))
            out = []
            for words, spans in zip(texts, own, strict=True):
                if spans:
                    spans.sort(key=lambda x: (x[0], x[2]))
                    keep = np.ones(len(words), bool)
                    for start, length, period in spans:
                        keep[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                out.append(b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            listed = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in spans] for spans in own], kind)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string")
