"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver. The configuration linear program over
it - the fewest bins such that bins of each pattern cover the number of pieces of every length - is solved by
multiplicative weights: a length's price falls exponentially with the share of its demand that is covered, one knapsack dynamic
programme prices all patterns, and every pattern within a tolerance of the best gains weight. Rounding takes whole bins of
the heaviest patterns while pieces last; best fit, again over the histogram, packs what is left. The plan has a size
that depends on the capacity and not on the data. Pieces then take their places by their rank within their length,
which is counted in two steps so that no length is ranked in one task.

Defined results: a null text is empty and gives one piece of the separator alone; repeated rows are packed as often as they
occur; an empty table gives no rows; very long texts are encoded in parts and cut; pieces of equal length (ties) take their places in any order; only the id and the text are
read, so other columns may have any name.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, small_batches, written

#: After a letter or digit, marks other than apostrophes, then a blank: the tokenizer ends a word before the marks anyway.
#: The look behind stands after the first mark, so the search runs from mark to mark.
_STOP = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z0-9].)[!-&(-/:-@\[-`{-~]*(?=[ \n])")
#: Letters alone, which the tokenizer keeps as one word.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


#: The encoders of a worker process, by the path of their tokenizer.
_ENCODERS: dict[str | None, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit numbers.

    The tokenizer ignores case and never joins across white space, so words between ASCII blanks are encoded once each and kept in
    two dictionaries of bounded size: when the newer is full it becomes the older, and words still in use move back. Texts with the start of a special token are encoded as they are.
    """

    def __init__(self, path: str | None, most_words: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.most, self.longest = most_words, 1 << 21

    def _parts(self, text: bytes) -> Iterator[str]:
        """A long text in parts that end after a blank, each no longer than `longest` but for longer words."""
        low = 0
        while low < len(text):
            high = len(text)
            if high - low > self.longest:
                last = text.rfind(b" ", low, low + self.longest)
                high = (last if last >= 0 else text.find(b" ", low + self.longest)) + 1 or len(text)  # find gives -1 where there is none
            yield text[low:high].decode()
            low = high

    @classmethod
    def of_worker(cls, path: str | None, most_words: int) -> WordEncoder:
        """The encoder of this worker process: it keeps its words for the worker's next tasks."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path, most_words)
        return _ENCODERS[path]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        plain: list[bytes] = []
        for i in range(0, len(words), 64):  # most groups are letters throughout, which one look tells
            group = words[i : i + 64]
            plain += group if _LETTERS(b"".join(group)) else filter(_LETTERS, group)
        rows = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for row, ids in zip(rows, self._whole([b" ".join(r).decode() for r in rows]), strict=True):
            ids = np.array(ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            raw = ids.tobytes()
            if len(cuts) != len(row):  # not one end for each word after all
                self.known.update((w, np.array(x, "<u4").tobytes()) for w, x in zip(row, self._whole([w.decode() for w in row]), strict=True))
                continue
            low = 0
            for w, high in zip(row, cuts.tolist(), strict=True):
                self.known[w] = raw[low:high]
                low = high
        other = [w for w in words if w not in self.known]
        self.known.update((w, np.array(x, "<u4").tobytes()) for w, x in zip(other, self._whole([w.decode() for w in other]), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        long = [len(text or "") * 4 > self.longest and len((text or "").encode()) > self.longest and "<|" not in text for text in texts]
        if not any(long):
            return self._short(texts)
        return [b"".join(self._short([part])[0] for part in self._parts(text.encode())) if cut else self._short([text])[0] for text, cut in zip(texts, long, strict=True)]

    def _short(self, texts: list[str | None]) -> list[bytes]:
        raw = [(text or "").encode() for text in texts]
        special = {i for i, x in enumerate(raw) if b"<|" in x}
        words = [[] if i in special else _STOP.sub(rb" \g<0>", x.lower()).split() for i, x in enumerate(raw)]
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        new = set().union(*words).difference(self.known)
        again = new & self.before.keys()
        self.known.update((w, self.before[w]) for w in again)
        self._learn(list(new - again))
        known = self.known
        out = [b"".join(itemgetter(*w)(known)) if len(w) > 1 else b"".join(known[x] for x in w) for w in words]
        for i in special:
            out[i] = np.array(self._whole([texts[i]])[0], "<u4").tobytes()
        return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, separator: int = 0, cache_words: int = 200_000) -> DataFrame:
    """The pieces of all documents: ids of the whole text and a separator, cut only where longer than the capacity.

    `tokenizer` is a path on the executors; by default the file of the installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of_worker(tokenizer, cache_words)
        end = np.array([separator], "<u4").tobytes()
        for batch in batches:
            for part in portions(batch, "text", 2 << 20):
                out: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    for k, low in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[low : low + 4 * capacity]
                        out.append((doc_id, k, low // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def solve(counts: dict[int, int], capacity: int, rounds: int = 24, eta: float = 6.0, tolerance: float = 0.02) -> dict[Pattern, float]:
    """The configuration linear program by multiplicative weights: bins of each pattern, as fractions."""
    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths], float)
    place = {int(x): i for i, x in enumerate(lengths)}
    cover = np.zeros(len(lengths))
    found: dict[Pattern, float] = defaultdict(float)
    for _ in range(rounds):
        ratio = cover / need
        price = lengths * np.exp(-eta * (ratio - np.average(ratio, weights=need * lengths)))
        value, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for c in range(1, capacity + 1):
            value[c] = value[c - 1]
            if k := upto[c]:
                gain = value[c - lengths[:k]] + price[:k]
                best = int(np.argmax(gain))
                if gain[best] > value[c]:
                    value[c], take[c] = gain[best], best
        for i, length in enumerate(lengths):
            rest = capacity - int(length)
            if price[i] + value[rest] < (1 - tolerance) * value[capacity] and ratio[i] > 0.5:
                continue
            parts = {int(length): 1}
            while rest > 0:
                if take[rest] < 0:
                    rest -= 1
                    continue
                x = int(lengths[take[rest]])
                parts[x] = parts.get(x, 0) + 1
                rest -= x
            if any(times > counts[x] for x, times in parts.items()):  # more than there are
                parts = {x: min(times, counts[x]) for x, times in parts.items()}
            pattern = tuple(sorted(parts.items(), reverse=True))
            step = need[i] / parts[int(length)] / rounds
            found[pattern] += step
            for x, times in pattern:
                cover[place[x]] += step * times
    return found


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over a histogram: equal bins are handled together."""
    by_space: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    spaces = np.zeros(capacity + 1, bool)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = np.flatnonzero(spaces[length:])
            if not len(fits):
                each = min(capacity // length, left)
                bins = left // each
                by_space[capacity - each * length].append((((length, each),), bins))
                spaces[capacity - each * length] = True
                left -= bins * each
                continue
            space = int(fits[0]) + length
            pattern, n = by_space[space].pop()
            each = min(space // length, max(left // n, 1))
            bins = min(n, left // each)
            if n > bins:
                by_space[space].append((pattern, n - bins))
            spaces[space] = bool(by_space[space])
            by_space[space - each * length].append((tuple(sorted((dict(pattern) | {length: dict(pattern).get(length, 0) + each}).items(), reverse=True)), bins))
            spaces[space - each * length] = True
            left -= bins * each
    return [x for group in by_space.values() for x in group]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Whole bins of patterns that together hold exactly `counts`."""
    left = {x: n for x, n in counts.items() if n}
    bins: list[tuple[Pattern, int]] = []
    if capacity in left:
        bins.append((((capacity, 1),), left.pop(capacity)))
    if left:
        weights = solve(left, capacity)
        slack = {p: capacity - sum(x * k for x, k in p) for p in weights}
        order = sorted(weights, key=lambda p: (slack[p] > 0, -weights[p], p))
        for least in (0, 1):
            for pattern in order:
                if least and slack[pattern]:
                    break  # only full bins go beyond their weight
                n = min(left[x] // k for x, k in pattern)
                n = min(n, max(least, round(weights[pattern])))
                if n > 0:
                    bins.append((pattern, n))
                    for x, k in pattern:
                        left[x] -= n * k
        bins += _best_fit({x: n for x, n in left.items() if n}, capacity)
    return bins


def slots(bins: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, times in a bin, first sequence, offset), by length and first rank."""
    rows, base, ranks = [], 0, defaultdict(int)
    for pattern, n in bins:
        offset = 0
        for length, times in pattern:
            rows.append((length, ranks[length], times, base, offset))
            ranks[length] += n * times
            offset += length * times
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    small_batches(docs.sparkSession)
    cut = written(pieces(docs, tokenizer, capacity), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = slots(plan(counts, capacity))
    salts = max(16, sum(counts.values()) // 100_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).alias("place"))
    shift = np.int64(1 << 50)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = where[:, 0] * shift + where[:, 1]
        for batch in batches:
            length, place = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            row = where[np.searchsorted(starts, length * shift + place, "right") - 1] if len(length) else where[:0]
            turn = place - row[:, 1]
            sequence = row[:, 3] + turn // np.maximum(row[:, 2], 1)
            offset = row[:, 4] + turn % np.maximum(row[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")
