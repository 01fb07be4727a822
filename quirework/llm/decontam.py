"""Benchmark decontamination by spaced seeds.

A seed is the hash of a window of words seen through a fixed mask, so words at the ignored places may differ. Benchmark items and
documents are hashed at every word. Hashes join; each hit fixes how an item lies on a document, and along that diagonal
the words are compared one by one. A document overlaps an item if some `window` consecutive aligned words (all words of a shorter item)
agree in at least `agree` of their number, whichever words were substituted. No overlap is missed: the masks for a length are
such that each choice of substituted words that leaves enough agreement leaves all words of some mask alone (covers()). Masks for
short items are used only where the benchmark has such items.

Hits of a document and an item are gathered as the set of their diagonals, each of which is scored once, by a running count: in time that is linear in the item.

Benchmarks are small against corpora, but that is checked: up to `broadcast_rows` seeds the hashes are broadcast and the texts
are never shuffled; beyond it the hashes are joined by a shuffle. Hits return to the words of their documents in the same way: broadcast up to that number, else by a shuffle.

Everything is made of DataFrame functions. Defined results: null and empty texts overlap nothing; very long texts and items are worked through whole; of equally good
places the first is named; other columns, whatever they are called, are never read by overlaps() and kept by decontaminate(); items of fewer than
`least_words` words are too short to tell and are skipped; repeated items count once, under their smallest id; rows of one
document id give one row for each item; rows without an id are reported under null and kept by decontaminate(); empty tables
give no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: 1: the word counts, 0: it is ignored. The first of these that covers a length is used for it; each mask starts and ends with 1.
MASKS = (("11010011",), ("1111", "11101"))


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def covers(masks: tuple[str, ...], size: int, needed: int) -> bool:
    """Whether any `needed` agreeing words among `size` hold all words of some mask."""
    places = [{k + j for j, c in enumerate(mask) if c == "1"} for mask in masks for k in range(size - len(mask) + 1)]
    return all(any(p.isdisjoint(gone) for p in places) for gone in combinations(range(size), size - needed))


def masks_for(size: int, needed: int) -> tuple[str, ...]:
    """Masks that cover a length: known ones for lengths that can be enumerated, else the run of words that always stays whole."""
    known = (masks for masks in MASKS if size <= 16 and covers(masks, size, needed))
    return next(known, ("1" * max(1, math.ceil(needed / (size - needed + 1))),))


def _hash(words: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, at + j) for j, c in enumerate(mask) if c == "1"])


def _item_seeds(words: Column, mask: str) -> Column:
    """(at, hash) at every word where the mask fits; null for items with fewer words than the mask."""
    return F.when(F.size(words) >= len(mask), F.transform(F.sequence(F.lit(0), F.size(words) - len(mask)), lambda i: F.struct(i.alias("at"), _hash(words, i, mask).alias("hash"))))


def _seeds(words: Column, masks: list[str]) -> Column:
    """(at, h0, h1, ...) at every word where the shortest mask fits; null for texts with fewer words."""
    span = min(map(len, masks))
    def at(i: Column) -> Column:
        return F.struct(i.cast("int").alias("at"), *[_hash(words, i, mask).alias(f"h{k}") for k, mask in enumerate(masks)])

    return F.when(F.size(words) >= span, F.transform(F.sequence(F.lit(0), F.size(words) - span), at))


def _run(doc: Column, item: Column, shift: Column, window: int) -> Column:
    """Agreeing words in the best window of the aligned words of an item at places shift, shift + 1, ... of doc: a running count along the diagonal."""
    low, high = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(doc) - shift)
    same = lambda j: F.when(F.get(item, j) == F.get(doc, j + shift), 1).otherwise(0)  # noqa: E731  0 outside of either

    def step(x: Column, j: Column) -> Column:
        now = x["now"] + same(j) - same(j - window)
        return F.when(x["best"] >= window, x).otherwise(F.struct(now.alias("now"), F.greatest(x["best"], now).alias("best")))

    run = F.reduce(F.sequence(low, high - 1), F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda x: x["best"])
    return F.when(high > low, run).otherwise(0)


def _best(doc: Column, item: Column, shifts: Column, window: int) -> Column:
    """shift and matched of the diagonal that agrees most, the first of them; behind one that agrees wholly no other is looked at."""
    whole = F.least(F.size(item), F.lit(window))

    def step(x: Column, shift: Column) -> Column:
        better = F.transform(F.array(_run(doc, item, shift, window)), lambda m: F.when(m > x["matched"], F.struct(shift.alias("shift"), m.alias("matched"))).otherwise(x))[0]
        return F.when(x["matched"] >= whole, x).otherwise(better)

    return F.reduce(shifts, F.struct(F.lit(0).alias("shift"), F.lit(0).alias("matched")), step)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, agree: float = 0.8, least_words: int = 8, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, at (the document's word over the item's first), matched (agreeing words in the best window)
    and needed, of every document and item that overlap: the place of the most agreement for each."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item")).where(F.size("item") >= least_words).groupBy("item").agg(F.min("item_id").alias("item_id"))
    items = written(items, "items")
    lengths = [r.n for r in items.select(F.least(F.size("item"), F.lit(window)).alias("n")).distinct().collect()]
    lengths_of: dict[str, list[int]] = {}
    for n in sorted(lengths):
        for mask in masks_for(n, math.ceil(n * agree)):
            lengths_of.setdefault(mask, []).append(n)
    masks = list(lengths_of) or list(MASKS[0])
    own = lambda mask: F.when(F.least(F.size("item"), F.lit(window)).isin(lengths_of.get(mask, [])), _item_seeds(F.col("item"), mask))
    seeds = items.select("item_id", F.explode(F.array(*map(own, masks))).alias("s")).select("item_id", F.explode("s").alias("s"))
    seeds = written(seeds.select("item_id", F.col("s.at").alias("item_at"), "s.hash"), "seeds")
    size = F.least(F.size("item"), F.lit(window))
    needed = F.ceil(size * agree).cast("int")

    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    # With the seeds as a plain column, the explosion and the broadcast join are one generated loop that never copies the words.
    # The outer forms keep the optimizer from inferring filters, below which all words would be split again for each seed.
    found = words.withColumn("seeds", _seeds(F.col("words"), masks)).select("doc_id", F.explode_outer("seeds").alias("s"))
    found = found.select("doc_id", F.col("s.at").alias("at"), F.explode_outer(F.array(*[F.col(f"s.h{k}") for k in range(len(masks))])).alias("hash"))
    small = seeds.count() <= broadcast_rows
    met = found.join(F.broadcast(seeds) if small else seeds, "hash").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    # However many seeds meet along a diagonal, it is scored once. Its numbers are those of places in two texts.
    near = written(met.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set("shift")).alias("shifts")), "near").withColumnRenamed("doc_id", "hit_id")
    few = near.agg(F.coalesce(F.sum(F.size("shifts") + 4), F.lit(0))).first()[0] <= broadcast_rows
    hits = words.join(F.broadcast(near) if few else near, F.col("doc_id").eqNullSafe(F.col("hit_id"))).join(F.broadcast(items) if small else items, "item_id")
    matched = hits.select("doc_id", "item_id", _best(F.col("words"), F.col("item"), F.col("shifts"), window).alias("b"), needed.alias("needed"))
    # As one element of a list, a score is computed once, not again for each use.
    matched = matched.select("doc_id", "item_id", F.explode_outer(F.filter(F.array(F.struct("b.shift", "b.matched", "needed")), lambda x: x["matched"] >= x["needed"])).alias("b")).where("b IS NOT NULL")
    best = matched.groupBy("doc_id", "item_id").agg(F.max_by("b", F.struct("b.matched", -F.col("b.shift"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.shift").alias("at"), F.col("b.matched").alias("matched"), F.col("b.needed").alias("needed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """docs without those that overlap an item."""
    bad = written(overlaps(docs, benchmark, **options).select("doc_id").distinct(), "leaks")
    return docs.join(bad, "doc_id", "left_anti")
