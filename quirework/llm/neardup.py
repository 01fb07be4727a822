"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find.

1. One pass over the texts gives each document the size of its set of word shingles, a 128-bit fingerprint of that set
   and the band keys of its SuperMinHash signature. Documents with one fingerprint are one class, under its smallest id.
2. Classes that share a band key share a bucket. Every bucket is named by its smallest class, and buckets of one
   name are one group, which a class joins once however many bands it shares. Buckets of one class are left.
3. The full sets of classes in groups are compared inside blocks of bounded size, by a matrix product of set
   membership. A task says which classes its union-find joined, never all pairs of a group.
4. In groups of several blocks, classes that this joined to the group's main component need no further comparison with each
   other. The open ones are dealt to blocks of their own, which meet all blocks of the group. Thus every pair in a bucket is
   compared or known to be in one component, and a group is sent once for each block of open classes, not for each of its blocks.
5. Where open classes fill more than `most_open` blocks, as those of texts that share a long passage and nothing else do, groups first fall into finer ones, without loss: two sets
   of the needed similarity share one of the first n - ceil(threshold * n) + 1 shingles of either, in any common order. The order puts shingles last that
   many classes of a block hold, so texts meet by what is their own. Steps 2 to 4 then go on with these buckets instead of those of bands.
6. Components of the joined classes, by joins, then hand back to every document.

Two documents are linked if 100 * |intersection| >= 100 * threshold * |union|. With 128 values in bands of four, a pair at
0.75 shares no band with a probability of 5e-6, a pair at 0.8 of 5e-8.

Defined results: null texts and texts without words have an empty set and link with nothing; repeated rows and ties are one class; the
smallest id of a component is its name. Very long texts are worked through alone, their signature in parts. An empty table gives no rows; columns
other than the id and the text are never read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix64, portions, small_batches, text_bytes, word_hashes, word_spans, written
from .components import components

_WEIGHTS = mix64(np.arange(1, 65, dtype=np.uint64))


def shingle_sets(texts: pa.Array, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct word shingles of all texts one after another, and their n + 1 offsets."""
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    s, e, at = word_spans(raw, offsets)
    words = word_hashes(raw, s, e)
    with np.errstate(over="ignore"):
        full = np.zeros(max(len(words) - ngram + 1, 0), np.uint64)
        for k in range(ngram):
            full += words[k : k + len(full)] * _WEIGHTS[k]
        full = mix64(full)
        sets = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= ngram:
                sets.append(np.unique(full[a : b - ngram + 1]))
            elif b > a:  # fewer words: the whole sequence is the one shingle
                sets.append(mix64(np.array([(words[a:b] * _WEIGHTS[: b - a]).sum() + _WEIGHTS[-1] * np.uint64(b - a)], np.uint64)))
            else:
                sets.append(full[:0])
    return np.concatenate(sets) if sets else full[:0], np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def superminhash(elements: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """A SuperMinHash signature (a row of `size` values) of each set; empty sets have infinite values.

    Element x gives slot p_j(x) the value j + r_j(x), where p(x) is a random permutation of the slots that is
    dealt out rank by rank. A set is done as soon as all its values are below the next rank, which for sets of more
    than a few hundred elements is after one to three ranks.
    """
    n = len(offsets) - 1
    out = np.full((n, size), np.inf)
    alive = np.flatnonzero(np.diff(offsets))
    owner = np.repeat(np.arange(n), np.diff(offsets))
    own = elements
    places: np.ndarray | None = None
    unit = 2.0**-53
    with np.errstate(over="ignore"):
        for j in range(size):
            draw = mix64(own ^ mix64(np.array([2 * j + 1], np.uint64)))
            rank = j + (mix64(draw) >> np.uint64(11)).astype(float) * unit
            k = j + ((draw >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
            if places is None and j == 0:
                slot = k
            else:
                row = np.arange(len(own))
                slot = places[row, k].astype(np.int64)
                places[row, k] = places[:, j]
            np.minimum.at(out.reshape(-1), owner * size + slot, rank)
            left = alive[out[alive].max(1) >= j + 1]
            if not len(left):
                break
            if len(left) < len(alive) or places is None:
                keep = np.isin(owner, left) if len(left) < len(alive) else slice(None)
                if places is None:  # after the first rank: the slot taken now holds what stood in front
                    own, owner, k = own[keep], owner[keep], k[keep]
                    places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(own), 1))
                    places[np.arange(len(own)), k] = 0
                else:
                    own, owner, places = own[keep], owner[keep], places[keep]
                alive = left
    return out


def signatures(elements: np.ndarray, offsets: np.ndarray, size: int, most: int = 1 << 20) -> np.ndarray:
    """superminhash() of sets of any size: a large set's signature is the minimum over those of its parts."""
    out = np.full((len(offsets) - 1, size), np.inf)
    large = np.diff(offsets) > most
    small = np.repeat(~large, np.diff(offsets))
    if not large.any():
        return superminhash(elements, offsets, size)
    out[~large] = superminhash(elements[small], np.concatenate([[0], np.cumsum(np.diff(offsets)[~large])]), size)
    for i in np.flatnonzero(large):
        for low in range(offsets[i], offsets[i + 1], most):
            part = elements[low : min(low + most, offsets[i + 1])]
            out[i] = np.minimum(out[i], superminhash(part, np.array([0, len(part)]), size)[0])
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of `rows` values; different bands have different keys."""
    with np.errstate(over="ignore"):
        bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), -1, rows)
        keys = (mix64(bits) * _WEIGHTS[:rows]).sum(2, dtype=np.uint64)
        return mix64(keys + mix64(np.arange(bits.shape[1], dtype=np.uint64))).view(np.int64)


def fingerprints(sets: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit fingerprint of each set: a sum of mixed elements."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ _WEIGHTS[40 + k]))])
        return np.diff(total[offsets]).view(np.int64)


def _signed(docs: DataFrame, ngram: int, size: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                sets, offsets = shingle_sets(part.column("text"), ngram)
                prints = [fingerprints(sets, offsets, k) for k in (0, 1)]
                keys = band_keys(signatures(sets, offsets, size), rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(prints[0]), pa.array(prints[1]), lists], ["doc_id", "n_shingles", "print_a", "print_b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>")


def _sets(docs: DataFrame, ngram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                sets, offsets = shingle_sets(part.column("text"), ngram)
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets * 8), pa.py_buffer(sets)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(sets, offsets, 0)), whole.cast(pa.binary())], ["rep", "print_a", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, print_a long, shingles binary")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set."""
    both = [*left, *right]
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    values, column = np.unique(np.concatenate(both), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1  # what only one set has adds to no intersection
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(shared.sum()), chunk):
        a, b = np.searchsorted(column, [low, low + chunk])
        has = np.zeros((len(both), chunk), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def _forest(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Union-find over links between places of ids: each joined id with the smallest of its tree."""
    top = np.arange(len(ids))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        if x != y:
            if ids[x] > ids[y]:
                x, y = y, x
            top[y] = x
    return [(int(ids[find(i)]), int(ids[i])) for i in range(len(ids)) if find(i) != i]


def _joined(blocks: DataFrame, threshold: float, common: float | None = None) -> DataFrame:
    """Links (a, b) that span what each block joins; hub is null. blocks: block, side (0 or 1), rep, print_a, shingles.

    A block with one side is compared within itself, one with two sides across. With `common`, and a column n_blocks, blocks of groups of several also tell the shingles that
    at least that share of their classes holds: a is the shingle, b the number of classes, hub the group.
    """
    percent = round(100 * threshold)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["side", "rep", "print_a"]).sort_values(["side", "rep"])
        ids, side = rows["rep"].to_numpy(), rows["side"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        sizes = np.array([len(x) for x in sets], float)
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1) if (side == 1).any() else first
        if len(first) and len(second):
            both = _overlaps([sets[i] for i in first], [sets[i] for i in second])
            union = sizes[first][:, None] + sizes[second][None, :] - both
            x, y = np.nonzero((100 * both >= percent * union) & (union > 0))
            pairs = np.stack([first[x], second[y]], 1)
            links = _forest(ids, pairs[pairs[:, 0] != pairs[:, 1]])
        else:
            links = []
        out = pd.DataFrame(links, columns=["a", "b"], dtype="int64").assign(hub=pd.array([pd.NA] * len(links), "Int64"))
        if common is None or rows["n_blocks"].iloc[0] == 1:
            return out
        values, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n >= max(2, common * len(sets))
        told = pd.DataFrame({"a": values[often].view(np.int64), "b": n[often].astype(np.int64)}).assign(hub=pd.array([int(rows["hub"].iloc[0])] * int(often.sum()), "Int64"))
        return pd.concat([out, told]) if len(out) else told

    return blocks.groupBy("block").applyInPandas(run, "a long, b long, hub long")


def _prefixes(rows: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """(hub, shingle, rep, print_a, n_shingles, open): of each class the shingles of which any set of the needed similarity must share one.

    rows: block, hub, rep, print_a, n_shingles, open, shingles; common: block, shingle, n. Shingles come in the order of n (0 for those not in common), then of their value.
    """
    percent = round(100 * threshold)

    def run(rows: pd.DataFrame, often: pd.DataFrame) -> pd.DataFrame:
        values = often["shingle"].to_numpy().astype(np.int64).view(np.uint64)
        turn = np.argsort(values)
        values, counts = values[turn], often["n"].to_numpy()[turn]
        parts = []
        for shingles in rows["shingles"]:
            own = np.frombuffer(shingles, np.uint64)
            at = np.minimum(np.searchsorted(values, own), max(len(values) - 1, 0))
            n = np.where(values[at] == own, counts[at], 0) if len(values) else np.zeros(len(own), np.int64)
            parts.append(own[np.argsort(n, kind="stable")[: len(own) - -(-percent * len(own) // 100) + 1]])
        sizes = [len(x) for x in parts]
        out = rows[["hub", "rep", "print_a", "n_shingles", "open"]].loc[rows.index.repeat(sizes)]
        return out.assign(shingle=np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return rows.groupBy("block").cogroup(common.groupBy("block")).applyInPandas(run, "hub long, rep long, print_a long, n_shingles long, open boolean, shingle long")


def _sized(member: DataFrame, by: list[str], block_rows: int, block_shingles: int, name: str = "n_blocks") -> DataFrame:
    """The number of blocks of each group of member."""
    groups = member.groupBy(*by).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    return groups.select(*by, F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("weight") / block_shingles)).cast("int").alias(name))


def _across(large: DataFrame) -> DataFrame:
    """Blocks of two sides for groups of several blocks (n_blocks, n_open): open classes, dealt anew to as few blocks as hold them, meet every block of their group.

    So a group of n classes is sent once for each block of open classes it has, and its open ones once for each of its blocks.
    """
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block, again = F.pmod(F.xxhash64("print_a", "rep"), F.col("n_blocks")).cast("int"), F.pmod(F.xxhash64("rep", "print_a"), F.col("n_open")).cast("int")
    left = large.where("open").select("hub", again.alias("i"), "rep", "print_a", other("n_blocks").alias("j"), F.lit(0).alias("side"))
    right = large.select("hub", block.alias("j"), "rep", "print_a", other("n_open").alias("i"), F.lit(1).alias("side"))
    return left.unionByName(right).select(F.struct("hub", "i", "j").alias("block"), "side", "rep", "print_a")


def _members(buckets: DataFrame, by: list[str], where: str = "true") -> DataFrame:
    """(hub, print_a) of classes in buckets (by, doc_id or rep as id, print_a): a bucket is named by its smallest id, and those of one class are left.

    All rows are shuffled twice: first as minima, for which copies and hot keys combine before, then as key and fingerprint, no more.
    """
    named = buckets.groupBy(*by).agg(F.min("id").alias("name"), F.min("print_a").alias("first"), F.max("print_a").alias("last"), F.bool_or(F.expr(where)).alias("wanted")).where("first <> last AND wanted")
    return buckets.select(*by, "print_a").join(named.select(*by, "name").hint("merge"), by).select(F.col("name").alias("hub"), "print_a").distinct()


def near_duplicates(docs: DataFrame, ngram: int = 5, threshold: float = 0.75, size: int = 128, rows: int = 4, block_rows: int = 192, block_shingles: int = 1_000_000, broadcast_ids: int = 2_000_000, most_open: int = 3, common: float = 0.05) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    `size` signature values in bands of `rows`. A block has about block_rows classes and block_shingles shingles.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = written(_signed(docs, ngram, size, rows), "signed")
    classes = written(signed.where("n_shingles > 0").groupBy("n_shingles", "print_a", "print_b").agg(F.min("doc_id").alias("rep")), "classes")
    named_classes = classes.where("rep IS NOT NULL").select("print_a", "rep", "n_shingles")

    def sets_of(ids: DataFrame) -> DataFrame:
        """Full sets of the documents of the ids. Up to a checked number the ids go to the texts, beyond it both are shuffled."""
        ids = written(ids.select(F.col("rep").alias("doc_id")).distinct(), "ids")
        return _sets(docs.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "doc_id", "left_semi"), ngram)

    def grouped(member: DataFrame) -> DataFrame:
        """Classes in groups with n_blocks. Grouped sides are written before they are joined: both sides of the joins then are plain shuffles, whose hot keys Spark can split."""
        member = written(member, "members")
        return written(member.join(written(_sized(member, ["hub"], block_rows, block_shingles), "groups"), "hub"), "grouped")

    def inside(member: DataFrame) -> DataFrame:
        """What the blocks of groups join within themselves, and common shingles of groups of several."""
        block = F.pmod(F.xxhash64("print_a", "rep"), F.col("n_blocks")).cast("int")
        blocks = member.select(F.struct("hub", block.alias("i"), F.lit(-1).alias("j")).alias("block"), "hub", "n_blocks", F.lit(0).alias("side"), "rep", "print_a")
        return written(_joined(blocks.join(sets_of(member), ["rep", "print_a"]), threshold, common), "links")

    def still_open(member: DataFrame, links: DataFrame) -> DataFrame:
        """Classes in groups of several blocks: open if they aren't in their group's largest component, and the number of blocks that open ones fill."""
        known = components(links).select(F.col("node").alias("rep"), "component")
        large = member.where("n_blocks > 1").join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        main = written(large.groupBy("hub", "component").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("main")), "main")
        large = written(large.join(main, "hub").select("hub", "rep", "print_a", "n_shingles", "n_blocks", (F.col("component") != F.col("main")).alias("open")), "large")
        return large.join(written(_sized(large.where("open"), ["hub"], block_rows, block_shingles, "n_open"), "opened"), "hub")

    def across(large: DataFrame) -> DataFrame:
        return written(_joined(written(_across(large), "across").join(sets_of(large), ["rep", "print_a"]), threshold), "links")

    def finer(large: DataFrame, common: DataFrame) -> DataFrame:
        """Classes in groups of shared prefixes; pairs of classes that aren't open need no comparison, so buckets of such classes alone are left."""
        block = F.pmod(F.xxhash64("print_a", "rep"), F.col("n_blocks")).cast("int")
        of = large.select(F.struct("hub", block.alias("i")).alias("block"), "hub", "rep", "print_a", "n_shingles", "open").join(sets_of(large), ["rep", "print_a"])
        hubs = written(large.select("hub", "n_blocks").distinct(), "hubs")
        often = written(common.groupBy("hub", "shingle").agg(F.sum("n").alias("n")), "common")
        often = often.join(hubs, "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("i"), "shingle", "n").select(F.struct("hub", "i").alias("block"), "shingle", "n")
        prefixes = written(_prefixes(of, often, threshold), "prefixes")
        member = _members(prefixes.select("hub", "shingle", F.col("rep").alias("id"), "print_a", "open"), ["hub", "shingle"], "open")
        return member.join(named_classes, "print_a")

    band = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "print_a", F.explode("bands").alias("key"))
    member = grouped(_members(band, ["key"]).join(named_classes, "print_a"))
    found = inside(member)
    links = found.where("hub IS NULL").select("a", "b")
    if not member.where("n_blocks > 1").isEmpty():
        large = written(still_open(member, links), "open")
        if not (few := large.where(F.col("n_open") <= most_open)).isEmpty():
            links = links.unionByName(across(few).select("a", "b"))
        if not (many := large.where(F.col("n_open") > most_open)).isEmpty():
            member = grouped(finer(many, found.where("hub IS NOT NULL").select("hub", F.col("a").alias("shingle"), F.col("b").alias("n"))))
            links = links.unionByName(inside(member).where("hub IS NULL").select("a", "b"))
            if not member.where("n_blocks > 1").isEmpty():
                links = links.unionByName(across(written(still_open(member, links), "open")).select("a", "b"))

    joined = components(links)
    named = classes.select("rep", "n_shingles", "print_a", "print_b").join(joined, F.col("rep") == F.col("node"), "left")
    named = named.select("n_shingles", "print_a", "print_b", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "print_a", "print_b").join(named, ["n_shingles", "print_a", "print_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
