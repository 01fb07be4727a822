"""Near-duplicate embeddings: a forest of random-projection trees with spill overlap.

Every vector has projections on a pool of random directions. For each label and length, trees are grown on a bounded sample (about `sample_rows` vectors): a node that
stands for more vectors than a leaf shall hold is cut at a quantile of one of a few directions drawn for it, where fewest vectors stand, and vectors closer to the
cut than a margin go to both sides. The trees have a size bounded by the sample; one pass routes every vector through them to its leaves. Leaves that come
out too large all the same, as they do where the table is far larger than the sample, are split further in distributed rounds, until they are small or splitting
no longer helps (many vectors at one place); such leaves are compared in blocks, so no task holds more than two blocks. Equal vectors of one label are a class.

Within a leaf a matrix product gives all cosines. A pair that meets in several leaves counts in the smallest of their common leaves
only, so the numbers of links add up without a table of pairs, and a leaf says what its union-find joined and nothing more. A pair at
the threshold is parted by one split with a probability of about 0.025; trees of five levels part it with about 0.12, and all eight of them
with less than 1e-7.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without label or id, link with
nothing and are their own component; vectors of different lengths never link; equal vectors, ties and repeated rows link with each other; an empty
table gives no rows; other columns are never read, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import discard, small_batches, written
from .components import components

POOL = 64


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values (a row each) of the usable vectors of a list column, those of one length together."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        x = values[starts[at][:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        if ok.any():
            yield at[ok], x[ok]


def normed(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, without overflow or underflow in the norm."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def projected(x: np.ndarray) -> np.ndarray:
    pool = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], POOL))
    return (normed(x) @ (pool / np.linalg.norm(pool, axis=0))).astype(np.float32)


@dataclass
class Tree:
    """Nodes: the direction of the pool that each is cut by (-1: a leaf), the cut, and the two nodes below."""

    direction: np.ndarray
    cut: np.ndarray
    below: np.ndarray

    def route(self, proj: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves of all rows."""
        row, node = np.arange(len(proj)), np.zeros(len(proj), np.int64)
        rows, leaves = [], []
        while len(row):
            end = self.direction[node] < 0
            rows.append(row[end])
            leaves.append(node[end])
            row, node = row[~end], node[~end]
            place = proj[row, self.direction[node]]
            left, right = place < self.cut[node] + near, place >= self.cut[node] - near
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.below[node[left], 0], self.below[node[right], 1]])
        return np.concatenate(rows), np.concatenate(leaves)


def grow(proj: np.ndarray, stands_for: float, leaf_size: int, near: float, rng: np.random.Generator, drawn: int = 3, least: int = 64, most_shared: float = 0.3) -> Tree:
    """A tree on a sample, each row of which stands for so many vectors."""
    direction, cut, below = [-1], [0.0], [(0, 0)]
    todo = [(0, np.arange(len(proj)))]
    while todo:
        node, own = todo.pop()
        if len(own) * stands_for <= leaf_size or len(own) < least:
            continue
        best = (most_shared, 0, 0.0)
        for d in rng.choice(POOL, drawn, replace=False):
            place = proj[own, d]
            for m in np.quantile(place, (0.5, 0.25, 0.75)):
                if (share := float((np.abs(place - m) < near).mean())) < best[0]:
                    best = (share, int(d), float(m))
        place = proj[own, best[1]]
        sides = own[place < best[2] + near], own[place >= best[2] - near]
        if best[0] >= most_shared or max(map(len, sides)) > 0.95 * len(own):
            continue  # many at one place
        direction[node], cut[node], below[node] = best[1], best[2], (len(cut), len(cut) + 1)
        for part in sides:
            todo.append((len(cut), part))
            direction.append(-1)
            cut.append(0.0)
            below.append((0, 0))
    return Tree(np.array(direction), np.array(cut), np.array(below))


Forest = dict[tuple[int, int], list[Tree]]


def fitted(usable: DataFrame, distance: float, trees: int, leaf_size: int, margin: float, sample_rows: int) -> Forest:
    """Trees by label and length, from about sample_rows vectors chosen by a hash of the id. A label whose vectors fit into a leaf has none."""
    total = usable.count()
    chance = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for at, x in matrices(batch.column("embedding")):
                yield pa.RecordBatch.from_arrays([pa.array(labels[at]), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(projected(x).tolist(), pa.list_(pa.float32()))], ["label", "dim", "proj"])

    some = usable.where(chance < int(1e9 * min(1.0, sample_rows / max(total, 1)))).limit(2 * sample_rows)
    rows = some.mapInArrow(run, "label long, dim int, proj array<float>").toPandas()
    out: Forest = {}
    for (label, dim), own in rows.groupby(["label", "dim"]):
        proj = np.array(own["proj"].tolist(), np.float32)
        grown = [grow(proj, max(1.0, total / sample_rows), leaf_size, margin * distance / math.sqrt(dim), np.random.default_rng([t, dim])) for t in range(trees)]
        if any(len(t.cut) > 1 for t in grown):
            out[int(label), int(dim)] = grown
    return out


def routed(usable: DataFrame, forest: Forest, distance: float, margin: float) -> DataFrame:
    """vec_id, label, dim, vec (bytes of the components as they came) and leaves of usable rows."""
    single = isinstance(usable.schema["embedding"].dataType.elementType, FloatType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for at, x in matrices(batch.column("embedding")):
                dim = x.shape[1]
                own = labels[at]
                row, leaf = [np.flatnonzero(~np.isin(own, [lab for lab, d in forest if d == dim]))], []
                leaf.append(np.zeros(len(row[0]), np.int64))
                for label in np.unique(own):
                    if trees := forest.get((int(label), dim)):
                        mine = np.flatnonzero(own == label)
                        proj = projected(x[mine])
                        for t, tree in enumerate(trees):
                            r, k = tree.route(proj, margin * distance / math.sqrt(dim))
                            row.append(mine[r])
                            leaf.append(k + (t << 40))
                rows, names = np.concatenate(row), np.concatenate(leaf)
                order = np.lexsort((names, rows))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(at)))]).astype(np.int32)
                raw = (x.astype(np.float32) if single else x).copy()
                size = raw.strides[0]
                vec = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * size).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(own), pa.array(np.full(len(at), dim, np.int32)), vec, pa.ListArray.from_arrays(pa.array(offsets), pa.array(names[order]))], ["vec_id", "label", "dim", "vec", "leaves"])

    return usable.mapInArrow(run, "vec_id long, label long, dim int, vec binary, leaves array<long>")


def components_of(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else float).astype(float)


def split(large: DataFrame, distance: float, leaf_size: int, margin: float, cuts: int = 3, most_shared: float = 0.3, most_rounds: int = 24) -> DataFrame:
    """(rep, k1, label, dim, leaf): the smaller leaves of the classes of leaves that are too large (with vec), all nodes split at once in each round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()):
                own = batch.filter(pc.equal(batch.column("dim"), int(dim)))
                x = np.stack([components_of(v, dim) for v in own.column("vec").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("rep", "k1", "label", "dim", "leaf")), pa.array(projected(x).tolist(), pa.list_(pa.float32()))], ["rep", "k1", "label", "dim", "leaf", "proj"])

    start = large.select("rep", "k1", "label", "dim", "leaf", "vec").mapInArrow(run, "rep long, k1 long, label long, dim int, leaf long, proj array<float>")
    state = start.select("rep", "k1", "label", "dim", "proj", F.xxhash64("label", "dim", "leaf").alias("node"), F.lit(None).cast("long").alias("parent"))
    done: list[DataFrame] = []
    last: DataFrame | None = None
    for turn in range(most_rounds):
        state = written(state, "nodes")
        if last is not None:
            discard(last)
        last = state
        sizes = state.groupBy("node").agg(F.count("*").alias("n"), F.max("parent").alias("parent"))
        stop = (F.col("n") <= leaf_size) | (F.col("parent").isNotNull() & (F.col("n") > 0.95 * F.col("parent")))
        sizes = written(sizes.select("node", "n", (stop if turn < most_rounds - 1 else F.lit(True)).alias("stop")), "sizes")
        done.append(written(state.join(sizes.where("stop"), "node").select("rep", "k1", "label", "dim", F.col("node").alias("leaf")), "ended"))
        if sizes.where("NOT stop").isEmpty():
            break
        # `cuts` projections of the pool for each node, one from each stretch of it.
        picks = [F.pmod(F.xxhash64("node", F.lit(c)), F.lit(POOL // cuts)).cast("int") + F.lit(1 + c * (POOL // cuts)) for c in range(cuts)]
        going = state.join(sizes.where("NOT stop").select("node", "n"), "node").select("rep", "k1", "label", "dim", "proj", "node", "n", *[F.element_at("proj", p).alias(f"p{c}") for c, p in enumerate(picks)])
        # Of three quantiles of each projection the one with the fewest classes around it; none where many stand at one place.
        quantiles = going.groupBy("node").agg(*[F.percentile_approx(f"p{c}", [0.25, 0.5, 0.75], 1000).alias(f"q{c}") for c in range(cuts)])
        near = F.lit(margin * distance) / F.sqrt("dim")
        beside = going.join(quantiles, "node").withColumn("near", near)
        crowd = beside.groupBy("node").agg(*[F.struct(F.avg((F.abs(F.col(f"p{c}") - F.col(f"q{c}")[k]) < F.col("near")).cast("double")).alias("share"), F.lit(k).alias("k")).alias(f"o{c}{k}") for c in range(cuts) for k in range(3)])
        best = [F.least(*[F.col(f"o{c}{k}") for k in (1, 0, 2)]) for c in range(cuts)]
        chosen = crowd.select("node", *[F.when(b["share"] <= most_shared, b["k"]).alias(f"k{c}") for c, b in enumerate(best)])
        at = written(quantiles.join(chosen, "node").select("node", *[F.get(f"q{c}", F.col(f"k{c}")).alias(f"m{c}") for c in range(cuts)]), "cuts")
        parted = going.withColumn("near", near).join(at, "node")
        stuck = F.coalesce(*[F.col(f"m{c}") for c in range(cuts)]).isNull()
        done.append(written(parted.where(stuck).select("rep", "k1", "label", "dim", F.col("node").alias("leaf")), "ended"))
        parted = parted.where(~stuck)
        for c in range(cuts):
            p, m = F.col(f"p{c}"), F.col(f"m{c}")
            sides = F.array_compact(F.array(F.when(p < m + F.col("near"), 0), F.when(p >= m - F.col("near"), 1)))
            parted = parted.withColumn(f"s{c}", F.explode(F.when(m.isNull(), F.array(F.lit(2))).otherwise(sides)))
        state = parted.select("rep", "k1", "label", "dim", "proj", F.xxhash64("node", *[f"s{c}" for c in range(cuts)]).alias("node"), F.col("n").alias("parent"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """(rep, k1, links, root) of what is linked within each block of a leaf or between two of its blocks."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "k1"]).reset_index(drop=True)
        unit = normed(np.stack([components_of(x, key[1]) for x in pdf["vec"]]))
        rep, k1, copies, part = (pdf[c].to_numpy() for c in ("rep", "k1", "copies", "part"))
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if key[3] != key[4]:
            linked &= part[:, None] != part[None, :]
        some = np.flatnonzero(linked.any(1))
        if not len(some):
            return pd.DataFrame({"rep": [], "k1": [], "links": [], "root": []}).astype("int64")
        linked, rep, k1, copies = linked[np.ix_(some, some)], rep[some], k1[some], copies[some]
        leaf = key[2]
        earlier = [x[x < leaf] for x in pdf["leaves"].to_numpy()[some]]
        names, place, seen = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
        has = np.zeros((len(some), len(names)), np.float32)
        has[np.repeat(np.arange(len(some)), [len(x) for x in earlier]), place] = 1
        has = has[:, seen > 1]
        first_here = linked & ~((has @ has.T) > 0) if has.shape[1] else linked
        label = np.arange(len(some))
        while True:  # the smallest place within reach: rows are sorted by id
            lower = np.minimum(label, np.where(linked, label[None, :], len(some)).min(1))
            if (lower == label).all():
                break
            label = lower
        return pd.DataFrame({"rep": rep, "k1": k1, "links": first_here @ copies, "root": rep[label]})

    return rows.groupBy("label", "dim", "leaf", "i", "j").applyInPandas(run, "rep long, k1 long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, trees: int = 8, leaf_size: int = 1024, margin: float = 0.5, sample_rows: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors."""
    small_batches(vectors.sparkSession)
    distance = math.sqrt(max(0.0, 2 - 2 * threshold))
    usable = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0")
    forest = fitted(usable, distance, trees, leaf_size, margin, sample_rows)
    keys = [F.xxhash64("label", "dim", "vec").alias("k1"), F.xxhash64(F.lit(1), "vec", "label", "dim").alias("k2")]
    units = written(routed(usable, forest, distance, margin).select("*", *keys), "units")
    classes = units.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), *[F.min_by(c, "vec_id").alias(c) for c in ("label", "dim", "vec", "leaves")])
    classes = written(classes, "classes")
    name = ["label", "dim", "leaf"]
    placed = classes.select("rep", "k1", "label", "dim", F.explode("leaves").alias("leaf"))
    sizes = written(placed.groupBy(*name).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    every = classes.select("rep", "k1", "copies", "vec", "leaves")
    too_large = sizes.where(F.col("n") > 4 * leaf_size)
    if not too_large.isEmpty():
        large = placed.join(too_large.select(*name), name).join(every.select("rep", "k1", "vec"), ["rep", "k1"])
        rest = placed.join(too_large.select(*name), name, "left_anti").select("rep", "k1", *name)
        placed = written(rest.unionByName(split(large, distance, leaf_size, margin).select("rep", "k1", *name)), "leaves")
        sizes = written(placed.groupBy(*name).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        every = every.drop("leaves").join(placed.groupBy("rep", "k1").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")), ["rep", "k1"])
    blocks = sizes.select(*name, F.ceil(F.col("n") / leaf_size).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(F.col("part"), other).alias("i"), F.greatest(F.col("part"), other).alias("j")))
    met = placed.join(blocks, name).withColumn("part", part).select("rep", "k1", *name, "part", F.explode(pairs).alias("b")).select("rep", "k1", *name, "part", "b.i", "b.j")
    found = written(_compare(met.join(every, ["rep", "k1"]), threshold), "found")
    links = found.groupBy("rep", "k1").agg(F.sum("links").alias("links"))
    joined = components(found.where("root <> rep").select(F.col("root").alias("a"), F.col("rep").alias("b")))
    named = classes.select("k1", "k2", "rep", "copies").join(links, ["rep", "k1"], "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = named.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    usable = units.select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
    broken = F.coalesce(F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | F.forall("embedding", lambda v: v == 0), F.lit(True))
    rest = vectors.select("vec_id", "label", "embedding").where(F.col("vec_id").isNull() | F.col("label").isNull() | broken)
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return usable.unionByName(alone)
