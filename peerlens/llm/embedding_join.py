"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with a cosine of at least c lie within a squared distance of 2 - 2c. After a random rotation a vector is cut
into blocks; each gets a share of that distance in proportion to its dimensions, so two vectors that link lie within the
share in at least one block. In a block a range join finds those pairs: a grid over some of its dimensions, with cells of
twice the range, puts every vector into its own cell and, as a guest, into the nearer neighbour in each dimension. How
many dimensions the grid takes follows from the number of vectors of the label, so that cells stay small. A pair is
examined in the first block that finds it, in the cell of its smaller name, and verified there in double precision, so
each link is found once and no pair leaves its task: what leaves are counts and the links of a spanning forest.

Equal vectors of a label are one class with a count. A cell with more classes than a task takes is cut into chunks that
meet two by two.

Vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link with nothing; so
do vectors of different lengths. A null id is no id: it counts as a vector, its component is named by the others.
Repeated rows are vectors like others. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .arrow_text import mixed, unpacked
from .components import components

LIKE = 0.93
BLOCKS = 8
CELL = 2048  # classes wanted in a cell
CHUNK = 4096  # classes of a cell that a task takes at once
SEED = 7
_SLACK = 1e-5  # of the filters in single precision; the check of a pair has none


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def cuts(d: int, blocks: int = BLOCKS) -> np.ndarray:
    """Bounds of the blocks of d dimensions."""
    return np.linspace(0, d, min(blocks, d) + 1).astype(int)


def _packed(kind: str):
    @F.arrow_udf("binary")
    def packed(vectors: pa.Array) -> pa.Array:
        """The components as bytes; null for a vector that links with nothing."""
        out = []
        for v in vectors:
            x = None if v.values is None else v.values
            if x is None or not len(x) or x.null_count:
                out.append(None)
                continue
            x = x.to_numpy(zero_copy_only=False).astype(kind)
            sound = np.isfinite(x).all() and (x != 0).any() and np.isfinite((x.astype(np.float64) ** 2).sum())
            out.append(x.tobytes() if sound else None)
        return pa.array(out, pa.binary())

    return packed


def _units(column: pa.Array, d: int, kind: str) -> np.ndarray:
    x = unpacked(column, kind)[0].reshape(-1, d).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _names(home: np.ndarray, near: np.ndarray) -> np.ndarray:
    """64-bit names of the own cell (first) and the guest cells of each class, from the coordinates one by one."""
    n, used = home.shape
    names = np.zeros((n, 1 << used), np.uint64)
    for guest in range(1 << used):
        for k in range(used):
            cell = home[:, k] + near[:, k] * ((guest >> k) & 1)
            names[:, guest] = mixed(names[:, guest] + cell.astype(np.uint64))
    return names


def _first_of_equal(names: np.ndarray) -> np.ndarray:
    """Marks each name of a row but for repeats, so that a class lies in a cell once even if two cells share a name."""
    order = np.argsort(names, axis=1, kind="stable")
    ranked = np.take_along_axis(names, order, 1)
    first = np.ones(names.shape, bool)
    first[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    out = np.empty_like(first)
    np.put_along_axis(out, order, first, 1)
    return out


def _cells(like: float, blocks: int, kind: str):
    """Each class in its own cell and in those it is a guest of, for every block."""
    size = np.dtype(kind).itemsize

    def run(batches):
        for batch in batches:
            data, lengths, grid = batch["data"], np.asarray([len(b) // size for b in batch["data"].to_pylist()]), batch["grid"].to_numpy()
            for d, g in sorted(set(zip(lengths.tolist(), grid.tolist()))):
                rows = np.flatnonzero((lengths == d) & (grid == g))
                turned = _units(data.take(pa.array(rows)), d, kind) @ rotation(d)
                bounds = cuts(d, blocks)
                for b, (low, high) in enumerate(zip(bounds, bounds[1:])):
                    used = min(g, high - low)
                    side = 2 * np.sqrt((2 - 2 * like) * (high - low) / d) * 1.001
                    at = turned[:, low : low + used] / side
                    home = np.floor(at).astype(np.int64)
                    near = np.where(at - home < 0.5, -1, 1)
                    names = _names(home, near)
                    once = _first_of_equal(names)
                    for guest in range(1 << used):
                        kept = np.flatnonzero(once[:, guest])
                        n, take, name = len(kept), pa.array(rows[kept]), names[kept, guest].view(np.int64)
                        yield pa.RecordBatch.from_arrays([
                            batch["label"].take(take), pa.array(np.full(n, d)), pa.array(np.full(n, b)), pa.array(name), pa.array(np.full(n, guest == 0)),
                            batch["cls"].take(take), batch["m"].take(take), data.take(take)],
                            ["label", "d", "block", "cell", "home", "cls", "m", "data"])

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n over the links a - b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _links(like: float, blocks: int, kind: str):
    """cls, links (sum of the counts of the classes it links with), root (a class of its component here)."""

    def run(rows: pa.Table) -> pa.Table:
        d, b = rows["d"][0].as_py(), rows["block"][0].as_py()
        rows = rows.sort_by("cls")  # a pair is taken once: from its smaller name, where that is at home
        names, home, m, part = rows["cls"].to_numpy(), rows["home"].to_numpy(zero_copy_only=False), rows["m"].to_numpy(), rows["part"].to_numpy()
        across = rows["low"][0].as_py() != rows["high"][0].as_py()
        unit = _units(rows["data"].combine_chunks(), d, kind)
        turned = (unit @ rotation(d)).astype(np.float32)
        bounds = cuts(d, blocks)
        shares = (2 - 2 * like) * np.diff(bounds) / d + _SLACK
        x = turned[:, bounds[b] : bounds[b + 1]]
        square, ones = (x * x).sum(1)[:, None], np.ones((len(x), 1), np.float32)
        left, right = np.hstack([-2 * x, square, ones]), np.hstack([x, ones, square]).T.copy()  # their product is the squared distance
        at_home = np.flatnonzero(home)
        found = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(at_home), 256):
            own = at_home[at : at + 256]
            start = own[0] + 1  # all partners come later
            p, q = np.divmod(np.flatnonzero(left[own] @ right[:, start:] <= shares[b]), max(len(x) - start, 1))
            p, q = own[p], q + start
            later = (names[p] < names[q]) & (part[p] != part[q] if across else True)
            p, q = p[later], q[later]
            for k in range(0, len(p), 1 << 16):
                i, j = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                for e in range(b):  # an earlier block has it
                    gap = ((turned[i, bounds[e] : bounds[e + 1]] - turned[j, bounds[e] : bounds[e + 1]]) ** 2).sum(1)
                    gap_in = gap > shares[e]
                    i, j = i[gap_in], j[gap_in]
                ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= like
                found.append(np.stack([i[ok], j[ok]], 1))
        pairs = np.concatenate(found)
        links = np.zeros(len(names), np.int64)
        np.add.at(links, pairs[:, 0], m[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], m[pairs[:, 0]])
        who = np.flatnonzero(links)
        root = _forest(len(names), pairs[:, 0], pairs[:, 1])
        return pa.table({"cls": names[who], "links": links[who], "root": names[root[who]]})

    return run


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", like: float = LIKE,
    blocks: int = BLOCKS, cell: int = CELL, chunk: int = CHUNK,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    kind = "<f8" if vectors.schema[embedding].dataType.simpleString() == "array<double>" else "<f4"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), _packed(kind)(embedding).alias("data"))
    rows = rows.withColumn("cls", F.when(F.col("label").isNotNull() & F.col("data").isNotNull(), F.xxhash64("label", "data")))
    rows = written_table(rows, "embedding-rows")
    sound = rows.where("cls is not null")
    classes = sound.groupBy("cls").agg(F.first("label").alias("label"), F.first("data").alias("data"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    classes = written_table(classes, "embedding-classes")
    counts = classes.groupBy("label").agg(F.count("*").alias("n"))
    grid = F.least(F.greatest(F.ceil(F.log(F.col("n") / cell) / F.log(F.lit(2.5))), F.lit(0)), F.lit(8)).cast("int")  # halves or thirds the rest
    dealt = classes.join(counts.select("label", grid.alias("grid")), "label").select("label", "grid", "cls", "m", "data")
    label_type = classes.schema["label"].dataType.simpleString()
    schema = f"label {label_type}, d long, block long, cell long, home boolean, cls long, m long, data binary"
    cells = dealt.mapInArrow(_cells(like, blocks, kind), schema)
    keys = ["label", "d", "block", "cell"]
    sizes = cells.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).alias("parts"))
    cells = cells.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    found = cells.groupBy(*keys, "low", "high").applyInArrow(_links(like, blocks, kind), "cls long, links long, root long")
    found = written_table(found, "embedding-links")
    joined = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "embedding")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    at = classes.select("cls", "m", "least").join(links, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    at = written_table(at.select("cls", "m", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component")), "embedding-labelled")
    least = at.groupBy("component").agg(F.min("least").alias("component_id"))
    named = at.join(least, "component").select("cls", (F.col("m") - 1 + F.col("links")).alias("n_links"), "component_id")
    full = sound.join(named, "cls").select("vec_id", "n_links", "component_id")
    alone = rows.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
