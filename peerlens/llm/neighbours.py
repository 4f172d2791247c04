"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash function projects a vector on a random normal direction and cuts the line into slots. `tables` tables each join some
functions to a bucket. A query visits its own bucket and perturbed ones, a slot up or down in some of the functions, in the
order of their estimated success: the probability, over the normal spread of a neighbour's projection around the query's,
that a neighbour lies in just these slots. What the tables find is merged and ranked by exact distances.

The index holds every vector. Its parameters are fitted on a bounded sample: `FITTED` queries, whose true neighbours among
all rows one pass finds, give the width of the slots and the number of buckets to visit, such that at least `RECALL` of their
neighbours are found; `SAMPLED` rows give the number of functions, from the wish for `BUCKET` vectors in a bucket. If more
than `PROBES` buckets had to be visited, there are fewer functions; without any, all vectors share a bucket.

Buckets whose first functions agree go to one group; groups of many rows or of many queries are cut into chunks, each pair of
which is a task, so no bucket is capped. A query for which fewer than `k` candidates come up, or whose length is not the
most common one, is compared with all rows in blocks.

Equal vectors are one entry with their `k` + 1 smallest ids: more can't be among the nearest. Rows without an id or a sound
vector (null, zero, null or non-finite components) take no part; vectors of different lengths are no candidates for each
other. Repeated rows are one. Of several vectors with one id a query takes the smallest in bytes, and as a candidate the id
counts with its nearest. An empty table gives an empty result. Only the two columns named are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table
from .arrow_text import mixed, unpacked
from .embedding_join import _packed

K = 10
TABLES = 3
BUCKET = 48  # vectors wanted in a bucket
GROUP = 8192  # vectors wanted in a group of buckets
ROWS, QUERIES = 32768, 2048  # of a group that one task compares
PROBES = 1024  # buckets visited in a table, at most
FITTED, SAMPLED, RECALL = 128, 2048, 0.95
WIDTH = 2.0  # of a slot, in distances of the sample's last neighbours
SPARE = 8  # candidates kept beyond those asked for, until distances are exact
SEED = 12


@dataclass
class Index:
    """Hash functions and how far to look; `lines` (tables, functions, d) in slot widths, `spread` of a neighbour likewise."""

    lines: np.ndarray
    shifts: np.ndarray
    spread: float
    group: int  # functions that name a group
    probes: int

    @property
    def tables(self) -> int:
        return len(self.lines)

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.lines[table].T + self.shifts[table]

    def named(self, cells: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(group, bucket) of rows of slot numbers."""
        name = np.full(len(cells), table + 1, np.uint64)
        group = name
        for k in range(cells.shape[1]):
            name = _next(name, cells[:, k])
            if k + 1 == self.group:
                group = name
        return group.view(np.int64), name.view(np.int64)

    def visits(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(groups, buckets) that each query visits, in the order of estimated success."""
        at = self.places(x, table)
        cells = np.floor(at).astype(np.int64)
        within = at - cells
        cost, name = np.zeros((len(x), 1)), np.full((len(x), 1), table + 1, np.uint64)
        group = name
        for k in range(cells.shape[1]):
            steps = []
            for step in (-1, 0, 1):
                chance = _below((step + 1 - within[:, k]) / self.spread) - _below((step - within[:, k]) / self.spread)
                steps.append(-np.log(np.maximum(chance, 1e-300)))
            cost = np.concatenate([cost + s[:, None] for s in steps], 1)
            name = np.concatenate([_next(name, cells[:, k, None] + step) for step in (-1, 0, 1)], 1)
            group = name if k + 1 == self.group else np.concatenate([group] * 3, 1) if k + 1 > self.group else group
            if cost.shape[1] > self.probes:  # what is cut here could only come after what is kept
                kept = np.argpartition(cost, self.probes - 1, axis=1)[:, : self.probes]
                cost, name = np.take_along_axis(cost, kept, 1), np.take_along_axis(name, kept, 1)
                group = np.take_along_axis(group, kept, 1) if group.shape[1] > 1 else group
        order = np.argsort(cost, axis=1, kind="stable")
        group = np.broadcast_to(group, name.shape)
        return np.take_along_axis(group, order, 1).view(np.int64), np.take_along_axis(name, order, 1).view(np.int64)


def _next(name: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return mixed(name * np.uint64(0x9E3779B97F4A7C15) + cell.astype(np.uint64))


def _below(z: np.ndarray) -> np.ndarray:
    """Normal distribution function, by an approximation good to seven digits."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z > 0, 1 - tail, tail)


def _vectors(column, d: int, kind: str) -> np.ndarray:
    return unpacked(column, kind)[0].reshape(-1, d).astype(np.float64)


def _nearest(queries: np.ndarray, rows: np.ndarray, keep: int, best: tuple[np.ndarray, np.ndarray], at: np.ndarray, first: int) -> None:
    """Takes rows[first:] into the `keep` nearest of the queries `at`: squared distances and row numbers."""
    dist, who = best
    x, length = queries[at], (queries[at] ** 2).sum(1)
    for low in range(0, len(rows), 4096):
        part = rows[low : low + 4096]
        for q in range(0, len(at), 512):
            d2 = length[q : q + 512, None] + (part * part).sum(1) - 2 * (x[q : q + 512] @ part.T)
            number = np.broadcast_to(np.arange(first + low, first + low + len(part)), d2.shape)
            if len(part) > keep:
                kept = np.argpartition(d2, keep - 1, axis=1)[:, :keep]
                d2, number = np.take_along_axis(d2, kept, 1), np.take_along_axis(number, kept, 1)
            mine = at[q : q + 512]
            d2, number = np.concatenate([dist[mine], d2], 1), np.concatenate([who[mine], number], 1)
            kept = np.argpartition(d2, keep - 1, axis=1)[:, :keep]
            dist[mine], who[mine] = np.take_along_axis(d2, kept, 1), np.take_along_axis(number, kept, 1)


def _exact(queries: np.ndarray, rows: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of all that was kept, from the vectors themselves."""
    q, column = np.nonzero(who >= 0)
    r, out = who[q, column], np.empty(len(q))
    for k in range(0, len(q), 1 << 15):
        gap = queries[q[k : k + (1 << 15)]] - rows[r[k : k + (1 << 15)]]
        out[k : k + (1 << 15)] = np.sqrt((gap * gap).sum(1))
    return q, r, out


def _compared(kind: str, k: int):
    """cls, vec_id, score: for every query the nearest ids among the buckets that it visits here."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return pa.table({"cls": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        size, keep = np.dtype(kind).itemsize, k + 1 + SPARE
        d = len(rows["data"][0].as_py()) // size
        order = np.argsort(rows["bucket"].to_numpy(), kind="stable")
        bucket, x = rows["bucket"].to_numpy()[order], _vectors(rows["data"], d, kind)[order]
        names, first = np.unique(bucket, return_index=True)
        last = np.concatenate([first[1:], [len(bucket)]])
        visited, n = unpacked(queries["buckets"], "<i8")
        who = np.repeat(np.arange(len(queries)), n)
        at = np.searchsorted(names, visited)
        hit = np.flatnonzero(names[np.minimum(at, len(names) - 1)] == visited)
        by_bucket = hit[np.argsort(at[hit], kind="stable")]
        q = _vectors(queries["data"], d, kind)
        best = np.full((len(q), keep), np.inf), np.full((len(q), keep), -1)
        places, begins = np.unique(at[by_bucket], return_index=True)
        for place, begin, end in zip(places.tolist(), begins.tolist(), [*begins[1:].tolist(), len(by_bucket)]):
            _nearest(q, x[first[place] : last[place]], keep, best, who[by_bucket[begin:end]], int(first[place]))
        a, b, score = _exact(q, x, best[1])
        ids = rows["ids"].combine_chunks().take(pa.array(order[b]))
        per = ids.value_lengths().to_numpy()
        a, score, ids = np.repeat(a, per), np.repeat(score, per), ids.flatten().to_numpy()
        ranked = np.lexsort((ids, score, a))
        a, score, ids = a[ranked], score[ranked], ids[ranked]
        kept = np.arange(len(a)) - np.searchsorted(a, a) <= k
        return pa.table({"cls": queries["cls"].to_numpy()[a[kept]], "vec_id": ids[kept], "score": score[kept]})

    return run


def _indexed(index: Index, d: int, kind: str):
    """Every vector once per table, with its group and bucket."""

    def run(batches):
        for batch in batches:
            x = _vectors(batch["data"], d, kind)
            for table in range(index.tables):
                group, bucket = index.named(np.floor(index.places(x, table)).astype(np.int64), table)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(bucket), batch["ids"], batch["data"]], ["group", "bucket", "ids", "data"])

    return run


def _probing(index: Index, d: int, kind: str):
    """Every query once per group that it visits, with the buckets there."""

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 64):
                part = batch.slice(low, 64)
                x = _vectors(part["data"], d, kind)
                for table in range(index.tables):
                    groups, buckets = index.visits(x, table)
                    who = np.repeat(np.arange(len(x)), groups.shape[1])
                    order = np.lexsort((groups.ravel(), who))
                    who, group, bucket = who[order], groups.ravel()[order], buckets.ravel()[order]
                    fresh = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (group[1:] != group[:-1])]))
                    lists = [bucket[s:e].tobytes() for s, e in zip(fresh.tolist(), [*fresh[1:].tolist(), len(who)])]
                    at = pa.array(who[fresh])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(group[fresh]), part["cls"].take(at), part["data"].take(at), pa.array(lists, pa.binary())], ["group", "cls", "data", "buckets"])

    return run


def _searched(rows: DataFrame, queries: DataFrame, kind: str, k: int, most_rows: int, most_queries: int) -> DataFrame:
    """rows: group, bucket, ids, data; queries: group, cls, data, buckets. Large groups meet chunk by chunk."""
    parts = rows.groupBy("group").agg(F.ceil(F.count("*") / most_rows).alias("parts"))
    cuts = queries.groupBy("group").agg(F.ceil(F.count("*") / most_queries).alias("cuts"))
    sizes = written_table(parts.join(cuts, "group"), "neighbour-groups")
    left = rows.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("data"), "parts"))
    left = left.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    right = queries.join(sizes, "group").withColumn("cut", F.pmod(F.xxhash64("cls"), "cuts"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keys = ["group", "part", "cut"]
    left, right = left.select(*keys, "bucket", "ids", "data"), right.select(*keys, "cls", "data", "buckets")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compared(kind, k), "cls long, vec_id long, score double")
    return found.groupBy("cls", "vec_id").agg(F.min("score").alias("score"))


def _true_neighbours(sample: np.ndarray, kind: str, k: int):
    """q, score, data: the nearest entries of each sampled query in a task's rows, the query's own vector left out."""

    def run(batches):
        d, size = sample.shape[1], np.dtype(kind).itemsize
        best = np.full((len(sample), k), np.inf), np.full((len(sample), k), -1)
        held: dict[int, bytes] = {}
        seen = 0
        for batch in batches:
            x = _vectors(batch["data"], d, kind)
            for low in range(0, len(x), 4096):
                part = x[low : low + 4096]
                d2 = (sample**2).sum(1)[:, None] + (part**2).sum(1) - 2 * sample @ part.T
                d2[d2 <= 1e-12] = np.inf
                number = np.broadcast_to(np.arange(seen + low, seen + low + len(part)), d2.shape)
                d2, number = np.concatenate([best[0], d2], 1), np.concatenate([best[1], number], 1)
                kept = np.argpartition(d2, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(d2, kept, 1), np.take_along_axis(number, kept, 1)
            data = batch["data"]
            now = np.unique(best[1][np.isfinite(best[0])])
            held = {n: held[n] if n < seen else data[n - seen].as_py() for n in now.tolist()}
            seen += len(batch)
        q, column = np.nonzero(np.isfinite(best[0]))
        data = [held[n] for n in best[1][q, column].tolist()]
        assert all(len(v) == d * size for v in data)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[0][q, column]), pa.array(data, pa.binary())], ["q", "score", "data"])

    return run


def fitted(entries: DataFrame, queries: DataFrame, kind: str, d: int, k: int, tables: int, recall: float = RECALL) -> Index:
    """The index for entries (ids, data) of length d; what reaches the driver is bounded by FITTED * k and SAMPLED vectors."""
    some = lambda df, n: [r.data for r in df.select("data").orderBy(F.xxhash64("data"), "data").limit(n).collect()]
    matrix = lambda data: np.frombuffer(b"".join(data), kind).reshape(-1, d).astype(np.float64)
    asked, sample, n = matrix(some(queries, FITTED)), matrix(some(entries, SAMPLED)), entries.count()
    none = Index(np.zeros((1, 0, d)), np.zeros((1, 0)), 1.0, 0, 1)
    found = entries.select("data").mapInArrow(_true_neighbours(asked, kind, k), "q long, score double, data binary")
    best = F.row_number().over(Window.partitionBy("q").orderBy("score", "data"))
    found = found.withColumn("rank", best).where(F.col("rank") <= k).collect()
    if not found:
        return none
    who, neighbours = np.array([r.q for r in found]), matrix([r.data for r in found])
    far = float(np.median([math.sqrt(max(r.score, 0)) for r in found]))
    rng = np.random.default_rng(SEED)
    width, most = WIDTH * far, 32
    lines, shifts = rng.normal(size=(tables, most, d)) / width, rng.uniform(size=(tables, most))
    cells = np.floor(sample @ lines.reshape(-1, d).T + shifts.ravel())
    meet = float(np.mean([((c := np.unique(column, return_counts=True)[1]) / len(sample)) @ (c / len(sample)) for column in cells.T]))
    if meet >= 1 or n <= BUCKET:
        return none
    functions = min(math.ceil(math.log(BUCKET / n) / math.log(meet)), most)
    group = max(math.floor(math.log(GROUP / n) / math.log(meet)), 0) if n > GROUP else 0
    for m in range(functions, 0, -1):
        index = Index(lines[:, :m], shifts[:, :m], far / width, min(group, m), PROBES)
        rank = np.full(len(who), PROBES + 1)
        for table in range(tables):
            visits = np.concatenate([index.visits(asked[q : q + 64], table)[1] for q in range(0, len(asked), 64)])
            _, own = index.named(np.floor(index.places(neighbours, table)).astype(np.int64), table)
            same = visits[who] == own[:, None]
            rank = np.minimum(rank, np.where(same.any(1), same.argmax(1) + 1, PROBES + 1))
        needed = int(np.sort(rank)[math.ceil(recall * len(rank)) - 1])
        if needed <= PROBES:
            index.probes = needed
            return index
    return none


def nearest(
    vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, tables: int = TABLES,
    most_rows: int = ROWS, most_queries: int = QUERIES, recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of the rows for which `is_query` (a column of vec_id) holds."""
    kind = "<f8" if vectors.schema[embedding].dataType.simpleString() == "array<double>" else "<f4"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), _packed(kind)(embedding).alias("data"))
    rows = written_table(rows.where("vec_id is not null and data is not null"), "neighbour-rows")
    few = F.dense_rank().over(Window.partitionBy("data").orderBy("vec_id"))
    entries = rows.withColumn("place", few).where(F.col("place") <= k + 1).groupBy("data").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    size = np.dtype(kind).itemsize
    entries = written_table(entries.withColumn("d", F.octet_length("data") / size), "neighbour-entries")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("data").alias("data"))
    asked = asked.withColumn("cls", F.min("vec_id").over(Window.partitionBy("data")))
    asked = written_table(asked.withColumn("d", F.octet_length("data") / size), "neighbour-queries")
    queries = asked.where("vec_id = cls").select("cls", "data", "d")
    common = queries.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    empty = vectors.sparkSession.createDataFrame([], "cls long, vec_id long, score double")
    found = empty
    if common is not None:
        d = int(common.d)
        own, mine = entries.where(F.col("d") == d).select("ids", "data"), queries.where(F.col("d") == d).select("cls", "data")
        index = fitted(own, mine, kind, d, k, tables, recall)
        placed = own.mapInArrow(_indexed(index, d, kind), "group long, bucket long, ids array<long>, data binary")
        probes = mine.mapInArrow(_probing(index, d, kind), "group long, cls long, data binary, buckets binary")
        found = _searched(placed, written_table(probes, "neighbour-probes"), kind, k, most_rows, most_queries)
    found = written_table(found, "neighbour-found")
    there = entries.groupBy("d").agg(F.sum(F.size("ids")).alias("there"))
    short = queries.join(found.groupBy("cls").agg(F.count("*").alias("n")), "cls", "left").join(there, "d")
    short = written_table(short.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k + 1), "there")).select("cls", "data", "d"), "neighbour-short")
    if not short.isEmpty():
        bucket = F.lit(0).cast("long")
        alike = entries.join(short.select("d").distinct(), "d", "left_semi")
        all_rows = alike.select(F.col("d").cast("long").alias("group"), bucket.alias("bucket"), "ids", "data")
        probes = short.select(F.col("d").cast("long").alias("group"), "cls", "data", F.lit(bytes(8)).alias("buckets"))
        more = _searched(all_rows, probes, kind, k, most_rows, most_queries)
        found = found.join(short, "cls", "left_anti").unionByName(more)
    first = F.row_number().over(Window.partitionBy("cls").orderBy("score", "vec_id"))
    found = found.withColumn("place", first).where(F.col("place") <= k + 1).select("cls", "vec_id", "score")
    each = asked.select(F.col("vec_id").alias("query_id"), "cls").join(found, "cls").where("vec_id <> query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
