"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

1. Each source gets a target from its weight, at most `most` times its own size; the excess goes to the others by weight.
2. All targets together are cut into blocks of `block` words. Sources get whole numbers of blocks by highest quotients
   target / (2 s + 1). A source's documents are dealt to bins and shards by a seeded hash, and its quota is apportioned
   to its bins and theirs to their shards in the same way, by size, so every shard has a whole quota.
3. In a shard the documents lie end to end in seeded order. A quota first buys whole passes over the shard; the rest is
   taken as blocks in seeded order, the last one cut to fit.

Everything follows from ids, sizes and the seed: another run or another layout of the rows gives the same mix.
Shards hold about `shard` words and rows, however large the source, and are the unit of work.

Null sources are one source, placed last; null texts have size 0. Rows of size 0 are never taken. Repeated rows are rows
like others. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table
from .arrow_text import list_array, rows_of

WEIGHTS = (5, 2, 1)
SEED = 20240601


def n_words(text: Column | str) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2 s + 1); equal quotients go to the earlier party."""
    votes = np.asarray(votes, float)
    total = votes.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(votes), np.int64)
    won = np.floor(votes * (seats / total) + 0.5).astype(np.int64)  # all but a few seats, by the divisor
    left = seats - int(won.sum())
    if left > 0:
        heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, won)) if v > 0]
        heapq.heapify(heap)
        for _ in range(left):
            _, i = heap[0]
            won[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * won[i] + 1), i))
    elif left < 0:
        heap = [(votes[i] / (2 * s - 1), -i) for i, s in enumerate(won) if s > 0]
        heapq.heapify(heap)
        for _ in range(-left):
            _, i = heapq.heappop(heap)
            won[-i] -= 1
            if won[-i] > 0:
                heapq.heappush(heap, (votes[-i] / (2 * won[-i] - 1), i))
    return won


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size -> with target and rank by name. Only sources meet here, one row each.

    With r = most * size / weight in ascending order, the sources whose r stays below the level that the rest would
    get are at their cap; the level is what remains, shared by the remaining weight.
    """
    by_name = Window.partitionBy().orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.partitionBy().orderBy("r", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "w", F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int")))
    level = (
        ranked.withColumn("cap", most * F.col("source_size"))
        .withColumn("r", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("r"), F.col("level"))).over(Window.partitionBy()))
    )
    got = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return level.select("source", "source_size", got.alias("target"), "rank")


def _shared(keys: list[str], part: str, quota: str):
    """Apportions the quota of a group to its parts by their size."""

    def share(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(part)
        won = sainte_lague(group["size"].to_numpy(), int(group[quota].iloc[0]))
        return group.assign(won=won)[[*keys, part, "won"]]

    return share


def mix(
    docs: DataFrame, sizes: Column, weights: tuple = WEIGHTS, most: float = 3.0, block: int = 16, shard: int = 1 << 16,
    seed: int = SEED, doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes, ranges.

    `taken` words: `passes` times the whole document and once the words of `ranges` (start, end exclusive).
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), sizes.alias("size"))
    rows = written_table(rows, "mix-sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(per_source.select("source", "source_size"), weights, most)

    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    listed = goal.withColumn("seats", blocks).withColumn("one", F.lit(0)).withColumn("size", F.col("target"))
    listed = listed.withColumn("name", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))))
    quota = listed.select("one", "name", "seats", "size").groupBy("one").applyInPandas(
        _shared(["one"], "name", "seats"), "one int, name string, won long")
    plan = (
        listed.join(quota, "name").join(per_source.select(F.col("source").alias("src"), "n"), F.col("source").eqNullSafe(F.col("src")))
        .select("source", "source_size", "target", F.col("rank").cast("long").alias("k"), F.col("won").alias("source_won"),
                F.ceil((F.col("source_size") + F.col("n")) / shard).alias("shards"))
        .withColumn("bins", F.ceil(F.sqrt("shards")).cast("long"))
    )
    plan = written_table(plan, "mix-sources")

    dealt = (
        rows.join(plan.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("shard", F.pmod("order", "shards"))
        .withColumn("bin", F.col("shard") % F.col("bins"))
    )
    per_shard = written_table(
        dealt.groupBy("k", "bin", "shard").agg(F.sum("size").alias("size"), F.first("source_won").alias("source_won")), "mix-shards")
    per_bin = per_shard.groupBy("k", "bin").agg(F.sum("size").alias("size"), F.first("source_won").alias("source_won"))
    bins = per_bin.groupBy("k").applyInPandas(_shared(["k"], "bin", "source_won"), "k long, bin long, won long")
    shards = (
        per_shard.select("k", "bin", "shard", "size").join(bins.withColumnRenamed("won", "bin_won"), ["k", "bin"])
        .groupBy("k", "bin").applyInPandas(_shared(["k", "bin"], "shard", "bin_won"), "k long, bin long, shard long, won long"))

    def select(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("size", "ascending")])
        size = group["size"].to_numpy()
        ends = np.cumsum(size)
        total = int(ends[-1])
        words = min(group["won"][0].as_py() * block, int(most * total))
        passes, rest = divmod(words, total) if total else (0, 0)
        rng = np.random.default_rng([seed, group["k"][0].as_py(), group["shard"][0].as_py()])
        edges = np.zeros(total + 1, np.int64)  # +1 where taken words begin, -1 where they end
        for b in rng.permutation(-(-total // block)).tolist() if rest else ():
            start = b * block
            stop = min(start + block, total, start + rest)
            edges[start] += 1
            edges[stop] -= 1
            rest -= stop - start
            if not rest:
                break
        on = np.cumsum(edges[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(on)])
        part = sums[ends] - sums[ends - size]
        first, last = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
        lo, hi = np.searchsorted(last, ends - size, "right"), np.searchsorted(first, ends, "left")
        counts = np.where(part > 0, hi - lo, 0)
        row = rows_of(counts)
        piece = np.arange(len(row)) - (np.cumsum(counts) - counts)[row] + lo[row]
        begins, stops = (ends - size)[row], ends[row]
        pieces = pa.StructArray.from_arrays(
            [pa.array(np.maximum(first[piece], begins) - begins), pa.array(np.minimum(last[piece], stops) - begins)], ["start", "end"])
        return group.select(["doc_id", "source", "size", "source_size", "target"]).append_column(
            "taken", pa.array(passes * size + part)).append_column(
            "passes", pa.array(np.where(size > 0, passes, 0))).append_column("ranges", list_array(pieces, counts))

    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = (f"doc_id {id_type}, source string, size long, source_size long, target double, taken long, passes long, "
           "ranges array<struct<start:long,end:long>>")
    return (
        dealt.select("k", "shard", "doc_id", "source", "size", "source_size", "target", "order")
        .join(shards.select("k", "shard", "won"), ["k", "shard"]).groupBy("k", "shard").applyInArrow(select, out))


_GAP = re.compile(r"[\x20\x09-\x0D]+")


@F.arrow_udf(T.ArrayType(T.StringType()))
def taken_texts(text: pa.Array, takes: pa.Array) -> pa.Array:
    """The texts that takes (passes, ranges) of a document give: a copy for each pass, and the words of the ranges, if
    any, joined by single spaces."""
    out = []
    for t, own in zip(text, takes):
        t, got = t.as_py() or "", []
        for take in own.as_py() or ():
            got += [t] * take["passes"]
            if take["ranges"]:
                words = _GAP.split(t.strip("\x20\x09\x0A\x0B\x0C\x0D"))
                got.append(" ".join(w for r in take["ranges"] for w in words[r["start"] : r["end"]]))
        out.append(got)
    return pa.array(out, pa.list_(pa.string()))


def mixed_documents(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents as the mix takes them: the rows of `docs`, once for each text that `taken_texts` gives.

    A document of which nothing is taken goes. Rows equal in id and text are taken as many times as there are of them.
    """
    id_of = how.pop("doc_id", "doc_id")
    named = docs.withColumn("__row", F.xxhash64(id_of, text))
    takes = mix(named, n_words(text), doc_id="__row", **how).where("taken > 0").groupBy(F.col("doc_id").alias("__row")).agg(
        F.collect_list(F.struct("passes", "ranges")).alias("__takes"))
    once = named.dropDuplicates(["__row"]).join(takes, "__row")
    return once.withColumn(text, F.explode(taken_texts(text, "__takes"))).drop("__row", "__takes").select(docs.columns)
