"""Join of documents by n-gram Jaccard similarity: a size-aware heavy-light join.

Sets. A document's set holds its distinct shingles of five words (64-bit hashes); a shorter one's whole word sequence is
one shingle; without words it is empty and links with nothing. Equal sets are one class from here on, so copies cost
nothing. A null text has no words, a null id is no id: such a row takes part, and a component of only such rows has a
null id. Repeated rows are copies. An empty table gives an empty result.

1. Shared shingles. Shingles are dealt to buckets by hash, packed per batch of documents; a bucket counts in how many
   classes each occurs and returns those of two or more to their classes. Only these can be in an intersection, so the
   rest is but counted. A shingle that many classes of one batch have is known as frequent there: it is sent once, as a
   mark, and not once for each class.
2. Keys. Small sets (up to a boundary) enumerate the subsets of every size that an overlap with a partner may need: two
   small sets that link have such a subset in common. Larger sets look up the inverted lists of the rarest part of their
   shingles, long enough that two sets that link share one. The boundary is where the cost of both is least, reckoned
   from the sizes of the classes.
3. Links. Classes that share a key, directly or over others, form a group. In a group a class is compared with the
   members that share a key with it, until it has joined their component; a class that has joined needs no more
   comparison inside it, so thousands of near copies need about one comparison each, and no pairs are written out.
   A group too large for a task is dealt to blocks, then the centres of what the blocks found are compared, and at last
   every pair that shares a key and still lies in two components is compared on its own.

Comparisons are exact: 100 * intersection >= 80 * union, on whole sets.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table
from .arrow_text import binaries, by_bytes, list_array, mixed, unpacked, utf8, words
from .components import components

WORDS = 5
SHARE = 80  # percent
FREQUENT = 8  # classes of one batch from which on a shingle counts as frequent
BATCH = 2_000_000  # shingles that a task packs at once
BUCKET = 2_000_000  # shingles of a bucket, about
GROUP = 4_000_000  # shared shingles compared in one task, about
_HOT = np.uint16(65535)
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(texts: pa.Array, n: int = WORDS):
    """The sorted distinct shingles of each text, one array each."""
    hashes, rows = words(*utf8(texts))
    counts = np.bincount(rows, minlength=len(texts)) if len(rows) else np.zeros(len(texts), np.int64)
    starts = np.cumsum(counts) - counts
    factor = mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        grams += hashes[k : k + len(grams)] * factor[k]
    grams = mixed(grams)
    for start, m in zip(starts.tolist(), counts.tolist()):
        if m >= n:
            own = np.sort(grams[start : start + m - n + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif m:
            yield mixed(np.array([int((hashes[start : start + m] * factor[:m]).sum())], np.uint64) + np.uint64(m))
        else:
            yield np.zeros(0, np.uint64)


def class_of(own: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed integer."""
    total = np.add.reduce(mixed(own + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) if len(own) else np.uint64(0)
    return int(mixed(np.array([total ^ np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def _classes(batches):
    for batch in batches:
        names, sizes = [], []
        for a, b in by_bytes(batch["text"]):
            for own in shingle_sets(batch["text"][a:b]):
                names.append(class_of(own) if len(own) else None)
                sizes.append(len(own))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "cls", "n"])


_BLOCK = "bucket long, cls binary, sizes binary, counts binary, low binary, high binary, frequent binary"


def _blocks(buckets: int):
    """Packs the shingles of the classes of a batch by bucket; frequent ones go straight back, under a negative bucket."""

    def packed(names, sizes, sets):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        ordered = np.sort(flat)
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        runs = np.diff(np.append(start, len(ordered)))
        frequent = ordered[start[runs >= FREQUENT]]
        common = frequent[np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)] == flat if len(frequent) else np.zeros(len(flat), bool)
        name, size = np.array(names, np.int64), np.array(sizes, np.uint32)
        bucket = (flat >> np.uint64(32)) % np.uint64(buckets)
        marks = (frequent >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((owner, bucket))
        order = order[~common[order]]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for b in range(buckets):
            own, mark = order[edges[b] : edges[b + 1]], frequent[marks == b] & _LOW
            if len(own) or len(mark):
                who, counts = np.unique(owner[own], return_counts=True)
                low = flat[own] & _LOW
                rows.append((b, name[who], size[who], counts.astype(np.uint32), low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16), mark))
        if common.any():
            who, counts = np.unique(owner[common], return_counts=True)
            keys = _keys(flat[common] & _LOW, bucket[common])
            low, high = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
            rows.append((-1 - int(name[0] & 0x7FFFFFFF), name[who], size[who], counts.astype(np.uint32), low, high, flat[:0]))
        cols = [pa.array([r[0] for r in rows], pa.int64())]
        cols += [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(1, 7)]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches):
        names, sizes, sets, seen, held = [], [], [], set(), 0
        for batch in batches:
            for a, b in by_bytes(batch["text"]):
                for own in shingle_sets(batch["text"][a:b]):
                    if len(own) and (name := class_of(own)) not in seen:
                        seen.add(name)
                        names.append(name)
                        sizes.append(len(own))
                        sets.append(own)
                        held += len(own)
                if held >= BATCH:
                    yield packed(names, sizes, sets)
                    names, sizes, sets, seen, held = [], [], [], set(), 0
        if sets:
            yield packed(names, sizes, sets)

    return run


def _keys(low: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """One 64-bit name of a shingle from its low bits and its bucket."""
    return mixed(low ^ mixed(bucket.astype(np.uint64) + np.uint64(1)))


_SHARED = "part long, cls binary, sizes binary, counts binary, keys binary, rarity binary"


def _shared(parts: int):
    """Shingles of a bucket that two or more classes have, packed by part of the classes, with their rarity (u16).

    Rarity: the number of classes that have the shingle, the same for all of them.
    """

    def run(block: pa.Table) -> pa.Table:
        bucket = block["bucket"][0].as_py()
        col = {n: unpacked(block[n], t)[0] for n, t in (("cls", "<i8"), ("sizes", "<u4"), ("counts", "<u4"), ("low", "<u4"), ("frequent", "<u8"))}
        owner = np.repeat(np.arange(len(col["cls"])), col["counts"])
        if bucket < 0:
            high = unpacked(block["high"], "<u4")[0]
            keys = col["low"].astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
            rarity = np.full(len(keys), _HOT)
        else:
            low = col["low"].astype(np.uint64) | (unpacked(block["high"], "<u2")[0].astype(np.uint64) << np.uint64(32))
            names = col["cls"][owner]
            order = np.lexsort((names, low))
            low, names, owner = low[order], names[order], owner[order]
            fresh = np.ones(len(low), bool)
            fresh[1:] = (low[1:] != low[:-1]) | (names[1:] != names[:-1])
            low, owner = low[fresh], owner[fresh]
            start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
            runs = np.diff(np.append(start, len(low)))
            rarity = np.repeat(np.minimum(runs, 65534), runs).astype(np.uint16)
            marks = np.unique(col["frequent"])
            if len(marks) and len(low):
                rarity[marks[np.minimum(np.searchsorted(marks, low), len(marks) - 1)] == low] = _HOT
            keep = rarity > 1
            keys, owner, rarity = _keys(low[keep], np.full(int(keep.sum()), bucket)), owner[keep], rarity[keep]
        part = col["cls"].view(np.uint64) % np.uint64(parts)
        order = np.lexsort((owner, part[owner]))
        keys, owner, rarity = keys[order], owner[order], rarity[order]
        edges = np.searchsorted(part[owner], np.arange(parts + 1, dtype=np.uint64))
        rows = []
        for k in np.flatnonzero(np.diff(edges)):
            at = slice(edges[k], edges[k + 1])
            who, counts = np.unique(owner[at], return_counts=True)
            rows.append((int(k), col["cls"][who], col["sizes"][who], counts.astype(np.uint32), keys[at], rarity[at]))
        out = [pa.array([r[0] for r in rows], pa.int64())]
        out += [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(1, 6)]
        return pa.Table.from_arrays(out, [c.split()[0] for c in _SHARED.split(", ")])

    return run


def overlap(s: int, t: int, share: int = SHARE) -> int:
    """Least intersection of sets of s and t shingles that link."""
    return -(-share * (s + t) // (100 + share))


def subset_sizes(s: int, share: int = SHARE) -> list[int]:
    """Overlaps that a set of s shingles may need with a partner of any size."""
    return sorted({overlap(s, t, share) for t in range(-(-share * s // 100), 100 * s // share + 1) if overlap(s, t, share) <= min(s, t)})


def prefix_length(s: int, share: int = SHARE) -> int:
    return s - -(-share * s // 100) + 1


def boundary(sizes: dict[int, int], share: int = SHARE, most: int = 24, scan: float = 2.0) -> int:
    """The largest small size: where subsets of the smaller sets and lists of the others cost least together.

    A subset costs 1; a look-up in a list costs `scan`. Sets of up to share percent of the boundary need no lists, since
    no larger set can link with them.
    """

    def cost(x: int) -> float:
        small = sum(n * sum(comb(s, o) for o in subset_sizes(s, share)) for s, n in sizes.items() if s <= x)
        return small + sum(n * scan * prefix_length(s, share) for s, n in sizes.items() if 100 * s >= share * (x + 1))

    return min(range(most + 1), key=cost)


def _candidates(small: int, share: int):
    """cls, size, keys, lists of the classes of a part: their shared shingles, and what they are looked up by."""

    def run(part: pa.Table) -> pa.Table:
        col = {n: unpacked(part[n], t)[0] for n, t in (("cls", "<i8"), ("sizes", "<u4"), ("counts", "<u4"), ("keys", "<u8"), ("rarity", "<u2"))}
        names, first, code = np.unique(col["cls"], return_index=True, return_inverse=True)
        owner = np.repeat(code, col["counts"])
        order = np.lexsort((col["keys"], owner))
        keys, rarity, owner = col["keys"][order], col["rarity"][order], owner[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, rarity, owner = keys[fresh], rarity[fresh], owner[fresh]
        edges = np.searchsorted(owner, np.arange(len(names) + 1)).tolist()
        out_keys, out_lists, keep = [keys[:0]], [keys[:0]], []
        for i, size in enumerate(col["sizes"][first].tolist()):
            own, rare = keys[edges[i] : edges[i + 1]], rarity[edges[i] : edges[i + 1]]
            lists = []
            if size <= small:
                for o in subset_sizes(size, share):
                    if o <= len(own):
                        chosen = np.array(list(combinations(range(len(own)), o)), np.int64)
                        lists.append(mixed(mixed(own + np.uint64(o))[chosen].sum(1, dtype=np.uint64)))
            if 100 * size >= share * (small + 1):
                take = prefix_length(size, share) - (size - len(own))
                if take > 0:
                    lists.append(own[np.lexsort((own, rare))[:take]])
            if lists:
                keep.append(i)
                out_keys.append(own)
                out_lists.append(np.concatenate(lists))
        return pa.table({
            "cls": names[keep], "size": col["sizes"][first][keep].astype(np.int64),
            "keys": binaries(np.concatenate(out_keys), np.array([len(x) for x in out_keys[1:]], np.int64)),
            "lists": binaries(np.concatenate(out_lists), np.array([len(x) for x in out_lists[1:]], np.int64))})

    return run


def links(a: np.ndarray, b: np.ndarray, s: int, t: int, share: int = SHARE) -> bool:
    """Whether two sets link, from their shared shingles (sorted) and their sizes."""
    if 100 * min(s, t) < share * max(s, t):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return 100 * both >= share * (s + t - both)


class _Merged:
    """Components of classes seen so far: every pair that shares a list is compared unless it is in one component."""

    def __init__(self, share: int):
        self.share, self.parent, self.sets, self.sizes = share, [], [], []
        self.lists: dict[int, dict[int, list[int]]] = {}
        self.centre: dict[int, int] = {}

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _link(self, i: int, j: int) -> bool:
        return links(self.sets[i], self.sets[j], self.sizes[i], self.sizes[j], self.share)

    def add(self, keys: np.ndarray, size: int, lists: np.ndarray) -> None:
        x = len(self.parent)
        self.parent.append(x)
        self.sets.append(keys)
        self.sizes.append(size)
        self.centre[x] = x
        near: dict[int, list[list[int]]] = {}
        for key in lists.tolist():
            for old, members in self.lists.setdefault(key, {}).items():
                near.setdefault(self.root(old), []).append(members)
        for top, found in near.items():
            top, own = self.root(top), self.root(x)
            if top == own:
                continue
            hit = self.centre[top] if self._link(x, self.centre[top]) else None
            if hit is None:
                seen = {self.centre[top]}
                for y in (y for members in found for y in reversed(members)):
                    if y not in seen:
                        seen.add(y)
                        if self._link(x, y):
                            hit = y
                            break
            if hit is not None:
                self.centre[top] = hit
                self.parent[own] = top
        top = self.root(x)
        for key in lists.tolist():
            self.lists[key].setdefault(top, []).append(x)


def _compared(share: int):
    """cls, label, centre of the classes of some groups; the label is the smallest class of the component found."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("grp", "ascending"), ("size", "ascending"), ("cls", "ascending")])
        names, group = rows["cls"].to_numpy(), rows["grp"].to_numpy()
        keys, nk = unpacked(rows["keys"], "<u8")
        lists, nl = unpacked(rows["lists"], "<u8")
        ek, el, sizes = np.cumsum(nk), np.cumsum(nl), rows["size"].to_numpy()
        label, centre = names.copy(), np.ones(len(names), bool)
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist() + [len(group)]
        for a, b in zip(start, start[1:]):
            merged = _Merged(share)
            for i in range(a, b):
                merged.add(keys[ek[i] - nk[i] : ek[i]], int(sizes[i]), lists[el[i] - nl[i] : el[i]])
            roots = np.array([merged.root(i) for i in range(b - a)])
            least = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(least, roots, names[a:b])
            label[a:b] = least[roots]
            centre[a:b] = [merged.centre[r] == i for i, r in enumerate(roots)]
        return pa.table({"cls": names, "label": label, "centre": centre})

    return run


def _linked(share: int):
    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array, s: pa.Array, t: pa.Array) -> pa.Array:
        ka, na = unpacked(a, "<u8")
        kb, nb = unpacked(b, "<u8")
        ea, eb = np.cumsum(na), np.cumsum(nb)
        return pa.array([
            links(ka[ea[i] - na[i] : ea[i]], kb[eb[i] - nb[i] : eb[i]], x, y, share)
            for i, (x, y) in enumerate(zip(s.to_pylist(), t.to_pylist()))], pa.bool_())

    return linked


@F.arrow_udf(T.ArrayType(T.LongType()))
def _longs(packed: pa.Array) -> pa.Array:
    values, counts = unpacked(packed, "<i8")
    return list_array(pa.array(values), counts)


def labels_of(sets: DataFrame, share: int = SHARE, group: int = GROUP) -> DataFrame:
    """cls, label for the classes of `sets` (cls, size, keys, lists): equal labels for what links, over any number of steps."""
    spark = sets.sparkSession
    lists = written_table(sets.select("cls", "size", F.explode(_longs("lists")).alias("key")), "jaccard-lists")
    hubs = lists.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("m")).where("m > 1")
    touching = components(lists.join(hubs, "key").select(F.col("cls").alias("a"), F.col("hub").alias("b")), "jaccard-groups")
    weight = (F.octet_length("keys") + F.octet_length("lists")) / 8
    members = sets.join(touching.withColumnRenamed("node", "cls"), "cls").withColumn("weight", weight)
    members = written_table(members, "jaccard-members")
    groups = written_table(members.groupBy("component").agg(F.sum("weight").alias("total")), "jaccard-weights")
    facts = groups.agg(F.sum(F.when(F.col("total") <= group, F.col("total"))).alias("light"), F.sum((F.col("total") > group).cast("long")).alias("large")).first()
    bins = max(int((facts.light or 0) / group) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = ["cls", "size", "keys", "lists", "grp"]
    schema = "cls long, label long, centre boolean"
    light = members.join(groups.where(F.col("total") <= group), "component").withColumn("grp", F.col("component"))
    light = light.withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(bins)))
    done = light.select("bin", *columns).groupBy("bin").applyInArrow(_compared(share), schema)
    if not facts.large:
        return done.select("cls", "label")
    heavy = members.join(groups.where(F.col("total") > group), "component")
    heavy = heavy.withColumn("block", F.pmod(F.xxhash64("cls"), F.ceil(F.col("total") / group))).withColumn("grp", F.col("component"))
    first = written_table(heavy.select("component", "block", *columns).groupBy("component", "block").applyInArrow(_compared(share), schema), "jaccard-blocks")
    centres = heavy.join(first.where("centre").select("cls"), "cls")
    shares = centres.groupBy("component").agg(F.sum("weight").alias("of_centres"))
    centres = centres.join(shares, "component").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.ceil(F.col("of_centres") / group)))
    second = written_table(centres.select("component", "block", *columns).groupBy("component", "block").applyInArrow(_compared(share), schema), "jaccard-centres")
    drawn = first.select(F.col("cls").alias("a"), F.col("label").alias("b")).union(second.select("cls", "label"))
    found = components(drawn, "jaccard-heavy")
    at = written_table(heavy.select("cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce(F.col("component"), F.col("cls")).alias("label")), "jaccard-now")
    # of each key that lies in several components: its other members, each with all, so a large component is not paired with itself
    key = lists.join(at, "cls")
    parts = key.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("parts"))
    key = key.join(parts.where("parts > 1").drop("parts"), "key")
    one, two = (key.select("key", "main", F.col("cls").alias(f"cls{i}"), F.col("size").alias(f"size{i}"), F.col("label").alias(f"label{i}")) for i in (1, 2))
    apart = one.where("label1 <> main").join(two.drop("main"), "key").where(
        f"label1 <> label2 and (label2 = main or cls1 < cls2) and 100 * least(size1, size2) >= {share} * greatest(size1, size2)")
    apart = apart.select("cls1", "cls2", "size1", "size2").distinct()
    pairs = apart.join(sets.select(F.col("cls").alias("cls1"), F.col("keys").alias("keys1")), "cls1").join(
        sets.select(F.col("cls").alias("cls2"), F.col("keys").alias("keys2")), "cls2")
    last = pairs.where(_linked(share)("keys1", "keys2", "size1", "size2")).select(F.col("cls1").alias("a"), F.col("cls2").alias("b"))
    whole = components(drawn.union(last), "jaccard-whole").select(F.col("node").alias("cls"), F.col("component").alias("label"))
    return done.select("cls", "label").union(whole)


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = SHARE, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = written_table(rows.mapInArrow(_classes, "doc_id long, cls long, n long"), "jaccard-classes")
    classes = named.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"))
    facts = classes.groupBy(F.least("n", F.lit(64)).alias("s")).agg(F.count("*").alias("sets"), F.sum("n").alias("total")).collect()  # 64 rows
    small = boundary({r.s: r.sets for r in facts}, share)
    buckets = max(sum(r.total for r in facts) // BUCKET + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = rows.select("text").mapInArrow(_blocks(buckets), _BLOCK)
    shared = blocks.groupBy("bucket").applyInArrow(_shared(buckets), _SHARED)
    sets = shared.groupBy("part").applyInArrow(_candidates(small, share), "cls long, size long, keys binary, lists binary")
    sets = written_table(sets, "jaccard-sets")
    labels = written_table(labels_of(sets, share, group), "jaccard-labels")
    at = classes.join(labels, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "least")
    at = written_table(at, "jaccard-labelled")
    least = at.groupBy("label").agg(F.min("least").alias("component_id"))
    found = at.join(least, "label").select("cls", "component_id")
    full = named.where("n > 0").join(found, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(named.where("n = 0").select("doc_id", F.col("n"), F.col("doc_id")))

