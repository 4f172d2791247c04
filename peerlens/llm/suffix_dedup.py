"""Removal of repeated passages with suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same text or another. Texts are
UTF-8 bytes; strings never cross texts and are judged on the input, not on what is left.

1. Anchors. Of the GRAM-byte strings inside every LENGTH bytes the one of least hash (leftmost of equals) is an anchor:
   equal strings of LENGTH bytes have the same anchor at the same place, and about one place in 101 is one. An anchor's
   window holds the strings that have it and no others, so each string lies in one window, about 500 bytes long.
2. Classes. Windows of one anchor that are equal as a whole are one class, counted before anything is moved. A class
   with several members repeats all over. Anchors that occur once need nothing more.
3. Shards. One window of each class of an anchor with several classes, one of them of a single member, goes, with its bytes, to the shard of the anchor.
   A shard gets a suffix array by Larsson-Sadakane refinement (groups of equal prefixes split by the group that follows
   them, the prefix doubling every round), common prefixes by Kasai's method, all windows in step, and the runs of
   suffixes that share LENGTH bytes. An anchor with more classes than a shard holds has several shards, split by text. Each
   gives out its different strings, sorted; these are dealt by value, and the strings of one shard are looked up by binary
   search among those merged before. The cost is linear in the number of shards.
4. The spans of each text are joined and cut out.

A text is known by a 64-bit hash of id and bytes. Null texts are empty; null ids are kept as they are. Repeated rows are
texts like others: of 400 bytes or more they lose everything. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table
from .arrow_text import by_bytes, inverse, mixed, powers, unpacked, utf8

LENGTH = 400
GRAM = 200
SHARD = 2_000_000  # bytes of windows in a shard, about
PIECE = 1 << 19  # bytes of a text worked on at once
_BASE = 0xD6E8FEB86659FD93
_PLACE = np.uint64((1 << 20) - 1)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row."""
    blocks = -(-len(h) // w)
    padded = np.full(blocks * w, ~np.uint64(0))
    padded[: len(h)] = h
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _piece(raw: np.ndarray, offsets: np.ndarray, first: int, last: int, length: int, gram: int):
    """Anchors at the bytes first..last - 1 of a run of texts: (row, place, key, window hash, left, right)."""
    w = length - gram + 1
    low, stop = max(0, first - w + 1), min(last, len(raw) - length + 1)  # the strings that may have them start here
    n, size = stop - low, stop - low + length - 1
    up, down = powers(_BASE, size + 1), powers(inverse(_BASE), size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((raw[low : low + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
    hashes = mixed((sums[gram:] - sums[:-gram]) * down[: size - gram + 1])
    least = _least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), w)
    spread = np.zeros(n + 1, np.int64)  # strings that lie in one text
    sizes = np.diff(offsets)
    from_, upto = np.clip(offsets[:-1] - low, 0, n), np.clip(offsets[1:] - length + 1 - low, 0, n)
    held = (sizes >= length) & (from_ < upto)
    np.add.at(spread, from_[held], 1)
    np.add.at(spread, upto[held], -1)
    starts = np.flatnonzero(np.cumsum(spread[:-1]) > 0)
    anchor = (least[starts] & _PLACE).astype(np.int64)  # never falls from one string to the next
    fresh = np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, bool)
    at, begin, end = anchor[fresh], starts[fresh], starts[np.append(fresh[1:], True)] + length if len(anchor) else anchor
    own = (at + low >= first) & (at + low < last)
    at, begin, end = at[own], begin[own], end[own]
    left, right = at - begin, end - at
    window = mixed((sums[end] - sums[begin]) * down[begin] + mixed(left.astype(np.uint64) * np.uint64(1 << 20) + right.astype(np.uint64)))
    row = np.searchsorted(offsets, at + low, "right") - 1
    return row, at + low - offsets[row], hashes[at], window, left, right


def anchors(texts: pa.Array, length: int = LENGTH, gram: int = GRAM):
    """Anchors of all strings of `length` bytes: arrays of row, place, key, window hash, left, right; one per row and place."""
    raw, offsets = utf8(texts)
    if len(raw) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    places = len(raw) - gram + 1
    parts = [_piece(raw, offsets, first, min(first + PIECE, places), length, gram) for first in range(0, places, PIECE)]
    return tuple(np.concatenate(p) for p in zip(*parts))


def suffix_array(text: np.ndarray, ends: np.ndarray, enough: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, group of each) of windows laid end to end; ends[i] is where the window of byte i stops.

    Windows are told apart by what follows them, so no two suffixes are equal and a group is a suffix's rank. With
    `enough`, suffixes that share so many bytes may stay in one group, in any order.
    """
    n = len(text)
    at, ends = np.arange(n, dtype=np.int32), ends.astype(np.int32)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    bits = int(len(used)).bit_length()
    h = 63 // bits  # as many first bytes as one number holds
    symbols = np.zeros(n + h, np.uint64)
    symbols[:n] = code[text]
    packed = np.zeros(n, np.uint64)
    for k in range(h):  # nothing past the end of the window
        packed = (packed << np.uint64(bits)) | np.where(at + k < ends, symbols[k : n + k], np.uint64(0))
    order = np.argsort(packed).astype(np.int32)
    few = np.flatnonzero((ends - at < h)[order])  # suffixes shorter than that are told apart by their window
    order[few] = order[few][np.lexsort((ends[order[few]], packed[order[few]]))]
    key, short = packed[order], (ends - at < h)[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (short[1:] & short[:-1])])
    group = np.empty(n, np.int32)
    where = None  # places of suffixes in groups that are not yet single
    while True:
        if where is None:
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, n))
            group[order] = np.repeat(starts + sizes - 1, sizes)  # a group is known by its last place
            where = np.flatnonzero(np.repeat(sizes > 1, sizes))
        else:
            starts = np.flatnonzero(new[where])  # every group here lies in `where` as a whole
            sizes = np.diff(np.append(starts, len(where)))
            group[order[where]] = np.repeat(where[starts] + sizes - 1, sizes)
            where = where[np.repeat(sizes > 1, sizes)]
        if not len(where) or (enough is not None and h >= enough):
            return order, group
        who = order[where]
        follower, stop = who + h, ends[who]
        following = np.where(follower < stop, group[np.minimum(follower, n - 1)] + (n + 1), stop)
        both = (group[who].astype(np.int64) << 32) | following
        sort = np.argsort(both)
        both = both[sort]
        order[where] = who[sort]
        new[where] = np.concatenate([[True], both[1:] != both[:-1]])
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, windows: np.ndarray, tied: np.ndarray | None = None, enough: int = 0) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, by Kasai's method along every window at once.

    windows: n + 1 offsets. A window's suffixes are taken in turn, each starting from one byte less than the last shared.
    tied: suffixes known to share `enough` bytes, which are not compared; the one after them starts from none, since
    their order says nothing about its own.
    """
    n = len(text)
    ends = np.repeat(windows[1:], np.diff(windows))
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    i, stop, h = windows[:-1].copy(), windows[1:], np.zeros(len(windows) - 1, np.int64)
    if tied is not None:
        shared[tied] = enough
        after = np.append(np.where(tied, n, np.arange(n)), n)
        after = np.minimum.accumulate(after[::-1])[::-1]  # the next suffix that is not tied
        i = after[i]
    live = np.flatnonzero(i < stop)
    while len(live):
        a = i[live]
        b = before[a]
        x, y = a + h[live], b + h[live]
        inside = (b >= 0) & (x < stop[live]) & (y < ends[b])
        same = inside & (text[np.minimum(x, n - 1)] == text[np.clip(y, 0, n - 1)])
        h[live[same]] += 1
        done = live[~same]
        shared[i[done]] = h[done]
        i[done] += 1
        h[done] = np.maximum(h[done] - 1, 0)
        if tied is not None:
            ahead = after[i[done]]
            h[done[ahead != i[done]]] = 0
            i[done] = ahead
        live = live[i[live] < stop[live]]
    return shared


class Shard:
    """Windows with their suffix array and the runs of suffixes that share `length` bytes.

    doc, start: number of the text of each window and where in it the window starts. A run repeats if it has two places.
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int):
        self.text, self.length = text, length
        self.windows = np.concatenate([[0], np.cumsum(sizes)])
        window = np.repeat(np.arange(len(sizes)), sizes)
        ends = self.windows[1:][window]
        order, group = suffix_array(text, ends, length)
        tied = np.zeros(len(text), bool)
        tied[order[1:]] = group[order[1:]] == group[order[:-1]]
        shared = common_prefixes(text, order, self.windows, tied, length)[order]
        long = ends[order] - order >= length
        run = np.cumsum(shared < length)
        self.order = order[long]
        _, first, self.run = np.unique(run[long], return_index=True, return_inverse=True)
        w = window[self.order]
        self.place = (doc[w] << 40) | (start[w] + self.order - self.windows[w])
        if len(first):
            self.low, self.high = np.minimum.reduceat(self.place, first), np.maximum.reduceat(self.place, first)
        else:
            self.low = self.high = self.place
        self.repeats = self.low != self.high

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first suffix) of each run: the different strings of `length` bytes, in order of the hash."""
        if not len(self.order):
            return np.zeros(0, np.uint64), self.order
        first = self.order[np.flatnonzero(np.concatenate([[True], self.run[1:] != self.run[:-1]]))]
        n = len(self.text)
        up, down = powers(_BASE, n + 1), powers(inverse(_BASE), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mixed((sums[first + self.length] - sums[first]) * down[first]), first

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, end) of the runs of bytes that repeat, as places in the texts' windows."""
        hit = self.order[self.repeats[self.run]] if len(self.order) else self.order
        edge = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + self.length, -1)
        on = np.cumsum(edge[:-1]) > 0
        starts = np.zeros(len(on) + 1, bool)
        starts[self.windows[:-1][np.diff(self.windows) > 0]] = True
        begin = np.flatnonzero(on & (starts[:-1] | ~np.concatenate([[False], on[:-1]]))) if len(on) else hit
        end = np.flatnonzero(on & (np.append(starts[1:-1], True) | ~np.append(on[1:], False))) + 1 if len(on) else hit
        window = np.searchsorted(self.windows, begin, "right") - 1
        return window, begin - self.windows[window], end - self.windows[window]


def _spots(length: int, gram: int):
    def run(batches):
        for batch in batches:
            did = batch["did"].to_numpy()
            for a, b in by_bytes(batch["text"], 1 << 20):
                row, place, key, window, left, right = anchors(batch["text"][a:b], length, gram)
                spot = (place << 20) | (left << 10) | right
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[a:b][row]), pa.array(spot), pa.array(key.view(np.int64)), pa.array(window.view(np.int64))],
                    ["did", "spot", "key", "window"])

    return run


def _fetched(batches):
    """The bytes of the windows wanted of each text."""
    for batch in batches:
        wanted = batch["wanted"]
        rows = wanted.flatten()
        offsets = wanted.offsets.to_numpy() - wanted.offsets.to_numpy()[0]
        spot = rows.field("spot").to_numpy()
        place, left, right = spot >> 20, (spot >> 10) & 1023, spot & 1023
        owner = np.repeat(np.arange(len(batch)), np.diff(offsets))
        texts = batch["text"].cast(pa.large_binary())
        data = [b""] * len(spot)
        for i, text in enumerate(texts):
            raw = text.as_buffer()
            for k in range(offsets[i], offsets[i + 1]):
                data[k] = raw[int(place[k] - left[k]) : int(place[k] + right[k])].to_pybytes()
        yield pa.RecordBatch.from_arrays(
            [rows.field("key"), rows.field("window"), rows.field("n"), batch["did"].take(pa.array(owner)), pa.array(place - left), pa.array(data, pa.binary())],
            ["key", "window", "n", "did", "start", "data"])


def _shard_of(rows: pa.Table, length: int) -> tuple[Shard, np.ndarray, np.ndarray, np.ndarray]:
    data, sizes = unpacked(rows["data"], np.uint8)
    did, start = rows["did"].to_numpy(), rows["start"].to_numpy()
    _, doc = np.unique(did, return_inverse=True)
    return Shard(data, sizes, doc, start, length), did, start, rows["n"].to_numpy()


def _span_rows(shard: Shard, did: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Table:
    """Spans of the classes of one member; a larger class repeats as a whole anyway."""
    window, begin, end = shard.spans()
    one = n[window] == 1
    window, begin, end = window[one], begin[one], end[one]
    return pa.table({"did": did[window], "start": start[window] + begin, "stop": start[window] + end})


def _in_shard(length: int):
    def run(rows: pa.Table) -> pa.Table:
        return _span_rows(*_shard_of(rows, length))

    return run


def _strings_of(length: int, parts: int):
    """Of a shard that is one of several of its anchor: its own spans (part null), and for every different string its
    hash, its place if it has but one (did, start), and the number of the shard, packed by part of the hashes."""

    def run(rows: pa.Table) -> pa.Table:
        shard, did, start, n = _shard_of(rows, length)
        own = _span_rows(shard, did, start, n)
        hashes, first = shard.strings()
        window = np.searchsorted(shard.windows, first, "right") - 1
        place = start[window] + first - shard.windows[window]
        lone = (shard.low == shard.high) & (n[window] == 1)
        part = hashes % np.uint64(parts)
        key = np.full(len(hashes), rows["key"][0].as_py(), np.int64)
        out = []
        for k in np.unique(part).tolist():
            at = np.flatnonzero(part == k)
            at = at[np.argsort(hashes[at])]
            out.append((k, rows["sub"][0].as_py(), *(x.tobytes() for x in (key[at], hashes[at], did[window[at]], place[at], lone[at].astype(np.uint8)))))
        empty = pa.nulls(len(own))
        cols = [pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)] + [pa.array([r[k] for r in out], pa.binary()) for k in range(2, 7)]
        names = ["part", "sub", "keys", "hashes", "dids", "places", "lone"]
        spans = pa.table({**{c: empty.cast(x.type) for c, x in zip(names, cols)}, "did": own["did"], "start": own["start"], "stop": own["stop"]})
        strings = pa.table({**dict(zip(names, cols)), **{c: pa.nulls(len(out), pa.int64()) for c in ("did", "start", "stop")}})
        return pa.concat_tables([spans.select(strings.column_names), strings])

    return run


_STRINGS = "part long, sub long, keys binary, hashes binary, dids binary, places binary, lone binary, did long, start long, stop long"


def _merged(length: int):
    """Spans of the strings that two shards have: each shard's sorted strings are looked up in those merged before it."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = dict(keys="<i8", hashes="<u8", dids="<i8", places="<i8", lone="u1")
        names, seen, owner = np.zeros(0, np.uint64), np.zeros(0, bool), []
        lists = []
        for i in range(len(rows)):
            col = {c: np.frombuffer(rows[c][i].as_py(), t) for c, t in kinds.items()}
            name = mixed(col["hashes"] ^ col["keys"].view(np.uint64))
            order = np.argsort(name)
            lists.append({c: x[order] for c, x in col.items()} | {"name": name[order]})
        for own in lists:
            at = np.searchsorted(names, own["name"])
            known = (at < len(names)) & (names[np.minimum(at, max(0, len(names) - 1))] == own["name"]) if len(names) else np.zeros(len(own["name"]), bool)
            seen[at[known]] = True
            fresh = own["name"][~known]
            into = np.searchsorted(names, fresh)
            names, seen = np.insert(names, into, fresh), np.insert(seen, into, False)
        did, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own in lists:
            hit = seen[np.searchsorted(names, own["name"])] & (own["lone"] == 1)
            did.append(own["dids"][hit])
            start.append(own["places"][hit])
        did, start = np.concatenate(did), np.concatenate(start)
        return pa.table({"did": did, "start": start, "stop": start + length})

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """did, spans (array of start, stop in bytes, may overlap) of the texts of `docs` (did, text) with repeats."""
    spark = docs.sparkSession
    spots = written_table(docs.mapInArrow(_spots(length, gram), "did long, spot long, key long, window long"), "repeat-spots")
    classes = spots.groupBy("key", "window").agg(F.count("*").alias("n"), F.min(F.struct("did", "spot")).alias("at"))
    classes = classes.select("key", "window", "n", "at.did", "at.spot")
    several = classes.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("total"), F.min("n").alias("fewest")).where("total > 1").drop("total")
    classes = written_table(classes.join(several, "key"), "repeat-classes")

    place, left, right = F.shiftright("spot", 20), F.shiftright("spot", 10).bitwiseAND(1023), F.col("spot").bitwiseAND(1023)
    whole = classes.where(F.col("n") > 1).where(left + right >= length).select("key", "window")
    spans = spots.join(whole, ["key", "window"]).select("did", (place - left).alias("start"), (place + right).alias("stop"))

    several = classes.where("classes > 1 and fewest = 1")  # classes of several members repeat as they are
    wanted = several.groupBy("did").agg(F.collect_list(F.struct("key", "window", "n", "spot")).alias("wanted"))
    texts = docs.join(wanted, "did").select("did", "text", "wanted")
    windows = texts.mapInArrow(_fetched, "key long, window long, n long, did long, start long, data binary")
    most = max(1, shard // length)  # windows of one anchor that still go to one shard
    facts = several.agg(F.count("*").alias("n"), F.max("classes").alias("classes")).first()
    shards = max(int(facts.n * 2 * length / shard) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "did long, start long, stop long"
    columns = ["did", "start", "n", "data"]
    if (facts.classes or 0) <= most:
        light = windows
    else:
        large = several.where(F.col("classes") > most).groupBy("key").agg(F.first("classes").alias("classes"))
        windows = written_table(windows, "repeat-windows")
        light = windows.join(large.select("key"), "key", "left_anti")
        heavy = windows.join(large, "key").withColumn("sub", F.pmod(F.xxhash64("did"), F.ceil(F.col("classes") / most)))
        heavy = heavy.select("key", "sub", *columns).groupBy("key", "sub").applyInArrow(_strings_of(length, shards), _STRINGS)
        heavy = written_table(heavy, "repeat-strings")
        spans = spans.union(heavy.where("part is null").select("did", "start", "stop"))
        spans = spans.union(heavy.where("part is not null").groupBy("part").applyInArrow(_merged(length), schema))
    light = light.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), *columns)
    spans = spans.union(light.groupBy("shard").applyInArrow(_in_shard(length), schema))
    return spans.distinct().groupBy("did").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


@F.arrow_udf(T.StructType().add("kept", "binary").add("n_removed", "long").add("n_spans", "long"))
def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The bytes of each text outside its spans, the number of bytes cut and of maximal runs of them."""
    kept, removed, runs = [], [], []
    for t, s in zip(text.cast(pa.large_binary()), spans):
        raw, own = t.as_py() or b"", sorted((x["start"], x["stop"]) for x in s.as_py() or ())
        out, at, n = [], 0, 0
        end = -1
        for a, b in own:
            if a > end:
                n += 1
                out.append(raw[at:a])
            end = max(end, b)
            at = end
        out.append(raw[at:])
        kept.append(b"".join(out))
        removed.append(len(raw) - len(kept[-1]))
        runs.append(n)
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["kept", "n_removed", "n_spans"])


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, shard: int = SHARD,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: a cut may fall inside a character) for every document."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = named.withColumn("did", F.xxhash64("doc_id", "text"))
    spans = written_table(repeated_spans(named.select("did", "text"), length, gram, shard), "repeat-spans")
    joined = named.join(spans, "did", "left").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), cut("text", "spans").alias("c"))
    return joined.select("doc_id", "n_bytes", "c.n_removed", "c.n_spans", "c.kept")
