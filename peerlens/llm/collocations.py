"""Phrase collocations by stripes.

A stripe belongs to a prefix of 0 to 2 words of a language and counts the words that come next: the stripe of no words
holds the word counts, that of one word the pairs, that of two words the triples. A task adds up the stripes of a window
of its texts and sends them on; they are merged element by element. From the merged stripes come

- the extensions: an element is a phrase and its number of occurrences,
- the totals: what a prefix counts is the element of its own, shorter prefix, and all words are the sum of the root stripe,
- the subsumption maxima: the largest element of a pair's own stripe, and over all stripes that end in the pair.

Stripes of very common prefixes have elements without end, so a stripe travels in segments: an element goes to the part that
its whole phrase hashes to. A task thus gets a share of the elements, whatever the prefix, and every element meets all its
counts there. Parts hold about `part` bytes of text. Only elements that occur often enough leave their part; a part of a
frequent phrase is at least as frequent, so nothing else is needed. For the same reason each length has a pass of its own:
pairs are counted only where both words are frequent, triples only where both pairs are. A bit for each frequent phrase goes
to all tasks, 16 MB however many there are (where a rare one shares a frequent one's bit, what holds it is counted too and
found rare). A language's best phrases are first picked within SHARES salted shares, so at most SHARES * `top` meet.

A null text is empty, a null lang is `und`. Empty texts and tables give no rows. Repeated rows count as often as they occur.
A text longer than a window is cut at a piece's end, a longer piece between words, with the last words told again as
context. Only the two columns named are read. Counts up to 10**15 are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table
from .arrow_text import binaries, mixed, strings, unpacked, utf8, words

LONGEST = 3  # words of a phrase
OFTEN = 10  # occurrences of a candidate
COVERED = 50  # per cent of a phrase's occurrences that lie in a longer candidate
TOP = 2000
SHARES = 32  # of a language's phrases, ranked apart before they are ranked together
WINDOW = 8 << 20  # bytes of text whose stripes are added up before they are sent
PART = 8 << 20  # bytes of text whose stripes a task merges
BITS, SLICE = 1 << 27, 1 << 16  # bits that mark frequent phrases, of which some rare ones share a bit; built in slices

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def stretches(raw: np.ndarray, window: int, longest: int = LONGEST):
    """(start, stop, words at the start that an earlier stretch has counted) of stretches of about `window` bytes."""
    at, told = 0, 0
    while at < len(raw):
        reach = window
        while True:
            end = min(at + reach, len(raw))
            if end == len(raw):
                yield at, end, told
                return
            part = raw[at:end]
            pieces = np.flatnonzero(_BREAK[part])
            if len(pieces):
                yield at, at + int(pieces[-1]) + 1, told
                at, told = at + int(pieces[-1]) + 1, 0
                break
            blank = _BLANK[part]
            cut = np.flatnonzero(blank)
            if len(cut):
                cut = int(cut[-1])
                starts = np.flatnonzero(~blank[:cut] & np.concatenate([[True], blank[: cut - 1]])[:cut])
                if len(starts) >= max(longest, 2 * told):
                    yield at, at + cut, told
                    at, told = at + int(starts[len(starts) - longest + 1]) if longest > 1 else at + cut, longest - 1
                    break
            reach *= 2


def _summed(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(key):
        return key, counts
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    return key[first], np.add.reduceat(counts[order], first)


def _hit(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names & np.uint64(len(bits) * 8 - 1)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _named(columns: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """64-bit names of phrases from the numbers of their words."""
    name = hashes[columns[0]]
    for c in columns[1:]:
        name = mixed(name * np.uint64(3) + hashes[c])
    return name


def _elements(ids: np.ndarray, piece: np.ndarray, told: int, hashes: np.ndarray, length: int, bits: np.ndarray | None):
    """The phrases of a length: their words as columns of ids, and counts. `bits` marks the shorter ones that are frequent."""
    size = len(hashes)
    at = np.flatnonzero(piece[: max(len(ids) - length + 1, 0)] == piece[length - 1 :]) if length > 1 else np.arange(len(ids))
    if bits is not None:
        there = np.zeros(len(ids), bool)
        start = np.flatnonzero(piece[: max(len(ids) - length + 2, 0)] == piece[length - 2 :])
        there[start] = _hit(bits, _named([ids[start + k] for k in range(length - 1)], hashes))
        at = at[there[at] & there[at + 1]]
    at = at[at + length > told]
    code, known = ids[at], []
    for k in range(1, length):
        values, code = np.unique(code * size + ids[at + k], return_inverse=True)
        known.append(values)
    counts = np.bincount(code, minlength=len(known[-1]) if known else size)
    code = np.flatnonzero(counts)
    counts, columns = counts[code], []
    for values in reversed(known):
        columns.append(values[code] % size)
        code = values[code] // size
    return [code, *reversed(columns)], counts


def _by_place(values: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then the second ones and so on: small numbers leave runs that compress to nothing."""
    return np.ascontiguousarray(values.astype("<i4")).view(np.uint8).reshape(-1, 4).T.ravel()


def _from_places(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


def _word_hashes(dictionary: pa.Array) -> np.ndarray:
    joined = b" ".join(dictionary.cast(pa.large_binary()).to_pylist())
    return words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), _BLANK)[0]


def _packed(lang: str, raw: np.ndarray, told: int, parts: int, lengths: list[int], bits: np.ndarray | None):
    """One row per part: the stripes of a stretch of text, their words numbered within the row."""
    low = _LOWER[raw]
    gap = _BLANK[low] | _BREAK[low]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return
    piece = np.cumsum(_BREAK[low])[start]
    coded = strings(low, start, stop).dictionary_encode()
    ids, dictionary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    hashes, size, levels = _word_hashes(dictionary), len(dictionary), []
    for length in lengths:
        columns, counts = _elements(ids, piece, told, hashes, length, bits)
        home = (_named(columns, hashes) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        levels.append(([c[order] for c in columns], counts[order], np.searchsorted(home[order], np.arange(parts + 1))))
    mark, number = np.zeros(size, bool), np.zeros(size, np.int32)
    rows, used_all = [], []
    for p in range(parts):
        cut = [([c[at[p] : at[p + 1]] for c in columns], counts[at[p] : at[p + 1]]) for columns, counts, at in levels]
        if not any(len(counts) for _, counts in cut):
            continue
        if sum(len(counts) for _, counts in cut) * 64 < size:
            used = np.unique(np.concatenate([c for columns, _ in cut for c in columns]))
        else:
            for columns, _ in cut:
                for c in columns:
                    mark[c] = True
            used = np.flatnonzero(mark)
            mark[used] = False
        number[used] = np.arange(len(used))
        row = [p]
        for columns, counts in cut:
            heads = np.ones(len(counts), bool)
            heads[1:] = False
            for c in columns[:-1]:
                heads[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(heads)
            prefix = np.stack([number[c[first]] for c in columns[:-1]], 1).ravel() if len(columns) > 1 else np.zeros(0, np.int32)
            spans = np.diff(np.concatenate([first, [len(counts)]])).astype(np.int32)
            row.append(_by_place(np.concatenate([prefix, spans])))
            row.append(_by_place(np.concatenate([number[columns[-1]], counts])))
        rows.append(row)
        used_all.append(used)
    if not rows:
        return
    n = len(rows)
    out = [pa.array([r[0] for r in rows], pa.int64()), pa.array([lang] * n, pa.string())]
    spaced = pc.binary_join_element_wise(dictionary, *[pa.scalar(x, pa.large_string()) for x in ("", " ")])  # no word holds a space
    raw, ends = utf8(spaced.take(pa.array(np.concatenate(used_all))))
    out.append(binaries(raw, np.diff(ends[np.concatenate([[0], np.cumsum([len(u) for u in used_all])])])))
    for k in range(1, 2 * len(lengths) + 1):
        out.append(binaries(np.concatenate([r[k] for r in rows]), np.array([len(r[k]) for r in rows])))
    yield pa.RecordBatch.from_arrays(out, names=["part", "lang", "words", *[f"{x}{k}" for k in lengths for x in ("stripes", "elements")]])


def _mapped(parts: int, window: int, lengths: list[int], frequent=None):
    """The stripes that hold phrases of these lengths; `frequent` is a broadcast bit for every frequent phrase one word shorter."""

    def run(batches):
        bits = None if frequent is None else np.frombuffer(frequent.value, np.uint8)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flushed(lang):
            raw = np.frombuffer(b"\n".join(held.pop(lang)), np.uint8)
            del sizes[lang]
            for at, end, told in stretches(raw, window, lengths[-1]):
                yield from _packed(lang, raw[at:end], told, parts, lengths, bits)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= window:
                    yield from flushed(lang)
            if sum(sizes.values()) >= 2 * window:
                for lang in list(held):
                    yield from flushed(lang)
        for lang in list(held):
            yield from flushed(lang)

    return run


def _merged(often: int, lengths: list[int], longest: int):
    """The elements of a part that occur often enough, and for each language the number of words counted here."""
    fields = pa.schema([("lang", pa.string()), *[(f"w{k + 1}", pa.string()) for k in range(longest)], ("name", pa.int64()), ("f", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        out = [fields.empty_table()]
        langs = rows["lang"].combine_chunks().dictionary_encode()
        for which, lang in enumerate(langs.dictionary.to_pylist()):
            own = rows.take(pa.array(np.flatnonzero(langs.indices.to_numpy() == which)))
            raw, sizes = unpacked(own["words"], np.uint8)
            stop = np.flatnonzero(raw == 0x20)
            coded = strings(raw, np.concatenate([[0], stop[:-1] + 1]), stop).dictionary_encode()
            ids, dictionary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            begins, size = np.concatenate([[0], np.searchsorted(stop, np.cumsum(sizes))]), len(dictionary)
            for length in lengths:
                prefix = length - 1
                stripes, n_stripes = unpacked(own[f"stripes{length}"], np.uint8)
                elements, n_elements = unpacked(own[f"elements{length}"], np.uint8)
                columns, counts = [[] for _ in range(length)], []
                at_s = at_e = 0
                for r, (s, e) in enumerate(zip(n_stripes.tolist(), n_elements.tolist())):
                    stripe, element = _from_places(stripes[at_s : at_s + s]), _from_places(elements[at_e : at_e + e])
                    at_s, at_e, heads, half = at_s + s, at_e + e, len(stripe) // length, len(element) // 2
                    spans = stripe[heads * prefix :]
                    for j in range(prefix):
                        columns[j].append(np.repeat(ids[begins[r] + stripe[: heads * prefix].reshape(heads, prefix)[:, j]], spans))
                    columns[prefix].append(ids[begins[r] + element[:half]])
                    counts.append(element[half:].astype(np.int64))
                columns, counts = [np.concatenate(c) for c in columns], np.concatenate(counts)
                key, shorter = columns[0], []
                for j, c in enumerate(columns[1:]):
                    if j:
                        known, key = np.unique(key, return_inverse=True)
                        shorter.append(known)
                    key = key * size + c
                key, total = _summed(key, counts)
                if length == 1:
                    out.append(pa.table([[lang], *[pa.nulls(1, pa.string())] * longest, pa.nulls(1, pa.int64()), [int(total.sum())]], schema=fields))
                kept = np.flatnonzero(total >= often)
                key, columns = key[kept], []
                for j in range(prefix, 0, -1):
                    columns.append(key % size)
                    key = shorter.pop()[key // size] if j > 1 else key // size
                columns = [key, *reversed(columns)]
                if not len(kept):
                    continue
                used, inverse = np.unique(np.concatenate(columns), return_inverse=True)
                name = _named(np.split(inverse, length), _word_hashes(dictionary.take(pa.array(used))))
                phrase = [dictionary.take(pa.array(c)) for c in columns]
                empty = [pa.nulls(len(kept), pa.string())] * (longest - length)
                out.append(pa.table([pa.array([lang] * len(kept), pa.string()), *phrase, *empty, name.view(np.int64), total[kept]], schema=fields))
        return pa.concat_tables(out)

    return run


def _bits(rows: pa.Table) -> pa.Table:
    """One slice of the bits, packed."""
    out = np.zeros(SLICE, np.uint8)
    out[rows["bit"].to_numpy()] = 1
    return pa.table({"slice": rows["slice"][:1], "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})


def _marked(names: DataFrame) -> bytes:
    """BITS bits, one set for every name: of fixed size, however many names there are."""
    at = F.col("name").bitwiseAND(F.lit(BITS - 1))
    where = names.select(F.floor(at / SLICE).alias("slice"), F.pmod(at, F.lit(SLICE)).alias("bit")).distinct()
    out = np.zeros((BITS // SLICE, SLICE // 8), np.uint8)
    for row in where.groupBy("slice").applyInArrow(_bits, "slice long, bits binary").collect():
        out[row.slice] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", often: int = OFTEN, longest: int = LONGEST, window: int = WINDOW, part: int = PART
) -> DataFrame:
    """lang, w1 .. w<longest>, f: phrases of that many words (the rest null) that occur often enough; without words, all words of the lang."""
    docs = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts, out, frequent = max(-(-size // part), 1), None, None
    names = ", ".join(f"w{k + 1} string" for k in range(longest))
    for lengths in [[k] for k in range(1, longest + 1)]:
        binary = ", ".join(f"stripes{k} binary, elements{k} binary" for k in lengths)
        rows = docs.mapInArrow(_mapped(parts, window, lengths, frequent), f"part long, lang string, words binary, {binary}")
        found = rows.groupBy("part").applyInArrow(_merged(often, lengths, longest), f"lang string, {names}, name long, f long")
        found = written_table(found, "phrase-stripes")
        if lengths[-1] < longest:
            last = found.where(F.col(f"w{lengths[-1]}").isNotNull())
            frequent = docs.sparkSession.sparkContext.broadcast(_marked(last.select("name")))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("lang", *[f"w{k + 1}" for k in range(longest)]).agg(F.sum("f").alias("f"))


def _scored(a: str, left: str, right: str):
    a, left, right = (F.col(c).cast("decimal(18,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * a * a, left * right)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", often: int = OFTEN, covered: int = COVERED, top: int = TOP,
    window: int = WINDOW, part: int = PART,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words."""
    counted = written_table(phrase_counts(docs, text, lang, often, LONGEST, window, part), "phrase-stripes")
    n = counted.where("w1 is null").select("lang", F.col("f").alias("n"))
    words_, pairs, triples = counted.where("w1 is not null and w2 is null"), counted.where("w2 is not null and w3 is null"), counted.where("w3 is not null")

    def word(at: str, total: str) -> DataFrame:
        return words_.select("lang", F.col("w1").alias(at), F.col("f").alias(total))

    def pair(first: str, second: str, total: str) -> DataFrame:
        return pairs.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("f").alias(total))

    ends = triples.select("lang", "f", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longest = ends.groupBy("lang", "p.w1", "p.w2").agg(F.max("f").alias("longer"))
    free = pairs.join(longest, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True)))
    twos = free.join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    twos = twos.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), "l", "r").withColumn("score", _scored("a", "l", "r"))
    threes = triples.join(word("w1", "l1"), ["lang", "w1"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
    threes = threes.join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(word("w3", "r2"), ["lang", "w3"])
    cuts = [F.struct(_scored("f", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    threes = threes.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.least(*cuts).alias("cut"))
    best = twos.unionByName(threes.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best_first = [F.desc("score"), F.desc("a"), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", share).orderBy(*best_first))).where(F.col("place") <= top)
    order = Window.partitionBy("lang").orderBy(*best_first)
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
