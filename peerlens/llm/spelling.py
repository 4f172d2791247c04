"""Spelling variants: words one letter apart, found by a search in a trie of letter-group counts.

The letters are dealt into groups; a word is described by its length and by how often each group occurs in it. Words that
differ by one inserted, deleted or replaced letter have counts that differ by a surplus of at most one and a deficit of at
most one. The trie has the length at its root and one level per group; a word's own path leads to its leaf, and its search
goes down the same trie with a budget of one surplus and one deficit:

- among words of its own length it spends the deficit first and then the surplus, so of two words one finds the other;
- among words one letter shorter it spends the deficit alone.

The upper levels are walked by Spark: a node of more bytes than a task should take is split by the next group's count, and
every word goes on to the children that its budget allows, until each node fits. From there a task goes on depth first.
At a leaf words are compared exactly, and only those that share the part before or the part after the middle.

A hot word is one row, since occurrences are added up before words meet. A text that is null or has no runs gives nothing;
so does an empty table. Repeated rows count as often as they occur. A null doc_id is named by the empty text. Texts and
words may have any length. Only the two columns named are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .arrow_text import by_bytes, mixed, powers, segments, strings, utf8

SHORTEST = 7  # code points of a word
OFTEN = 2  # occurrences of a word
TIMES = 10  # a form occurs so many times as often
THIN = 31  # runs whose hash this divides lose a letter

GROUPS = ("e", "n", "a", "r", "i", "t", "os", "hl", "dcq", "umpf", "gbvwykjxz")  # the last group is every other letter
NODE = 1 << 21  # bytes of words, visitors included, of a node that one task searches
LEAF = 128  # words of a node that are compared without going further down
COUNTED = 1 << 20  # distinct words of a task that are held before they are passed on
_ODD = 0x9E3779B97F4A7C15
_MOST = 15  # counts above it are alike to the trie

_group = np.full(256, len(GROUPS), np.uint8)
for _k, _letters in enumerate(GROUPS):
    _group[list(_letters.encode())] = _k
LEVELS = len(GROUPS) + 1

# What a word is to a node: at home (and so searching its own length with nothing spent), deficit spent, deficit and
# surplus spent, searching shorter words with nothing spent, searching shorter words with the deficit spent.
HOME, LESS, EVEN, LONG, DROPPED = range(5)
# State after a child whose count is one less than, as much as, or one more than the word's; -1: not that way.
_STEP = np.array([[LESS, HOME, -1], [-1, LESS, EVEN], [-1, EVEN, -1], [DROPPED, LONG, -1], [-1, DROPPED, -1]])

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_BREAK = ~_LETTER
_BREAK[0x80:] = False  # a stretch is never cut within a letter
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _runs(part: np.ndarray, begins: np.ndarray, shortest: int):
    """(start, stop, code points) of the runs of letters; `begins` are where texts begin."""
    follows = np.zeros(len(part), bool)
    follows[:-1] = (part[1:] >= 0x80) & (part[1:] < 0xC0)
    lead = (part == 0xC3) & follows
    tail = np.zeros(len(part), bool)
    tail[1:] = lead[:-1]
    letter = _LETTER[part] | lead | tail
    fresh = np.ones(len(part), bool)
    fresh[1:] = ~letter[:-1]
    fresh[begins] = True
    last = np.ones(len(part), bool)
    last[:-1] = ~letter[1:]
    last[begins[begins > 0] - 1] = True
    start, stop = np.flatnonzero(letter & fresh), np.flatnonzero(letter & last) + 1
    points = np.concatenate([[0], np.cumsum(~tail)])
    n = points[stop] - points[start]
    kept = n >= shortest
    return start[kept], stop[kept], n[kept]


def _named(names: list[bytes], longest: int) -> np.ndarray:
    """crc32 of each name followed by 0 .. `longest` further bytes, but for what those bytes themselves add."""
    out = np.empty((longest + 1, len(names)), np.uint32)
    out[0] = [zlib.crc32(n) for n in names]
    for k in range(longest):
        out[k + 1] = _CRC[out[k] & np.uint32(0xFF)] ^ (out[k] >> np.uint32(8))
    return out


def _thinned(words: pa.Array, at: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> list[str]:
    """The words at these places without the letter that the hash points to."""
    out = []
    for word, h, size in zip(words.take(pa.array(at)).to_pylist(), hashes.tolist(), n.tolist()):
        cut = h % size
        out.append(word[:cut] + word[cut + 1 :])
    return out


def _counted(shortest: int, thin: int):
    def run(batches):
        held, size = [], 0

        def total():
            whole = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            return whole.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high in by_bytes(texts):
                raw, offsets = utf8(texts.slice(low, high - low))
                names = [f"{'' if i is None else i}:".encode() for i in ids.slice(low, high - low).to_pylist()]
                for at, end in segments(raw, offsets, _BREAK):
                    part = _LOWER[raw[at:end]]
                    begins = offsets[(offsets >= at) & (offsets < end)] - at
                    start, stop, n = _runs(part, begins, shortest)
                    if not len(start):
                        continue
                    coded = strings(part, start, stop).dictionary_encode()
                    which, words = coded.indices.to_numpy(), coded.dictionary
                    own = np.array([zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint32)
                    row, size_in_bytes = np.searchsorted(offsets, start + at, "right") - 1, stop - start
                    first, rows = int(row[0]), int(row[-1] - row[0]) + 1
                    table = _named(names[first : first + rows], min(int(size_in_bytes.max()), 256))
                    h = table[np.minimum(size_in_bytes, len(table) - 1), row - first] ^ own[which]
                    for k in np.flatnonzero(size_in_bytes >= len(table)).tolist():
                        h[k] = zlib.crc32(part[start[k] : stop[k]].tobytes(), zlib.crc32(names[row[k]]))
                    hit = h % np.uint32(thin) == 0
                    counts = np.bincount(which[~hit], minlength=len(words))
                    seen = np.flatnonzero(counts)
                    held.append(pa.table({"word": words.take(pa.array(seen)), "n": counts[seen]}))
                    cut = np.flatnonzero(hit & (n > shortest))
                    if len(cut):
                        less = pa.array(_thinned(words, which[cut], h[cut], n[cut]), pa.large_string())
                        held.append(pa.table({"word": less, "n": np.ones(len(cut), np.int64)}))
                    size += len(seen) + len(cut)
                    if size > COUNTED:
                        whole = total()
                        size, held = sum(map(len, whole)), [pa.Table.from_batches(whole).cast(held[0].schema)]
                        if size > COUNTED // 2:
                            yield from whole
                            size, held = 0, []
        if held:
            yield from total()

    return run


def word_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, often: int = OFTEN, thin: int = THIN
) -> DataFrame:
    """word, n: the words of all texts that occur often enough, runs whose hash is divisible by `thin` without a letter."""
    found = docs.select(doc_id, text).mapInArrow(_counted(shortest, thin), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _bytes_of(words: list[str]) -> np.ndarray:
    """All letters, one byte each, one word after the other."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8)


def _split(batches):
    """Every row to the children of its node that its state allows; `node` becomes the child."""
    for batch in batches:
        for low in range(0, len(batch), 1 << 14):
            part = batch.slice(low, 1 << 14)
            words = part["word"].to_pylist()
            sizes = np.array([len(w) for w in words])
            level, state, node = part["level"].to_numpy(), part["state"].to_numpy(), part["node"].to_numpy()
            here = _group[_bytes_of(words)] == np.repeat(level, sizes)
            own = np.minimum(np.add.reduceat(here, np.concatenate([[0], np.cumsum(sizes)[:-1]])), _MOST)
            for step in (-1, 0, 1):
                then = _STEP[state, step + 1]
                child = own + step
                kept = np.flatnonzero((then >= 0) & (child >= 0) & (child <= _MOST))
                if not len(kept):
                    continue
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays([
                    part["length"].take(at), pa.array((level[kept] + 1).astype(np.int32)), pa.array(node[kept] << 4 | child[kept]),
                    pa.array(then[kept].astype(np.int32)), part["word"].take(at), part["n"].take(at)],
                    ["length", "level", "node", "state", "word", "n"])


def _hash(letters: np.ndarray) -> np.ndarray:
    """64-bit values of the rows; equal rows have equal ones."""
    out, some = np.zeros(len(letters), np.uint64), 1 << 16
    for k in range(0, letters.shape[1], some):
        part = letters[:, k : k + some]
        out = mixed(out + (part.astype(np.uint64) + np.uint64(1)) @ powers(_ODD, some)[: part.shape[1]])
    return out


class _Node:
    """The words at home in one node, as a trie in sorted order, and what is found in it."""

    def __init__(self, length: int, home: list[str], guests: list[str], level: int):
        self.length, self.level, half = length, level, length // 2
        self.home = _bytes_of(home).reshape(len(home), length)
        longer = np.array([len(w) > length for w in guests], bool)
        self.longer = np.concatenate([np.zeros(len(home), bool), longer])
        letters = np.zeros((len(home) + len(guests), length + 1), np.uint8)
        letters[: len(home), :length] = self.home
        for flag, size in ((False, length), (True, length + 1)):
            rows = np.flatnonzero(longer == flag)
            if len(rows):
                letters[len(home) + rows, :size] = _bytes_of([guests[k] for k in rows.tolist()]).reshape(len(rows), size)
        self.letters = letters
        self.counts = np.empty((len(letters), LEVELS), np.uint8)
        groups = _group[letters]
        groups[~self.longer, length] = LEVELS
        for k in range(LEVELS):
            self.counts[:, k] = np.minimum((groups == k).sum(1), _MOST)
        self.head = _hash(letters[:, :half])
        self.tail = np.where(self.longer, _hash(letters[:, half + 1 :]), _hash(letters[:, half:length]))
        self.order = np.lexsort(self.counts[: len(home), ::-1].T)
        self.sorted = self.counts[self.order]
        self.found = []

    def search(self, states: np.ndarray) -> np.ndarray:
        """(searcher, word at home) of every pair of near words."""
        self._down(0, len(self.order), self.level, np.arange(len(states)), states)
        return np.concatenate(self.found) if self.found else np.zeros((0, 2), np.int64)

    def _down(self, low: int, high: int, level: int, who: np.ndarray, states: np.ndarray) -> None:
        if high - low <= LEAF or level == LEVELS:
            self._compare(self.order[low:high], who, states)
            return
        column = self.sorted[low:high, level]
        starts = low + np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1])
        own = self.counts[who, level].astype(np.int64)
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), high]):
            step = int(self.sorted[start, level]) - own
            then = np.where(np.abs(step) <= 1, _STEP[states, np.clip(step, -1, 1) + 1], -1)
            goes = np.flatnonzero(then >= 0)
            if len(goes):
                self._down(start, stop, level + 1, who[goes], then[goes])

    def _compare(self, words: np.ndarray, who: np.ndarray, states: np.ndarray) -> None:
        """Leaf words that share a half with a searcher, compared letter by letter, some pairs at a time."""
        for keys, other in ((self.head, None), (self.tail, self.head)):
            here = words[np.argsort(keys[words], kind="stable")]
            low = np.searchsorted(keys[here], keys[who])
            high = np.searchsorted(keys[here], keys[who], "right")
            some = np.flatnonzero(high > low)
            reach = np.cumsum(high[some] - low[some])
            at = 0
            while at < len(some):
                done = reach[at - 1] if at else 0
                upto = max(int(np.searchsorted(reach, done + (1 << 16), "right")), at + 1)
                rows = some[at:upto]
                n = high[rows] - low[rows]
                a, first = np.repeat(who[rows], n), np.repeat(states[rows] == HOME, n)
                b = here[np.repeat(low[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                kept = ~first | (a < b)  # both are searchers here: the first finds the second
                if other is not None:
                    kept &= other[a] != other[b]  # the first halves have found it
                a, b = a[kept], b[kept]
                near = self._near(a, b)
                if near.any():
                    self.found.append(np.stack([a[near], b[near]], 1))
                at = upto

    def _near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), bool)
        rows = max((1 << 22) // (self.length + 1), 1)
        for k in range(0, len(a), rows):
            x, y = self.letters[a[k : k + rows]], self.home[b[k : k + rows]]
            differ = x[:, :-1] != y
            longer = self.longer[a[k : k + rows]]
            # One letter too many: before it the words agree, from it on each letter equals the next one of the longer word.
            before = np.cumsum(differ, axis=1) == 0
            good = before | (x[:, 1:] == y)
            out[k : k + rows] = np.where(longer, good.all(1), differ.sum(1) == 1)
        return out


def _search(rows: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: of the near words found in this node, their number and the most frequent."""
    length, level, states = rows["length"][0].as_py(), rows["level"][0].as_py(), rows["state"].to_numpy()
    order = np.argsort(states != HOME, kind="stable")
    rows, states = rows.take(pa.array(order)), states[order]
    words, n, own = rows["word"].to_pylist(), rows["n"].to_numpy(), int((states == HOME).sum())
    pairs = _Node(length, words[:own], words[own:], level).search(states)
    of, other = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    used = np.unique(of)
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    best = np.lexsort((rank[other], -n[other], of))
    first = best[np.searchsorted(of[best], used)]
    return pa.table({
        "word": rows["word"].take(pa.array(used)), "n_near": np.bincount(of, minlength=len(words))[used],
        "best_n": n[other[first]], "best": rows["word"].take(pa.array(other[first]))})


def near_words(words: DataFrame, shortest: int = SHORTEST, node: int = NODE) -> DataFrame:
    """word, n_near, best_n, best of every word that has near ones, from rows word, n without repeats."""
    size = F.length("word").cast("int")
    start = words.select("word", "n", F.explode(F.array(F.struct(size.alias("length"), F.lit(HOME).alias("state")), F.struct((size - 1).alias("length"), F.lit(LONG).alias("state")))).alias("e"))
    rows = start.where(F.col("e.length") >= shortest).select("e.length", F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), "e.state", "word", "n")
    fit = []
    for level in range(LEVELS):
        sizes = rows.groupBy("length", "node").agg(F.sum(F.lit(16) + F.col("length")).alias("size"), F.min("state").alias("home"))
        sizes = sizes.where(F.col("home") == HOME).select("length", "node", (F.col("size") > node).alias("large"))
        sized = written_table(rows.join(sizes, ["length", "node"]), "variant-nodes")
        fit.append(sized.where(~F.col("large")).drop("large"))
        large = sized.where("large").select("length", "level", "node", "state", "word", "n")
        if large.isEmpty():
            break
        rows = large.mapInArrow(_split, rows.schema)
    else:
        fit.append(rows)
    dealt = fit[0].select("length", "level", "node", "state", "word", "n")
    for more in fit[1:]:
        dealt = dealt.unionByName(more)
    found = dealt.groupBy("length", "level", "node").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("top")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least)
    return found.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms lead in the end; `forms` has word, form, and no form leads back.

    A round goes twice as far as the one before, and a chain has at most as many steps as a count has digits.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written_table(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = TIMES, node: int = NODE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written_table(word_counts(docs, doc_id, text), "variant-words")
    near = near_words(words, node=node)
    is_form = F.col("best_n") >= times * F.col("n")
    full = words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"))
    full = written_table(full, "variant-forms")
    named = roots(full.where("form is not null"))
    return full.join(named, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
