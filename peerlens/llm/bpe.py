"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a vocabulary file become a model of the tokenizers library: every byte is written as a printable
character, every way to split a token into two others is a merge of the token's rank. A text is cut by the
vocabulary's pattern and each piece is encoded on its own, without special tokens. Decoding looks each id up in the
reversed byte table, so characters that were split over several tokens come back whole once the bytes are joined.

Packed encoding cuts a text further, at every single space between two characters that are not white space: the pattern
begins a piece there whatever stands around it. Runs between such cuts recur, so each goes through the library once and
its ids are kept, up to a bounded number of runs.

A null text is an empty one and has no tokens; an empty list decodes to no bytes. Ids are packed as little-endian
unsigned 32-bit integers; `unpacked_ids` gives them as an array.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import SEGMENT, by_bytes, list_array, unpacked

VOCABULARY = "byte_bpe_50k.tiktoken"


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)


def byte_characters() -> list[str]:
    """A printable character for each byte: its own where it has one, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(4)
def token_bytes(vocabulary: str) -> tuple[bytes, ...]:
    """The bytes of each id."""
    with open(_path(vocabulary), "rb") as lines:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}
    return tuple(ranks.get(i, b"") for i in range(max(ranks) + 1))


@lru_cache(4)
def tokenizer(vocabulary: str):
    """The library's tokenizer for a vocabulary file; made once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    ids = {t: i for i, t in enumerate(token_bytes(vocabulary)) if t}
    name = {t: "".join(shown[b] for b in t) for t in ids}
    merges = [(name[t[:k]], name[t[k:]]) for t in ids for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
    out = Tokenizer(models.BPE(vocab={name[t]: i for t, i in ids.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER = re.compile(r" \s|\s |\A | \Z")  # a space that is no cut
_KEPT = 300_000  # runs in each of two generations of kept ids


class _Runs:
    """Packed ids of runs seen lately: a full generation becomes the old one, and what is used of that is kept on."""

    def __init__(self):
        self.now, self.old = {}, {}

    def fresh(self, runs: set[str]) -> list[str]:
        """Those of the runs whose ids are to be added."""
        if len(self.now) > _KEPT:
            self.now, self.old = {}, self.now
        missing = runs - self.now.keys()
        kept = missing & self.old.keys()
        self.now.update(zip(kept, map(self.old.__getitem__, kept)))
        return list(missing - kept)


_known: dict[str, tuple[_Runs, _Runs]] = {}


@lru_cache(4)
def _table(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens end to end, start and length of each)."""
    tokens = token_bytes(vocabulary)
    length = np.array([len(t) for t in tokens], np.int32)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length, dtype=np.int32) - length, length


def packed_ids(texts: list[str], vocabulary: str = VOCABULARY) -> list[bytes]:
    """Little-endian ids of each text."""
    first, later = _known.setdefault(vocabulary, (_Runs(), _Runs()))
    runs = [_CUT.split(t) if _OTHER.search(t) else t.split(" ") for t in texts]
    heads = [r.pop(0) for r in runs]
    library = tokenizer(vocabulary)
    begin = first.fresh(set(heads))
    for run, e in zip(begin, library.encode_batch(begin, add_special_tokens=False)):
        first.now[run] = np.array(e.ids, "<u4").tobytes()
    follow = later.fresh(set().union(*runs))
    for at in range(0, len(follow), 512):  # many runs in one text, told apart by the bytes of their tokens
        part = follow[at : at + 512]
        ids = np.array(library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(r.encode()) + 1 for r in part])
        cuts = (4 * (np.searchsorted(np.cumsum(_table(vocabulary)[2][ids]), ends) + 1)).tolist()
        raw, start = ids.tobytes(), 0
        for run, cut in zip(part, cuts):
            later.now[run] = raw[start:cut]
            start = cut
    ids = later.now.__getitem__
    return [first.now[head] + b"".join(map(ids, r)) for head, r in zip(heads, runs)]


def encode(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Packed ids of each text."""

    @F.arrow_udf("binary")
    def packed(text: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for a, b in by_bytes(text):
            out += packed_ids([t or "" for t in text[a:b].to_pylist()], vocabulary)
        return pa.array(out, pa.binary())

    return packed(text)


def encode_with_offsets(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """array<struct<id,start,end>>: each token with the code points that it touches, end exclusive.

    Tokens that share a split character have the same offsets.
    """

    @F.arrow_udf("array<struct<id:int,start:int,end:int>>")
    def tokens(text: pa.Array) -> pa.Array:
        ids, marks, counts = [], [], []
        for a, b in by_bytes(text, SEGMENT):
            texts = [t or "" for t in text[a:b].to_pylist()]
            for e in tokenizer(vocabulary).encode_batch(texts, add_special_tokens=False):
                ids += e.ids
                marks += e.offsets
                counts.append(len(e.ids))
        at = np.array(marks, np.int32).reshape(-1, 2)
        rows = pa.StructArray.from_arrays(
            [pa.array(ids, pa.int32()), pa.array(at[:, 0]), pa.array(at[:, 1])], ["id", "start", "end"])
        return list_array(rows, np.array(counts, np.int64))

    return tokens(text)


def decode(packed: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """The bytes that packed ids stand for; null for null."""

    @F.arrow_udf("binary")
    def plain(packed: pa.Array) -> pa.Array:
        flat, start, length = _table(vocabulary)
        ids, counts = unpacked(packed.fill_null(b""), "<u4")
        ends, out = np.cumsum(counts), []
        for end, n in zip(ends.tolist(), counts.tolist()):
            parts = []
            for at in range(end - n, end, SEGMENT):
                some = ids[at : min(at + SEGMENT, end)]
                sizes = length[some]
                stops = np.cumsum(sizes, dtype=np.int32)
                parts.append(flat[np.arange(stops[-1], dtype=np.int32) + np.repeat(start[some] - stops + sizes, sizes)].tobytes())
            out.append(b"".join(parts))
        return pa.array(out, pa.binary(), mask=np.asarray(packed.is_null()))

    return plain(packed)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def unpacked_ids(packed: pa.Array) -> pa.Array:
    """Packed ids as an array; empty for null."""
    ids, counts = unpacked(packed.fill_null(b""), "<u4")
    return list_array(pa.array(ids.astype(np.int32)), counts)


def n_tokens(packed: Column | str) -> Column:
    return F.floor(F.octet_length(packed) / 4).cast("long")


def encode_documents(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with packed ids of `text` in `out`. Other columns pass through unchanged."""
    return df.withColumn(out, encode(F.col(text), vocabulary))
