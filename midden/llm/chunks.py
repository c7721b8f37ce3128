"""Cutting texts at white space so that every distinct chunk is tokenized once.

A byte-level BPE pre-tokenizer never joins a non-space character with white space that
follows it, and a word BPE drops white space. So a text's ids are its chunks' ids in a row,
and a batch needs the tokenizer only for the chunks that it hasn't met.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
# What str.isspace() adds.
ODD = "\x1c\x1d\x1e\x1f"
PUNCTUATION = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())

_ANY = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_IRREGULAR = f"^[ \n]|[ \n]$|[ \n][ \n]|[{''.join(c for c in WHITE + ODD if c not in ' \n')}]"


def _whole(texts: pa.Array) -> pa.Array:
    """A copy that starts at the start of its buffers: Arrow's string functions err on slices that were cast."""
    return texts.cast(pa.string()).take(pa.array(np.arange(len(texts))))


def _listed(column: pa.Array) -> list[str]:
    """As to_pylist, without a scalar for each string."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Chunked:
    """names: distinct chunks; index: for each chunk in order its name; ends: for each text the end of its chunks.

    With within, chunks are themselves cut, the texts of within; names are its names.
    """

    def __init__(self, names: list[str], index: np.ndarray, ends: np.ndarray, within: Chunked | None = None):
        self.names, self.index, self.ends, self.within = names, index, ends, within

    def gather(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and for each text the end of its own; values has the 32-bit ids of each name."""
        if self.within is None:
            sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
            pool = np.frombuffer(b"".join(values), np.uint32)
        else:
            pool, stops = self.within.gather(values)
            sizes = np.diff(stops, prepend=0).astype(np.int32)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        own = sizes[self.index]
        total = np.cumsum(own, dtype=np.int32)
        place = np.repeat(starts[self.index] - (total - own), own)
        place += np.arange(len(place), dtype=np.int32)
        return pool[place], np.concatenate(([0], total)).astype(np.int64)[self.ends]


def spaced(texts: pa.Array) -> Chunked:
    """Chunks keep the white space before them. Joined, they give the text."""
    texts = _whole(texts)
    odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
    even = texts.filter(pa.array(~odd))
    pieces = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
    flat = pieces.flatten()
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    coded = flat.dictionary_encode()
    names = [p if p[:1] == "\n" else " " + p for p in _listed(coded.dictionary)]
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(even):  # a text's first chunk has nothing before it
        first = flat.take(pa.array(offsets[:-1])).dictionary_encode()
        index[offsets[:-1]] = first.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(names)
        names += _listed(first.dictionary)
    sizes = np.zeros(len(texts), np.int64)
    sizes[~odd] = np.diff(offsets)
    if not odd.any():
        return Chunked(names, index, np.cumsum(sizes))
    known: dict[str, int] = {}
    found = [[known.setdefault(c, len(known) + len(names)) for c in _ANY.findall(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
    names += list(known)
    sizes[odd] = list(map(len, found))
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]), np.int64)
    out[np.repeat(~odd, sizes)] = index
    out[np.repeat(odd, sizes)] = np.fromiter((i for x in found for i in x), np.int64)
    return Chunked(names, out, ends)


def ended(cut: Chunked) -> Chunked:
    """cut with its chunks parted where a letter or digit precedes ASCII punctuation up to the end.

    Byte-level pre-tokenizers part them there too, so both sides have the ids that they have alone, and endings don't make other chunks.
    """
    whole = pa.array(cut.names, pa.string())
    core = pc.utf8_rtrim(whole, PUNCTUATION)
    parted = pc.and_(pc.not_equal(core, whole), pc.match_substring_regex(core, "[A-Za-z0-9À-ÖØ-öø-ÿ]$"))
    coded = pc.if_else(parted, core, whole).dictionary_encode()
    names, at = _listed(coded.dictionary), parted.to_numpy(zero_copy_only=False)
    known: dict[str, int] = {}
    tails = [known.setdefault(n[len(c) :], len(known) + len(names)) for n, c in zip(_listed(whole.filter(parted)), _listed(core.filter(parted)), strict=True)]
    ends = np.cumsum(1 + at)
    index = np.empty(len(whole) + len(tails), np.int64)
    index[ends - 1 - at] = coded.indices.to_numpy(zero_copy_only=False)
    index[ends[at] - 1] = tails
    return Chunked(names + list(known), cut.index, cut.ends, Chunked(names + list(known), index, ends))


def words(texts: pa.Array, lower: bool = True) -> Chunked:
    """Chunks between ASCII white space, ASCII letters in lower case if lower; some chunks may be empty."""
    texts = _whole(texts)
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    coded = pieces.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Chunked(coded.dictionary.to_pylist(), index, offsets[1:] - offsets[0])


class Cache:
    """Ids by chunk, as bytes, in two generations of at most limit entries of some 150 bytes; what is used lives on, so memory is bounded."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int = 100_000):
        self.make, self.limit = make, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, names: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        out, missing = [], []
        for at, name in enumerate(names):
            value = young.get(name)
            if value is None and (value := old.get(name)) is not None:
                young[name] = value
            if value is None:
                missing.append(at)
            out.append(value)
        made = self.make([names[at] for at in missing]) if missing else []
        for at, value in zip(missing, made, strict=True):
            out[at] = value
            if len(name := names[at]) <= 64:
                young[name] = value
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out
