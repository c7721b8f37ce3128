"""Byte-level BPE encoding and decoding over padded matrices of byte ranks.

The pre-tokens of a batch are put into matrices by length (padded to the bucket's width).
In each round every row looks its neighbouring pairs up in a hash table of pair ranks and
merges its leftmost pair of minimum rank; rows that have nothing left to merge leave the
matrix and the columns that no row needs are cut (compaction). A row as long as a
whole document would need as many rounds as it has bytes, so in the widest bucket a row
merges, in one round, as many of its leftmost minimum-rank pairs as provably come next in
that order: a run of them ends where a merge makes a pair of lower or equal rank.

Cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded
alike; ids of unknown ranks can't occur, as every single byte has a rank.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import chunks
from .common import map_arrow, slices, texts_of

NONE = np.int64(1 << 40)


class Ranks:
    """A rank file: byte strings and their ranks, one a line, base64 and decimal."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pattern = regex.compile(pattern.replace(r"\s", rf"[{chunks.WHITE}]").replace(r"\S", rf"[^{chunks.WHITE}]").replace(rf"[^[{chunks.WHITE}]", rf"[^{chunks.WHITE}"))
        self.whole = rank
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        self.size = max(rank.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, r in rank.items():
            self.bytes[r] = token
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, self.size)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # Every split of a token into two tokens is a pair that merges to it.
        keys, values = [], []
        for token, r in rank.items():
            for i in range(1, len(token)):
                a, b = rank.get(token[:i]), rank.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(r)
        self._hash(np.array(keys, np.int64), np.array(values, np.int64))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table, filled in vectorised rounds: whoever finds its slot taken tries the next."""
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot, rest, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(rest):
            self.probes += 1
            at = slot[rest]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[rest[free]]  # of several, the last stays
            won = self.keys[at] == keys[rest]
            self.values[at[won]] = values[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks to which pairs merge, NONE where they don't; negative ids are padding."""
        keys = left * self.size + right
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        out = out.reshape(shape)
        out[(left < 0) | (right < 0)] = NONE
        return out

    def encode(self, tokens: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        out: list[np.ndarray] = [None] * len(tokens)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for at, token in enumerate(tokens):
            r = self.whole.get(token)
            if r is not None:
                out[at] = np.array([r], np.uint32)
            else:
                buckets.setdefault(max(4, 1 << (len(token) - 1).bit_length()) if token else 0, []).append(at)
        for width, own in sorted(buckets.items()):
            if width == 0:
                for at in own:
                    out[at] = np.empty(0, np.uint32)
            elif width > 256:
                for at in own:
                    out[at] = self._long(tokens[at])
            else:
                step = max(1, (1 << 18) // width)
                for i in range(0, len(own), step):
                    self._matrix([tokens[at] for at in own[i : i + step]], width, own[i : i + step], out)
        return out

    def _matrix(self, tokens: list[bytes], width: int, own: list[int], out: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(len(tokens), width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte[raw], -1)
        rows = np.arange(len(tokens))
        ranks = self.pair(ids[:, :-1], ids[:, 1:])
        while True:
            least = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), least]
            live = best < NONE
            if not live.all():
                for i in np.flatnonzero(~live):
                    out[own[rows[i]]] = ids[i, : sizes[i]].astype(np.uint32)
                if not live.any():
                    return
                ids, ranks, rows, sizes, least, best = ids[live], ranks[live], rows[live], sizes[live], least[live], best[live]
                cut = int(sizes.max())
                ids, ranks = ids[:, :cut], ranks[:, : cut - 1]
            # Drop the column after each row's merge, and renew the two ranks beside it.
            n, w = ids.shape
            at = np.arange(n)
            ids[at, least] = best
            keep = np.ones((n, w), bool)
            keep[at, least + 1] = False
            ids = np.concatenate((ids[keep].reshape(n, w - 1), np.full((n, 1), -1, np.int64)), axis=1)
            sizes -= 1
            keep = keep[:, 1:]  # the rank at j is that of the pair j, j + 1
            ranks = np.concatenate((ranks[keep].reshape(n, w - 2), np.full((n, 1), NONE, np.int64)), axis=1)
            right = np.where(least + 1 < w, ids[at, np.minimum(least + 1, w - 1)], -1)
            ranks[at, least] = self.pair(best, right)
            has = np.flatnonzero(least > 0)
            ranks[has, least[has] - 1] = self.pair(ids[has, least[has] - 1], best[has])

    def _long(self, token: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(token, np.uint8)]
        while len(ids) > 1:
            ranks = self.pair(ids[:-1], ids[1:])
            best = ranks.min()
            if best >= NONE:
                break
            at = np.flatnonzero(ranks == best)
            # Of overlapping pairs (a a a), from the left every second one merges.
            run = np.cumsum(np.diff(at, prepend=at[0]) != 1)
            start = np.full(int(run[-1]) + 1, len(ids), np.int64)
            np.minimum.at(start, run, at)
            at = at[(at - start[run]) % 2 == 0]
            joined = np.zeros(len(ids), bool)
            joined[at] = True
            left = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            left = np.where((at > 1) & joined[np.maximum(at - 2, 0)], best, left)
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            made = np.minimum(self.pair(left, np.full(len(at), best)), self.pair(np.full(len(at), best), right))
            stop = np.flatnonzero(made <= best)
            at = at[: int(stop[0]) + 1] if len(stop) else at
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids.astype(np.uint32)

    def encode_chunks(self, names: list[str]) -> list[bytes]:
        """The ids of chunks of text, each cut by the pattern; a pre-token that occurs again is encoded once."""
        known: dict[str, int] = {}
        parts = [[known.setdefault(p, len(known)) for p in self.pattern.findall(name)] for name in names]
        ids = [x.tobytes() for x in self.encode([p.encode() for p in known])]
        return [b"".join([ids[i] for i in p]) for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: one gather from the tokens' bytes in a row."""
        ids = ids.astype(np.int64)
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]))].tobytes()


_known: dict[tuple[str, str], tuple[Ranks, chunks.Cache]] = {}


def ranks_of(path: str, pattern: str) -> tuple[Ranks, chunks.Cache]:
    """One table and one bounded cache of chunks for each Python worker."""
    if (path, pattern) not in _known:
        ranks = Ranks(path, pattern)
        _known[path, pattern] = ranks, chunks.Cache(ranks.encode_chunks)
    return _known[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = ranks_of(path, pattern)
        for batch in slices(batches, "text", 4 << 20):
            cut = chunks.spaced(batch.column("text"))
            flat, ends = cut.gather(cache.get(cut.names))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(key), ids], [key, "ids"])

    return map_arrow(texts_of(docs, key, text=text), run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary): the bytes of every row's ids; null ids: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, _ = ranks_of(path, pattern)
        for batch in batches:
            rows = batch.column("ids")
            for i in range(0, batch.num_rows, 64):
                part = rows.slice(i, 64)
                done = [ranks.decode(np.asarray(x.values)) if x.is_valid else b"" for x in part]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(i, 64), pa.array(done, pa.binary())], [key, "bytes"])

    return map_arrow(docs.selectExpr(key, f"`{ids}` AS ids"), run, f"{key} {docs.schema[key].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids, and gives digests of both, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cache = ranks_of(path, pattern)
        decimal = np.array([str(i) for i in range(ranks.size)], object)
        for batch in slices(batches, "text", 4 << 20):
            cut = chunks.spaced(batch.column("text"))
            flat, ends = cut.gather(cache.get(cut.names))
            starts = np.concatenate(([0], ends[:-1]))
            n, ids, back = [], [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                own = flat[a:b]
                n.append(b - a)
                ids.append(hashlib.sha256(" ".join(decimal[own].tolist()).encode()).hexdigest())
                back.append(hashlib.sha256(ranks.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(texts_of(docs, key, text=text), run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
