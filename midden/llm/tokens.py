"""Ids of whole texts by a tokenizers file, with the library called once for each new chunk.

A chunk is what stands between white space (see chunks). Chunks that end in a comma or full
stop behind an ASCII letter are looked up without it, as both pre-tokenizers cut there; for
byte-level vocabularies so is all punctuation at the end. A
chunk of Latin letters only is one pre-token, so it goes straight to the library's BPE
model; all others go through the library's whole pipeline. A text with the string of an
added token goes whole to the library, which gives it that token's id.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import chunks
from .common import single_threaded

ENDINGS = ",."
#: Chunks that byte-level vocabularies keep in each of the cache's generations; words with their case and space are many.
BYTE_LEVEL_CHUNKS = 400_000


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the rest from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class Encoder:
    """Ids by a file of the tokenizers library; word_ends: its vocabulary drops white space and case."""

    def __init__(self, path: str, word_ends: bool, limit: int = 100_000):
        single_threaded()
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.word_ends, self.letters = word_ends, byte_letters()
        self.cut = chunks.words if word_ends else lambda texts: chunks.ended(chunks.spaced(texts))
        self.cache = chunks.Cache(self._make, limit)
        self.endings = {c: self._plain([c])[0] for c in ENDINGS}
        self.newline = self._plain(["\n"])[0]

    def _plain(self, names: list[str], added: bool = False) -> list[bytes]:
        """The library's ids; added: with the added tokens' own, which chunks don't have."""
        self.tool.encode_special_tokens = not added
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tool.encode_batch_fast(names, add_special_tokens=False)]

    def _spelled(self, name: str) -> str | None:
        """The one pre-token that name is, as the model spells it, or None."""
        lead, core = (" ", name[1:]) if name[0] == " " else ("", name)
        if not core.isalpha():
            return None
        if core.isascii():  # spelled as they are
            return (self.letters[32] if lead else "") + (core.lower() if self.word_ends else core)
        if max(core) > "\xff":
            return None
        if self.word_ends:
            core = core.lower()
        return (lead + core).encode().decode("latin-1").translate(self.letters)

    def _make(self, names: list[str]) -> list[bytes]:
        bare = [n[:-1] if n[-1:] in ENDINGS and len(n) > 1 and n[-2].isascii() and n[-2].isalpha() else n for n in names]
        starts = [False] * len(bare) if self.word_ends else [b[:1] == "\n" and b[1:2].isalpha() for b in bare]
        core = bare if self.word_ends else [b[1:] if s else b for b, s in zip(bare, starts, strict=True)]
        made: dict[str, bytes] = {"": b""}
        whole = []
        model = self.tool.model
        for c in dict.fromkeys(core):
            if c and (spelled := self._spelled(c)) is not None:
                made[c] = array("I", [t.id for t in model.tokenize(spelled)]).tobytes()
            elif c:
                whole.append(c)
        made.update(zip(whole, self._plain(whole), strict=True))
        out = []
        for name, b, s, c in zip(names, bare, starts, core, strict=True):
            ids = made[c]
            if s or len(b) != len(name):
                ids = (self.newline if s else b"") + ids + (b"" if len(b) == len(name) else self.endings[name[-1]])
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and for each text the end of its own."""
        marked = np.zeros(len(texts), bool)
        for token in self.added:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cut = self.cut(pc.if_else(pa.array(marked), pa.scalar("", texts.type), texts) if marked.any() else texts)
        flat, ends = cut.gather(self.cache.get(cut.names))
        if not marked.any():
            return flat, ends
        parts = np.split(flat, ends[:-1])
        for i in np.flatnonzero(marked).tolist():
            parts[i] = np.frombuffer(self._plain([texts[i].as_py()], added=True)[0], np.uint32)
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])


_known: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, word_ends: bool) -> Encoder:
    """One for each Python worker."""
    if (path, word_ends) not in _known:
        _known[path, word_ends] = Encoder(path, word_ends, 100_000 if word_ends else BYTE_LEVEL_CHUNKS)
    return _known[path, word_ends]


def each(column: pa.Array, path: str, word_ends: bool, end: int) -> Iterator[np.ndarray]:
    """For each text its ids with the end id."""
    flat, ends = encoder(path, word_ends).encode(column)
    stop, start = np.array([end], np.uint32), 0
    for e in ends.tolist():
        yield np.concatenate((flat[start:e], stop))
        start = e
