"""Main text of web pages by a recurrent block labeller: a bidirectional LSTM in numpy.

A page becomes its leaf blocks in order: runs of text between block-level tags, without
what head, scripts, styles and comments hold; HTML's implied end tags are applied. The LSTM reads for each block hashed vectors of its tag path
(names, classes, ids) and of its words, and some sizes; forward and backward states
together label the block, so every label depends on the whole page.

Labels for training come from the markup's own meaning: what stands in article or main is text, what
stands in menus, headers, footers, asides, forms, or in containers named so is not.
Training pages are a bounded sample (sample pages of at most longest bytes by the hash of their id), and training runs in one executor task. Each is also rendered
anew with other containers and more kinds of boilerplate from other pages' words, some of them without any telling name, so that the
labeller doesn't depend on one template.

Cases: a null or empty html, or one without text, gives an empty text; broken markup is read as far as it
goes, in time that grows with its length: an open head ends where the body's elements or text begin, items, cells, rows, options and paragraphs end where
HTML says they do, and an unclosed noscript, select or object hides nothing
from the next block element on; scripts and styles cut no word or block in which they stand; without article or main in any page containers named as text say what is text,
and without these all is text but what the markup says is something else; repeated rows, and rows without an id, are labelled like others;
very long pages are labelled whole; extra columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_one_task, map_arrow, slices

# Element names by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title svg iframe object textarea select".split())
UNSURE = frozenset("noscript select object".split())  # of HIDDEN, those that hide all up to their own end tag only
SILENT = frozenset(("script", "style"))  # of HIDDEN, those that hold no elements and may stand within a word
HEAD_TAGS = frozenset("base link meta noscript script style template title head html".split())
TEXT_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset("nav header footer aside form button menu dialog".split())
# Words in class or id names of what is no main text.
OTHER_NAMES = frozenset("ad ads advert advertisement banner promo sponsor sponsored nav navbar menu header masthead footer sidebar aside widget related share social comment comments reply replies cookie consent notice popup modal breadcrumb breadcrumbs form subscribe newsletter login pagination copyright tags".split())
TEXT_NAMES = frozenset("content article post entry story body main text".split())

# Elements that a start tag ends, and the elements beyond which it doesn't look for them, as HTML's optional end tags say.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr", "caption", "colgroup")), frozenset(("table",))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
# Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
# Elements in which an end tag or an implied one doesn't look for elements outside.
SCOPES = frozenset("table td th caption button object select template html".split())

PATH, WORD, SIZES, HIDDEN_SIZE = 24, 12, 8, 24
INPUT = 2 * PATH + WORD + SIZES
NAME = re.compile(r"[a-z]+")


class Node:
    """An element within its parents; what its path means and its path's vector follow from those of its parent."""

    __slots__ = ("parent", "tag", "names", "says", "named", "near", "tells")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...] = ()):
        self.parent, self.tag, self.names = parent, tag, names
        self.says, self.named = (_meaning(-1 if parent is None else (parent.says, parent.named)[k], tag, names, bool(k)) for k in (0, 1))
        own = element(tag, names)
        near, tells = (np.zeros(PATH), np.zeros(PATH)) if parent is None else (parent.near, parent.tells)
        # Telling elements fade by each telling one nearer to the text, others by each element.
        if names or tag in OTHER_TAGS or tag in TEXT_TAGS:
            self.near, self.tells = NEAR * near, own + TELLS * tells
        else:
            self.near, self.tells = own + NEAR * near, tells


NEAR, TELLS = 0.5, 0.7


def _meaning(before: int, tag: str, names: tuple[str, ...], named: bool) -> int:
    """1: main text, 0: something else, -1: the markup doesn't say; named: containers named as text count as main text."""
    if before == 0 or (tag in OTHER_TAGS or OTHER_NAMES.intersection(names)) and not (tag == "header" and before == 1):
        return 0
    return 1 if tag in TEXT_TAGS or named and TEXT_NAMES.intersection(names) else before


def node(*path: tuple[str, tuple[str, ...]]) -> Node | None:
    """The last element of a path of (tag, names)."""
    out = None
    for tag, names in path:
        out = Node(out, tag, names)
    return out


Block = tuple[Node | None, str, int]


class Blocks(HTMLParser):
    """(element, text, link characters) of leaf blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[Node] = []
        self.open: Counter[str] = Counter()
        self.found: list[Block | None] = []
        self.parts: list[str] = []
        self.hidden = self.links = self.linked = 0
        # Place in the path, blocks before it, and a list: the blocks before the first block element in it, once there is one.
        # All that such an element met open share a list, so no block before an inner one's is in an outer list's range.
        self.unsure: list[tuple[int, int, list[int]]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((self.path[-1] if self.path else None, text, self.linked))
        self.parts, self.linked = [], 0

    def end(self, at: int, own: bool = False) -> None:
        """End the path's elements from at on; own: by the end tag of the one at at."""
        while self.unsure and self.unsure[-1][0] >= at:
            place, first, block = self.unsure.pop()
            if not block or own and place == at:
                del self.found[first:]
            else:  # what follows keeps its place
                self.found[first : block[0]] = [None] * (block[0] - first)
            if block:
                block[0] = min(block[0], first)
        for x in self.path[at:]:
            self.hidden -= x.tag in HIDDEN and x.tag not in UNSURE
            self.open[x.tag] -= 1
        del self.path[at:]

    def last(self, tags: frozenset[str], limits: frozenset[str]) -> int:
        """The place of the innermost element of tags within limits, or -1."""
        if any(self.open[t] for t in tags):
            for at in range(len(self.path) - 1, -1, -1):
                if self.path[at].tag in tags:
                    return at
                if self.path[at].tag in limits:
                    break
        return -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE and tag not in SILENT:
            self.flush()
        if self.open["head"] and (tag == "body" or tag not in HEAD_TAGS and self.path[-1].tag == "head"):
            at = self.last(frozenset(("head",)), frozenset())
            self.flush()
            self.end(at)
        if tag in ENDS_P and (at := self.last(frozenset(("p",)), SCOPES)) >= 0:
            self.end(at)
        if tag in IMPLIED and (at := self.last(*IMPLIED[tag])) >= 0:
            self.end(at)
        if tag in VOID:
            return
        if self.unsure and tag not in INLINE and tag not in HIDDEN and tag not in ("option", "optgroup"):
            self.unsure[-1][2] or self.unsure[-1][2].append(len(self.found))
        if tag not in INLINE:
            names = tuple(NAME.findall(" ".join(v.lower() for k, v in attrs if k in ("class", "id", "role") and v)))
            self.path.append(Node(self.path[-1] if self.path else None, tag, names))
            self.open[tag] += 1
        if tag in UNSURE:
            self.unsure.append((len(self.path) - 1, len(self.found), self.unsure[-1][2] if self.unsure and not self.unsure[-1][2] else []))
        self.hidden += tag in HIDDEN and tag not in UNSURE
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
            self.links -= tag == "a"
        else:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.links = max(0, self.links - (tag == "a"))
        if tag in INLINE:
            return
        if tag not in SILENT:
            self.flush()
        if (at := self.last(frozenset((tag,)), frozenset())) >= 0:
            self.end(at, own=True)

    def handle_data(self, data: str) -> None:
        if self.hidden and self.path[-1].tag == "head" and data.strip():
            self.flush()
            self.end(len(self.path) - 1)
        if not self.hidden:
            self.parts.append(data)
            self.linked += len(data) * bool(self.links)


def blocks(html: str) -> list[Block]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    parser.end(0)
    return [block for block in parser.found if block is not None]


def meaning(place: Node | None, named: bool = False) -> int:
    return -1 if place is None else place.named if named else place.says


@lru_cache(1 << 16)
def element(tag: str, names: tuple[str, ...]) -> np.ndarray:
    """The hashed vector of a tag and its name words."""
    out = np.zeros(PATH)
    for k, token in enumerate((tag, *names)):
        for j in (0, 1):
            h = xxhash.xxh32_intdigest(token, j)
            out[h % PATH] += (1.0 if h & 1 << 20 else -1.0) * (1.5 if k else 1.0)
    return out


@lru_cache(1 << 18)
def word_code(word: str) -> int:
    """Where a word counts: the first WORD places are positive, the others negative."""
    h = xxhash.xxh32_intdigest(word, 7)
    return h % WORD + (0 if h & 1 << 20 else WORD)


def vectors(found: list[Block]) -> np.ndarray:
    """A row for each block: hashed path, hashed words and sizes, all of the whole path and text."""
    out = np.zeros((len(found), INPUT), np.float32)
    for i, (place, text, linked) in enumerate(found):
        if place is not None:
            out[i, :PATH], out[i, PATH : 2 * PATH] = place.near, place.tells
        words = text.lower().split(" ")
        codes = np.bincount(list(map(word_code, words)), minlength=2 * WORD)
        signed = codes[:WORD] - codes[WORD:]
        out[i, 2 * PATH : 2 * PATH + WORD] = signed / max(1.0, float(signed @ signed) ** 0.5)
        n = len(text)
        out[i, 2 * PATH + WORD :] = (np.log1p(n) / 6, linked / max(1, n), np.log1p(len(words)) / 4, text[-1] in ".!?", text[:1].isupper(), np.log1p(sum(map(text.count, ".,;:"))) / 4, i / max(1, len(found)), np.log1p(len(found)) / 6)
    return out


class Labeller:
    """The weights of both directions and of the output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d, h = INPUT, HIDDEN_SIZE
        self.w = {}
        for name in ("f", "b"):
            self.w[f"{name}x"] = rng.normal(0, d**-0.5, (d, 4 * h)).astype(np.float32)
            self.w[f"{name}h"] = rng.normal(0, h**-0.5, (h, 4 * h)).astype(np.float32)
            self.w[f"{name}0"] = np.repeat(np.array([0, 1, 0, 0], np.float32), h)
        self.w["o"] = rng.normal(0, (2 * h) ** -0.5, 2 * h).astype(np.float32)
        self.w["o0"] = np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, name: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states over steps x rows x inputs; gates are input, forget, candidate, output."""
        steps, rows, h = x.shape[0], x.shape[1], HIDDEN_SIZE
        state, cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
        out, kept = np.empty((steps, rows, h), np.float32), []
        given = x @ self.w[f"{name}x"] + self.w[f"{name}0"]
        for t in range(steps):
            z = given[t] + state @ self.w[f"{name}h"]
            gate = 1 / (1 + np.exp(-np.clip(z, -20, 20)))
            candidate = np.tanh(z[:, 2 * h : 3 * h])
            new = gate[:, h : 2 * h] * cell + gate[:, :h] * candidate
            tanh = np.tanh(new)
            if keep:
                kept.append((state, cell, gate, candidate, tanh))
            cell, state = new, gate[:, 3 * h :] * tanh
            out[t] = state
        return out, kept

    def _turn(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each row's own steps in reverse, padding stays behind."""
        t = np.arange(x.shape[0])[:, None]
        at = np.where(t < sizes, sizes - 1 - t, t)
        return x[at, np.arange(x.shape[1])]

    def logits(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        f, _ = self._pass(x, "f", False)
        b, _ = self._pass(self._turn(x, sizes), "b", False)
        return np.concatenate((f, self._turn(b, sizes)), axis=2) @ self.w["o"] + self.w["o0"]

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over labelled blocks (y is 0 or 1, others -1)."""
        h, back = HIDDEN_SIZE, {}
        turned = self._turn(x, sizes)
        (f, fk), (b, bk) = self._pass(x, "f", True), self._pass(turned, "b", True)
        both = np.concatenate((f, self._turn(b, sizes)), axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["o"] + self.w["o0"], -20, 20)))
        g = np.where(y >= 0, p - y, 0).astype(np.float32) / max(1, (y >= 0).sum())
        back["o"], back["o0"] = np.einsum("tr,trh->h", g, both), np.array([g.sum()])
        up = g[:, :, None] * self.w["o"]
        for name, xs, kept, dh in (("f", x, fk, up[:, :, :h]), ("b", turned, bk, self._turn(up[:, :, h:], sizes))):
            wx, wh, w0 = (np.zeros_like(self.w[name + k]) for k in "xh0")
            d_state, d_cell = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
            for t in range(len(kept) - 1, -1, -1):
                state, cell, gate, candidate, tanh = kept[t]
                i, fo, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 3 * h :]
                d_state = d_state + dh[t]
                d_cell = d_cell + d_state * o * (1 - tanh**2)
                z = np.concatenate((d_cell * candidate * i * (1 - i), d_cell * cell * fo * (1 - fo), d_cell * i * (1 - candidate**2), d_state * tanh * o * (1 - o)), axis=1)
                wx += xs[t].T @ z
                wh += state.T @ z
                w0 += z.sum(axis=0)
                d_state, d_cell = z @ self.w[f"{name}h"].T, d_cell * fo
            back[name + "x"], back[name + "h"], back[name + "0"] = wx, wh, w0
        return back

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page whether its blocks are main text; pages of like length go together."""
        out: list = [np.empty(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 256 and len(pages[order[end]]) * (end + 1 - at) <= 40_000:
                end += 1
            own = order[at:end]
            x, sizes = _padded([pages[i] for i in own])
            z = self.logits(x, sizes)
            for k, i in enumerate(own):
                out[i] = z[: len(pages[i]), k] > 0
            at = end
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((int(sizes.max()), len(pages), INPUT), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, sizes


def rendered(found: list[Block], others: list[str], rng: np.random.Generator, named: bool = False) -> tuple[list[Block], list[int]]:
    """The page's labelled blocks in containers of another template, with boilerplate made of others' words, both also deeply nested.

    Some renderings have no telling name at all; their boilerplate is short and mostly links, as nothing else could tell it.
    """
    text = [(p, t, n) for p, t, n in found if meaning(p, named) == 1]
    names = sorted(OTHER_NAMES)
    bare = rng.random() < 0.12
    tag = ("article", "main", "section", "div")[rng.integers(4)]
    kind = (tag, (sorted(TEXT_NAMES)[rng.integers(len(TEXT_NAMES))],) if tag in ("section", "div") or rng.random() < 0.3 else ())
    root = node(("html", ()), ("body", ()))

    def bare_name() -> tuple[str, tuple[str, ...]]:
        return "div", ("".join(chr(97 + rng.integers(26)) for _ in range(int(rng.integers(1, 6)))),) if rng.random() < 0.7 else ()

    def wrapped(place: Node | None) -> Node | None:
        """place, or an element up to a dozen neutral elements within it."""
        plain = ("div", "ul", "li", "section", "td")
        for _ in range(int(rng.integers(1, 13)) if rng.random() < 0.4 else 0):
            place = Node(place, plain[rng.integers(len(plain))])
        return place

    def aside(k: int, within: Node | None) -> list[Block]:
        out: list[Block] = []
        for _ in range(k):
            kind = ("div", (names[rng.integers(len(names))],)) if rng.random() < 0.7 else (sorted(OTHER_TAGS)[rng.integers(len(OTHER_TAGS))], ())
            place = Node(wrapped(Node(within, *(bare_name() if bare else kind))), ("p", "li", "div", "ul")[rng.integers(4)])
            for _ in range(int(rng.integers(1, 6))):
                words = others[rng.integers(len(others))].split(" ")
                a = int(rng.integers(len(words)))
                short = bare or rng.random() < 0.6
                piece = " ".join(words[a : a + int(rng.integers(1, 6 if bare else 30))] if short else words)  # readers write whole paragraphs too
                out.append((place, piece, len(piece) * int(rng.random() < (0.9 if bare else 0.3))))
        return out

    before, after = aside(int(rng.integers(0, 4)), root), aside(int(rng.integers(0, 4)), root)
    middle: list[Block] = []
    labels: list[int] = []
    own = wrapped(Node(root, *(bare_name() if bare else kind)))
    for p, t, n in text:
        if rng.random() < 0.04 and not bare:
            inner = aside(1, own)
            middle += inner
            labels += [0] * len(inner)
        middle.append((Node(own, p.tag, p.names) if p is not None else own, t, n))
        labels.append(1)
    return before + middle + after, [0] * len(before) + labels + [0] * len(after)


def train(pages: list[str], rounds: int = 18, batch: int = 32, seed: int = 3, most_blocks: int = 120, renderings: int = 600) -> Labeller | None:
    """Fit on the pages as they are and as rendered anew, about `renderings` times in all; of a longer page windows of most_blocks blocks. The weights are the mean over the last third of the rounds. None if no page says what is text."""
    rng = np.random.default_rng(seed)
    model = Labeller(seed)
    found = [b for b in map(blocks, pages) if b]
    others = [t for b in found for p, t, _ in b[:8]] or ["text"]
    data = []
    named = not any(meaning(p) == 1 for b in found for p, _, _ in b)
    if named and not any(meaning(p, True) == 1 for b in found for p, _, _ in b):
        return None
    for b in found:
        for own, y in ((b, [meaning(p, named) for p, _, _ in b]), *(rendered(b, others, rng, named) for _ in range(-(-renderings // len(found))))):
            if not own:
                continue
            v = vectors(own)
            for a in range(0, len(own), most_blocks):
                data.append((v[a : a + most_blocks], np.array(y[a : a + most_blocks])))
    m, v, mean = ({k: np.zeros_like(w) for k, w in model.w.items()} for _ in range(3))
    t, late = 0, 0
    for r in range(rounds):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[i][0]) // 8 for i in order], kind="stable")]
        starts = rng.permutation(np.arange(0, len(order), batch))
        for a in starts:
            own = order[a : a + batch]
            x, sizes = _padded([data[i][0] for i in own])
            y = np.full(x.shape[:2], -1)
            for k, i in enumerate(own):
                y[: len(data[i][1]), k] = data[i][1]
            t += 1
            for k, g in model.gradients(x, sizes, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.w[k] = (model.w[k] - (0.01 if r < rounds * 2 // 3 else 0.003) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            if r >= rounds * 2 // 3:
                late += 1
                for k, w in model.w.items():
                    mean[k] += (w - mean[k]) / late
    model.w = mean
    return model


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = 200, longest: int = 1 << 20) -> Labeller | None:
    """Train on at most `sample` pages of up to `longest` bytes, those that say what is text before others, then by the hash of their key."""
    tags, names = (f"(?i)<({'|'.join(sorted(TEXT_TAGS))})[\\s>/]", f"(?i)(class|id|role)\\s*=[^>]*\\b({'|'.join(sorted(TEXT_NAMES))})\\b")
    says = F.when(F.col(html).rlike(tags), 2).when(F.col(html).rlike(names), 1).otherwise(0)
    full = pages.where((F.octet_length(html) > 0) & (F.octet_length(html) <= longest)).select(F.xxhash64(key, html).alias("mark"), says.alias("says"), F.col(html).alias("html"))
    chosen = full.select("mark", "says").distinct().orderBy(F.desc("says"), F.xxhash64("mark"), "mark").limit(sample).select("mark")  # marks alone are compared, so no task sends pages
    rows = full.join(F.broadcast(chosen), "mark").groupBy("mark").agg(F.first("html").alias("html"))
    return in_one_task(rows, lambda t: train([h for h, _ in sorted(zip(t["html"].to_pylist(), t["mark"].to_pylist(), strict=True))]))


def extract(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """(page_id, url, text, n_chars): the joined main text of every page; without a model all that isn't marked as something else."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = ["page_id", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 2 << 20):
            found = [blocks(h) for h in batch.column("html").to_pylist()]
            marks = [[meaning(p) != 0 for p, _, _ in b] for b in found] if shared.value is None else shared.value.label([vectors(b) for b in found])
            texts = [" ".join(t for (_, t, _), keep in zip(b, m, strict=True) if keep) for b, m in zip(found, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(pages.select(*names, F.coalesce("html", F.lit("")).alias("html")), run, f"{kinds}, text string, n_chars long")
