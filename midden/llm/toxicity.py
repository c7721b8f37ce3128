"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed rows: of the word itself and of its first letters. Over
the vectors run filters of several widths; each filter's largest value over the whole
text feeds a logistic output. Training follows the gradient through the maxima with adaptive
steps. The rows start from the words' smoothed log-odds in one direction and small noise.

Thresholds differ by language. A text's language is guessed from its words alone, and on
training rows set aside for that, each language's logits get a logistic calibration, so
that 0.5 is the threshold in every language. The lang column only names the classes on which
the guesser is fitted; labels, lang, source and doc_id are no inputs of a score.

The classifier is fitted on a bounded sample (sample labelled rows of each label, and half of
sample_bytes of text for each); of labelled documents of more than longest bytes training has a window of whole words.
It runs in one executor task. At its peak that holds about 15 bytes for each byte of the sample (word places, and a few
arrays of 8 bytes for each pair of a text and a distinct word), some 170 MB for the 12 MB of the
default; only the weights, 40 bytes for each bucket that two texts share, come to the driver.
Every document is scored whole.

Cases: null and empty texts get the score of a text without words; without both labels in the
training rows every score is the share of toxic rows among them (0 if there are none), at
most 0.49, and a warning says so; repeated rows get equal scores; extra columns don't matter.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import cut, forget, held_out, in_one_task, map_arrow, slices, texts_of

BUCKETS = 1 << 26
PREFIXES = (3, 4, 5)
WIDTHS = (1, 2, 3)
LEAST = 20  # labelled documents
STRIP = ".,;:!?\"'()[]"


def word_buckets(word: str) -> list[int]:
    """The hashed rows of a word, -1 where it is too short for a prefix."""
    word = word.lower().strip(STRIP)
    return [xxhash.xxh32_intdigest(word) & (BUCKETS - 1)] + [xxhash.xxh32_intdigest(word[:n], n) & (BUCKETS - 1) if len(word) > n else -1 for n in PREFIXES]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Texts as rows of distinct words, with two words of padding before each, so that no filter reaches into the next text."""

    def __init__(self, texts: pa.Array):
        cut = chunks.words(texts)
        self.names = cut.names
        n = len(cut.ends)
        sizes = np.diff(cut.ends, prepend=0)
        self.pad = len(self.names)
        self.starts = np.concatenate(([0], cut.ends[:-1])) + 2 * np.arange(n) if n else np.empty(0, np.int64)
        self.rows = np.full(int(sizes.sum()) + 2 * n, self.pad, np.int32)
        self.rows[np.arange(int(sizes.sum())) + 2 * np.repeat(np.arange(1, n + 1), sizes)] = cut.index
        self.n = n

    def buckets(self) -> np.ndarray:
        out = np.full((len(self.names) + 1, 1 + len(PREFIXES)), -1, np.int32)
        for i, w in enumerate(self.names):
            out[i] = word_buckets(w)
        return out

    def part(self, first: int, last: int) -> Words:
        """The texts from first to last, with the same names."""
        out = object.__new__(Words)
        out.names, out.pad, out.n = self.names, self.pad, last - first
        ends = np.append(self.starts, len(self.rows))
        out.starts, out.rows = self.starts[first:last] - ends[first], self.rows[ends[first] : ends[last]]
        return out


class Model:
    """The rows that training has met, in order of their bucket; others count as zero."""

    def __init__(self, kept: np.ndarray, dim: int = 8, filters: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.kept = kept
        self.rows = np.zeros((len(kept) + 1, dim), np.float32)  # the last is zero
        self.rows[:-1] = rng.normal(0, 0.02, (len(kept), dim))
        self.filters = [rng.normal(0, 0.3, (w, dim, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.full(filters, 0.1, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, (len(WIDTHS), filters)).astype(np.float32)
        for w, f in enumerate(self.filters):  # half of the filters look for the first direction at one place
            f[w // 2, 0, : filters // 2] = 1
            self.out[w, : filters // 2] = 0.5
        self.base = np.float32(-1)
        self.languages: list[str] = []
        self.language_log = np.zeros((len(kept) + 1, 1), np.float32)
        self.calibration = np.array([[1.0, 0.0]])

    def places(self, buckets: np.ndarray) -> np.ndarray:
        """Where the buckets' rows are; of unknown ones the last."""
        at = np.minimum(np.searchsorted(self.kept, buckets), len(self.kept) - 1) if len(self.kept) else np.zeros(buckets.shape, np.int64)
        return np.where(self.kept[at] == buckets, at, len(self.kept)) if len(self.kept) else at

    def vectors(self, words: Words, places: np.ndarray) -> np.ndarray:
        """The sum of the rows of each distinct word."""
        out = self.rows[places[:, 0]]
        for c in range(1, places.shape[1]):
            out += self.rows[places[:, c]]
        out[words.pad] = 0
        return out

    def logits(self, words: Words, places: np.ndarray) -> np.ndarray:
        vectors = self.vectors(words, places)
        out = np.full(words.n, self.base, np.float32)
        for w, f, bias, o in zip(WIDTHS, self.filters, self.bias, self.out, strict=True):
            z = (vectors @ f[0])[words.rows]
            for j in range(1, w):
                z[:-j] += (vectors @ f[j])[words.rows[j:]]
            out += np.maximum(np.maximum.reduceat(z, words.starts, axis=0) + bias, 0) @ o
        return out

    def language(self, words: Words, places: np.ndarray) -> np.ndarray:
        """The class of the largest sum of the words' log shares."""
        own = self.language_log[places[:, 0]]
        own[words.pad] = 0
        return np.add.reduceat(own[words.rows], words.starts, axis=0).argmax(axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts)
        if not words.n:
            return np.empty(0)
        places = self.places(words.buckets())
        a, b = self.calibration[self.language(words, places)].T
        return sigmoid(a * self.logits(words, places) + b)


def _platt(z: np.ndarray, y: np.ndarray, pull: float = 0.1) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton's steps."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0, 0.0
    mid, scale = (z[y == 1].mean() + z[y == 0].mean()) / 2, max(1e-6, z.std())
    x = np.stack(((z - mid) / scale, np.ones(len(z))), axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        grad = x.T @ ((p - y)) + pull * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * mid / scale)


def train(texts: list[str] | pa.Array, toxic: np.ndarray, languages: list[str], rounds: int = 6, batch: int = 64, rate: float = 0.1, seed: int = 7) -> Model:
    """The model of labelled texts; every fifth is set aside for the calibration."""
    words = Words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    buckets = words.buckets()
    # Rows for buckets that at least two texts have, with smoothed log-odds of toxic texts.
    text_of = np.repeat(np.arange(words.n, dtype=np.int32), np.diff(np.append(words.starts, len(words.rows))))
    pairs = text_of.astype(np.int64) << 32 | words.rows
    pairs.sort()
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    owner, word = (pairs >> 32).astype(np.int32), pairs.astype(np.int32)
    del pairs
    aside = np.arange(words.n) % 5 == 0
    kept, p, n = _document_counts(owner, word, buckets, toxic, aside)
    del owner, word
    model = Model(kept, seed=seed)
    of = [max(1, int(((toxic == c) & ~aside).sum())) for c in (0, 1)]
    model.rows[:-1, 0] = np.clip(np.log(((p + 0.5) / of[1]) / ((n + 0.5) / of[0])), -1, 4) / 4
    places = model.places(buckets).astype(np.int32)
    del buckets

    model.languages = sorted(set(languages))
    by = np.array([model.languages.index(x) for x in languages], np.int64)
    logs = np.zeros((len(kept) + 1, len(model.languages)), np.float32)
    known = places[words.rows, 0]
    for c in range(len(model.languages)):
        logs[:, c] = np.bincount(known[by[text_of] == c], minlength=len(kept) + 1)
    logs[-1] = 0
    logs = np.log(logs + 0.1) - np.log(logs.sum(axis=0) + 0.1 * len(logs))
    model.language_log = logs - logs.mean(axis=1, keepdims=True)
    model.language_log[-1] = 0
    del known, text_of, logs

    _descend(model, words, places, toxic, np.flatnonzero(~aside), rounds, batch, rate, seed)
    parts = [words.part(a, min(a + 256, words.n)) for a in range(0, words.n, 256)]
    z, guess = (np.concatenate([f(p, places) for p in parts]) for f in (model.logits, model.language))
    overall = _platt(z[aside], toxic[aside])
    model.calibration = np.array([_platt(z[own], toxic[own]) if (own := aside & (guess == c)).sum() >= 40 and 5 <= toxic[own].sum() <= own.sum() - 5 else overall for c in range(len(model.languages))])
    return model


def _document_counts(owner: np.ndarray, word: np.ndarray, buckets: np.ndarray, toxic: np.ndarray, aside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of at least two texts, and how many toxic and other training texts have each; one kind of bucket at a time bounds memory."""
    parts = []
    for c in range(buckets.shape[1]):
        column = buckets[word, c]
        flat = owner[column >= 0].astype(np.int64) * BUCKETS + column[column >= 0]
        flat.sort()
        flat = flat[np.concatenate(([True], flat[1:] != flat[:-1]))] if len(flat) else flat
        text, bucket = (flat >> 26).astype(np.int32), (flat & (BUCKETS - 1)).astype(np.int32)
        del flat, column
        kept, inverse, count = np.unique(bucket, return_inverse=True, return_counts=True)
        use = ~aside[text]
        p = np.bincount(inverse[use & (toxic[text] == 1)], minlength=len(kept))
        n = np.bincount(inverse[use & (toxic[text] == 0)], minlength=len(kept))
        parts.append((kept[count >= 2], p[count >= 2], n[count >= 2]))
    kept, first = np.unique(np.concatenate([x[0] for x in parts]), return_index=True)
    return kept, np.concatenate([x[1] for x in parts])[first], np.concatenate([x[2] for x in parts])[first]


def _descend(model: Model, words: Words, places: np.ndarray, toxic: np.ndarray, use: np.ndarray, rounds: int, batch: int, rate: float, seed: int) -> None:
    """Adaptive gradient steps; the gradient of a maximum goes to the place where it is taken."""
    rng = np.random.default_rng(seed)
    ends = np.append(words.starts[1:], len(words.rows))
    squares = {"rows": np.full(len(model.rows), 1e-2, np.float32)} | {f"f{w}": np.full(f.shape, 1e-2) for w, f in enumerate(model.filters)} | {f"b{w}": np.full(b.shape, 1e-2) for w, b in enumerate(model.bias)} | {"out": np.full(model.out.shape, 1e-2), "base": np.full((), 1e-2)}

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        squares[name] += grad * grad
        return value - rate * grad / np.sqrt(squares[name])

    for _ in range(rounds):
        order = rng.permutation(use)
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            at = np.concatenate([np.arange(words.starts[t], ends[t]) for t in own])
            starts = np.cumsum(ends[own] - words.starts[own]) - (ends[own] - words.starts[own])
            seq = words.rows[at]
            used, seq = np.unique(seq, return_inverse=True)
            vectors = model.rows[places[used]].sum(axis=1)
            vectors[used == words.pad] = 0
            tops, hidden = [], []
            for width, f, b in zip(WIDTHS, model.filters, model.bias, strict=True):
                z = (vectors @ f[0])[seq]
                for j in range(1, width):
                    z[:-j] += (vectors @ f[j])[seq[j:]]
                top = np.maximum.reduceat(z, starts, axis=0)
                span = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(seq))))
                first = np.full(top.shape, len(seq), np.int64)
                rows, cols = np.nonzero(z == top[span])
                np.minimum.at(first, (span[rows], cols), rows)
                tops.append(first)
                hidden.append(np.maximum(top + b, 0))
            logit = model.base + sum(h @ o for h, o in zip(hidden, model.out, strict=True))
            weight = np.where(toxic[own] == 1, 0.5 / max(1, (toxic[own] == 1).sum()), 0.5 / max(1, (toxic[own] == 0).sum()))
            g = (weight * (sigmoid(logit) - toxic[own])).astype(np.float32)
            row_grad = np.zeros(vectors.shape, np.float32)
            out_grad = np.stack([g @ h for h in hidden]) + 1e-4 * model.out
            for w, width in enumerate(WIDTHS):
                back = g[:, None] * model.out[w] * (hidden[w] > 0)
                f_grad = np.zeros_like(model.filters[w])
                for j in range(width):
                    place = np.minimum(tops[w] + j, len(seq) - 1)
                    inside = tops[w] + j < len(seq)
                    who = seq[place]
                    f_grad[j] = np.einsum("tk,tkd->dk", back * inside, vectors[who])
                    for k in range(back.shape[1]):
                        np.add.at(row_grad, who[:, k], (back[:, k] * inside[:, k])[:, None] * model.filters[w][j][:, k])
                model.filters[w] = step(f"f{w}", model.filters[w], f_grad).astype(np.float32)
                model.bias[w] = step(f"b{w}", model.bias[w], back.sum(axis=0)).astype(np.float32)
            model.out = step("out", model.out, out_grad).astype(np.float32)
            model.base = np.float32(step("base", model.base, g.sum()))
            row_grad[used == words.pad] = 0
            hot = np.flatnonzero(np.abs(row_grad).sum(axis=1))
            target = places[used[hot]]
            spread = np.repeat(hot, target.shape[1])
            flat, back_at = np.unique(target.ravel(), return_inverse=True)
            total = np.zeros((len(flat), row_grad.shape[1]), np.float32)
            np.add.at(total, back_at, row_grad[spread])
            squares["rows"][flat] += (total * total).sum(axis=1)
            model.rows[flat] -= (rate * 0.5 * total / np.sqrt(squares["rows"][flat])[:, None]).astype(np.float32)
            model.rows[-1] = 0


def constant(share: float) -> Model:
    model = Model(np.empty(0, np.int64))
    model.out[:] = 0
    model.base = np.float32(0)
    share = min(max(share, 1e-3), 0.49)
    model.calibration = np.array([[0.0, np.log(share / (1 - share))]])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 2000, sample_bytes: int = 12 << 20, longest: int = 256 << 10, train_rows=None) -> Model:
    """Fit on at most `sample` training rows of each label, first by the hash of their id, as long as a label's texts stay in half of sample_bytes.

    Of a text of more than `longest` bytes training has a window of whole words of at most that many; ids whose rows are
    over half of sample_bytes together, or more than `sample`, aren't learned from.
    """
    longest = min(longest, sample_bytes // 2)
    keep = ~held_out() if train_rows is None else train_rows
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep).select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    sizes = docs.select("doc_id", F.least(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(longest)).cast("long").alias("bytes")).join(known, "doc_id").groupBy("doc_id", "label").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes, "toxicity-sizes")  # numbers of labelled documents
    fits = sizes.where((F.col("bytes") + F.col("n") <= sample_bytes // 2) & (F.col("n") <= sample))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    tops = [fits.where(F.col("label") == c).orderBy(*order).limit(sample).toPandas() for c in (0, 1)]
    tops = [t[(t["bytes"] + t["n"]).cumsum() <= sample_bytes // 2] for t in tops]
    if sum(map(len, tops)) < LEAST or not all(map(len, tops)):
        return _without_classifier(sizes, label)
    ids = [(i, c) for c, t in enumerate(tops) for i in t["doc_id"].tolist()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(ids, f"doc_id {kind}, label int")
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", _window(F.coalesce("text", F.lit("")), longest).alias("text"), lang.alias("lang")).join(F.broadcast(chosen), "doc_id")  # 2 * sample rows of two numbers
    model = in_one_task(rows, _train_table)
    forget(sizes)
    return model


def _window(text: Column, longest: int) -> Column:
    """text if it has at most longest bytes, else whole words of a part that begins anywhere, by the text's hash."""
    chars = longest // 4  # at most four bytes each
    start = F.pmod(F.xxhash64(text), F.char_length(text) - chars + 1).cast("int") + 1
    part = F.substring(text, start, F.lit(chars))
    words = F.regexp_replace(F.regexp_replace(part, r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+[^\x20\x09-\x0D]*$", "")
    return F.when(F.octet_length(text) <= longest, text).when(F.length(words) > 0, words).otherwise(part)


def _train_table(rows: pa.Table) -> Model:
    rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")]))
    return train(rows["text"].combine_chunks(), rows["label"].to_numpy().astype(np.float32), rows["lang"].to_pylist())


def _without_classifier(sizes: DataFrame, label: str) -> Model:
    """The constant model where too few labelled documents can be learned from."""
    have = {r["label"]: (r["docs"], r["toxic"]) for r in sizes.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.sum("label").alias("toxic")).collect()}
    docs, toxic = (sum(x) for x in zip(*have.values(), strict=True)) if have else (0, 0)
    warnings.warn(f"{label}: {docs} labelled documents of {len(have)} labels are no base for a classifier; all documents get one score", stacklevel=3)
    return constant(toxic / docs if docs else 0.0)


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) for every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by fit's sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(shared.value.scores(batch.column("text")), pa.float64())], [key, "score"])

    return map_arrow(texts_of(docs, key), run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    rows = score(docs, fit(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't toxic, with docs' columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            text = pc.fill_null(batch.column("text"), "")
            yield batch.filter(pa.array(model.value.scores(text) < 0.5)).select(names)

    return map_arrow(docs, run, docs.schema)
