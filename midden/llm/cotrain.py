"""Quality by co-training: a classifier of a document's text and one of its metadata teach each other.

The text view has rates of the text's statistics and hashed words and pairs of words; the metadata view hashed source, language
and size class. Each has its own logistic classifier. In every round each view, calibrated on labelled rows set aside,
labels all unlabelled documents; those of which it is confident become training rows of the other view, if the
labelled rows set aside bear out that confidence. Rounds end when both pass on the same documents as before.
At the end each view's logits are calibrated on the rows set aside, and a small logistic combination of both scores every document.

Only labelled rows are bounded (`sample`, first by the hash of their id). The features of all unlabelled documents are written once;
a Newton step is one pass over them, in which every batch gives its sums of gradients and Hessians, so no
row comes to the driver. All passed documents together weigh as much as the labelled ones at most.

Cases: null and empty texts have zero statistics and no words, null or missing metadata is a value of its own; without both
labels in the training rows every score is their mean label (1 if there are none); repeated rows get equal scores;
extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import cut, forget, held_out, map_arrow, slices
from .rules import COUNTS, features, statistics_of

META, WORDS = 64, 192
ROUNDS, STEPS, SURE = 5, 3, 0.95
WIDTHS = (len(COUNTS) + WORDS + 1, META + 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def text_view(counts: np.ndarray, texts: pa.Array | None = None) -> np.ndarray:
    """Rates of rows of COUNTS, most on a log scale; signed sums of hashed words and pairs, as shares of their root; and a constant."""
    with np.errstate(divide="ignore", invalid="ignore"):
        by = features(lambda c: counts[:, COUNTS.index(c)].astype(np.float64))
    rates = np.stack([np.log1p(50 * v) if k != "n_words" else np.log1p(v) for k, v in by.items()], axis=1)
    hashed = np.zeros((len(counts), WORDS)) if texts is None else hashed_words(texts)
    return np.concatenate((rates, hashed, np.ones((len(counts), 1))), axis=1)


def hashed_words(texts: pa.Array) -> np.ndarray:
    own = chunks.words(texts)
    code = np.array([xxhash.xxh3_64_intdigest(w) for w in own.names], np.uint64)[own.index] if len(own.index) else np.empty(0, np.uint64)
    n = len(own.ends)
    row = np.repeat(np.arange(n), np.diff(own.ends, prepend=0))
    both = np.concatenate((code, (code[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:])[row[:-1] == row[1:]])) if len(code) else code
    rows = np.concatenate((row, row[:-1][row[:-1] == row[1:]])) if len(code) else row
    sign = np.where(both >> np.uint64(60) & np.uint64(1), 1.0, -1.0)
    out = np.bincount(rows * WORDS + ((both >> np.uint64(20)) % np.uint64(WORDS)).astype(np.int64), weights=sign, minlength=n * WORDS).reshape(n, WORDS)
    return out / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))[:, None]


def metadata_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source, language and size class, and a constant."""
    out = np.zeros((len(source), META + 1))
    out[:, -1] = 1
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        for token in (f"s:{s}", f"l:{g}", f"n:{None if n is None else int(2 * np.log2(1 + max(0, n)))}"):
            out[i, xxhash.xxh32_intdigest(token) % META] += 1
    return out


class Logistic:
    """A logistic classifier of standardised inputs, by damped Newton steps from sums over its rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pull: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        self.mean[-1], self.scale[-1] = 0, 1
        self.beta = np.zeros(x.shape[1])
        self.ridge = pull * np.eye(len(self.beta))
        self.ridge[-1, -1] = 1e-3
        self.x, self.y = x, y
        for _ in range(30):
            if self.step(np.zeros(len(self.beta)), np.zeros(self.ridge.shape)) < 1e-6:
                break

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10)

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the rows' loss."""
        z = self.standard(x)
        p = sigmoid(z @ self.beta)
        return z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z

    def step(self, gradient: np.ndarray, hessian: np.ndarray) -> float:
        """A step on the labelled rows' sums and those given; its largest entry."""
        g, h = self.sums(self.x, self.y)
        move = np.linalg.solve(h + hessian + self.ridge, g + gradient + self.ridge @ self.beta)
        self.beta = self.beta - np.clip(move, -2, 2)
        return float(np.abs(move).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.beta

    def slim(self) -> Logistic:
        """A copy without rows, to be sent."""
        out = object.__new__(Logistic)
        out.mean, out.scale, out.beta = self.mean, self.scale, self.beta
        return out


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic calibration of logits; the slope is positive."""
    both = Logistic(np.stack((z, np.ones(len(z))), axis=1), y, 0.1)
    a, b = both.beta[0] / both.scale[0], both.beta[1] - both.beta[0] * both.mean[0] / both.scale[0]
    return (float(a), float(b)) if a > 0 else (1e-3, 0.0)


class CoTrained:
    """The views' classifiers on labelled rows; every fifth is set aside for calibration."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray):
        aside = np.arange(len(y)) % 5 == 0
        if y[aside].min(initial=1) == y[aside].max(initial=0):
            aside = np.ones(len(y), bool)  # too few rows to set any aside
        use = ~aside if (~aside).any() and y[~aside].min() < y[~aside].max() else np.ones(len(y), bool)
        self.aside, self.y = [v[aside] for v in views], y[aside]
        self.labelled = int(use.sum())
        self.views = [Logistic(v[use], y[use]) for v in views]
        self.calibrate()

    def calibrate(self) -> None:
        """Calibrate both views on the rows set aside, find how sure each has to be, and fit the combination."""
        self.lines = [calibrated(m.logit(v), self.y) for m, v in zip(self.views, self.aside, strict=True)]
        z = self.logits(self.aside)
        self.sure = []
        for k in (0, 1):
            p = sigmoid(z[:, k])
            own = np.maximum(p, 1 - p) >= SURE
            right = ((p > 0.5) == (self.y == 1))[own]
            # A view that errs on the rows set aside more than it claims passes on nothing.
            self.sure.append(SURE if len(right) and right.mean() >= SURE - 0.02 else 2.0)
        self.combine = Logistic(z, self.y, 0.1)

    def logits(self, views: list[np.ndarray]) -> np.ndarray:
        """Calibrated logits of both views, and a constant."""
        z = [np.clip(a * m.logit(v) + b, -20, 20) for m, v, (a, b) in zip(self.views, views, self.lines, strict=True)]
        return np.stack([*z, np.ones(len(z[0]))], axis=1)

    def passed(self, views: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view the rows that it passes on, and its labels for them."""
        p = sigmoid(self.logits(views)[:, :2])
        return [(np.maximum(p[:, k], 1 - p[:, k]) >= self.sure[k], (p[:, k] > 0.5).astype(float)) for k in (0, 1)]

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """To nine decimals, as sums over batches of other sizes differ in their last bits."""
        z = self.logits(views)
        return tuple(np.round(sigmoid(x), 9) for x in (self.combine.logit(z), z[:, 0], z[:, 1]))

    def slim(self) -> CoTrained:
        out = object.__new__(CoTrained)
        out.views, out.lines, out.sure, out.combine = [m.slim() for m in self.views], self.lines, self.sure, self.combine.slim()
        return out


def exchange(teacher: CoTrained, pupils: list[Logistic], views: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each pupil the number of rows that the other view passes on to it, and their sums."""
    out = []
    for k, (rows, labels) in enumerate(reversed(teacher.passed(views))):
        out.append((int(rows.sum()), *pupils[k].sums(views[k][rows], labels[rows])))
    return out


class Constant:
    def __init__(self, share: float):
        self.share = share

    def slim(self) -> Constant:
        return self

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (np.full(len(views[0]), self.share),) * 3


def _plain(docs: DataFrame) -> DataFrame:
    """The columns of both views; a missing metadata column counts as null."""
    of = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), of("source", "string"), of("lang", "string"), of("n_chars", "long"))


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    counts = np.array([statistics_of(x) for x in batch.column("text").cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(COUNTS))
    return [text_view(counts, batch.column("text")), metadata_view(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))]


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Both views of a batch of written features."""
    both = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float16).reshape(batch.num_rows, sum(WIDTHS)).astype(np.float64)
    return [both[:, : WIDTHS[0]], both[:, WIDTHS[0] :]]


def with_features(rows: DataFrame) -> DataFrame:
    """(doc_id, label, features): both views of every row, as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            both = np.concatenate(_views(batch), axis=1).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in both], pa.binary())], ["doc_id", "label", "features"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, features binary")


def pooled(free: DataFrame, teacher: CoTrained, pupils: list[Logistic]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """exchange() over all rows of free: a task sends one row of sums."""
    sent = (teacher.slim(), [p.slim() for p in pupils])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.concatenate([np.concatenate(([n], g, h.ravel())) for n, g, h in exchange(*sent, _arrays(batch))])
            total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums"):
                own = np.frombuffer(x.as_buffer(), np.float64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = map_arrow(free.select("features"), run, "sums binary")
    rows = map_arrow(parts.repartition(16), add, "sums binary").collect()  # 16 rows of sums, whatever the input
    flat, out, at = np.sum([np.frombuffer(bytes(r["sums"]), np.float64) for r in rows], axis=0) if rows else np.zeros(sum(1 + w + w * w for w in WIDTHS)), [], 0
    for w in WIDTHS:
        out.append((int(flat[at]), flat[at + 1 : at + 1 + w], flat[at + 1 + w : at + 1 + w + w * w].reshape(w, w)))
        at += 1 + w + w * w
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000, rounds: int = ROUNDS) -> CoTrained | Constant:
    """Fit on at most `sample` labelled rows and all unlabelled ones; held-out rows are neither."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = with_features(_plain(docs).join(F.broadcast(chosen), "doc_id"))
    got = rows.groupBy("doc_id", "label").agg(F.min("features").alias("features")).select(rows.columns).toArrow()  # a row of features an id, however often it is repeated
    if not got.num_rows:
        return Constant(1.0)
    got = got.take(pc.sort_indices(got, [("doc_id", "ascending"), ("features", "ascending")])).combine_chunks().to_batches()[0]
    y = got.column("label").to_numpy().astype(float)
    if y.min() == y.max():
        return Constant(float(y.mean()))
    model = CoTrained(_arrays(got), y)
    if not rounds:
        return model
    free = with_features(_plain(docs).where(F.col("doc_id").isNotNull() & ~held_out()).withColumn("label", F.lit(None).cast("int")))
    free = cut(free.join(known.select("doc_id").hint("merge"), "doc_id", "left_anti"), "cotrain-features")  # features are shuffled, not texts
    before = None
    for _ in range(rounds):
        teacher = model.slim()
        counts: list[int] = []
        for _ in range(STEPS):
            found = pooled(free, teacher, model.views)
            counts = [n for n, _, _ in found]
            for pupil, (n, gradient, hessian) in zip(model.views, found, strict=True):
                weight = min(1.0, model.labelled / n) if n else 0.0
                pupil.step(weight * gradient, weight * hessian)
            if not any(counts):
                break
        model.calibrate()
        if counts == before or not any(counts):
            break
        before = counts
    forget(free)
    return model


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, text_score, metadata_score) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).slim())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, shared.value.scores(_views(batch)))], ["doc_id", "score", "text_score", "metadata_score"])

    rows = map_arrow(_plain(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, text_score double, metadata_score double")
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "metadata_score")
