"""Quality rules learned as a decision list over a text's statistics.

Sequential covering: on labelled rows a rule, a conjunction of threshold conditions, is
grown by information gain on two thirds of what is left, pruned on the other third, and what
it covers is set aside; it ends when no rule is precise enough on the pruning rows. The list
becomes one ordered Spark conditional expression. Rows that are held out (see common.held_out) aren't learned from.

Cases: a null or empty text has zero statistics; labels may miss, repeat or be null (null
ones are left out); without usable labels the list is empty and rejects nothing; repeated
rows get equal verdicts; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_stops", "n_commas", "n_bars", "n_marks")
STATS = f"struct<{','.join(f'{c}:bigint' for c in COUNTS)}>"

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _kinds() -> dict[str, np.ndarray]:
    code = np.arange(256)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122)
    of = lambda chars: np.isin(code, list(chars))
    return {
        "n_symbols": of(SYMBOLS), "n_upper": letter & (code < 97), "n_letters": letter | (code >= 0xC0), "n_digits": of(b"0123456789"), "n_stops": of(b"."), "n_commas": of(b","), "n_bars": of(b"|"), "n_marks": of(b"!?"),
        "white": of(b" \t\n\v\f\r"), "points": (code < 0x80) | (code >= 0xC0),
    }


KINDS = _kinds()
_TABLE = np.stack(list(KINDS.values())).astype(np.int64)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that stand in a window of words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + own[i : i + n]
    mixed ^= mixed >> np.uint64(32)
    order = np.sort(mixed)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    at = np.flatnonzero(np.isin(mixed, order[1:][same]))
    found: dict[tuple, int] = {}  # windows of equal hashes are compared by their words
    of = [found.setdefault(tuple(words[i : i + window]), len(found)) for i in at.tolist()]
    at = at[np.bincount(of)[of] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def statistics_of(text: bytes) -> tuple[int, ...]:
    """COUNTS of one UTF-8 text."""
    words = text.split()
    by = dict(zip(KINDS, (_TABLE @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist(), strict=True))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), by["points"] - by["white"], by["n_symbols"], len(lines) - len(set(lines)), repeated_words(words), len(lines), *(by[c] for c in COUNTS[6:]))


def with_statistics(docs: DataFrame, name: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs, or its columns in carry, with a struct column of COUNTS under name, in one pass."""
    out_type = pa.struct([(c, pa.int64()) for c in COUNTS])
    names = docs.columns if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name):
            found = [statistics_of(x) for x in batch.column(name).cast(pa.binary()).to_pylist()]
            col = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(COUNTS), fields=list(out_type))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), col], [*names, name])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), f"`{name}` {STATS}"])
    return map_arrow(docs.select(*(f"`{c}`" for c in names), F.coalesce(F.col(text), F.lit("")).alias(name)), run, schema)


def features(get) -> dict:
    """Rates from counts; get gives a count by name, as a Column or an array, and all work on both."""
    n = get("n_words") + 1.0
    return {
        "n_words": get("n_words") * 1.0,
        "word_length": get("word_chars") / n,
        "symbols_a_word": get("n_symbols") / n,
        "repeated_lines": get("n_dup_lines") / (get("n_lines") + 1.0),
        "repeated_words": get("n_repeat_words") / n,
        "words_a_line": get("n_words") / (get("n_lines") + 1.0),
        "upper_case": get("n_upper") / (get("n_letters") + 1.0),
        "letters": get("n_letters") / (get("word_chars") + 1.0),
        "digits": get("n_digits") / (get("word_chars") + 1.0),
        "stops_a_word": get("n_stops") / n,
        "commas_a_word": get("n_commas") / n,
        "bars_a_word": get("n_bars") / n,
        "marks_a_word": get("n_marks") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= limit, else value < limit
    limit: float

    def holds(self, value):
        return value >= self.limit if self.above else value < self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.feature])
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(y), bool)
    while len(rule) < most and (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        best = (0.0, None)
        for name, values in x.items():
            own, hit = values[inside], y[inside]
            order = np.argsort(own, kind="stable")
            v, pos = own[order], np.cumsum(hit[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1  # between distinct values
            if not len(at):
                continue
            below_p, below = pos[at - 1], at
            for above in (False, True):
                p = p0 - below_p if above else below_p
                t = len(v) - below if above else below
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / t) - np.log2(p0 / (p0 + n0))), 0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float((v[at[k] - 1] + v[at[k]]) / 2)))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside &= best[1].holds(x[best[1].feature])
    return rule


def learn(x: dict[str, np.ndarray], reject: np.ndarray, precision: float = 0.9, most_rules: int = 16, most_conditions: int = 4, least: int = 3) -> list[Rule]:
    """Rules, in order, each of which rejects what it covers."""
    third = np.arange(len(reject)) % 3 == 2
    left = np.ones(len(reject), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, prune = left & ~third, left & third
        if reject[grow].sum() < least:
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, reject[grow], most_conditions)

        def worth(r: Rule, rows: np.ndarray = prune) -> tuple[float, float]:
            own = reject[rows][_covers(r, {k: v[rows] for k, v in x.items()}, int(rows.sum()))]
            return ((own.sum() - (~own).sum()) / max(1, len(own)), own.mean() if len(own) else 0.0)

        shorter = [rule[:i] for i in range(len(rule), 0, -1)]
        rule = max(shorter, key=lambda r: worth(r)[0], default=())  # of equals the longest
        if not rule or worth(rule)[1] < precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(reject))
    return rules


def rejects(rules: list[Rule], stats: str) -> Column:
    """The list as one ordered conditional expression over a struct column of COUNTS."""
    by = features(lambda c: F.col(f"`{stats}`.{c}"))
    out = None
    for rule in rules:
        test = None
        for c in rule:
            test = c.holds(by[c.feature]) if test is None else test & c.holds(by[c.feature])
        out = F.when(test, F.lit(True)) if out is None else out.when(test, F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def base_fails(stats: str) -> Column:
    """Fewer than 10 words, or over 20 of 100 words in repeated windows."""
    get = lambda c: F.col(f"`{stats}`.{c}")
    return (get("n_words") < 10) | (100 * get("n_repeat_words") > 20 * get("n_words"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000) -> list[Rule]:
    """Learn from at most sample labelled documents that aren't held out, by the hash of their id; only their statistics come to the driver."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).alias("label")).dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    stats = with_statistics(rows, "stats", carry=["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("stats").alias("stats"))  # one row an id, however often it is repeated
    got = stats.select("doc_id", "label", "stats.*").toPandas().sort_values(["doc_id", *COUNTS])
    if got.empty:
        return []
    x = features(lambda c: got[c].to_numpy(np.float64))
    return learn(x, (got["label"] == 0).to_numpy())


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the columns of op8: counts, base_failed and kept."""
    rows = with_statistics(docs, "stats", carry=["doc_id"])
    return rows.select("doc_id", *(F.col(f"stats.{c}") for c in COUNTS[:5]), base_fails("stats").alias("base_failed"), (~base_fails("stats") & ~rejects(rules, "stats")).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base and the learned list keep, with docs' columns."""
    rules = fit(docs, labels)
    name = "stats"
    while name in docs.columns:
        name += "_"
    return with_statistics(docs, name).where(~base_fails(name) & ~rejects(rules, name)).select(*(f"`{c}`" for c in docs.columns))
