"""Terminal damage models of groups: a grid fit by beta-binomial likelihood, a G-test against a flat model, classes, library types.

A group's counts are 20 numbers an end at most, so its fit is one row's work in an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.damage import clamped, damage_class, model_class

POSITIONS = 20


def _steps(first: float, last: float, step: float) -> list[float]:
    out, x = [], first
    while x <= last:
        out.append(x)
        x += step
    return out


DECAYS, MULTIPLES = _steps(0.3, 1.5, 0.05), _steps(0.5, 1.5, 0.1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive numbers: Stirling's series from 8 on, below by the recurrence."""
    x = np.asarray(x, float)
    shift = np.zeros(x.shape)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1)), shift)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def log_beta_binomial(k: np.ndarray, n: np.ndarray, mean: np.ndarray, concentration: float) -> np.ndarray:
    """Of k successes in n; 0 without trials."""
    mean = np.clip(mean, 1e-10, 1 - 1e-10)
    a, b = np.maximum(mean * concentration, 0.01), np.maximum((1 - mean) * concentration, 0.01)
    k = np.clip(k, 0, n)
    value = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + log_beta(k + a, n - k + b) - log_beta(a, b)
    return np.where(n < 0.01, 0.0, value)


def rates_fit(k: np.ndarray, n: np.ndarray, positions: int = 15) -> dict[str, float]:
    """Amplitude and decay of one end by a grid around the first position's excess, with baseline, concentration, fit and errors."""
    inner_n, inner_k = n[15:20].sum(), k[15:20].sum()
    base = inner_k / inner_n if inner_n >= 10 else 0.01
    out = {"amplitude": 0.0, "amplitude_se": 0.0, "decay": 0.35, "baseline": float(base), "concentration": 100.0, "r2": 0.0, "log_lik": 0.0}
    n, k = n[:positions].astype(float), k[:positions].astype(float)
    if n.sum() < 100:
        return out
    z = np.arange(len(n))
    first = max(0.001, k[0] / n[0] - base) if n[0] >= 10 else 0.0
    decay, amplitude = (x.ravel() for x in np.meshgrid(DECAYS, first * np.array(MULTIPLES), indexing="ij"))
    use = (amplitude >= 0.001) & (amplitude <= 0.5)
    out["amplitude"] = 0.0
    if use.any():
        decay, amplitude = decay[use], amplitude[use]
        rate = amplitude[:, None] * np.exp(-decay[:, None] * z) + base
        ll = log_beta_binomial(k[None], n[None], rate, 100.0).sum(axis=1)
        best = int(ll.argmax())
        out |= {"amplitude": float(amplitude[best]), "decay": float(decay[best]), "log_lik": float(ll[best])}
    expected = out["amplitude"] * np.exp(-out["decay"] * z) + base
    seen = np.divide(k, n, out=np.zeros(len(n)), where=n > 0)
    enough = n >= 10
    var = expected * (1 - expected) / np.maximum(n, 1)
    own = enough & (var > 1e-10)
    if own.sum() > 2:
        over = ((seen - expected)[own] ** 2 / var[own]).sum() / own.sum()
        out["concentration"] = float(np.clip(100 / over, 10, 1000)) if over > 0 else 1000.0
    mean = seen[n > 0].mean()
    total = ((seen - mean)[enough] ** 2).sum()
    out["r2"] = float(max(0.0, 1 - ((seen - expected)[enough] ** 2).sum() / total)) if total > 1e-10 else 0.0
    if out["amplitude"] > 0.001:
        out["amplitude_se"] = float(np.sqrt(out["amplitude"] * (1 - out["amplitude"]) / n.sum()))
    return out


def g_score(k: np.ndarray, n: np.ndarray, amplitude: float, decay: float) -> float:
    """How much better the decay fits the first ten positions than a flat rate: difference of G by the root of the observations."""
    inner_n, inner_k = n[14:20].sum(), k[14:20].sum()
    base = inner_k / inner_n if inner_n > 100 else 0.01
    if n[:10].sum() <= 100:
        return 0.0
    z = np.arange(min(10, len(n)))
    k10, n10 = k[:10].astype(float), n[:10].astype(float)
    use = n10 >= 10

    def g(rate: np.ndarray) -> float:
        rate = np.clip(rate, 0.001, 0.999)
        out = 0.0
        for o, e in ((k10, n10 * rate), (n10 - k10, n10 * (1 - rate))):
            own = use & (o > 0)
            out += float((o[own] * np.log(o[own] / e[own])).sum())
        return 2 * out

    return (g(np.full(len(z), base)) - g(amplitude * np.exp(-decay * z) + base)) / float(np.sqrt(n10.sum()))


def model(k5: np.ndarray, n5: np.ndarray, k3: np.ndarray, n3: np.ndarray, prior: float = 0.5) -> dict[str, float]:
    """Both ends' fits, the score of their mean curve on pooled counts, and the posterior; the prior under 100 observations."""
    if n5.sum() + n3.sum() < 100:
        five = three = {"amplitude": 0.0, "decay": 0.35, "baseline": 0.01, "concentration": 100.0, "r2": 0.0}
        score, p = 0.0, prior
    else:
        five, three = rates_fit(k5, n5), rates_fit(k3, n3)
        score = g_score(k5 + k3, n5 + n3, (five["amplitude"] + three["amplitude"]) / 2, (five["decay"] + three["decay"]) / 2)
        p = 1 / (1 + np.exp(-score / 2))
    out = {f"{c}{end}": float(fit[c]) for end, fit in ((5, five), (3, three)) for c in ("amplitude", "decay", "baseline", "concentration")}
    return out | {"r2": (five["r2"] + three["r2"]) / 2, "score": float(score), "p": float(p)}


FIELDS = [f"{c}{end}" for end in (5, 3) for c in ("amplitude", "decay", "baseline", "concentration")] + ["r2", "score", "p"]


@pandas_udf(StructType([StructField(c, DoubleType()) for c in FIELDS]))
def fitted(k5: pd.Series, n5: pd.Series, k3: pd.Series, n3: pd.Series) -> pd.DataFrame:
    rows = [model(*(np.asarray(x, np.int64) for x in row)) for row in zip(k5, n5, k3, n3, strict=True)]
    return pd.DataFrame(rows, columns=FIELDS)


def profiles(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, k5, n5, k3, n3): counts (by, end, position, k, n) as arrays of POSITIONS numbers, missing ones 0."""
    pooled = counts.where(F.col("position") < POSITIONS).groupBy(*by, "end", "position").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    per = pooled.groupBy(*by).agg(*(F.map_from_entries(F.collect_list(F.when(F.col("end") == end, F.struct(F.col("position").cast("long").alias("position"), F.col(c).alias("v"))))).alias(f"{c}{end}") for end in (5, 3) for c in ("k", "n")))  # POSITIONS entries

    def filled(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda i: F.coalesce(F.try_element_at(F.col(c), i.cast("long")), F.lit(0)).cast("long")).alias(c)

    return per.select(*by, *map(filled, ("k5", "n5", "k3", "n3")))


def models(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, FIELDS, damage): a model for every group of counts (by, end, position, k, n), with its class and evidence from 0 to 4."""
    rows = profiles(counts, by).withColumn("m", fitted("k5", "n5", "k3", "n3"))
    score = F.col("score")
    strength = F.when(score < -1.0, 0).when(score < 0.5, 1).when(score < 1.5, 2).when(score < 2.5, 3).otherwise(4)
    tier = model_class(F.col("p"), (F.col("amplitude5") + F.col("amplitude3")) / 2, (F.col("decay5") + F.col("decay3")) / 2)
    return rows.select(*by, "m.*").select("*", strength.alias("evidence"), tier.alias("class"))


def bin_report(counts: DataFrame, posteriors: DataFrame, bin_: str = "bin") -> DataFrame:
    """One row a bin: read-weighted posterior (0.5 without reads), decays and amplitudes of both ends, first rates, class.

    counts: (bin, end, position, k, n); posteriors: (bin, n, p) of contigs.
    """
    pooled = posteriors.groupBy(bin_).agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("p_ancient"))
    first = counts.where("position = 0").groupBy(bin_).agg(*((F.sum(F.when(F.col("end") == e, F.col("k"))) / F.sum(F.when(F.col("end") == e, F.col("n")))).alias(c) for e, c in ((5, "ct1"), (3, "ga1"))))
    rows = models(counts, [bin_]).join(pooled, bin_, "left").join(first, bin_, "left")
    p, ct1 = F.coalesce("p_ancient", F.lit(0.5)), F.coalesce("ct1", F.lit(0.0))
    return rows.select(bin_, p.alias("p_ancient"), "decay5", "decay3", "amplitude5", "amplitude3", ct1.alias("ct1"), F.coalesce("ga1", F.lit(0.0)).alias("ga1"), damage_class(p, ct1).alias("damage_class"))


def library_types(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos1, pos3, late, library): excess rates over positions 15 to 19 (0-based); single-stranded (ss) where damage still shows at positions 9 to 14."""
    rate = F.col("k") / F.col("n")
    base = counts.where("position BETWEEN 15 AND 19 AND n > 100").groupBy(*by).agg(F.avg(rate).alias("base"))
    rows = counts.join(base, by, "left").withColumn("excess", rate - F.coalesce("base", F.lit(0.0)))
    at = lambda i: F.coalesce(F.max(F.when((F.col("position") == i) & (F.col("n") > 0), F.col("excess"))), F.lit(0.0))
    late = F.avg(F.when(F.col("position").between(9, 14) & (F.col("n") > 100), F.greatest(F.lit(0.0), F.col("excess"))))
    sums = rows.groupBy(*by).agg(at(0).alias("pos1"), at(2).alias("pos3"), F.coalesce(late, F.lit(0.0)).alias("late"))
    ss = (F.col("pos1") > 0.05) & (F.col("late") > 0.02) & (F.col("pos3") > 0.01) & (F.col("late") > 0.3 * F.col("pos3"))
    return sums.withColumn("library", F.when(ss, "ss").otherwise("ds"))


def decay_line(rates: DataFrame, by: list[str], baseline: float = 0.01, first: int = 5) -> DataFrame:
    """(by, decay, amplitude): least squares on log(rate - baseline) over the first positions whose excess is above 0.001, within [0.1, 2] and [0.01, 0.5]; 0.5 and 0.1 without two of them."""
    use = rates.where((F.col("position") < first) & (F.col("rate") - baseline > 0.001))
    y = F.log(F.col("rate") - baseline)
    fit = use.groupBy(*by).agg(F.regr_slope(y, F.col("position")).alias("slope"), F.regr_intercept(y, F.col("position")).alias("start"))
    every = rates.select(*by).distinct().join(fit, by, "left")
    good = F.col("slope").isNotNull()
    return every.select(*by, F.when(good, clamped(-F.col("slope"), 0.1, 2.0)).otherwise(0.5).alias("decay"), F.when(good, clamped(F.exp("start"), 0.01, 0.5)).otherwise(0.1).alias("amplitude"))


def model_shifts(windows: DataFrame, by: list[str], window: str = "window", segment: int = 5, least: int = 100, least_p: float = 0.3, least_amplitude: float = 0.05) -> DataFrame:
    """(by, window, p_before, p_after, amplitude_gap): every `segment` windows the models of the segments before and behind, where posterior or amplitude differ.

    windows: (by, window, end, position, k, n), windows from 0; contigs of fewer than ten windows have none. Each window's counts go to the
    cuts beside it, so a cut is a sum over keys and no contig is gathered.
    """
    number = windows.groupBy(*by).agg((F.max(window) + 1).alias("number")).where("number >= 10")
    cut = F.explode(F.array((F.floor(F.col(window) / segment) * segment).cast("long"), (F.floor(F.col(window) / segment) * segment + segment).cast("long")))
    sided = windows.join(number, by).withColumn("cut", cut).withColumn("side", F.when(F.col(window) < F.col("cut"), "before").otherwise("after"))
    sided = sided.where((F.col("cut") >= segment) & (F.col("cut") < F.col("number") - segment))
    keys = [*by, "cut", "side"]
    enough = sided.where("position < 10").groupBy(*keys).agg(F.sum("n").alias("seen")).where(F.col("seen") >= least)
    m = models(sided.select(*keys, "end", "position", "k", "n"), keys).join(enough, keys)
    side = lambda name: m.where(F.col("side") == name).select(*by, "cut", F.col("p").alias(f"p_{name}"), F.col("amplitude5").alias(f"a5_{name}"), F.col("amplitude3").alias(f"a3_{name}"))
    both = side("before").join(side("after"), [*by, "cut"])
    gap = F.greatest(F.abs(F.col("a5_after") - F.col("a5_before")), F.abs(F.col("a3_after") - F.col("a3_before")))
    rows = both.select(*by, F.col("cut").alias(window), "p_before", "p_after", gap.alias("amplitude_gap"))
    return rows.where((F.abs(F.col("p_after") - F.col("p_before")) >= least_p) | (F.col("amplitude_gap") >= least_amplitude))
