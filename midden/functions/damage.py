"""Column expressions of terminal damage: error rates, decay, smoothing, classes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def phred_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def decay_rate(z: Column, amplitude: Column, decay: Column, baseline: Column) -> Column:
    """Mismatch rate at the 1-based distance z from an end, within [0.001, 0.999]."""
    return F.greatest(F.lit(0.001), F.least(F.lit(0.999), amplitude * F.exp(-decay * (z - 1)) + baseline))


def smoothed_rate(k: Column, n: Column) -> Column:
    """(k + 0.5) / (n + 1), and 0.5 without observations."""
    return F.when(n > 0, (k + 0.5) / (n + 1.0)).otherwise(F.lit(0.5))


def beta_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Normal bounds of Beta(k + 0.5, n - k + 0.5), within [0, 1]."""
    a, b = k + 0.5, n - k + 0.5
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0)))
    return F.greatest(F.lit(0.0), mean - z * sd), F.least(F.lit(1.0), mean + z * sd)


def logistic(x: Column) -> Column:
    """With x cut to [-20, 20]."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))


def damage_class(p: Column, ct1: Column) -> Column:
    """Of a bin by pooled posterior and first C>T rate."""
    return F.when((p > 0.5) & (ct1 > 0.02), "ancient").when(p < 0.2, "modern").otherwise("mixed")


def consensus_class(ct1: Column, ga1: Column) -> Column:
    """Of a consensus bin by the mean terminal rate."""
    mean = (ct1 + ga1) / 2
    return F.when(mean >= 0.10, "ancient").when(mean >= 0.03, "moderate").otherwise("modern")


def is_damage(ref: Column, base: Column, d5: Column, d3: Column, zone: int) -> Column:
    """C>T near the 5' end or G>A near the 3' end."""
    return ((ref == "C") & (base == "T") & (d5 <= zone)) | ((ref == "G") & (base == "A") & (d3 <= zone))


def length_log_likelihood(length: Column, mean: float, sd: float) -> Column:
    """Under a normal distribution, without the constant; -100 for lengths of 0 or less."""
    return F.when(length > 0, -((length - mean) * (length - mean)) / (2 * sd * sd) - math.log(sd)).otherwise(-100.0)


def identity_log_likelihood(identity: Column, mode: float, sd: float) -> Column:
    """Of a percentage under a normal distribution, without the constant; 0 for a deviation of 0 or less."""
    z = (identity - mode) / sd if sd > 0 else F.lit(0.0)
    return -0.5 * z * z - math.log(sd) if sd > 0 else F.lit(0.0)


def is_inconsistent(ref: Column, base: Column, d5: Column, d3: Column, zone: int) -> Column:
    """A mismatch that damage doesn't make: C>T near the 3' end only, G>A near the 5' end only, or any other kind."""
    ct, ga = (ref == "C") & (base == "T"), (ref == "G") & (base == "A")
    return (ct & (d3 <= zone) & (d5 > zone)) | (ga & (d5 <= zone) & (d3 > zone)) | ~(ct | ga)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def observed_given(true: Column, base: Column, d5: Column, d3: Column, error: Column) -> Column:
    """P(base | true base) where C turns into T with rate d5 and G into A with rate d3 before errors, of which each other base gets a third."""
    good, bad = 1.0 - error, error / 3.0
    stay = lambda d: (1.0 - d) * good + d * bad
    turn = lambda d: d * good + (1.0 - d) * bad
    c = F.when(base == "C", stay(d5)).when(base == "T", turn(d5)).otherwise(bad)
    g = F.when(base == "G", stay(d3)).when(base == "A", turn(d3)).otherwise(bad)
    return F.when(true == "C", c).when(true == "G", g).when(true == base, good).otherwise(bad)


def site_log_ratio(base: Column, true: str, turned: str, d: Column, error: Column) -> Column:
    """Of one observation of a site: log P(base | true) - log P(base | turned), where damage of rate d turns true into turned; 0 for other bases."""
    good, bad = 1.0 - error, error / 3.0
    seen = F.log(F.greatest(F.lit(0.001), d * good + (1.0 - d) * bad)) - F.log(good)
    kept = F.log(F.greatest(F.lit(0.001), (1.0 - d) * good + d * bad)) - F.log(bad)
    return F.when(base == turned, seen).when(base == true, kept).otherwise(0.0)


def normal_quantile(p: Column) -> Column:
    """By a rational approximation with errors under 4.5e-4; -6 and 6 at the ends."""
    t = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p <= 0, -6.0).when(p >= 1, 6.0).when(F.abs(p - 0.5) < 1e-10, 0.0).when(p < 0.5, -z).otherwise(z)


def model_class(p: Column, amplitude: Column, decay: Column) -> Column:
    """Three tiers of a fitted model."""
    sure = (p >= 0.8) & (amplitude >= 0.01) & ((amplitude < 0.05) | (decay > 0.3))
    return F.when(p < 0.5, "modern").when(sure, "ancient").otherwise("uncertain")


def effective_length(decay: Column) -> Column:
    """(1 - decay^20) / (1 - decay), 20 at 0 and 1 at 1."""
    return F.when(decay < 1e-10, 20.0).when(decay > 0.9999, 1.0).otherwise((1.0 - F.pow(decay, 20)) / (1.0 - decay))
