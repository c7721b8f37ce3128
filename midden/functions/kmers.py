"""k-mer features in linear time: Arrow-batched kernels over bases coded as two bits.

Windows with a letter other than A, C, G, T (either case) don't count. Null and too short sequences have no
k-mers. Codes of k-mers are base-4 numbers, A C G T being 0 to 3, so they order like their letters; k is at most 31.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType

from .sequence import canonical_kmers

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def bases(seq: str | None) -> np.ndarray:
    """0 to 3, and 4 for other letters."""
    return _CODE[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]


def windows(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all windows of k bases, and which are valid."""
    n = len(code) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, bool)
    out = np.zeros(n, np.int64)
    for j in range(k):
        out = out << 2 | (code[j : j + n] & 3)
    bad = np.concatenate(([0], np.cumsum(code > 3)))
    return out, bad[k:] == bad[:n]


def reverse_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """The codes of the reverse complements."""
    out = np.zeros(len(codes), np.int64)
    for j in range(k):
        out = out << 2 | (3 - (codes >> (2 * j) & 3))
    return out


def canonical_codes(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    own, valid = windows(code, k)
    return np.minimum(own, reverse_codes(own, k)), valid


@lru_cache
def places(k: int) -> np.ndarray:
    """For each code the place of its canonical k-mer among all, sorted."""
    every = np.arange(4**k)
    return np.unique(np.minimum(every, reverse_codes(every, k)), return_inverse=True)[1]


def counts(code: np.ndarray, k: int, canonical: bool = True) -> np.ndarray:
    own, valid = windows(code, k)
    own = own[valid]
    return np.bincount(places(k)[own], minlength=int(places(k).max()) + 1) if canonical else np.bincount(own, minlength=4**k)


def of_counts(seq: Column, k: int, canonical: bool = True) -> Column:
    """Counts of all (canonical) k-mers in order."""

    @pandas_udf(ArrayType(LongType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: counts(bases(x), k, canonical))

    return run(seq)


def named_counts(seq: Column, k: int) -> Column:
    """(kmer, n) of the canonical k-mers that seq has."""
    names = F.array(*map(F.lit, canonical_kmers(k)))
    return F.filter(F.arrays_zip(names.alias("kmer"), of_counts(seq, k).alias("n")), lambda x: x["n"] > 0)


def of_set(seq: Column, k: int, canonical: bool = False) -> Column:
    """The distinct codes of seq's k-mers, ascending."""

    @pandas_udf(ArrayType(LongType()))
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            own, valid = canonical_codes(bases(x), k) if canonical else windows(bases(x), k)
            return np.unique(own[valid])

        return s.map(one)

    return run(seq)


def letters(code: Column, k: int) -> Column:
    """A code as letters."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


@pandas_udf(ArrayType(DoubleType()))
def pseudo_shares(n: pd.Series) -> pd.Series:
    """(count + 1) / sum of arrays of counts."""
    return n.map(lambda x: (np.asarray(x) + 1.0) / (np.sum(x) + len(x)))


def clr_of(n: np.ndarray, pseudo: float = 1e-6) -> np.ndarray:
    """Centred log-ratios of the shares of counts, each share raised by pseudo."""
    logs = np.log(np.asarray(n) / max(1, np.sum(n)) + pseudo)
    return logs - logs.mean()


@pandas_udf(ArrayType(DoubleType()))
def clr(n: pd.Series) -> pd.Series:
    return n.map(clr_of)


def window_variances(code: np.ndarray, size: int = 500, step: int = 250, most: int | None = None) -> list[float]:
    """Of the windows of a sequence (the first `most` of them, if given) the variance of the shares of canonical 4-mers."""
    out = []
    for a in range(0, len(code) - size + 1, step)[:most]:
        c = counts(code[a : a + size], 4)
        share = c / max(1, c.sum())
        out.append(float(((share - share.mean()) ** 2).mean()))
    return out


@pandas_udf(ArrayType(DoubleType()))
def local_variances(s: pd.Series) -> pd.Series:
    return s.map(lambda x: window_variances(bases(x)))


def windows_of(code: np.ndarray, size: int, step: int) -> list[np.ndarray]:
    """The whole windows of a sequence."""
    return [code[a : a + size] for a in range(0, len(code) - size + 1, step)]


def entropy_of(code: np.ndarray, k: int) -> float:
    """Shannon entropy of k-mers; add-one shares where there are few, else with Miller and Madow's correction; zero under 20 letters."""
    c = counts(code, k, canonical=False) if len(code) >= 20 else np.zeros(1, np.int64)
    total = int(c.sum())
    if not total:
        return 0.0
    if total < 2 * 4**k:
        p = (c + 1) / (total + 4**k)
        return float(-(p * np.log2(p)).sum())
    p = c[c > 0] / total
    return float(-(p * np.log2(p)).sum()) + ((len(p) - 1) / (2 * total) if len(p) > 1 else 0.0)


def entropies(code: np.ndarray) -> list[float]:
    """entropy_of for k from 2 to 6."""
    return [entropy_of(code, k) for k in range(2, 7)]


@pandas_udf(ArrayType(DoubleType()))
def entropy_scaling(s: pd.Series) -> pd.Series:
    return s.map(lambda x: entropies(bases(x)))


@pandas_udf(ArrayType(DoubleType()))
def window_entropies(s: pd.Series) -> pd.Series:
    """Entropies of 4-mers in windows of 1,000 letters every 500."""
    return s.map(lambda x: [] if x is None else [entropy_of(own, 4) for own in windows_of(bases(x), 1000, 500)])


def syncmer_codes(code: np.ndarray, k: int = 21, s: int = 11) -> np.ndarray:
    """Distinct canonical k-mers whose least canonical s-mer, the first of equals, is the first or the last."""
    own, valid = canonical_codes(code, k)
    if not len(own):
        return own
    small, _ = canonical_codes(code, s)
    n = k - s + 1
    least = np.lib.stride_tricks.sliding_window_view(small, n).argmin(axis=1)
    return np.unique(own[valid & ((least == 0) | (least == n - 1))])


@pandas_udf(ArrayType(LongType()))
def syncmers(s: pd.Series) -> pd.Series:
    return s.map(lambda x: syncmer_codes(bases(x)))


def minimizer_codes(code: np.ndarray, k: int, w: int = 10) -> np.ndarray:
    """The least k-mer of every w windows in a row, distinct, ascending; windows with an unknown base are passed over."""
    own, valid = canonical_codes(code, k)
    own = own[valid]
    return np.unique(np.lib.stride_tricks.sliding_window_view(own, w).min(axis=1)) if len(own) >= w else own[:0]


def minimizers(seq: Column, k: int, w: int = 10) -> Column:
    @pandas_udf(ArrayType(LongType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: minimizer_codes(bases(x), k, w))

    return run(seq)


def mixed(h: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A 64-bit finaliser's bits of h under a seed."""
    h = h ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Codes that are mixed under all seeds at once.
MIXED = 1024


def minhash_of(codes: np.ndarray, size: int = 128) -> list[int]:
    """The least of `size` mixes; of an empty set all bits set."""
    h = codes.astype(np.uint64)
    seeds = np.array([0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1 for i in range(size)], np.uint64)[:, None]
    out = np.full(size, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), MIXED):
        np.minimum(out, mixed(h[at : at + MIXED], seeds).min(axis=1), out=out)
    return out.view(np.int64).tolist()


@pandas_udf(ArrayType(LongType()))
def minhash(codes: pd.Series) -> pd.Series:
    return codes.map(lambda c: minhash_of(np.array([] if c is None else c, np.int64)))


def strobemer_places(code: np.ndarray, k: int = 15, low: int = 20, high: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of order-2 strobes: a k-mer and the least canonical k-mer low to high letters behind its end; with both codes."""
    last = len(code) - 2 * k - high + 1
    if last < 1:
        return (np.empty(0, np.int64),) * 3
    own, valid = canonical_codes(code, k)
    own = np.where(valid, own, np.int64(1) << 62)
    behind = np.lib.stride_tricks.sliding_window_view(own[k + low :], high - low + 1)[:last].min(axis=1)
    at = np.flatnonzero((own[:last] < 1 << 62) & (behind < 1 << 62))
    return at, own[at], behind[at]


def box_lacunarity(at: np.ndarray, length: int, size: int) -> float:
    """Second moment of the counts of a gliding box over the squared first."""
    if not len(at) or length < size:
        return 1.0
    mark = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=length))))
    c = (mark[size:] - mark[: length - size + 1]).astype(float)
    return float((c * c).mean() / c.mean() ** 2) if c.mean() >= 1e-10 else 1.0


def strobemer_spacing(code: np.ndarray) -> list[float]:
    """Lacunarity in boxes of 100 to 2,000, slope and intercept of their logs, mean, variation and entropy of spacings, density a 1,000 letters and the fit of the logs; zeros under 3,000 letters or 20 strobes."""
    n = len(code)
    at = strobemer_places(code)[0] if n >= 3000 else np.empty(0, np.int64)
    if len(at) < 20:
        return [0.0] * 12
    sizes = [s for s in (100, 200, 500, 1000, 2000) if s < n]
    lac = [box_lacunarity(at, n, s) for s in sizes]
    x, y = np.log(sizes), np.log(lac)
    slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
    start = float(y.mean() - slope * x.mean())
    total = float(((y - y.mean()) ** 2).sum())
    fit = min(1.0, max(0.0, 1 - float(((y - slope * x - start) ** 2).sum()) / total)) if total > 1e-10 else 0.0
    gap = np.diff(at).astype(float)
    share = np.bincount(np.minimum((20 * gap / (gap.max() + 1)).astype(int), 19)) / len(gap)
    share = share[share > 0]
    return [*lac, *[0.0] * (5 - len(lac)), slope, start, float(gap.mean()), float(gap.std() / gap.mean()), float(-(share * np.log2(share)).sum()), 1000 * len(at) / n, fit]


@pandas_udf(ArrayType(DoubleType()))
def strobemer_features(s: pd.Series) -> pd.Series:
    return s.map(lambda x: strobemer_spacing(bases(x)))
