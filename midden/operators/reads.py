"""Alignments to terminal counts, and reads to posteriors: all from observations (read, ref, base, q, d5, d3).

d5 and d3 are 1-based distances from the ends of the molecule. Every estimate is a sum over observations of a read
and then over reads of a group, so a hot contig is partial sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import damage as fd

CURVE = {"amplitude": 0.3, "decay": 0.5, "baseline": 0.01}
CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
MD = re.compile(r"(\d+)|\^([A-Za-z]+)|([A-Za-z])")
_SWAP = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


def aligned_pairs(seq: bytes, cigar: str, md: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in seq of its aligned letters, and their letters in the reference (from MD) and in the read."""
    places, at = [], 0
    for n, op in CIGAR.findall(cigar):
        n = int(n)
        if op in "M=X":
            places.append(np.arange(at, at + n))
        if op in "M=XIS":
            at += n
    place = np.concatenate(places) if places else np.empty(0, np.int64)
    place = place[place < len(seq)]
    read = np.frombuffer(seq.upper(), np.uint8)[place]
    ref, i = read.copy(), 0
    for same, gone, other in MD.findall(md):
        if same:
            i += int(same)
        elif other and i < len(ref):
            ref[i] = ord(other.upper())
            i += 1
    return place, ref, read


def observations(reads: DataFrame, least_mapq: int = 0) -> DataFrame:
    """(qname, contig, ref, base, q, d5, d3, length) of every aligned A, C, G or T of mapped primary reads (qname, contig, flag, mapq, cigar, seq, qual array, md).

    Reverse reads are turned to the molecule's strand. Reads without CIGAR or MD have none; a missing quality is 30.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("ref", "base", "q", "d5", "d3")}
            sizes, lengths = [], []
            for flag, cigar, seq, qual, md in zip(*(batch.column(c).to_pylist() for c in ("flag", "cigar", "seq", "qual", "md")), strict=True):
                text = (seq or "").encode()
                place, ref, read = aligned_pairs(text, cigar or "", md or "") if md else (np.empty(0, np.int64),) * 3
                q = np.array(qual, np.int32)[place] if qual is not None and len(qual) == len(text) else np.full(len(place), 30, np.int32)
                d5, d3 = place + 1, len(text) - place
                if flag & 16:
                    ref, read = (np.frombuffer(x.astype(np.uint8).tobytes().translate(_SWAP), np.uint8) for x in (ref, read))
                    d5, d3 = d3, d5
                known = np.isin(ref, list(b"ACGT")) & np.isin(read, list(b"ACGT"))
                for c, v in zip(cols, (ref, read, q, d5, d3), strict=True):
                    cols[c].append(v[known])
                sizes.append(int(known.sum()))
                lengths.append(len(text))
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            letters = [pa.array(list(np.concatenate([*cols[c], np.empty(0, np.uint8)]).astype(np.uint8).tobytes().decode()), pa.string()) for c in ("ref", "base")]
            numbers = [pa.array(np.concatenate([*cols[c], np.empty(0, np.int64)]), pa.int32(), safe=False) for c in ("q", "d5", "d3")]
            yield pa.RecordBatch.from_arrays([batch.column("qname").take(row), batch.column("contig").take(row), *letters, *numbers, pa.array(np.repeat(lengths, sizes), pa.int32())], ["qname", "contig", "ref", "base", "q", "d5", "d3", "length"])

    mapped = reads.where((F.col("flag").bitwiseAND(0x904) == 0) & (F.col("mapq") >= least_mapq))
    rows = mapped.select("qname", "contig", F.col("flag").cast("int").alias("flag"), "cigar", "seq", "qual", "md")
    return rows.mapInArrow(run, "qname string, contig string, ref string, base string, q int, d5 int, d3 int, length int")


def positions_in_reads(reads: DataFrame, positions: DataFrame, by: list[str], size: int = 256) -> DataFrame:
    """The columns of reads (by, start, end, ...) beside each position (by, pos) in [start, end): an equi-join on buckets of `size` letters that a read touches."""
    touched = F.sequence(F.floor(F.col("start") / size), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / size))
    dealt = reads.where("end > start").withColumn("_bucket", F.explode(touched))
    at = positions.withColumn("_bucket", F.floor(F.col("pos") / size))
    return dealt.join(at, [*by, "_bucket"]).where("pos >= start AND pos < end").drop("_bucket")


def terminal_counts(obs: DataFrame, by: list[str], positions: int = 15, least_q: int = 0) -> DataFrame:
    """(by, end, position, k, n): from each end, 0-based, how many reference C (5') or G (3') there are, and how many of them are read as T or A."""
    use = obs.where(F.col("q") >= least_q)
    five = use.where((F.col("ref") == "C") & (F.col("d5") <= positions)).select(*by, F.lit(5).alias("end"), (F.col("d5") - 1).alias("position"), (F.col("base") == "T").alias("hit"))
    three = use.where((F.col("ref") == "G") & (F.col("d3") <= positions)).select(*by, F.lit(3).alias("end"), (F.col("d3") - 1).alias("position"), (F.col("base") == "A").alias("hit"))
    return five.unionAll(three).groupBy(*by, "end", "position").agg(F.count_if("hit").alias("k"), F.count(F.lit(1)).alias("n"))


def mismatch_spectrum(obs: DataFrame, by: list[str], zone: int = 5, least: int = 10) -> DataFrame:
    """Shares of terminal T>C, A>G and others (5'), and of C>T, T>C and others (3'), of all bases in the zone; null with `least` bases or fewer."""
    is_ = lambda a, b: (F.col("ref") == a) & (F.col("base") == b)
    in5, in3, off = F.col("d5") <= zone, F.col("d3") <= zone, F.col("ref") != F.col("base")
    kinds = {"tc5": in5 & is_("T", "C"), "ag5": in5 & is_("A", "G"), "other5": in5 & off & ~is_("T", "C") & ~is_("A", "G") & ~is_("C", "T"), "ct3": in3 & is_("C", "T"), "tc3": in3 & is_("T", "C"), "other3": in3 & off & ~is_("C", "T") & ~is_("T", "C") & ~is_("G", "A")}
    sums = obs.groupBy(*by).agg(F.count_if(in5).alias("n5"), F.count_if(in3).alias("n3"), *(F.count_if(c).alias(k) for k, c in kinds.items()))
    return sums.select(*by, *(F.when(F.col("n" + k[-1]) > least, F.col(k) / F.col("n" + k[-1])).alias(k) for k in kinds))


def _rates(curve5: dict, curve3: dict) -> tuple[Column, Column, Column]:
    five = fd.decay_rate(F.col("d5"), *(F.lit(curve5[c]) for c in ("amplitude", "decay", "baseline")))
    three = fd.decay_rate(F.col("d3"), *(F.lit(curve3[c]) for c in ("amplitude", "decay", "baseline")))
    return five, three, fd.clamped(fd.phred_error(F.col("q")), 0.001, 0.5)


def classify(obs: DataFrame, read: list[str], prior: float = 0.5, zone: int = 5, least_q: int = 20, full: bool = False, curve5: dict = CURVE, curve3: dict = CURVE) -> DataFrame:
    """(read, mismatches, consistent, inconsistent, in_zone, llr, p): the posterior of being ancient, from mismatches or, if full, from all positions.

    p is the prior without any usable observation, else within [1e-6, 1 - 1e-6].
    """
    d5, d3, error = _rates(curve5, curve3)
    ref, base = F.col("ref"), F.col("base")
    off = ref != base
    ancient = fd.clamped(fd.observed_given(ref, base, d5, d3, error), 1e-10, 0.999)
    modern = fd.clamped(F.when(off, error / 3.0).otherwise(1.0 - error), 1e-10, 0.999)
    good = F.col("q") >= least_q
    use = good if full else good & off
    damaged = fd.is_damage(ref, base, F.col("d5"), F.col("d3"), zone)
    odd = ~damaged & fd.is_inconsistent(ref, base, F.col("d5"), F.col("d3"), zone)
    sums = obs.groupBy(*read).agg(
        F.count_if(good & off).alias("mismatches"), F.count_if(good & off & damaged).alias("consistent"), F.count_if(good & off & odd).alias("inconsistent"),
        F.count_if(use & (F.least("d5", "d3") <= zone)).alias("in_zone"), F.count_if(use).alias("used"),
        F.coalesce(F.sum(F.when(use, F.log(ancient) - F.log(modern))), F.lit(0.0)).alias("llr"),
    )
    p = 1.0 / (1.0 + F.exp(-(F.col("llr") + float(np.log(prior / (1 - prior))))))
    return sums.select(*read, "mismatches", "consistent", "inconsistent", "in_zone", "llr", F.when(F.col("used") > 0, fd.clamped(p, 1e-6, 1 - 1e-6)).otherwise(prior).alias("p"))


def population_likelihoods(obs: DataFrame, read: list[str], zone: int = 5, least_q: int = 20, curve5: dict = CURVE, curve3: dict = CURVE) -> DataFrame:
    """(read, dep, cryo, informative, expected, detected): log-likelihoods of a damaged and an undamaged molecule, C and G in their zones, the chance to see damage, and whether it is seen."""
    d5, d3, error = _rates(curve5, curve3)
    ref, base, good = F.col("ref"), F.col("base"), F.col("q") >= least_q
    c, g = (ref == "C") & (F.col("d5") <= zone), (ref == "G") & (F.col("d3") <= zone)
    none = F.when(c, F.log(F.greatest(F.lit(1e-10), 1.0 - d5))).when(g, F.log(F.greatest(F.lit(1e-10), 1.0 - d3))).otherwise(0.0)
    sums = obs.groupBy(*read).agg(
        F.coalesce(F.sum(F.when(good, F.log(F.greatest(F.lit(1e-15), fd.observed_given(ref, base, d5, d3, error))))), F.lit(0.0)).alias("dep"),
        F.coalesce(F.sum(F.when(good, F.log(F.greatest(F.lit(1e-15), F.when(ref == base, 1.0 - error).otherwise(error / 3.0))))), F.lit(0.0)).alias("cryo"),
        F.count_if(good & (c | g)).alias("informative"), F.sum(none).alias("none"),
        F.max(((c & (base == "T")) | (g & (base == "A"))).cast("int")).alias("detected"),
    )
    return sums.withColumn("expected", 1.0 - F.exp("none")).drop("none")


def detection(likelihoods: DataFrame, by: list[str]) -> DataFrame:
    """(by, reads, expected, observed, undamaged): mean chance to see damage, share of reads with damage, and 1 - observed / expected within [0, 1], 0.5 without any chance."""
    sums = likelihoods.groupBy(*by).agg(F.count(F.lit(1)).alias("reads"), F.avg("expected").alias("expected"), F.avg("detected").alias("observed"))
    return sums.withColumn("undamaged", F.when(F.col("expected") < 1e-6, 0.5).otherwise(fd.clamped(1.0 - F.col("observed") / F.col("expected"), 0.0, 1.0)))


def share_interval(likelihoods: DataFrame, shares: DataFrame, by: list[str]) -> DataFrame:
    """(by, share, se, low, high): Fisher's error of the undamaged share (by, share) of a mixture of (by, dep, cryo)."""
    a, b, theta = F.exp("cryo"), F.exp("dep"), F.col("share")
    mix = theta * a + (1.0 - theta) * b
    score = F.when(mix > 1e-30, F.pow((a - b) / mix, 2))
    sums = likelihoods.join(shares, by).groupBy(*by).agg(F.first("share").alias("share"), F.sum(score).alias("fisher"))
    se = F.when(F.col("fisher") > 0, 1.0 / F.sqrt("fisher")).otherwise(1.0)
    return sums.select(*by, "share", se.alias("se"), F.greatest(F.lit(0.0), F.col("share") - 1.96 * se).alias("low"), F.least(F.lit(1.0), F.col("share") + 1.96 * se).alias("high"))


def site_ratios(obs: DataFrame, site: list[str], curve5: dict = CURVE, curve3: dict = CURVE) -> DataFrame:
    """(site, ct, ga): log-likelihood ratios of a true C against T, and of a true G against A, over a site's observations."""
    d5, d3, _ = _rates(curve5, curve3)
    error = fd.clamped(fd.phred_error(F.col("q")), 0.001, 0.999)
    return obs.groupBy(*site).agg(F.sum(fd.site_log_ratio(F.col("base"), "C", "T", d5, error)).alias("ct"), F.sum(fd.site_log_ratio(F.col("base"), "G", "A", d3, error)).alias("ga"))


def _posteriors(sums: list[Column]) -> tuple[list[Column], Column]:
    top = F.greatest(*sums)
    down = sum((F.exp(s - top) for s in sums[1:]), F.exp(sums[0] - top))
    return [F.exp(s - top) / down for s in sums], top


def _call(p: list[Column], prefix: str) -> list[Column]:
    """The best base, the first of equals, its posterior, and the second posterior."""
    best = F.array_max(F.array(*(F.struct(x.alias("p"), F.lit(-i).alias("i")) for i, x in enumerate(p))))
    second = F.element_at(F.sort_array(F.array(*p), asc=False), 2)
    return [F.element_at(F.array(*map(F.lit, "ACGT")), 1 - best["i"]).alias(f"{prefix}base"), best["p"].alias(f"{prefix}p"), second.alias(f"{prefix}second")]


def genotype_two_stage(obs: DataFrame, site: list[str], zone: int = 5, least_p: float = 0.95, curve5: dict = CURVE, curve3: dict = CURVE) -> DataFrame:
    """(site, reads, interior, base, p, second, stage): from reads outside both zones if two of them or more are sure, else from all with damage in the zones."""
    d5, d3, error = _rates(curve5, curve3)
    base, inside = F.col("base"), (F.col("d5") > zone) & (F.col("d3") > zone)
    plain = [F.log(F.greatest(F.lit(1e-10), F.when(base == g, 1.0 - error).otherwise(error / 3.0))) for g in "ACGT"]
    full = [F.log(F.greatest(F.lit(1e-10), fd.observed_given(F.lit(g), base, d5, d3, error))) for g in "ACGT"]
    sums = obs.groupBy(*site).agg(
        F.count(F.lit(1)).alias("reads"), F.count_if(inside).alias("interior"),
        *(F.coalesce(F.sum(F.when(inside, x)), F.lit(0.0)).alias(f"i{k}") for k, x in enumerate(plain)),
        *(F.sum(F.when(inside, x).otherwise(y)).alias(f"a{k}") for k, (x, y) in enumerate(zip(plain, full, strict=True))),
    )
    first, _ = _posteriors([F.col(f"i{k}") for k in range(4)])
    both, _ = _posteriors([F.col(f"a{k}") for k in range(4)])
    rows = sums.select(*site, "reads", "interior", *_call(first, "i_"), *_call(both, "a_"))
    sure = (F.col("interior") >= 2) & (F.col("i_p") >= least_p)
    return rows.select(*site, "reads", "interior", *(F.when(sure, F.col(f"i_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in ("base", "p", "second")), F.when(sure, 1).otherwise(2).alias("stage"))


def genotype_two_population(obs: DataFrame, site: list[str], ancient: str = "p_ancient", least_weight: float = 1.0, curve5: dict = CURVE, curve3: dict = CURVE) -> DataFrame:
    """Calls of the ancient, the modern and both populations, to which each read belongs by its posterior; the ancient share, and how far the two calls differ."""
    d5, d3, error = _rates(curve5, curve3)
    base, w = F.col("base"), F.col(ancient)
    old = [w * F.log(F.greatest(F.lit(1e-10), fd.observed_given(F.lit(g), base, d5, d3, error))) for g in "ACGT"]
    new = [(1.0 - w) * F.log(F.greatest(F.lit(1e-10), F.when(base == g, 1.0 - error).otherwise(error / 3.0))) for g in "ACGT"]
    sums = obs.groupBy(*site).agg(F.sum(w).alias("w"), F.sum(1.0 - w).alias("v"), *(F.sum(x).alias(f"o{k}") for k, x in enumerate(old)), *(F.sum(x).alias(f"n{k}") for k, x in enumerate(new)))
    groups = {"ancient_": [F.col(f"o{k}") for k in range(4)], "modern_": [F.col(f"n{k}") for k in range(4)], "": [F.col(f"o{k}") + F.col(f"n{k}") for k in range(4)]}
    post = {name: _posteriors(x)[0] for name, x in groups.items()}
    gap = F.greatest(*(F.abs(a - b) for a, b in zip(post["ancient_"], post["modern_"], strict=True)))
    rows = sums.select(*site, "w", "v", gap.alias("gap"), *(c for name, p in post.items() for c in _call(p, name)))
    enough = (F.col("w") >= least_weight) & (F.col("v") >= least_weight)
    return rows.select(*site, (F.col("w") / (F.col("w") + F.col("v"))).alias("fraction"), "base", "p", "second", F.when(F.col("w") >= least_weight, F.col("ancient_base")).alias("ancient_base"), F.when(F.col("v") >= least_weight, F.col("modern_base")).alias("modern_base"), F.when(enough, F.col("gap")).otherwise(0.0).alias("disagreement"), (enough & (F.col("ancient_base") != F.col("modern_base"))).alias("disagree"))
