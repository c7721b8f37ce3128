"""Two populations of a contig's reads, told apart by damage: neutral bases, memberships by EM, two consensus sequences.

Damage stands at the ends of molecules, so each place's neutral base is the majority of the observations outside both zones, and reads are judged against that, not
against a reference that may hold damage. The likelihoods don't change in the loop: a round is a sum over each contig's reads, so a contig may hold
any share of them; contigs stop by themselves and leave the rounds. Memberships then weigh each place's two calls.

Cases: a place without a neutral base has no say in a membership; a read without usable observations gets the prior; contigs without reads aren't in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import damage as fd
from . import reads
from .iterate import cut, forget


def neutral_bases(obs: DataFrame, contig: str = "contig", pos: str = "pos", zone5: int = 5, zone3: int = 5, least_q: int = 20, least_depth: int = 3) -> DataFrame:
    """(contig, pos, ref): the base of more than half of the good observations outside both zones, of which there are least_depth or more."""
    rows = obs.where((F.col("q") >= least_q) & (F.col("d5") > zone5) & (F.col("d3") > zone3))
    sums = rows.groupBy(contig, pos).agg(*(F.count_if(F.col("base") == b).alias(b) for b in "ACGT"))
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    best = F.greatest(*map(F.col, "ACGT"))
    base = F.coalesce(*(F.when(F.col(b) == best, b) for b in "ACGT"))
    return sums.where((total >= least_depth) & (best > F.floor(total / 2))).select(contig, pos, base.alias("ref"))


def _posterior(prior):
    p = fd.clamped(1.0 / (1.0 + F.exp(-(F.col("llr") + F.log(prior / (1.0 - prior))))), 1e-6, 1 - 1e-6)
    return F.when(F.col("used") > 0, p).otherwise(prior)


def memberships(obs: DataFrame, contig: str = "contig", read: str = "read", pos: str = "pos", rounds: int = 10, prior: float = 0.5, low: float = 0.1, high: float = 0.9, near: float = 0.01, zone: int = 5, least_q: int = 20, full: bool = True) -> tuple[DataFrame, DataFrame]:
    """Reads (contig, read, llr, in_zone, p) and contigs (contig, reads, prior, rounds): a contig's prior is the mean membership, reads with more places in the zones weighing more.

    obs: (contig, read, pos, base, q, d5, d3). rounds counts the judging ones, as many as `rounds`; a contig stops when its prior moves by less than near.
    """
    known = obs.join(neutral_bases(obs, contig, pos, zone, zone, least_q), [contig, pos])
    judged = reads.classify(known, [contig, read], prior, zone, least_q, full).select(contig, read, "llr", "in_zone")
    usable = known.where(F.col("q") >= least_q)
    used = (usable if full else usable.where("ref <> base")).groupBy(contig, read).agg(F.count(F.lit(1)).alias("used"))
    every = obs.select(contig, read).distinct().join(judged, [contig, read], "left").join(used, [contig, read], "left")
    base = cut(every.na.fill({"llr": 0.0, "in_zone": 0, "used": 0}))
    state = cut(base.groupBy(contig).agg(F.count(F.lit(1)).alias("reads")).select(contig, "reads", F.lit(prior).alias("prior"), F.lit(1).alias("rounds"), F.lit(False).alias("done")))
    weight = 1.0 + 0.1 * F.col("in_zone")
    for step in range(2, rounds + 1):
        moving = base.join(state.where("NOT done").select(contig, "prior", F.col("reads")), contig)
        new = moving.groupBy(contig).agg(F.first("reads").alias("reads"), F.first("prior").alias("old"), (F.sum(weight * _posterior(F.col("prior"))) / F.greatest(F.lit(1.0), F.sum(weight))).alias("mean"))
        new = new.withColumn("prior", F.round(fd.clamped(F.col("mean"), low, high), 12))
        next_ = cut(state.where("done").unionByName(new.select(contig, "reads", "prior", F.lit(step).alias("rounds"), (F.abs(F.col("prior") - F.col("old")) < near).alias("done"))))
        forget(state)
        state = next_
        if state.where("NOT done").isEmpty():
            break
    rows = base.join(state.select(contig, "prior"), contig).withColumn("p", _posterior(F.col("prior"))).select(contig, read, "llr", "in_zone", "p")
    return rows, state.select(contig, "reads", "prior", "rounds")


def consensus(obs: DataFrame, contig: str = "contig", read: str = "read", pos: str = "pos", **how) -> DataFrame:
    """The two calls of every place (reads.genotype_two_population) from reads weighed by their memberships."""
    rows, _ = memberships(obs, contig, read, pos, **how)
    joined = obs.join(rows.select(contig, read, F.col("p").alias("p_ancient")), [contig, read])
    return reads.genotype_two_population(joined, [contig, pos])


def summary(rows: DataFrame, contig: str = "contig", hard_high: float = 0.8, hard_low: float = 0.2) -> DataFrame:
    """(contig, reads, ancient, modern, unclear, mean_p, confidence): reads by hard limits, mean membership and mean distance from a half."""
    p = F.col("p")
    return rows.groupBy(contig).agg(F.count(F.lit(1)).alias("reads"), F.count_if(p >= hard_high).alias("ancient"), F.count_if(p <= hard_low).alias("modern"), F.count_if((p > hard_low) & (p < hard_high)).alias("unclear"), F.avg("p").alias("mean_p"), F.avg(F.abs(p - 0.5)).alias("confidence"))
