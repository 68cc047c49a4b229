"""How likely a base is on a haplotype: a multinomial logit of read position, quality and haplotype nucleotide.

The linear predictor of a choice is a dot product over nine terms; codes are A=0, C=1, T=2, G=3 and the choices C, G, T
are measured against A. Terms: 1, read_pos, qua, h=C, h=G, h=T and qua times each of the last three.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keep import cut

#: So many sites of haplotypes are sent to every task.
BROADCAST_SITES = 1_000_000
#: Sites of haplotypes that are packed together.
STRETCH = 128
TERMS = ("one", "read_pos", "qua", "hC", "hG", "hT", "qua_hC", "qua_hG", "qua_hT")
#: Codes of the choices, in order.
CHOICES = {"C": 1, "G": 3, "T": 2}
KEY = ["read_pos", "qua", "hap_nuc", "nuc"]

#: A plain model for queries with fixed coefficients: rows are TERMS, columns C, G, T.
FIXED_BETA = [
    [-1.2, -1.1, -1.3], [0.001, -0.002, 0.0015], [-0.01, -0.02, -0.015], [2.5, 0.2, 0.3], [0.1, 2.4, 0.2], [0.25, 0.15, 2.6], [0.08, 0.005, -0.004], [0.006, 0.09, 0.003], [-0.002, 0.004, 0.085],
]


def terms(read_pos: Column, qua: Column, hap: Column) -> list[Column]:
    hot = [(hap == code).cast("double") for code in CHOICES.values()]
    return [F.lit(1.0), read_pos.cast("double"), qua.cast("double"), *hot, *[qua * h for h in hot]]


def log_probability(read_pos: Column, qua: Column, hap: Column, nuc: Column, beta: list[list[float]]) -> Column:
    """Log chance of reading nuc, as one expression without functions of ours."""
    x = terms(read_pos, qua, hap)
    score = [functools.reduce(operator.add, [x[i] * float(beta[i][c]) for i in range(len(TERMS))]) for c in range(3)]
    own = F.lit(0.0)
    for c, code in enumerate(CHOICES.values()):
        own = F.when(nuc == code, score[c]).otherwise(own)
    top = F.greatest(F.lit(0.0), *score)  # taken out, so that no score is too large for exp
    return own - top - F.log(F.exp(-top) + F.exp(score[0] - top) + F.exp(score[1] - top) + F.exp(score[2] - top))


def consensus(bases: DataFrame, by: str = "true_hap") -> DataFrame:
    """region, ref_pos, h0 to h3: the most frequent nucleotide of each class of reads, the lowest code of equals."""
    each = [F.count_if((F.col(by) == k) & (F.col("nuc") == n)).alias(f"c{k}{n}") for k in range(4) for n in range(4)]
    counts = bases.groupBy("region", "ref_pos").agg(*each)

    def best(k: int) -> Column:
        top = F.greatest(*[F.col(f"c{k}{n}") for n in range(4)])
        found = F.coalesce(*[F.when(F.col(f"c{k}{n}") == top, n) for n in range(4)])
        return F.when(top > 0, found).cast("long").alias(f"h{k}")

    return counts.select("region", "ref_pos", *[best(k) for k in range(4)])


def observations(bases: DataFrame, haps: DataFrame) -> DataFrame:
    """Bases with the nucleotides of the four haplotypes there; bases where the first or last haplotype has a gap go.

    Haplotypes have one row a site: while these are few they go to every task, and the bases stay where they are.
    """
    haps = cut(haps.filter("h0 >= 0 and h3 >= 0"))
    haps = F.broadcast(haps) if haps.count() <= BROADCAST_SITES else haps.hint("merge")
    return bases.join(haps, ["region", "ref_pos"])


def observations_of_reads(reads: DataFrame, haps: DataFrame, first: Column, last: Column, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """observations() of the bases that `spread` makes of reads, for haplotypes of any number.

    reads: region and what `spread` needs, which gives ref_pos of each base and keeps other columns; first, last: a read's
    sites. Reads meet the haplotypes, packed by stretches of sites, before they are spread: no single base is dealt.
    """
    sites = haps.filter("h0 >= 0 and h3 >= 0").select("region", F.floor(F.col("ref_pos") / STRETCH).alias("_bin"), F.struct("ref_pos", "h0", "h1", "h2", "h3").alias("s"))
    packed = sites.groupBy("region", "_bin").agg(F.collect_list("s").alias("_haps")).withColumn("_at", F.col("_haps.ref_pos"))
    dealt = reads.withColumn("_bin", F.explode(F.sequence(F.floor(first / STRETCH), F.floor(last / STRETCH))))
    bases = spread(dealt.join(packed.hint("merge"), ["region", "_bin"])).filter(F.floor(F.col("ref_pos") / STRETCH) == F.col("_bin"))
    met = bases.withColumn("_k", F.array_position("_at", F.col("ref_pos"))).filter("_k > 0").withColumn("_h", F.get("_haps", (F.col("_k") - 1).cast("int")))
    return met.withColumns({f"h{k}": F.col(f"_h.h{k}") for k in range(4)}).drop("_bin", "_haps", "_at", "_k", "_h")


def by_haplotype(obs: DataFrame) -> DataFrame:
    """obs once for each haplotype: hap (0 to 3) and hap_nuc."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("hap"), F.col(f"h{k}").alias("hap_nuc")) for k in range(4)]))
    return obs.withColumn("_e", each).select("*", "_e.hap", "_e.hap_nuc").drop("_e", "h0", "h1", "h2", "h3").filter("hap_nuc >= 0")


def lookup(obs: DataFrame, beta: list[list[float]]) -> DataFrame:
    """Log probabilities of the distinct (read_pos, qua, hap_nuc, nuc): all that scoring depends on."""
    return by_haplotype(obs).select(*KEY).distinct().withColumn("lp", log_probability(*[F.col(c) for c in KEY], beta))


def read_loglik(obs: DataFrame, beta: list[list[float]]) -> DataFrame:
    """region, read_id, ll0 to ll3: the log-likelihood of each read on each haplotype, with one shuffle by read."""
    lps = {f"ll{k}": F.sum(log_probability(F.col("read_pos"), F.col("qua"), F.col(f"h{k}"), F.col("nuc"), beta)) for k in range(4)}
    return obs.groupBy("region", "read_id").agg(*[v.alias(k) for k, v in lps.items()])


def responsibilities(loglik: DataFrame, eta: list[float]) -> DataFrame:
    """loglik with w0 to w3 and log_mix = ln sum eta e**ll, by the largest term taken out."""
    x = [F.col(f"ll{k}") + F.log(F.lit(float(eta[k]))) for k in range(4)]
    top = F.greatest(*x)
    total = functools.reduce(operator.add, [F.exp(v - top) for v in x])
    return loglik.withColumns({**{f"w{k}": F.exp(v - top) / total for k, v in enumerate(x)}, "log_mix": top + F.log(total)})


def mixture(resp: DataFrame) -> DataFrame:
    """The haplotypes' shares by region."""
    return resp.groupBy("region").agg(*[F.avg(f"w{k}").alias(f"eta{k}") for k in range(4)])


def sufficient_statistics(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Weights summed by (read_pos, qua, hap_nuc, nuc): lossless for the regression, and bounded by those four ranges."""
    return rows.filter("hap_nuc >= 0").groupBy(*KEY).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("w"))


def fitted(stats: DataFrame, beta: list[list[float]]) -> DataFrame:
    """stats with pA, pC, pG, pT, the model's chances of each nucleotide, and residual, 1 less the chance of what was read."""
    code = {"A": 0, **CHOICES}
    p = {f"p{c}": F.exp(log_probability(F.col("read_pos"), F.col("qua"), F.col("hap_nuc"), F.lit(k), beta)) for c, k in code.items()}
    own = F.coalesce(*[F.when(F.col("nuc") == k, F.col(f"p{c}")) for c, k in code.items()])
    return stats.withColumns(p).withColumn("residual", 1 - own)


def log_likelihood(stats: DataFrame, beta: list[list[float]]) -> DataFrame:
    return stats.agg(F.sum(F.col("w") * log_probability(*[F.col(c) for c in KEY], beta)).alias("loglik"))


def gradient(stats: DataFrame, beta: list[list[float]]) -> DataFrame:
    """term, choice, value: derivatives of the log-likelihood."""
    x = terms(F.col("read_pos"), F.col("qua"), F.col("hap_nuc"))
    out = []
    for choice, code in CHOICES.items():
        p = F.exp(log_probability(F.col("read_pos"), F.col("qua"), F.col("hap_nuc"), F.lit(code), beta))
        rest = F.col("w") * ((F.col("nuc") == code).cast("double") - p)
        out += [F.sum(x[i] * rest).alias(f"{name}:{choice}") for i, name in enumerate(TERMS)]
    wide = stats.agg(*out)
    pairs = [F.struct(F.lit(n).alias("term"), F.lit(c).alias("choice"), F.col(f"`{n}:{c}`").alias("value")) for c in CHOICES for n in TERMS]
    return wide.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")
