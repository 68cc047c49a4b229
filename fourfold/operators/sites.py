"""From counts at a site to the candidate states of its four haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.plans.options import Options

GAP = -1


def _most_frequent(counts: Column, many: int) -> list[Column]:
    """The most frequent nucleotides, the higher code on a tie, in order of codes."""
    ranked = F.slice(F.reverse(F.array_sort(F.filter(counts, lambda x: x["n"] > 0))), 1, many)
    kept = F.array_sort(F.transform(ranked, lambda x: F.struct(x["nuc"].alias("nuc"), x["n"].alias("n"))))
    return [F.get(kept, F.lit(k)) for k in range(many)]


def call_sites(sites: DataFrame, options: Options | None = None, symbol: str | None = None) -> DataFrame:
    """sites (n0 to n3, n_del, depth) with site_class, a0, a1, major, minor and n_states.

    symbol: a column with M, I or J for each universal column; M everywhere without it. Classes: mono, two, perm_two,
    two_het (two and the double heterozygotes), gap2, gap4, empty; with the options `single` and `sampling` no site of two
    nucleotides is mono; with `single`, single takes the place of perm_two: one permutation for each sub-genome. With third_nuc a site of three nucleotides or more
    also gets triple (the nucleotides) and n_triple (4 or 12 states more, which stand first).
    """
    o = options or Options()
    counts = F.array(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(k).alias("nuc")) for k in range(4)])
    first, second = _most_frequent(counts, 2)
    out = sites.withColumn("_x", first).withColumn("_y", second)
    n1, n2 = F.coalesce(F.col("_x.n"), F.lit(0)), F.coalesce(F.col("_y.n"), F.lit(0))
    a0, a1 = F.col("_x.nuc"), F.col("_y.nuc")
    total, most = n1 + n2, F.greatest(n1, n2)
    major = F.when(n1 >= n2, a0).otherwise(a1)
    share = most / total
    single = a1.isNull()
    mono = F.lit(False) if o.single or o.sampling else ((total - most == 1) & (total > 4)) | (share >= o.majority)
    two = F.lit("two_het" if o.dbheter else "two")
    pair = F.when(mono, "mono").when(share >= o.three_hap, "single" if o.single else "perm_two").otherwise(two)
    every = F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3") + F.col("n_del")
    gapped = F.col("n_del") / every >= 0.4
    odd = F.col(symbol).isin("I", "J") if symbol else F.lit(False)
    even = (n1 / total).between(0.45, 0.55)
    gap = F.when(single, F.when(odd, "gap2").otherwise("mono")).when(even, F.when(odd, F.lit("gap4")).otherwise(pair)).otherwise(F.when(odd, "gap2").otherwise("mono"))
    label = F.when(a0.isNull(), "empty").when(gapped, gap).when(single, "mono").otherwise(pair)
    out = out.withColumn("site_class", label)
    states = F.create_map(*[F.lit(x) for kv in (("mono", 1), ("two", 2), ("perm_two", 6), ("single", 2), ("two_het", 6), ("gap2", 2), ("gap4", 4), ("empty", 1)) for x in kv])
    out = out.withColumns({"a0": a0, "a1": a1, "major": major, "minor": F.when(n1 >= n2, a1).otherwise(a0), "n_states": F.element_at(states, F.col("site_class"))})
    out = out.drop("_x", "_y")
    if not o.third_nuc:
        return out
    three = _most_frequent(counts, 3)
    n = [t["n"] for t in three]
    total, most = n[0] + n[1] + n[2], F.greatest(*n)
    top = F.when(n[0] == most, 0).when(n[1] == most, 1).otherwise(2)
    rest = (total - most) / most
    clear = rest.between(2 - o.left_range, o.left_range) | (most / total >= o.two_hap)
    has = three[2].isNotNull() & ~gapped
    triple = F.when(has, F.array(*[t["nuc"] for t in three]))
    out = out.withColumns({"triple": triple, "n_triple": F.when(has, F.when(clear, 4).otherwise(12)).otherwise(0), "top": F.when(has, top)})
    return out.withColumn("n_states", F.col("n_states") + F.col("n_triple"))


def site_states(calls: DataFrame) -> DataFrame:
    """region, ref_pos, state_idx, h0 to h3: every candidate state of every site, in its fixed order; -1 is a gap."""
    g, a, b, x, y = F.lit(GAP), F.col("a0"), F.col("a1"), F.col("major"), F.col("minor")
    rows = lambda *r: F.array(*[F.array(*[c.cast("int") for c in s]) for s in r])
    two = ((a, a, b, b), (b, b, a, a))
    # The permutations of three majors and a minor, in order of codes.
    up = ((x, x, x, y), (x, x, y, x), (x, y, x, x), (y, x, x, x))
    het = ((a, b, b, a), (a, b, a, b), (b, a, a, b), (b, a, b, a))
    table = (
        F.when(F.col("site_class") == "mono", rows((x, x, x, x)))
        .when(F.col("site_class") == "two", rows(*two))
        .when(F.col("site_class") == "two_het", rows(*two, *het))
        .when(F.col("site_class") == "perm_two", F.when(y > x, rows(*up, *two)).otherwise(rows(*up[::-1], *two)))
        .when(F.col("site_class") == "single", F.when(y > x, rows(up[0], up[2])).otherwise(rows(up[3], up[1])))
        .when(F.col("site_class") == "gap2", rows((g, g, x, x), (x, x, g, g)))
        .when(F.col("site_class") == "gap4", rows((g, g, a, b), (g, g, b, a), (a, b, g, g), (b, a, g, g)))
        .otherwise(rows((g, g, g, g)))
    )
    if "triple" in calls.columns:
        n = [F.col("triple")[k] for k in range(3)]

        def four(u, v, big):
            return ((u, v, big, big), (v, u, big, big), (big, big, u, v), (big, big, v, u))

        every = rows(*four(n[1], n[2], n[0]), *four(n[1], n[0], n[2]), *four(n[2], n[0], n[1]))
        one = F.when(F.col("top") == 0, rows(*four(n[1], n[2], n[0]))).when(F.col("top") == 1, rows(*four(n[0], n[2], n[1]))).otherwise(rows(*four(n[0], n[1], n[2])))
        table = F.when(F.col("n_triple") == 12, F.concat(every, table)).when(F.col("n_triple") == 4, F.concat(one, table)).otherwise(table)
    out = calls.select("region", "ref_pos", F.posexplode(table).alias("state_idx", "s"))
    return out.select("region", "ref_pos", "state_idx", *[F.col("s")[k].alias(f"h{k}") for k in range(4)])
