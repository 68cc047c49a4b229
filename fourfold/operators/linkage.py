"""Which alleles reads carry at the sites that may vary, and what neighbouring alleles say about haplotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .emission import BROADCAST_SITES
from .keep import cut
from .ranges import overlapping, points_in_intervals

MISSING, GENOME_GAP = -1, 4


def snp_sites(calls: DataFrame) -> DataFrame:
    """Sites with more than one state, numbered along each region; symbol goes along if calls have one."""
    more = ["symbol"] if "symbol" in calls.columns else []
    sites = calls.filter("n_states > 1").select("region", "ref_pos", "a0", "a1", "n_states", "site_class", *more)
    return sites.withColumn("site", F.row_number().over(W.partitionBy("region").orderBy("ref_pos")) - 1)


def settled(sites: DataFrame) -> DataFrame:
    """sites written out, and sent to every task if they are few enough; if not, what joins them isn't sent either, however small Spark takes it for."""
    done = cut(sites)
    return F.broadcast(done) if done.count() <= BROADCAST_SITES else done.hint("merge")


def linkage(bases: DataFrame, reads: DataFrame, sites: DataFrame, symbol: str | None = None) -> DataFrame:
    """region, read_id, site, ref_pos, nuc of every site inside a read's extent.

    nuc is one of the site's two alleles, or -1: missing or a third allele; a missing base in a column of the universal
    genome where one sub-genome has a gap (symbol I or J) is 4. Sites are settled once; while they are few they go to
    every task, and only the bases that lie on one are dealt by read.
    """
    sites = settled(sites)
    inside = points_in_intervals(sites, reads.select("region", "read_id", "first_pos", "last_pos"), ["region"], "ref_pos", "first_pos", "last_pos")
    held = bases.select("region", "read_id", "ref_pos", "nuc").join(sites.select("region", "ref_pos"), ["region", "ref_pos"], "left_semi")
    seen = inside.join(held.hint("merge"), ["region", "read_id", "ref_pos"], "left")
    lost = F.when(F.col(symbol).isin("I", "J") & F.col("nuc").isNull(), GENOME_GAP).otherwise(MISSING) if symbol else F.lit(MISSING)
    allele = F.when((F.col("nuc") == F.col("a0")) | (F.col("nuc") == F.col("a1")), F.col("nuc")).otherwise(lost)
    return seen.select("region", "read_id", "site", "ref_pos", F.coalesce(allele, F.lit(MISSING)).cast("long").alias("nuc"))


def masked(bases: DataFrame, sites: DataFrame) -> DataFrame:
    """region, read_id, site of bases that are neither of their site's two alleles: taken as missing.

    Bases that come from an explode look small to Spark, so it is settled here which side goes to every task: the sites.
    """
    at = bases.select("region", "read_id", "ref_pos", "nuc").join(settled(sites.select("region", "ref_pos", "site", "a0", "a1")), ["region", "ref_pos"])
    return at.filter(~(F.col("nuc").eqNullSafe(F.col("a0")) | F.col("nuc").eqNullSafe(F.col("a1")))).select("region", "read_id", "site")


def unshared(link: DataFrame, gone: DataFrame, sites: DataFrame) -> DataFrame:
    """region, site: sites that no read covers together with the next one; a read doesn't cover what is masked in it (gone)."""
    order = W.partitionBy("region", "read_id").orderBy("site")
    cover = link.select("region", "read_id", "site").join(gone, ["region", "read_id", "site"], "left_anti")
    tied = cover.withColumn("after", F.lead("site").over(order)).filter("after = site + 1").select("region", "site").distinct()
    inner = sites.select("region", "site").join(sites.select("region", (F.col("site") - 1).alias("site")), ["region", "site"])
    return inner.join(tied, ["region", "site"], "left_anti")


def adjacent_pairs(link: DataFrame) -> DataFrame:
    """region, site, nuc, next_nuc, n: how often reads carry two alleles at neighbouring sites, both known; a gap of one sub-genome is known."""
    order = W.partitionBy("region", "read_id").orderBy("site")
    pairs = link.withColumn("next_site", F.lead("site").over(order)).withColumn("next_nuc", F.lead("nuc").over(order))
    pairs = pairs.filter("next_site = site + 1 and nuc >= 0 and next_nuc >= 0")
    return pairs.groupBy("region", "site", "nuc", "next_nuc").agg(F.count("*").alias("n"))


def patterns(link: DataFrame) -> DataFrame:
    """region, first_site, pattern, n, first_read: distinct rows of the linkage table; reads that know no allele are left out.

    A pattern has a letter for each site in a read's extent, `-` for a missing one.
    """
    letter = F.translate(F.col("nuc").cast("string"), "0123", "ACTG")
    letter = F.when(F.col("nuc") == MISSING, "-").when(F.col("nuc") == GENOME_GAP, "*").otherwise(letter)
    rows = link.groupBy("region", "read_id").agg(F.min("site").alias("first_site"), F.array_sort(F.collect_list(F.struct("site", letter.alias("c")))).alias("s"), F.max("nuc").alias("any"))
    rows = rows.filter(F.col("any") >= 0).withColumn("pattern", F.array_join(F.col("s.c"), ""))
    return rows.groupBy("region", "first_site", "pattern").agg(F.count("*").alias("n"), F.min("read_id").alias("first_read"))


def contained(rows: DataFrame) -> DataFrame:
    """Partial patterns that another pattern of the same first site and length completes: it has all the letters that they know.

    Patterns are projected on each set of places that a partial one of their group knows, of which there are few; a
    partial pattern goes if its own letters come out twice there. No two patterns are compared.
    """
    group = ["region", "first_site", "_l"]
    keyed = rows.withColumn("_l", F.length("pattern")).withColumn("_mask", F.regexp_replace("pattern", "[^-]", "x"))
    masks = keyed.filter(F.col("pattern").contains("-")).select(*group, "_mask").distinct()
    seen = F.array_join(F.zip_with(F.split("pattern", ""), F.split("_mask", ""), lambda c, m: F.when(m == "x", c).otherwise(m)), "")
    cast = keyed.select(*group, "pattern").join(masks, group).withColumn("_seen", seen)
    # What knows less than the places asked for is another set's case.
    cast = cast.filter(F.regexp_replace("_seen", "[^-]", "x") == F.col("_mask"))
    twice = cast.groupBy(*group, F.col("_seen").alias("pattern")).agg(F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(twice, [*group, "pattern"], "left_semi").drop("_l", "_mask")


def window_patterns(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """region, first_site, last_site, pattern, n: what reads know of each window of sites (spans), from the distinct patterns of all reads.

    A letter for each site of the window, `-` where a read doesn't reach; reads that know nothing of it are left out.
    """
    reads = rows.select("region", "pattern", "n", F.col("first_site").alias("p_from"), (F.col("first_site") + F.length("pattern") - 1).alias("p_to"))
    wide = spans.select("region", "first_site", "last_site").distinct()
    met = overlapping(reads, wide, ["region"], (F.col("p_from") <= F.col("last_site")) & (F.col("p_to") >= F.col("first_site")), ("p_from", "p_to"), ("first_site", "last_site"), 16)
    before = F.greatest(F.col("p_from") - F.col("first_site"), F.lit(0)).cast("int")
    skipped = F.greatest(F.col("first_site") - F.col("p_from"), F.lit(0)).cast("int")
    size = (F.col("last_site") - F.col("first_site") + 1).cast("int")
    cut = F.substr(F.concat(F.repeat(F.lit("-"), before), F.substr(F.col("pattern"), skipped + 1)), F.lit(1), size)
    out = met.select("region", "first_site", "last_site", F.rpad(cut, size, F.lit("-")).alias("pattern"), "n").filter(F.translate("pattern", "-", "") != "")
    return out.groupBy("region", "first_site", "last_site", "pattern").agg(F.sum("n").alias("n"))


def combinations(states: DataFrame, sites: DataFrame) -> DataFrame:
    """region, site, s1, s2, g1, g2: all pairs of states of a site and the next; g: the states' four nucleotides."""
    rows = states.join(sites.select("region", "ref_pos", "site"), ["region", "ref_pos"])
    rows = rows.select("region", "site", F.col("state_idx").alias("s"), F.array("h0", "h1", "h2", "h3").alias("g"))
    after = rows.select("region", (F.col("site") - 1).alias("site"), F.col("s").alias("s2"), F.col("g").alias("g2"))
    return rows.withColumnsRenamed({"s": "s1", "g": "g1"}).join(after, ["region", "site"])


def supported(combos: DataFrame, pairs: DataFrame) -> DataFrame:
    """Combinations all of whose four haplotypes agree with a read; all of a site's, if none is. A state's gap is a read's gap of one sub-genome."""
    seen = pairs.groupBy("region", "site").agg(F.collect_set(F.concat_ws(",", "nuc", "next_nuc")).alias("seen"))  # 16 at most
    marked = combos.join(seen, ["region", "site"], "left")
    code = lambda x: F.when(x < 0, GENOME_GAP).otherwise(x).cast("string")
    need = F.zip_with("g1", "g2", lambda x, y: F.concat_ws(",", code(x), code(y)))
    good = F.coalesce(F.forall(need, lambda p: F.array_contains(F.col("seen"), p)), F.lit(False))
    marked = marked.withColumn("good", good).withColumn("any", F.max("good").over(W.partitionBy("region", "site")))
    return marked.filter("good or not any").drop("seen", "any")


def permitted(combos: DataFrame) -> DataFrame:
    """region, site, s1, s2, s3: neighbouring combinations that agree on the state of the site they share."""
    after = combos.select("region", (F.col("site") - 1).alias("site"), F.col("s1").alias("s2"), F.col("s2").alias("s3"))
    return combos.select("region", "site", "s1", "s2").join(after, ["region", "site", "s2"])


def most_abundant(rows: DataFrame, most: int = 4) -> DataFrame:
    """The `most` most frequent patterns of each region and first site, and the next if it is as frequent as the last of them."""
    order = W.partitionBy("region", "first_site").orderBy(F.desc("n"), "pattern")
    ranked = rows.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("n").over(order))
    return ranked.filter((F.col("place") <= most) | ((F.col("place") == most + 1) & (F.col("before") == F.col("n")))).drop("before")


def until_share(rows: DataFrame, share: float = 0.95) -> DataFrame:
    """Patterns by falling frequency until their sum reaches a share of all."""
    order = W.partitionBy("region", "first_site").orderBy(F.desc("n"), "pattern")
    total = F.sum("n").over(W.partitionBy("region", "first_site"))
    ranked = rows.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", total)
    return ranked.filter(F.col("before") < share * F.col("total"))
