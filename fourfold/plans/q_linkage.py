"""Queries over linkage, steps and combinations of states."""

from __future__ import annotations

from pyspark.sql import functions as F

from fourfold.operators import impute, linkage, numbering, pileup, repair, sampling, sites, steps
from fourfold.operators.keep import cut
from fourfold.plans.q_pileup import LOW, MASK, SITES_SQL
from fourfold.plans.views import table, tetra


def _parts(spark, sf_dir):
    """Bases, and reads, calls and varying sites written out: they are small, and much is made of them."""
    bases = pileup.mask_low_quality(tetra(spark, sf_dir), MASK)
    reads = cut(pileup.read_summary(bases))
    calls = cut(sites.call_sites(pileup.site_table(bases, LOW, reads=reads)))
    return bases, reads, calls, cut(linkage.snp_sites(calls))


def _link(spark, sf_dir):
    bases, reads, calls, snps = _parts(spark, sf_dir)
    return linkage.linkage(bases, reads, snps), calls, snps


def _long(df, *names):
    return df.select(*[F.col(n).cast("long").alias(n) for n in names])


def linkage_long(spark, sf_dir):
    return _long(_link(spark, sf_dir)[0], "region", "read_id", "site", "ref_pos", "nuc")


def adjacent_pair_transitions(spark, sf_dir):
    return _long(linkage.adjacent_pairs(_link(spark, sf_dir)[0]), "region", "site", "nuc", "next_nuc", "n")


def _patterns(spark, sf_dir):
    out = linkage.patterns(_link(spark, sf_dir)[0])
    return out.withColumn("first_site", F.col("first_site").cast("long"))


def distinct_linkage_rows(spark, sf_dir):
    return _patterns(spark, sf_dir)


def imputed_linkage_rows(spark, sf_dir):
    """Distinct patterns with their missing alleles filled; a search for best paths, so without SQL."""
    link = _link(spark, sf_dir)[0]
    return impute.impute(linkage.patterns(link), link, linkage.adjacent_pairs(link))


def contained_linkage_rows(spark, sf_dir):
    return linkage.contained(_patterns(spark, sf_dir))


def hap_abundance_topk(spark, sf_dir):
    out = linkage.most_abundant(_patterns(spark, sf_dir))
    return out.select("region", "first_site", "pattern", "n", F.col("place").cast("long").alias("place"))


def cumulative_abundance(spark, sf_dir):
    out = linkage.until_share(_patterns(spark, sf_dir))
    return out.select("region", "first_site", "pattern", "n", F.col("before").cast("long").alias("before"))


def _combos(spark, sf_dir):
    link, calls, snps = _link(spark, sf_dir)
    return linkage.combinations(sites.site_states(calls), snps), link


def combo_cartesian(spark, sf_dir):
    return _long(_combos(spark, sf_dir)[0], "region", "site", "s1", "s2")


def _supported(spark, sf_dir):
    combos, link = _combos(spark, sf_dir)
    return linkage.supported(combos, linkage.adjacent_pairs(link))


def combo_supported(spark, sf_dir):
    return _long(_supported(spark, sf_dir), "region", "site", "s1", "s2")


def transition_permit(spark, sf_dir):
    """Neighbouring combinations that agree."""
    return _long(linkage.permitted(cut(_supported(spark, sf_dir))), "region", "site", "s1", "s2", "s3")


#: Of all combinations of three neighbouring sites, those that are chosen before repair.
CHOSEN = "(s1 * 5 + s2 * 3 + s3 * 7 + site) % 4 = 0"


def state_repair(spark, sf_dir):
    """States of windows of three sites, of which a part is chosen, and those that neighbours ask for."""
    link, calls, snps = _link(spark, sf_dir)
    states = sites.site_states(calls)
    combos = cut(linkage.combinations(states, snps).select("region", "site", "s1", "s2"))
    pool = linkage.permitted(combos).select("region", F.lit(0).alias("block_id"), F.col("site").alias("t"), F.expr("(s1 * 100 + s2 * 10 + s3)").alias("place"), F.array("s1", "s2", "s3").alias("combo"), F.expr(f"{CHOSEN}").alias("taken"))
    pool = cut(pool)
    windows = pool.groupBy("region", "block_id", "t").agg(F.col("t").alias("first_site"), (F.col("t") + 2).alias("last_site"))
    out = repair.repair(windows, pool.filter("taken"), pool)
    return out.select("region", F.col("t").cast("long").alias("site"), *[F.col("combo")[k].cast("long").alias(f"s{k + 1}") for k in range(3)], F.col("added").cast("long").alias("added"))


def _parents(spark, sf_dir):
    _, reads, _, snps = _parts(spark, sf_dir)
    return steps.parents(cut(steps.step_sites(pileup.steps(reads), snps)))


def step_parent_asof(spark, sf_dir):
    return _long(_parents(spark, sf_dir), "region", "t", "first_site", "last_site", "parent_t", "overlap").na.fill(-1)


def block_ids(spark, sf_dir):
    return _long(steps.blocks(_parents(spark, sf_dir)), "region", "t", "block_id")


def linked_site_counts(spark, sf_dir):
    """What linked reads carry at each varying site."""
    out = sampling.site_counts(_link(spark, sf_dir)[0])
    return _long(out, "region", "ref_pos", "n0", "n1", "n2", "n3", "n_del", "depth")


def block_new_sites(spark, sf_dir):
    """Sites of each block's windows that the block before doesn't hold, where blocks are cut at every 40th step."""
    rows = _parents(spark, sf_dir).withColumn("block_id", F.floor(F.col("t") / 40))
    return _long(sampling.block_sites(rows), "region", "block_id", "site")


def dense_numbers(spark, sf_dir):
    """Reads of each region numbered from 1 along their keys, by ranges."""
    reads = pileup.read_summary(tetra(spark, sf_dir)).select("region", F.col("read_id").alias("line"))
    return numbering.numbered(reads, "region", "line", "read_id")


def state_space_size(spark, sf_dir):
    """Product of the numbers of states in each step's window."""
    _, reads, _, snps = _parts(spark, sf_dir)
    windows = pileup.steps(reads).withColumn("end", F.col("start") + F.col("span") - 1)
    inside = steps.points_in_intervals(snps, windows.select("region", "t", "start", "end"), ["region"], "ref_pos", "start", "end")
    return inside.groupBy("region", "t").agg(F.round(F.sum(F.log2(F.col("n_states").cast("double"))), 6).alias("log2_states"))


def weighted_group_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("w"), F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"))


QUERIES = {f.__name__: f for f in (linkage_long, adjacent_pair_transitions, distinct_linkage_rows, imputed_linkage_rows, contained_linkage_rows, hap_abundance_topk, cumulative_abundance, combo_cartesian, combo_supported, transition_permit, state_repair, step_parent_asof, block_ids, linked_site_counts, block_new_sites, dense_numbers, state_space_size, weighted_group_sum)}

SNP_SQL = f"""{SITES_SQL},
snp as (select region, ref_pos, a0, a1, major, minor, site_class, case site_class when 'two' then 2 else 6 end as n_states, row_number() over (partition by region order by ref_pos) - 1 as site from calls where site_class <> 'mono'),
link as (select s.region, r.read_id, s.site, s.ref_pos, coalesce(case when m.nuc in (s.a0, s.a1) then m.nuc end, -1) as nuc
  from snp s join reads r on s.region = r.region and s.ref_pos between r.first_pos and r.last_pos left join m on m.region = r.region and m.read_id = r.read_id and m.ref_pos = s.ref_pos)"""
PAIR_SQL = f"""{SNP_SQL},
pr as (select region, site, nuc, lead(site) over w as next_site, lead(nuc) over w as next_nuc from link window w as (partition by region, read_id order by site)),
pairs as (select region, site, nuc, next_nuc, count(*) as n from pr where next_site = site + 1 and nuc >= 0 and next_nuc >= 0 group by all)"""
PATTERN_SQL = f"""{SNP_SQL},
rowz as (select region, read_id, min(site) as first_site, string_agg(case nuc when 0 then 'A' when 1 then 'C' when 2 then 'T' when 3 then 'G' else '-' end, '' order by site) as pattern, max(nuc) as top from link group by all),
pat as (select region, first_site, pattern, count(*) as n, min(read_id) as first_read from rowz where top >= 0 group by all)"""
COMBO_SQL = f"""{PAIR_SQL},
stl as (select region, site, case site_class when 'two' then [[a0, a0, a1, a1], [a1, a1, a0, a0]]
  else (case when minor > major then [[major, major, major, minor], [major, major, minor, major], [major, minor, major, major], [minor, major, major, major]]
        else [[minor, major, major, major], [major, minor, major, major], [major, major, minor, major], [major, major, major, minor]] end) || [[a0, a0, a1, a1], [a1, a1, a0, a0]] end as g from snp),
st as (select region, site, s, g[s + 1] as g from (select region, site, g, unnest(range(0, len(g))) as s from stl)),
combo as (select x.region, x.site, x.s as s1, y.s as s2, x.g as g1, y.g as g2 from st x join st y on x.region = y.region and y.site = x.site + 1),
hap as (select region, site, s1, s2, unnest([1, 2, 3, 4]) as k, g1, g2 from combo),
ok as (select h.region, h.site, s1, s2, count(p.n) = 4 as good from hap h left join pairs p on p.region = h.region and p.site = h.site and p.nuc = g1[k] and p.next_nuc = g2[k] group by all),
sup as (select region, site, s1, s2 from (select *, bool_or(good) over (partition by region, site) as anyg from ok) where good or not anyg)"""
STEP_SQL = f"""{SNP_SQL},
stp as (select region, first_pos as start, max(last_pos - first_pos + 1) as span, row_number() over (partition by region order by first_pos) - 1 as t from reads group by region, first_pos),
loc as (select p.region, t, min(site) as first_site, max(site) as last_site from stp p join snp s on s.region = p.region and s.ref_pos >= start and s.ref_pos < start + span group by all),
par as (select b.region, b.t, b.first_site, b.last_site, a.t as parent_t, case when a.t is not null then least(a.last_site, b.last_site) - b.first_site + 1 end as overlap,
  row_number() over (partition by b.region, b.t order by least(a.last_site, b.last_site) desc, a.t) as r
  from loc b left join loc a on a.region = b.region and a.t < b.t and a.last_site >= b.first_site),
parent as (select * from par where r = 1)"""

ORACLES = {
    "linkage_long": f"with {SNP_SQL} select region, read_id, site, ref_pos, nuc::bigint as nuc from link",
    "adjacent_pair_transitions": f"with {PAIR_SQL} select region, site, nuc::bigint as nuc, next_nuc::bigint as next_nuc, n from pairs",
    "distinct_linkage_rows": f"with {PATTERN_SQL} select region, first_site, pattern, n, first_read from pat",
    "contained_linkage_rows": f"""with {PATTERN_SQL} select region, first_site, pattern, n, first_read from pat a where exists (select 1 from pat b where a.region = b.region and a.first_site = b.first_site
and length(a.pattern) = length(b.pattern) and a.pattern <> b.pattern and regexp_full_match(b.pattern, replace(a.pattern, '-', '.')))""",
    "hap_abundance_topk": f"""with {PATTERN_SQL}, r as (select *, row_number() over w as place, lag(n) over w as before from pat window w as (partition by region, first_site order by n desc, pattern))
select region, first_site, pattern, n, place from r where place <= 4 or place = 5 and before = n""",
    "cumulative_abundance": f"""with {PATTERN_SQL}, r as (select *, coalesce(sum(n) over (partition by region, first_site order by n desc, pattern rows between unbounded preceding and 1 preceding), 0)::bigint as before, sum(n) over (partition by region, first_site) as total from pat)
select region, first_site, pattern, n, before from r where before < 0.95 * total""",
    "combo_cartesian": f"with {COMBO_SQL} select region, site, s1, s2 from combo",
    "combo_supported": f"with {COMBO_SQL} select region, site, s1, s2 from sup",
    "transition_permit": f"with {COMBO_SQL} select a.region, a.site, a.s1, a.s2, b.s2 as s3 from sup a join sup b on a.region = b.region and b.site = a.site + 1 and a.s2 = b.s1",
    "state_repair": f"""with recursive {COMBO_SQL},
pool as (select a.region, a.site, a.s1, a.s2, b.s2 as s3 from combo a join combo b on a.region = b.region and b.site = a.site + 1 and a.s2 = b.s1),
chosen as (select * from pool where {CHOSEN}),
by_left as (select region, site, s1, s2, min(s3) as s3 from pool group by all), by_right as (select region, site, s2, s3, min(s1) as s1 from pool group by all),
back as (select region, site, s1, s2, s3, 0 as added from chosen
  union select p.region, p.site, p.s1, p.s2, p.s3, 1 from back b join by_right p on p.region = b.region and p.site = b.site - 1 and p.s2 = b.s1 and p.s3 = b.s2
  where not exists (select 1 from chosen c where c.region = p.region and c.site = p.site and c.s2 = p.s2 and c.s3 = p.s3)),
fore as (select region, site, s1, s2, s3, added from back
  union select p.region, p.site, p.s1, p.s2, p.s3, 2 from fore b join by_left p on p.region = b.region and p.site = b.site + 1 and p.s1 = b.s2 and p.s2 = b.s3
  where not exists (select 1 from back c where c.region = p.region and c.site = p.site and c.s1 = p.s1 and c.s2 = p.s2))
select region, site, s1::bigint as s1, s2::bigint as s2, s3::bigint as s3, added::bigint as added from fore""",
    "step_parent_asof": f"with {STEP_SQL} select region, t, first_site, last_site, coalesce(parent_t, -1) as parent_t, coalesce(overlap, -1) as overlap from parent",
    "block_ids": f"with {STEP_SQL} select region, t, (sum((parent_t is null)::int) over (partition by region order by t) - 1)::bigint as block_id from parent",
    "linked_site_counts": f"with {SNP_SQL} select region, ref_pos, " + ", ".join(f"count(*) filter (nuc = {k}) as {n}" for k, n in enumerate(("n0", "n1", "n2", "n3", "n_del"))) + ", count(*) as depth from link where nuc >= 0 group by region, ref_pos",
    "block_new_sites": f"""with {STEP_SQL}, b as (select distinct region, t // 40 as block_id, unnest(range(first_site, last_site + 1)) as site from loc)
select region, block_id, site from b where not exists (select 1 from b p where p.region = b.region and p.block_id = b.block_id - 1 and p.site = b.site)""",
    "dense_numbers": f"with {SNP_SQL.split('m as (')[0]} r as (select distinct region, read_id as line from tetra) select region, line, row_number() over (partition by region order by line) as read_id from r",
    "state_space_size": f"""with {STEP_SQL} select p.region, t, round(sum(log2(n_states)), 6) as log2_states from stp p join snp s on s.region = p.region and s.ref_pos >= start and s.ref_pos < start + span group by all""",
    "weighted_group_sum": "select l_returnflag, l_linestatus, l_linenumber, sum(l_quantity::bigint)::bigint as w, count(*) as n, min(l_orderkey) as first_key from lineitem group by all",
}
