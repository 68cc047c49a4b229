"""Queries over the pileup and site genotyping operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fourfold.operators import pileup, sites
from fourfold.plans.options import Options
from fourfold.plans.views import TETRA_SQL, tetra

MASK, LOW = 15, 18


def _masked(spark, sf_dir):
    return pileup.mask_low_quality(tetra(spark, sf_dir), MASK)


def snp_call_table(spark, sf_dir):
    calls = sites.call_sites(pileup.site_table(_masked(spark, sf_dir), LOW))
    long = [F.col(c).cast("long").alias(c) for c in ("region", "ref_pos", "depth", "n0", "n1", "n2", "n3", "n_del", "major", "minor", "n_states")]
    return calls.select(*long, "site_class").withColumn("minor", F.coalesce("minor", F.lit(-1)))


def site_state_rows(spark, sf_dir):
    states = sites.site_states(sites.call_sites(pileup.site_table(_masked(spark, sf_dir), LOW)))
    return states.select(*[F.col(c).cast("long").alias(c) for c in states.columns])


def three_nucleotide_states(spark, sf_dir):
    """States where a third nucleotide counts: four more if one of the three is clearly the double one, else twelve."""
    states = sites.site_states(sites.call_sites(pileup.site_table(_masked(spark, sf_dir), LOW), Options(third_nuc=1)))
    return states.select(*[F.col(c).cast("long").alias(c) for c in states.columns])


def pileup_counts(spark, sf_dir):
    return pileup.base_counts(tetra(spark, sf_dir))


def site_coverage(spark, sf_dir):
    return pileup.coverage(pileup.read_summary(_masked(spark, sf_dir))).select("region", "ref_pos", F.col("depth").cast("long").alias("depth"))


def uncovered_sites(spark, sf_dir):
    # Only bases of the best qualities, so that some sites have none.
    return pileup.uncovered_sites(pileup.mask_low_quality(tetra(spark, sf_dir), 41))


def quality_masked_pileup(spark, sf_dir):
    kept = pileup.drop_lowest_quality(_masked(spark, sf_dir), LOW)
    return pileup.base_counts(kept)


def read_summary(spark, sf_dir):
    return pileup.read_summary(_masked(spark, sf_dir))


def step_table(spark, sf_dir):
    return pileup.steps(pileup.read_summary(_masked(spark, sf_dir)))


def masked_group_sizes(spark, sf_dir):
    """Largest position over which at least four bases lie, for each region."""
    return pileup.last_supported(tetra(spark, sf_dir))


QUERIES = {f.__name__: f for f in (snp_call_table, site_state_rows, three_nucleotide_states, pileup_counts, site_coverage, uncovered_sites, quality_masked_pileup, read_summary, step_table, masked_group_sizes)}

SITES_SQL = f"""{TETRA_SQL},
m as (select * from tetra where qua >= {MASK}),
reads as (select region, read_id, min(ref_pos) as first_pos, max(ref_pos) as last_pos from m group by all),
cov as (select region, ref_pos, count(*) as depth from (select region, unnest(range(first_pos, last_pos + 1)) as ref_pos from reads) group by all),
low as (select *, count(*) over w as real, min(qua) over w as lowest, row_number() over (partition by region, ref_pos order by qua desc, read_id desc) as rn from m window w as (partition by region, ref_pos)),
low2 as (select *, count(*) filter (where qua = lowest) over (partition by region, ref_pos) as nl from low),
kept as (select * from low2 where case when real <= 2 then rn = 1 when lowest < {LOW} and real > nl then qua > lowest else true end),
cnt as (select region, ref_pos, max(real) as real, sum((nuc = 0)::bigint)::bigint as n0, sum((nuc = 1)::bigint)::bigint as n1, sum((nuc = 2)::bigint)::bigint as n2, sum((nuc = 3)::bigint)::bigint as n3 from kept group by all),
site as (select c.*, cov.depth, case when real <= 2 then 0 else cov.depth - real end as n_del from cnt c join cov using (region, ref_pos)),
tall as (select region, ref_pos, unnest([0, 1, 2, 3]) as nuc, unnest([n0, n1, n2, n3]) as n from site),
top as (select *, row_number() over (partition by region, ref_pos order by n desc, nuc desc) as r from tall where n > 0),
two as (select region, ref_pos, min(nuc) as a0, case when count(*) > 1 then max(nuc) end as a1, arg_min(n, nuc) as x, case when count(*) > 1 then arg_max(n, nuc) else 0 end as y from top where r <= 2 group by all),
cls as (select s.*, a0, a1, x, y, case when x >= y then a0 else a1 end as major, case when x >= y then a1 else a0 end as minor,
  case when (x + y - greatest(x, y) = 1 and x + y > 4) or greatest(x, y) / (x + y) >= 0.9 then 'mono' when greatest(x, y) / (x + y) >= 0.55 then 'perm_two' else 'two' end as pair,
  n_del / (n0 + n1 + n2 + n3 + n_del) >= 0.4 as gapped from site s join two using (region, ref_pos)),
calls as (select *, case when a1 is null then 'mono' when gapped and not (x / (x + y) between 0.45 and 0.55) then 'mono' else pair end as site_class from cls)"""

ORACLES = {
    "snp_call_table": f"""with {SITES_SQL}
select region, ref_pos, depth, n0, n1, n2, n3, n_del, major::bigint as major, coalesce(minor, -1)::bigint as minor, case site_class when 'mono' then 1 when 'two' then 2 else 6 end::bigint as n_states, site_class from calls""",
    "site_state_rows": f"""with {SITES_SQL},
st as (select region, ref_pos, case site_class when 'mono' then [[major, major, major, major]]
  when 'two' then [[a0, a0, a1, a1], [a1, a1, a0, a0]]
  else (case when minor > major then [[major, major, major, minor], [major, major, minor, major], [major, minor, major, major], [minor, major, major, major]]
        else [[minor, major, major, major], [major, minor, major, major], [major, major, minor, major], [major, major, major, minor]] end) || [[a0, a0, a1, a1], [a1, a1, a0, a0]] end as s from calls),
ex as (select region, ref_pos, unnest(range(0, len(s))) as state_idx, s from st)
select region, ref_pos, state_idx::bigint as state_idx, s[state_idx + 1][1]::bigint as h0, s[state_idx + 1][2]::bigint as h1, s[state_idx + 1][3]::bigint as h2, s[state_idx + 1][4]::bigint as h3 from ex""",
    "three_nucleotide_states": f"""with {SITES_SQL},
tri as (select region, ref_pos, list(nuc order by nuc) as c, list(n order by nuc) as k from top where r <= 3 group by all having count(*) = 3),
trj as (select t.*, list_position(k, list_max(k)) as t, list_max(k) as most, list_sum(k) as total from tri t join cls using (region, ref_pos) where not gapped),
trs as (select region, ref_pos, (total - most) / most between 0.8 and 1.2 or most / total >= 0.45 as clear, t, c[1] as a, c[2] as b, c[3] as d from trj),
trl as (select region, ref_pos, case when not clear then [[b, d, a, a], [d, b, a, a], [a, a, b, d], [a, a, d, b], [b, a, d, d], [a, b, d, d], [d, d, b, a], [d, d, a, b], [d, a, b, b], [a, d, b, b], [b, b, d, a], [b, b, a, d]]
  when t = 1 then [[b, d, a, a], [d, b, a, a], [a, a, b, d], [a, a, d, b]] when t = 2 then [[a, d, b, b], [d, a, b, b], [b, b, a, d], [b, b, d, a]] else [[a, b, d, d], [b, a, d, d], [d, d, a, b], [d, d, b, a]] end as more from trs),
st as (select region, ref_pos, case site_class when 'mono' then [[major, major, major, major]]
  when 'two' then [[a0, a0, a1, a1], [a1, a1, a0, a0]]
  else (case when minor > major then [[major, major, major, minor], [major, major, minor, major], [major, minor, major, major], [minor, major, major, major]]
        else [[minor, major, major, major], [major, minor, major, major], [major, major, minor, major], [major, major, major, minor]] end) || [[a0, a0, a1, a1], [a1, a1, a0, a0]] end as s from calls),
su as (select region, ref_pos, case when more is null then s else more || s end as s from st left join trl using (region, ref_pos)),
ex as (select region, ref_pos, unnest(range(0, len(s))) as state_idx, s from su)
select region, ref_pos, state_idx::bigint as state_idx, s[state_idx + 1][1]::bigint as h0, s[state_idx + 1][2]::bigint as h1, s[state_idx + 1][3]::bigint as h2, s[state_idx + 1][4]::bigint as h3 from ex""",
    "pileup_counts": f"with {TETRA_SQL} select region, ref_pos, nuc, count(*) as n, sum(qua)::bigint as sum_qua from tetra group by all",
    "site_coverage": f"with {SITES_SQL} select region, ref_pos, depth from cov",
    "uncovered_sites": f"""with {TETRA_SQL}, m as (select region, ref_pos from tetra where qua >= 41),
e as (select region, unnest(range(min(ref_pos), max(ref_pos) + 1)) as ref_pos from m group by region)
select region, ref_pos from e except select region, ref_pos from m""",
    "quality_masked_pileup": f"""with {TETRA_SQL}, m as (select * from tetra where qua >= {MASK}),
l as (select *, min(qua) over (partition by region, ref_pos) as lowest, count(*) over (partition by region, ref_pos) as total from m),
k as (select *, count(*) filter (where qua = lowest) over (partition by region, ref_pos) as nl from l)
select region, ref_pos, nuc, count(*) as n, sum(qua)::bigint as sum_qua from k where not (lowest < {LOW} and total > nl and qua = lowest) group by all""",
    "read_summary": f"""with {TETRA_SQL} select region, read_id, count(*) as n_bases, min(ref_pos) as first_pos, max(ref_pos) as last_pos, max(read_pos) as last_read_pos, sum(qua)::bigint as sum_qua,
max(ref_pos) - min(ref_pos) + 1 - count(*) as n_missing from tetra where qua >= {MASK} group by all""",
    "step_table": f"""with {SITES_SQL} select region, first_pos as start, count(*) as n_reads, max(last_pos - first_pos + 1) as span, row_number() over (partition by region order by first_pos) - 1 as t from reads group by region, first_pos""",
    "masked_group_sizes": f"""with {TETRA_SQL}, e as (select region, ref_pos from tetra group by all having count(*) >= 4)
select region, max(ref_pos) as last_pos from e group by region""",
}
