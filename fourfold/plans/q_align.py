"""Queries over SAM records, projection onto universal columns, gaps, options and steps; lines and sequences are made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fourfold.functions import codec
from fourfold.operators import linkage, pileup, project, quantiles, sites, steps, targets
from fourfold.operators.keep import cut
from fourfold.plans.options import Options
from fourfold.plans.q_linkage import PATTERN_SQL, SNP_SQL, STEP_SQL
from fourfold.plans.q_pileup import LOW, MASK, SITES_SQL
from fourfold.plans.views import table, tetra
from fourfold.sources import sam

# What a SAM line holds, in words that Spark and DuckDB both read.
FLAG = "case when event_id % 11 = 0 then 4 when event_id % 13 = 0 then 2048 when event_id % 7 = 0 then 16 else 0 end"
CIGAR = "concat(event_id % 3 + 1, 'H', event_id % 6 + 1, 'S', 20 + event_id % 30, 'M', event_id % 4 + 1, 'I', 10 + event_id % 20, 'M', event_id % 5 + 1, 'D15M')"
LENGTH = "(event_id % 6 + 1 + 20 + event_id % 30 + event_id % 4 + 1 + 10 + event_id % 20 + 15)"
SEQ = f"substr(repeat('ACGTTGCAAC', 12), cast(event_id % 10 + 1 as int), cast({LENGTH} as int))"
QUAL = f"substr(repeat('II5?FB+7G:', 12), cast(event_id % 10 + 1 as int), cast({LENGTH} as int))"
LIMITS = Options(drop_soft_clipped=6, drop_indel=5, min_length=60, max_length=110, max_eerr=1.3)


def _lines(spark, sf_dir):
    value = f"concat_ws('\t', concat('r', event_id), {FLAG}, concat('chr', event_id % 5), event_id * 7 % 1000 + 1, '60', {CIGAR}, '*', '0', '0', {SEQ}, {QUAL})"
    return table(spark, sf_dir, "events").selectExpr("event_id as line", f"{value} as value")


def sam_records(spark, sf_dir):
    """Fields of SAM records."""
    rows = sam.parse_records(_lines(spark, sf_dir))
    return rows.select("line", "name", F.col("flag").cast("long").alias("flag"), "rname", "pos", F.size("ops").cast("long").alias("n_ops"), "cigar", F.md5(F.concat("seq", "qual").cast("binary")).alias("digest"))


def sam_filter_report(spark, sf_dir):
    """How many records each rule leaves out, the first that holds."""
    return sam.report(sam.reasons(sam.parse_records(_lines(spark, sf_dir)), LIMITS))


def sam_base_table(spark, sf_dir):
    """Aligned bases of the records that stay: how many of each letter, and where they lie, by record."""
    rows = sam.reasons(sam.parse_records(_lines(spark, sf_dir)), Options()).filter("reason is null")
    bases = sam.base_table(rows)
    return bases.groupBy("line", "nuc").agg(F.count("*").alias("n"), F.sum("read_pos").cast("long").alias("read_pos"), F.sum("ref_pos").cast("long").alias("ref_pos"), F.sum("qua").cast("long").alias("qua"))


# Two aligned sequences for each customer, with gaps in either, and reads for each of their orders.
SEQ_A = "translate(md5(concat('a', c_custkey)), '0123456789abcdef', 'ACGT-ACGTACG-TAC')"
SEQ_B = "translate(md5(concat('b', c_custkey)), '0123456789abcdef', 'GT-ACGTACGTACGT-')"
READ = "translate(md5(cast(o_orderkey as {string})), '0123456789abcdef', 'ACGTACGTACGTACGT')"
MARKS = "translate(md5(concat('q', o_orderkey)), '0123456789abcdef', '+,-./0123456789:')"


def _columns(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").selectExpr("c_custkey as target", f"{SEQ_A} as seq_a", f"{SEQ_B} as seq_b", "cast(101 as bigint) as first_a", "cast(540 as bigint) as first_b", "if(c_custkey % 2 = 0, 1, -1) as step_b")
    return project.universal_columns(pairs)


def universal_columns(spark, sf_dir):
    """Columns of two aligned sequences with their symbols and real coordinates, forwards and backwards."""
    out = _columns(spark, sf_dir)
    return out.groupBy("target", "symbol").agg(F.count("*").alias("n"), F.sum(F.col("col") * F.coalesce("pos_a", F.lit(0))).alias("sum_a"), F.sum(F.col("col") * F.coalesce("pos_b", F.lit(0))).alias("sum_b"), F.min("col").alias("first"), F.max("col").alias("last"))


def _projected(spark, sf_dir):
    ops = codec.parse_cigar(F.lit("5M2D6M1I4M"))
    orders = table(spark, sf_dir, "orders")
    reads = orders.selectExpr("o_custkey as target", "o_orderkey as line", "96 + o_orderkey % 25 as pos", f"{READ.format(string='string')} as seq", f"{MARKS} as qual").withColumn("ops", ops)
    cols = _columns(spark, sf_dir).select("target", "col", "symbol", F.col("pos_a").alias("pos"), F.col("base_a").alias("base"))
    return project.project(reads, cols, F.col("line") % 3 == 0)


def projected_reads(spark, sf_dir):
    """Universal columns that each read covers, its bases there, complemented where the genome runs backwards."""
    out = _projected(spark, sf_dir)
    return out.groupBy("target", "line").agg(F.count("*").alias("n"), F.count("nuc").alias("n_bases"), F.min("col").alias("first"), F.max("col").alias("last"), F.sum("read_idx").cast("long").alias("read_idx"), F.sum(F.col("col") * F.coalesce("qua", F.lit(0))).cast("long").alias("qua"), F.count_if(F.col("nuc") == "A").alias("n_a"))


def alignment_scores(spark, sf_dir):
    """Log-likelihood of each projected read, with the penalty for its gaps."""
    out = project.score(_projected(spark, sf_dir))
    return out.select("target", "line", F.round("ll_aln", 6).alias("ll_aln"), "new_pos", "aln_len", "gap_in")


def pileup_text_rows(spark, sf_dir):
    """Rows of the pileup text: read indices carried over gaps, bases of low quality as gaps."""
    rows = project.pileup_rows(_projected(spark, sf_dir).withColumn("read_id", F.col("line")), 20)
    return rows.groupBy("region", "read_id").agg(F.sum("read_pos").alias("read_pos"), F.count_if(F.col("qua") == -1).alias("n_gaps"), F.sum("qua").cast("long").alias("qua"), F.count_if(F.col("nuc") == "-").alias("n_dashes"))


HIGH = 30
SYMBOL = "case ref_pos % 3 when 0 then 'I' when 1 then 'J' else 'M' end"


def _called(spark, sf_dir, options=None):
    bases = pileup.mask_low_quality(tetra(spark, sf_dir), HIGH)
    return sites.call_sites(pileup.site_table(bases, 10).withColumn("symbol", F.expr(SYMBOL)), options, "symbol")


def gap_site_calls(spark, sf_dir):
    """Site classes where most bases are missing, by the symbol of the universal column."""
    calls = _called(spark, sf_dir)
    return calls.groupBy("region", "symbol", "site_class").agg(F.count("*").alias("n"), F.sum("ref_pos").alias("ref_pos"), F.sum("n_states").cast("long").alias("n_states"))


def gap_site_states(spark, sf_dir):
    """States of sites with gaps."""
    states = sites.site_states(_called(spark, sf_dir).filter("site_class in ('gap2', 'gap4')"))
    return states.select(*[F.col(c).cast("long").alias(c) for c in states.columns])


def single_site_states(spark, sf_dir):
    """States with the option `single`: no site of two nucleotides is monomorphic."""
    states = sites.site_states(sites.call_sites(pileup.site_table(pileup.mask_low_quality(tetra(spark, sf_dir), MASK), LOW), Options(single=1)))
    return states.select(*[F.col(c).cast("long").alias(c) for c in states.columns])


def cut_off_counts(spark, sf_dir):
    """Counts of nucleotides that reach a share of their site's coverage."""
    out = pileup.site_table(tetra(spark, sf_dir), 10, cut_off=0.15)
    return out.select("region", "ref_pos", *[F.col(f"n{k}").cast("long").alias(f"n{k}") for k in range(4)])


def _parts(spark, sf_dir, symbol=False):
    bases = pileup.mask_low_quality(tetra(spark, sf_dir), MASK)
    reads = cut(pileup.read_summary(bases))
    calls = pileup.site_table(bases, LOW, reads=reads)
    if symbol:
        calls = calls.withColumn("symbol", F.expr(SYMBOL))
    calls = sites.call_sites(calls, None, "symbol" if symbol else None)
    return bases, reads, cut(linkage.snp_sites(calls))


def linkage_with_gaps(spark, sf_dir):
    """Alleles of reads where a missing base in a column of one sub-genome is a gap."""
    bases, reads, snps = _parts(spark, sf_dir, True)
    out = linkage.linkage(bases, reads, snps, "symbol")
    return out.groupBy("region", "site", "nuc").agg(F.count("*").alias("n"), F.sum("read_id").alias("reads"))


def masked_alleles(spark, sf_dir):
    """Bases that are neither of a site's two alleles."""
    bases, _, snps = _parts(spark, sf_dir)
    return linkage.masked(bases, snps).select("region", "read_id", F.col("site").cast("long").alias("site"))


def _windows(spark, sf_dir):
    _, reads, snps = _parts(spark, sf_dir)
    return cut(steps.step_sites(pileup.steps(reads), snps))


def window_support(spark, sf_dir):
    """What reads know of each window of sites."""
    bases, reads, snps = _parts(spark, sf_dir)
    located = cut(steps.step_sites(pileup.steps(reads), snps)).filter("n_sites > 0")
    out = linkage.window_patterns(linkage.patterns(linkage.linkage(bases, reads, snps)), located)
    return out.select(F.col("region"), F.col("first_site").cast("long").alias("first_site"), F.col("last_site").cast("long").alias("last_site"), "pattern", "n")


def delete_steps(spark, sf_dir):
    """Steps without varying sites go; the others and their parents are numbered anew."""
    located = _windows(spark, sf_dir)
    left = steps.drop_steps(located, located.filter("n_sites = 0 or t % 3 = 1"))
    return left.select("region", F.col("t").cast("long").alias("t"), "start", F.col("n_sites").cast("long").alias("n_sites"))


def trimmed_windows(spark, sf_dir):
    """Windows cut where linkage is broken; every fifth site is taken as unshared with the next."""
    bases, reads, snps = _parts(spark, sf_dir)
    located = cut(steps.step_sites(pileup.steps(reads), snps))
    members = reads.select("region", "read_id", F.col("first_pos").alias("start")).hint("merge").join(located.select("region", "start", "t"), ["region", "start"])
    out = steps.trim(located, members, linkage.masked(bases, snps), snps.filter("site % 2 = 1").select("region", "site"))
    return out.select("region", "t", *[F.col(c).cast("long").alias(c) for c in ("first_site", "last_site")])


def merge_steps(spark, sf_dir):
    """Steps to be merged into those of an earlier block, where blocks are cut at every 40th step."""
    rows = _windows(spark, sf_dir).filter("n_sites > 0").withColumn("block_id", F.floor(F.col("t") / 40))
    return steps.merges(rows).select("region", *[F.col(c).cast("long").alias(c) for c in ("t", "into")])


SECOND = "concat(10 + event_id % 25, 'M', event_id % 3 + 1, 'D', {length} - 10 - event_id % 25, 'M')"
SHIFT = "event_id % 60 - 30"


def trimmed_alignments(spark, sf_dir):
    """Two alignments of each read, cut to their common extent."""
    rows = sam.parse_records(_lines(spark, sf_dir)).withColumn("event_id", F.col("line"))
    first = rows.select("line", F.lit("a").alias("genome"), F.col("pos").alias("start"), "ops")
    second = rows.select("line", F.lit("b").alias("genome"), (F.col("pos") + F.expr(SHIFT)).alias("start"), codec.parse_cigar(F.expr(SECOND.format(length="length(seq)"))).alias("ops"))
    out = targets.common_extent(first.unionByName(second), ["line"])
    return out.select("line", "genome", F.col("start").cast("long").alias("start"), codec.cigar_text(F.col("ops")).alias("cigar"))


def region_parts(spark, sf_dir):
    """Names, starts and ends of regions named after records, and what isn't such a name."""
    rows = sam.parse_records(_lines(spark, sf_dir))
    text = F.when(F.col("line") % 9 == 0, F.col("rname")).otherwise(codec.region_name(F.concat("rname", F.lit(":x-"), F.col("line") % 3), F.col("pos"), F.col("pos") + F.length("seq")))
    return rows.select("line", codec.split_region(text).alias("g")).select("line", F.coalesce("g.name", F.lit("-")).alias("name"), F.coalesce("g.start", F.lit(-1)).alias("start"), F.coalesce("g.end", F.lit(-1)).alias("stop"))


def quality_quantiles(spark, sf_dir):
    """Of each region's bases the lower median of the qualities, their ninth decile, and the site up to which 4,000 bases lie."""
    bases = pileup.mask_low_quality(tetra(spark, sf_dir), MASK).select("region", "ref_pos", "qua")
    out = quantiles.weighted_quantile(bases, ["region"], "qua", 0.5).withColumnRenamed("qua", "median")
    high = quantiles.weighted_quantile(bases, ["region"], "qua", 0.9, bins=4).withColumnRenamed("qua", "high")
    until = quantiles.cumulative_cut(bases, ["region"], "ref_pos", 4000, bins=8).withColumnRenamed("ref_pos", "until")
    return out.join(high, "region").join(until, "region").select("region", "median", "high", F.coalesce("until", F.lit(-1)).alias("until"))


def sequence_checks(spark, sf_dir):
    """Quality and nucleotide codecs on whole records: errors, chance of no error, censored qualities, decoded letters, region names."""
    rows = sam.parse_records(_lines(spark, sf_dir))
    first = codec.xy_code(F.substring("seq", 1, 1))
    return rows.select(
        "line", F.round(codec.expected_errors(F.col("qual")), 6).alias("expected"), F.round(codec.error_free_probability(F.col("qual")), 9).alias("error_free"),
        codec.censored_phred(F.substring("qual", 1, 1), 20, 35).cast("long").alias("censored"), codec.xy_char(F.when(F.col("line") % 4 > 0, first)).alias("letter"), codec.phred_char(codec.phred(F.substring("qual", 2, 1))).alias("mark"),
        codec.region_name(F.col("rname"), F.col("pos"), F.col("pos") + codec.reference_length(F.col("ops"))).alias("region"), codec.is_nucleotide(F.col("seq")).alias("valid"),
    )


def set_equal(spark, sf_dir):
    """Customers whose orders use one and the same set of priorities in both states, open and filled."""
    o = table(spark, sf_dir, "orders")
    sets = o.groupBy("o_custkey").agg(*[F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))).alias(s) for s in ("O", "F")])
    return sets.filter((F.size("O") > 0) & (F.col("O") == F.col("F"))).select("o_custkey", F.size("O").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (
    sam_records, sam_filter_report, sam_base_table, universal_columns, projected_reads, alignment_scores, pileup_text_rows, gap_site_calls, gap_site_states, single_site_states,
    cut_off_counts, linkage_with_gaps, masked_alleles, window_support, delete_steps, trimmed_windows, merge_steps, trimmed_alignments, region_parts, quality_quantiles, sequence_checks, set_equal,
)}

SAM_SQL = f"""sam as (select event_id as line, concat('r', event_id) as name, {FLAG} as flag, concat('chr', event_id % 5) as rname, event_id * 7 % 1000 + 1 as pos, {CIGAR} as cigar, {SEQ} as seq, {QUAL} as qual,
  event_id % 3 + 1 as h, event_id % 6 + 1 as s, 20 + event_id % 30 as m1, event_id % 4 + 1 as i, 10 + event_id % 20 as m2, event_id % 5 + 1 as d, {LENGTH} as len from events)"""
ERRORS_SQL = "list_sum(list_transform(range(1, length(qual) + 1), lambda k: pow(10.0::double, -(ascii(substr(qual, k::int, 1)) - 33) / 10.0)))"
COLUMNS_SQL = f"""pr as (select c_custkey as target, {SEQ_A} as sa, {SEQ_B} as sb, case when c_custkey % 2 = 0 then 1 else -1 end as step from customer),
un as (select target, step, unnest(range(0, 32)) as col, sa, sb from pr),
ab as (select target, step, col, substr(sa, col::int + 1, 1) as a, substr(sb, col::int + 1, 1) as b from un),
cols as (select target, col, a, b, case when a = '-' then 'I' when b = '-' then 'J' else 'M' end as symbol,
  case when a <> '-' then 100 + sum((a <> '-')::int) over w end as pos_a, case when b <> '-' then 540 + step * (sum((b <> '-')::int) over w - 1) end as pos_b from ab window w as (partition by target order by col))"""
PROJECT_SQL = f"""{COLUMNS_SQL},
rd as (select o_custkey as target, o_orderkey as line, 96 + o_orderkey % 25 as pos, {READ.format(string='varchar')} as seq, {MARKS} as qual from orders),
lim as (select target, min(pos_a) as low, max(pos_a) as high from cols group by target),
sp as (select r.*, greatest(pos, low) as f, least(pos + 16, high) as t from rd r join lim using (target) where greatest(pos, low) <= least(pos + 16, high)),
cov as (select s.target, s.line, s.pos, s.seq, s.qual, c.col, c.pos_a, c.symbol, c.a as ref_base from sp s join cols x on x.target = s.target and x.pos_a = s.f join cols y on y.target = s.target and y.pos_a = s.t
  join cols c on c.target = s.target and c.col between x.col and y.col),
idx as (select *, pos_a - pos as g, case when pos_a - pos < 5 then pos_a - pos when pos_a - pos < 7 then null when pos_a - pos < 13 then pos_a - pos - 2 else pos_a - pos - 1 end as read_idx from cov),
prj as (select target, line, col, symbol, ref_base, read_idx, case when read_idx is not null then ascii(substr(qual, read_idx::int + 1, 1)) - 33 end as qua,
  case when read_idx is not null then case when line % 3 = 0 then translate(substr(seq, read_idx::int + 1, 1), 'ACGT', 'TGCA') else substr(seq, read_idx::int + 1, 1) end end as nuc from idx)"""
HIGH_SQL = SITES_SQL.replace(f"qua >= {MASK}", f"qua >= {HIGH}").replace(f"lowest < {LOW}", "lowest < 10")
CALLED_SQL = f"""{HIGH_SQL},
odd as (select *, {SYMBOL} as symbol from cls),
called as (select *, case when a1 is null then case when gapped and symbol <> 'M' then 'gap2' else 'mono' end
  when gapped then case when x / (x + y) between 0.45 and 0.55 then case when symbol <> 'M' then 'gap4' else pair end when symbol <> 'M' then 'gap2' else 'mono' end else pair end as site_class from odd)"""
ODD_SQL = f"""{SITES_SQL},
odd as (select *, {SYMBOL} as symbol from cls),
called as (select *, case when a1 is null then case when gapped and symbol <> 'M' then 'gap2' else 'mono' end
  when gapped then case when x / (x + y) between 0.45 and 0.55 then case when symbol <> 'M' then 'gap4' else pair end when symbol <> 'M' then 'gap2' else 'mono' end else pair end as site_class from odd),
osnp as (select region, ref_pos, a0, a1, symbol, row_number() over (partition by region order by ref_pos) - 1 as site from called where site_class <> 'mono'),
olink as (select s.region, r.read_id, s.site, coalesce(case when m.nuc in (s.a0, s.a1) then m.nuc when m.nuc is null and symbol <> 'M' then 4 end, -1) as nuc
  from osnp s join reads r on s.region = r.region and s.ref_pos between r.first_pos and r.last_pos left join m on m.region = r.region and m.read_id = r.read_id and m.ref_pos = s.ref_pos)"""

ORACLES = {
    "sam_records": f"with {SAM_SQL} select line, name, flag::bigint as flag, rname, pos, 7::bigint as n_ops, cigar, md5(concat(seq, qual)) as digest from sam",
    "sam_filter_report": f"""with {SAM_SQL}, r as (select case when flag & 4 <> 0 then 'unmapped' when flag & 2048 <> 0 then 'secondary' when greatest(s, h) >= 6 then 'clipped' when greatest(i, d) >= 5 then 'indel'
  when len < 60 then 'short' when len > 110 then 'long' when {ERRORS_SQL} > 1.3 then 'errors' else 'kept' end as reason from sam) select reason, count(*) as n from r group by reason""",
    "sam_base_table": f"""with {SAM_SQL}, k as (select *, unnest(range(0, m1 + i + m2 + d + 15)) as p from sam where flag & 4 = 0 and flag & 2048 = 0),
b as (select *, case when p < m1 then 'M' when p < m1 + i then 'I' when p < m1 + i + m2 then 'M' when p < m1 + i + m2 + d then 'D' else 'M' end as op,
  case when p < m1 + i + m2 then s + p else s + p - d end as ri, case when p < m1 then pos + p - 1 when p < m1 + i then -1 else pos + p - i - 1 end as rp from k)
select line, case when op = 'D' then '-' else substr(seq, ri::int + 1, 1) end as nuc, count(*) as n, sum(case when op = 'D' then -1 else ri + h end)::bigint as read_pos, sum(rp)::bigint as ref_pos,
  sum(case when op = 'D' then -1 else ascii(substr(qual, ri::int + 1, 1)) - 33 end)::bigint as qua from b group by all""",
    "universal_columns": f"with {COLUMNS_SQL} select target, symbol, count(*) as n, sum(col * coalesce(pos_a, 0))::bigint as sum_a, sum(col * coalesce(pos_b, 0))::bigint as sum_b, min(col) as first, max(col) as last from cols group by all",
    "projected_reads": f"""with {PROJECT_SQL} select target, line, count(*) as n, count(nuc) as n_bases, min(col) as first, max(col) as last, sum(read_idx)::bigint as read_idx, sum(col * coalesce(qua, 0))::bigint as qua, count(*) filter (where nuc = 'A') as n_a from prj group by all""",
    "alignment_scores": f"""with {PROJECT_SQL}, v as (select *, ref_base = '-' or nuc is null as gap, case when nuc = ref_base then ln(1 - pow(10.0::double, -qua / 10.0)) else -qua / 10.0 * ln(10.0::double) - ln(3.0::double) end as lp from prj),
s as (select target, line, coalesce(sum(lp) filter (where not gap), 0.0) as ll, count(*) filter (where gap) as gap_in, min(col) as new_pos, count(*) as aln_len from v group by all)
select target, line, round(ll + case when gap_in > 0 then gap_in * ln(1e-5::double * aln_len) - 1e-5::double * aln_len - ln(factorial(gap_in::int)::double) else 0.0 end, 6) as ll_aln, new_pos, aln_len, gap_in from s""",
    "pileup_text_rows": f"""with {PROJECT_SQL}, c as (select *, coalesce(last_value(read_idx ignore nulls) over (partition by target, line order by col), -1) as rp, qua is null or qua < 20 as low from prj)
select target as region, line as read_id, sum(rp)::bigint as read_pos, count(*) filter (where low) as n_gaps, sum(case when low then -1 else qua end)::bigint as qua, count(*) filter (where low) as n_dashes from c group by all""",
    "gap_site_calls": f"""with {CALLED_SQL} select region, symbol, site_class, count(*) as n, sum(ref_pos)::bigint as ref_pos, sum(case site_class when 'mono' then 1 when 'two' then 2 when 'gap2' then 2 when 'gap4' then 4 else 6 end)::bigint as n_states from called group by all""",
    "gap_site_states": f"""with {CALLED_SQL}, st as (select region, ref_pos, case site_class when 'gap2' then [[-1, -1, major, major], [major, major, -1, -1]] else [[-1, -1, a0, a1], [-1, -1, a1, a0], [a0, a1, -1, -1], [a1, a0, -1, -1]] end as s from called where site_class in ('gap2', 'gap4')),
ex as (select region, ref_pos, unnest(range(0, len(s))) as state_idx, s from st)
select region, ref_pos, state_idx::bigint as state_idx, s[state_idx + 1][1]::bigint as h0, s[state_idx + 1][2]::bigint as h1, s[state_idx + 1][3]::bigint as h2, s[state_idx + 1][4]::bigint as h3 from ex""",
    "single_site_states": f"""with {SITES_SQL}, one as (select *, case when a1 is null or (gapped and not (x / (x + y) between 0.45 and 0.55)) then 'mono' when greatest(x, y) / (x + y) >= 0.55 then 'single' else 'two' end as c from cls),
st as (select region, ref_pos, case c when 'mono' then [[major, major, major, major]] when 'two' then [[a0, a0, a1, a1], [a1, a1, a0, a0]]
  else case when minor > major then [[major, major, major, minor], [major, minor, major, major]] else [[minor, major, major, major], [major, major, minor, major]] end end as s from one),
ex as (select region, ref_pos, unnest(range(0, len(s))) as state_idx, s from st)
select region, ref_pos, state_idx::bigint as state_idx, s[state_idx + 1][1]::bigint as h0, s[state_idx + 1][2]::bigint as h1, s[state_idx + 1][3]::bigint as h2, s[state_idx + 1][4]::bigint as h3 from ex""",
    "cut_off_counts": f"""with {SITES_SQL.replace(f"qua >= {MASK}", "true").replace(f"lowest < {LOW}", "lowest < 10")}
select region, ref_pos, case when n0 >= depth * 0.15 then n0 else 0 end as n0, case when n1 >= depth * 0.15 then n1 else 0 end as n1, case when n2 >= depth * 0.15 then n2 else 0 end as n2, case when n3 >= depth * 0.15 then n3 else 0 end as n3 from site""",
    "linkage_with_gaps": f"with {ODD_SQL} select region, site, nuc::bigint as nuc, count(*) as n, sum(read_id)::bigint as reads from olink group by all",
    "masked_alleles": f"with {SNP_SQL} select m.region, m.read_id, s.site from m join snp s on s.region = m.region and s.ref_pos = m.ref_pos where m.nuc not in (s.a0, s.a1)",
    "window_support": f"""with {PATTERN_SQL}, {STEP_SQL.split(SNP_SQL + ",")[1]},
wn as (select distinct region, first_site as w1, last_site as w2 from loc),
cut as (select p.region, w1, w2, n, rpad(substr(concat(repeat('-', greatest(first_site - w1, 0)::int), substr(pattern, greatest(w1 - first_site, 0)::int + 1)), 1, (w2 - w1 + 1)::int), (w2 - w1 + 1)::int, '-') as pattern
  from pat p join wn on wn.region = p.region and first_site <= w2 and first_site + length(pattern) - 1 >= w1)
select region, w1 as first_site, w2 as last_site, pattern, sum(n)::bigint as n from cut where translate(pattern, '-', '') <> '' group by all""",
    "delete_steps": f"""with {STEP_SQL} select p.region, row_number() over (partition by p.region order by p.t) - 1 as t, p.start, (last_site - first_site + 1) as n_sites from stp p join loc using (region, t) where p.t % 3 <> 1""",
    "trimmed_windows": f"""with {STEP_SQL}, gone as (select m.region, m.read_id, s.site from m join snp s on s.region = m.region and s.ref_pos = m.ref_pos where m.nuc not in (s.a0, s.a1)),
mine as (select distinct p.region, p.t, g.site from gone g join reads r on r.region = g.region and r.read_id = g.read_id join stp p on p.region = r.region and p.start = r.first_pos),
held as (select l.region, l.t, l.first_site, s.site from loc l join snp s on s.region = l.region and s.site between l.first_site and l.last_site - 1 where s.site % 2 = 1),
brk as (select h.region, h.t, case when a.t is not null then h.site when b.t is not null then h.site + 1 end - h.first_site as pl from held h left join mine a on a.region = h.region and a.t = h.t and a.site = h.site left join mine b on b.region = h.region and b.t = h.t and b.site = h.site + 1),
ord as (select region, t, pl, lead(pl) over w as nxt, count(*) over (partition by region, t) as k, row_number() over w as r from brk where pl is not null window w as (partition by region, t order by pl)),
gap as (select region, t, min(r) as r from ord where nxt - pl > 1 group by all),
one as (select region, t, case when pl = 0 then 1 else 0 end as f, case when pl > 0 then pl - 1 end as l from ord where k = 1
  union all select o.region, o.t, o.pl + 1, o.nxt - 1 from ord o join gap g using (region, t, r) where k > 1)
select l.region, l.t, l.first_site + coalesce(f, 0) as first_site, coalesce(l.first_site + o.l, last_site) as last_site from loc l left join one o using (region, t)""",
    "merge_steps": f"""with {STEP_SQL}, b as (select *, t // 40 as block from loc), fs as (select region, first_site, last_site, min(t) as into_t, min(t) // 40 as into_block from b group by all),
same as (select b.region, b.t, into_t from b join fs using (region, first_site, last_site) where block > into_block),
left_ as (select b.* from b anti join same using (region, t)),
ex as (select region, t, block, unnest(range(first_site, last_site + 1)) as site from left_),
prev as (select region, block + 1 as block, site, max(t) as into_t from ex group by all)
select region, t, into_t as "into" from same union all select region, t, arg_min(into_t, site) as "into" from ex join prev using (region, block, site) group by region, t""",
    "trimmed_alignments": f"""with {SAM_SQL},
o as (select line, 'a' as genome, pos as start, unnest(['H', 'S', 'M', 'I', 'M', 'D', 'M']) as op, unnest([h, s, m1, i, m2, d, 15]) as len, unnest(range(7)) as k from sam
  union all select event_id, 'b', pos + {SHIFT}, unnest(['M', 'D', 'M']), unnest([10 + event_id % 25, event_id % 3 + 1, len - 10 - event_id % 25]), unnest(range(3)) from (select *, line as event_id from sam)),
r as (select *, start + coalesce(sum(case when op in ('M', 'D') then len else 0 end) over (partition by line, genome order by k rows between unbounded preceding and 1 preceding), 0) as rs from o),
e as (select line, max(start) as lo, min(stop) as hi from (select line, genome, any_value(start) as start, max(rs + case when op in ('M', 'D') then len else 0 end) as stop from r group by all) group by line having max(start) < min(stop)),
p as (select r.*, lo, case when op in ('M', 'D') then greatest(0, least(rs + len, hi) - greatest(rs, lo)) when op = 'I' and rs > lo and rs < hi then len else 0 end as kept,
  case when op in ('M', 'D') then least(len, greatest(0, lo - rs)) when rs <= lo then len else 0 end as lead from r join e using (line)),
q as (select *, case when op = 'I' and kept > 0 then 0 else lead end as ahead from p)
select line, genome, any_value(lo)::bigint as start, concat(case when sum(case when op = 'H' then ahead else 0 end) > 0 then sum(case when op = 'H' then ahead else 0 end)::bigint || 'H' else '' end,
  case when sum(case when op in ('M', 'I', 'S') then ahead else 0 end) > 0 then sum(case when op in ('M', 'I', 'S') then ahead else 0 end)::bigint || 'S' else '' end,
  string_agg(kept::bigint || op, '' order by k) filter (kept > 0),
  case when sum(case when op in ('M', 'I', 'S') then len - kept - ahead else 0 end) > 0 then sum(case when op in ('M', 'I', 'S') then len - kept - ahead else 0 end)::bigint || 'S' else '' end) as cigar
from q group by line, genome""",
    "region_parts": f"""with {SAM_SQL} select line, case when line % 9 = 0 then '-' else concat(rname, ':x-', line % 3) end as name, case when line % 9 = 0 then -1 else pos end as start, case when line % 9 = 0 then -1 else pos + len end as stop from sam""",
    "quality_quantiles": f"""with {SITES_SQL},
q as (select region, qua, sum(count(*)) over (partition by region order by qua) as c, sum(count(*)) over (partition by region) as n from m group by region, qua),
s as (select region, ref_pos, sum(count(*)) over (partition by region order by ref_pos) as c from m group by region, ref_pos)
select a.region, a.median, a.high, coalesce(b.until, -1) as until from (select region, min(qua) filter (c >= n * 0.5) as median, min(qua) filter (c >= n * 0.9) as high from q group by region) a
left join (select region, min(ref_pos) as until from s where c >= 4000 group by region) b using (region)""",
    "sequence_checks": f"""with {SAM_SQL} select line, round({ERRORS_SQL}, 6) as expected, round(list_product(list_transform(range(1, length(qual) + 1), lambda k: 1 - pow(10.0::double, -(ascii(substr(qual, k::int, 1)) - 33) / 10.0))), 9) as error_free,
  least(greatest(ascii(substr(qual, 1, 1)) - 33, 20), 35)::bigint as censored, case when line % 4 > 0 then substr(seq, 1, 1) else 'N' end as letter, substr(qual, 2, 1) as mark, concat(rname, ':', pos, '-', pos + m1 + m2 + d + 15) as region, true as valid from sam""",
    "set_equal": """with s as (select o_custkey, list_sort(list(distinct o_orderpriority) filter (where o_orderstatus = 'O')) as o, list_sort(list(distinct o_orderpriority) filter (where o_orderstatus = 'F')) as f from orders group by 1)
select o_custkey, len(o)::bigint as n from s where len(o) > 0 and o = f""",
}
