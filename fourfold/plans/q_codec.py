"""Queries over codecs, range joins, the merge of two genomes and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fourfold.functions import codec
from fourfold.operators import pileup, ranges, targets
from fourfold.plans.views import TETRA_SQL, table, tetra


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null and text <> ''")


def xy_encode(spark, sf_dir):
    """How often each code stands in each whole text."""
    return _texts(spark, sf_dir).select("doc_id", *codec.xy_counts(F.col("text")))


def iupac_decode(spark, sf_dir):
    """Letters of IUPAC in each text, what they may stand for in all, and how many are unambiguous."""
    return _texts(spark, sf_dir).select("doc_id", *codec.iupac_counts(F.col("text")))


def revcomp(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(codec.reverse_complement(F.col("text")).cast("binary")).alias("digest"))


def phred_expected_error(spark, sf_dir):
    """Expected errors of each whole text taken as a quality string, over characters from ! to ~."""
    rows = _texts(spark, sf_dir).select("doc_id", codec.text_errors(F.col("text")).alias("e")).filter("e.n > 0")
    return rows.select("doc_id", F.round("e.expected", 6).alias("expected"), "e.n")


CIGAR = "concat(event_id % 5 + 1, 'S', 20 + event_id % 30, 'M', event_id % 4 + 1, 'I', 10 + event_id % 20, 'M', event_id % 3 + 1, 'D15M')"


def cigar_explode(spark, sf_dir):
    """Operations of each alignment with their places in the genome and in the read."""
    reads = table(spark, sf_dir, "events").selectExpr("event_id", f"{CIGAR} as cigar", "event_id * 7 % 1000 + 1 as pos")
    out = targets.cigar_blocks(reads.withColumn("ops", codec.parse_cigar(F.col("cigar"))), "ops", "pos")
    return out.select("event_id", F.col("op_idx").cast("long").alias("op_idx"), "op", F.col("len").cast("long").alias("len"), F.col("ref_start").cast("long").alias("ref_start"), F.col("read_start").cast("long").alias("read_start"))


def cigar_summary(spark, sf_dir):
    ops = codec.parse_cigar(F.col("cigar"))
    reads = table(spark, sf_dir, "events").selectExpr("event_id", f"{CIGAR} as cigar")
    return reads.select("event_id", codec.reference_length(ops).cast("long").alias("ref_len"), codec.query_length(ops).cast("long").alias("query_len"), codec.longest(ops, "S").cast("long").alias("clip"), codec.longest(ops, "ID").cast("long").alias("indel"))


def region_overlap_join(spark, sf_dir):
    """The first target, in file order, that each read reaches into."""
    reads = pileup.read_summary(tetra(spark, sf_dir)).selectExpr("region", "read_id", "first_pos as rs", "last_pos + 1 as re")
    regions = table(spark, sf_dir, "nation").selectExpr("n_nationkey as target", "n_nationkey * 15 as s", "n_nationkey * 15 + 40 + n_regionkey * 30 as e")
    return targets.first_target(reads, regions, ["region", "read_id"])


def two_genome_merge(spark, sf_dir):
    """Keys of two files with their counts in either; kept: in both, once each."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey % 50 as part", "l_linestatus")
    a, b = (rows.filter(F.col("l_linestatus") == s).select("l_orderkey", "part") for s in ("O", "F"))
    return targets.merge_files(a, b, ["l_orderkey", "part"])


def set_intersect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'O'").select("o_custkey").intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


def set_except(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'O'").select("o_custkey").subtract(o.filter("o_orderstatus = 'F'").select("o_custkey"))


def semi_missing(spark, sf_dir):
    """Customers with orders."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_nationkey")


def anti_missing(spark, sf_dir):
    """Customers without a pending order."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


def poisson_gap_penalty(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("(l_linenumber - 1) % 5 as gaps", "cast(l_quantity as long) + 50 as length").groupBy("gaps", "length").agg(F.count("*").alias("n"))
    return rows.select(F.col("gaps").cast("long").alias("gaps"), "length", "n", F.round(codec.poisson_gap_penalty(F.col("gaps"), F.col("length")), 6).alias("penalty"))


def sub_prob_matrix(spark, sf_dir):
    """Chances and log chances of reading each base as each other, at the qualities that occur."""
    rows = tetra(spark, sf_dir).selectExpr("nuc", "qua", "(nuc + read_pos) % 4 as true_nuc").groupBy("nuc", "qua", "true_nuc").agg(F.count("*").alias("n"))
    p = codec.substitution_probability(F.col("nuc"), F.col("true_nuc"), F.col("qua"))
    lp = codec.substitution_probability(F.col("nuc"), F.col("true_nuc"), F.col("qua"), log=True)
    return rows.select("nuc", "qua", "true_nuc", "n", F.round(p, 9).alias("p"), F.round(lp, 9).alias("lp"))


QUERIES = {f.__name__: f for f in (xy_encode, iupac_decode, revcomp, phred_expected_error, cigar_explode, cigar_summary, region_overlap_join, two_genome_merge, set_intersect, set_except, semi_missing, anti_missing, poisson_gap_penalty, sub_prob_matrix)}

CHARS_SQL = "chars as (select doc_id, unnest(string_split(text, '')) as ch from documents where text is not null and text <> '')"

ORACLES = {
    "xy_encode": f"""with {CHARS_SQL}, c as (select doc_id, case when regexp_full_match(ch, '[ACGTUacgtu]') then (ascii(ch) >> 1) & 3 end as code from chars)
select doc_id, count(*) filter (where code = 0) as n0, count(*) filter (where code = 1) as n1, count(*) filter (where code = 2) as n2, count(*) filter (where code = 3) as n3, count(*) filter (where code is null) as n_other from c group by doc_id""",
    "iupac_decode": f"""with {CHARS_SQL}, t as (select * from (values ('A', 1, 1), ('C', 1, 1), ('G', 1, 1), ('T', 1, 1), ('U', 1, 1), ('M', 2, 0), ('R', 2, 0), ('W', 2, 0), ('S', 2, 0), ('Y', 2, 0), ('K', 2, 0), ('V', 3, 0), ('H', 3, 0), ('D', 3, 0), ('B', 3, 0), ('N', 4, 0), ('X', 4, 0)) v(c, k, plain))
select doc_id, count(k) as n_valid, coalesce(sum(k), 0)::bigint as n_options, coalesce(sum(plain), 0)::bigint as n_plain from chars left join t on t.c = upper(ch) group by doc_id""",
    "revcomp": "select doc_id, md5(reverse(translate(text, 'ACGTUacgtu', 'TGCAAtgcaa'))) as digest from documents where text is not null",
    "phred_expected_error": f"""with {CHARS_SQL}, c as (select doc_id, ch, count(*) as n from chars where ch between '!' and '~' and length(ch) = 1 group by all)
select doc_id, round(sum(n * pow(10.0::double, -(ascii(ch) - 33) / 10.0)), 6) as expected, sum(n)::bigint as n from c group by doc_id""",
    "cigar_explode": f"""with r as (select event_id, regexp_extract_all({CIGAR}, '[0-9]+[MIDNSHP=X]') as ops, event_id * 7 % 1000 + 1 as pos from events),
o as (select event_id, pos, unnest(range(0, len(ops))) as op_idx, unnest(ops) as m from r),
p as (select event_id, pos, op_idx, right(m, 1) as op, left(m, -1)::bigint as len from o)
select event_id, op_idx, op, len, (pos + coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then len else 0 end) over w, 0))::bigint as ref_start, coalesce(sum(case when op in ('M', 'I', 'S', '=', 'X') then len else 0 end) over w, 0)::bigint as read_start
from p window w as (partition by event_id order by op_idx rows between unbounded preceding and 1 preceding)""",
    "cigar_summary": """select event_id, (20 + event_id % 30 + 10 + event_id % 20 + event_id % 3 + 1 + 15)::bigint as ref_len, (event_id % 5 + 1 + 20 + event_id % 30 + event_id % 4 + 1 + 10 + event_id % 20 + 15)::bigint as query_len, (event_id % 5 + 1)::bigint as clip, greatest(event_id % 4 + 1, event_id % 3 + 1)::bigint as indel from events""",
    "region_overlap_join": f"""with {TETRA_SQL}, r as (select region, read_id, min(ref_pos) as rs, max(ref_pos) + 1 as re from tetra group by all),
g as (select n_nationkey as target, n_nationkey * 15 as s, n_nationkey * 15 + 40 + n_regionkey * 30 as e from nation)
select region, read_id, min(target) as target from r join g on case when re - rs < e - s then (rs >= s and re <= e) or (rs < s and re >= s + 1) or (rs + 1 < e and re >= e) else s >= rs and e <= re end group by all""",
    "two_genome_merge": """with r as (select l_orderkey, l_partkey % 50 as part, l_linestatus from lineitem where l_linestatus in ('O', 'F'))
select l_orderkey, part, count(*) filter (where l_linestatus = 'O') as n_a, count(*) filter (where l_linestatus = 'F') as n_b, count(*) filter (where l_linestatus = 'O') = 1 and count(*) filter (where l_linestatus = 'F') = 1 as kept from r group by all""",
    "set_intersect": "select o_custkey from orders where o_orderstatus = 'O' intersect select o_custkey from orders where o_orderstatus = 'F'",
    "set_except": "select o_custkey from orders where o_orderstatus = 'O' except select o_custkey from orders where o_orderstatus = 'F'",
    "semi_missing": "select c_custkey, c_nationkey from customer where exists (select 1 from orders where o_custkey = c_custkey)",
    "anti_missing": "select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
    "poisson_gap_penalty": """with r as (select (l_linenumber - 1) % 5 as gaps, l_quantity::bigint + 50 as length, count(*) as n from lineitem group by all)
select gaps::bigint as gaps, length, n, round(case when gaps > 0 then gaps * ln(1e-5::double * length) - 1e-5::double * length - ln(factorial(gaps::int)::double) else 0.0 end, 6) as penalty from r""",
    "sub_prob_matrix": f"""with {TETRA_SQL}, r as (select nuc, qua, (nuc + read_pos) % 4 as true_nuc, count(*) as n from tetra group by all), e as (select *, pow(10.0::double, -qua / 10.0) as e from r)
select nuc, qua, true_nuc, n, round(case when nuc = true_nuc then 1 - e else e / 3 end, 9) as p, round(case when nuc = true_nuc then ln(1 - e) else -qua / 10.0 * ln(10.0::double) - ln(3.0::double) end, 9) as lp from e""",
}
