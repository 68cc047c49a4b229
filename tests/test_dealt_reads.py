"""Reads meet packed haplotypes before they are spread into bases."""

import re

import pytest
from pyspark.sql import functions as F

from fourfold.operators import emission
from fourfold.plans import q_model
from fourfold.plans.views import spread, tetra_reads


def dealt(df):
    """What the plan deals: the text below each exchange, as far as it is not summed up first."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for k, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            until = next((i for i in range(k + 1, len(lines)) if depth[i] <= depth[k]), len(lines))
            out.append("\n".join(lines[k:until]).split("Aggregate")[0])
    return out


@pytest.mark.parametrize("name", ["read_loglik", "responsibility", "mixture_update"])
def test_single_bases_are_not_dealt(spark, sf_dir, name, monkeypatch):
    """With haplotypes of too many sites for every task, all bases were dealt by site: the disk was full at 6 GB."""
    monkeypatch.setattr(emission, "BROADCAST_SITES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = dealt(q_model.QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert parts and not any(re.search(r"Generate explode.*\[j#|Scan ExistingRDD\[region#\w+,read_id#\w+,read_pos#", x) for x in parts)


def test_observations_of_reads(spark, sf_dir):
    """The same as of bases, where sites lack, haplotypes have gaps (-1) or are not known."""
    reads = tetra_reads(spark, sf_dir).filter("read_id < 60")
    bases = spread(reads)
    haps = emission.consensus(bases).filter("ref_pos % 7 > 0").withColumn("h0", F.expr("if(ref_pos % 11 = 0, -1, h0)")).withColumn("h1", F.expr("if(ref_pos % 5 = 0, -1, h1)")).withColumn("h2", F.expr("if(ref_pos % 3 = 0, null, h2)"))
    want = emission.observations(bases, haps)
    got = emission.observations_of_reads(reads, haps, F.col("st"), F.col("st") + 99, spread)
    assert set(got.columns) == set(want.columns)
    columns = sorted(want.columns)
    rows = [sorted(map(str, df.select(*columns).collect())) for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 1000
