"""Bases that come from an explode look small to Spark: what goes to every task is settled by the number of sites."""

import re

import pytest

from fourfold.operators import emission, keep, linkage
from fourfold.plans import phase, q_align, q_phase


def sent(df):
    """What the plan sends to every task: the text of each part below a broadcast."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            until = next((i for i in range(k + 1, len(lines)) if depth[i] <= depth[k]), len(lines))
            out.append("\n".join(lines[k:until]))
    return out


def of_bases(part):
    """Whether single bases are in it, not yet summed up: made by the explode of a read, or read from a checkpoint."""
    return bool(re.search(r"Generate explode.*\[j#|Scan ExistingRDD\[region#\w+,read_id#\w+,read_pos#", part.split("Aggregate")[0]))


def test_masked_sends_sites_only(spark, sf_dir, monkeypatch):
    bases, _, snps = q_align._parts(spark, sf_dir)
    few = linkage.masked(bases, snps)
    assert of_bases(few._jdf.queryExecution().executedPlan().toString())
    assert [of_bases(x) for x in sent(few)] == [False]
    monkeypatch.setattr(linkage, "BROADCAST_SITES", 0)
    many = linkage.masked(bases, snps)
    assert sent(many) == []
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


@pytest.mark.parametrize("name", ["masked_alleles", "trimmed_windows"])
def test_queries_send_no_bases(spark, sf_dir, name):
    assert not any(map(of_bases, sent(q_align.QUERIES[name](spark, sf_dir))))


class Enough(Exception):
    """All joins of single bases are done."""


@pytest.mark.parametrize("name", ["baum_welch_fit", "phase_haplotypes"])
def test_phasing_sends_no_bases(spark, sf_dir, name, monkeypatch):
    """Whatever phasing writes out until it begins to learn."""
    parts, plain = [], keep.cut

    def noted(df):
        parts.extend(sent(df))
        return plain(df)

    def learn(*_):
        raise Enough

    for module in (phase, linkage, emission):
        monkeypatch.setattr(module, "cut", noted)
    monkeypatch.setattr(phase, "_learn", learn)
    with pytest.raises(Enough):
        q_phase.QUERIES[name](spark, sf_dir)
    assert parts and not any(map(of_bases, parts))
